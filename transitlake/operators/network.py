"""A feed-forward classifier with focal loss, trained on all executors.

The loss and its slope are sums over rows: every task adds up its rows with the present
weights, partial sums meet in levels of tasks, and the driver takes the next step. What
moves per step has the size of the network, never of the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.operators.boosting import CLASSES, softmax
from transitlake.operators.descent import minimised
from transitlake.session import cut_lineage

#: partial sums that one task adds up, and that the driver does
FAN_IN, AT_LAST = 64, 2


@dataclass
class Network:
    """``layers``: widths from input to classes; ``point``: all weights in one array; inputs
    are standardised by ``mean`` and ``spread``."""

    layers: list[int]
    mean: list[float]
    spread: list[float]
    point: list[float]

    def probabilities(self, vector: str) -> Column:
        model = self

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = unpacked(np.array(model.point), model.layers)
            for values in batches:
                if len(values):
                    x = standardised(np.stack(values.to_numpy()), model.mean, model.spread)
                    yield pd.Series(list(softmax(forward(x, weights)[-1])))
                else:
                    yield pd.Series([], dtype=object)

        return score(vector_to_array(F.col(vector)))

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @staticmethod
    def from_json(text: str) -> Network:
        return Network(**json.loads(text))


def standardised(x: np.ndarray, mean: list[float], spread: list[float]) -> np.ndarray:
    return np.clip((np.nan_to_num(x, nan=0.0) - np.array(mean)) / np.array(spread), -10, 10)


def unpacked(point: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((point[at : at + a * b].reshape(a, b), point[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, weights: list) -> list[np.ndarray]:
    """The input and every layer's output; the last one is not squashed."""
    out = [x]
    for i, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        out.append(z if i + 1 == len(weights) else np.tanh(z))
    return out


def focal(x: np.ndarray, y: np.ndarray, w: np.ndarray, point: np.ndarray, layers: list[int], gamma: float) -> np.ndarray:
    """Summed focal loss ``w (1 - p)^gamma * -log p`` of the true classes, then its slope."""
    weights = unpacked(point, layers)
    outputs = forward(x, weights)
    p = softmax(outputs[-1])
    every = np.arange(len(y))
    true = np.clip(p[every, y], 1e-12, 1.0)
    off = 1.0 - true
    loss = float((w * off**gamma * -np.log(true)).sum())
    pull = w * (gamma * off ** max(gamma - 1, 0) * true * np.log(true) - off**gamma) if gamma else -w
    one = np.zeros_like(p)
    one[every, y] = 1.0
    delta = pull[:, None] * (one - p)
    slopes = []
    for i in range(len(weights) - 1, -1, -1):
        slopes.append(np.concatenate([(outputs[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ weights[i][0].T) * (1 - outputs[i] ** 2)
    return np.concatenate([[loss], *reversed(slopes)])


def added(parts: DataFrame, partitions: int) -> np.ndarray:
    """The sum of the rows' arrays; partial sums meet in tasks, ``FAN_IN`` at a time, until
    ``AT_LAST`` are left for the driver. Sums run in the order of ``part``, so that reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = np.frombuffer(raw, np.float64)
                total, part = (held, number) if total is None else (total + held, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "held"])

    while partitions > AT_LAST:
        partitions = math.ceil(partitions / FAN_IN)
        parts = parts.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(run, "part int, held binary")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    return sum((np.frombuffer(r["held"], np.float64) for r in rows[1:]), np.frombuffer(rows[0]["held"], np.float64)) if rows else np.zeros(1)


def fit(
    df: DataFrame, vector: str, y: str, weight: str | None = None, hidden: tuple[int, ...] = (96, 32), gamma: float = 2.0,
    rounds: int = 60, penalty: float = 1e-4, seed: int = 42,
) -> Network:
    """Train on rows with a feature vector and a class; weights are scaled to mean 1.

    The narrow training table is written once and kept in the executors' memory while it
    fits; every step reads it once.
    """
    known = df.where(F.col(y).isNotNull())
    first = known.select(vector).first()
    width = len(first[0]) if first is not None else 0
    layers = [width, *hidden, CLASSES]
    if first is None:
        return Network(layers, [], [], [0.0] * sum(a * b + b for a, b in zip(layers, layers[1:])))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ready = cut_lineage(known.select(vector_to_array(F.col(vector)).alias("x"), F.col(y).cast("int").alias("y"), w.alias("w")))
    ready = ready.persist()
    cells = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    row = ready.agg(
        F.count("*"), F.sum("w"), *[F.coalesce(F.avg(c), F.lit(0.0)) for c in cells], *[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in cells]
    ).first()
    n, whole, mean, spread = row[0], row[1], list(row[2 : 2 + width]), [s if s > 1e-9 else 1.0 for s in row[2 + width :]]
    partitions = ready.rdd.getNumPartitions()

    def ask(point: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                if batch.num_rows:
                    x = standardised(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width), mean, spread)
                    held = focal(x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), point, layers, gamma)
                    total = held if total is None else total + held
            if total is not None:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "held"])

        total = added(ready.mapInArrow(run, "part int, held binary"), partitions) / whole
        return float(total[0]) + 0.5 * penalty * float(point @ point), total[1:] + penalty * point

    rng = np.random.default_rng(seed)
    start = np.concatenate(
        [np.concatenate([rng.normal(0, 1 / math.sqrt(a), a * b), np.zeros(b)]) for a, b in zip(layers, layers[1:])]
    )
    point = minimised(ask, start, rounds, settled=1e-6) if n and whole else start
    ready.unpersist()
    return Network(layers, mean, spread, point.tolist())
