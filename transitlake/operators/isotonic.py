"""Isotonic regression of any number of points.

Pooling adjacent violators may be done in parts: blocks that were pooled inside a range of
scores stay pooled, so pooling the blocks of neighbouring ranges gives what one pass over all
points would. Equal scores are merged first, ranges are pooled in parallel, and their blocks
are merged up a tree of ranges. What is left over is the fitted step function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.operators.ranks import RANGES, range_count, with_ranges

#: ranges whose blocks one task merges, and the most steps that a model may have
FAN_IN, MOST_STEPS = 64, 1_000_000
BLOCK = "low double, high double, w double, wy double"


def pooled(low: np.ndarray, high: np.ndarray, w: np.ndarray, wy: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (lowest and highest score, weight, weighted sum) of rising means, from blocks in
    the order of their scores."""
    out: list[tuple[float, float, float, float]] = []
    for a, b, n, s in zip(low.tolist(), high.tolist(), w.tolist(), wy.tolist()):
        while out and out[-1][3] * n >= s * out[-1][2]:
            first, _, m, t = out.pop()
            a, n, s = first, n + m, s + t
        out.append((a, b, n, s))
    return out


@dataclass
class Isotonic:
    """Linear between ``scores``, which rise, and level beyond them."""

    scores: list[float]
    values: list[float]

    def predict(self, score: Column) -> Column:
        xs, ys = self.scores, self.values

        @F.pandas_udf("double")
        def between(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for given in batches:
                yield pd.Series(np.interp(given.to_numpy(), xs, ys) if xs else np.full(len(given), np.nan))

        return between(score)

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @staticmethod
    def from_json(text: str) -> Isotonic:
        return Isotonic(**json.loads(text))


def blocks(df: DataFrame, score: str, y: str, weight: str | None = None) -> DataFrame:
    """``low, high, w, wy``: the blocks of the whole fit. Rows without a score or a ``y``, and
    rows of weight 0, take no part."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = df.select(F.col(score).cast("double").alias("low"), F.col(y).cast("double").alias("y"), w.alias("w"))
    points = points.where(F.col("low").isNotNull() & ~F.isnan("low") & F.col("y").isNotNull() & (F.col("w") > 0))
    # equal scores are one point: merged map-side, so a hot score is one row a task
    merged = points.groupBy("low").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    ranges = range_count(df)
    held = with_ranges(merged, "low", ranges).select(RANGES, "low", F.col("low").alias("high"), "w", "wy")
    schema = f"{RANGES} int, {BLOCK}"

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        found = pooled(*(frame[c].to_numpy() for c in ("low", "high", "w", "wy")))
        out = pd.DataFrame(found, columns=["low", "high", "w", "wy"])
        out.insert(0, RANGES, int(frame[RANGES].iloc[0]))
        return out

    while True:
        held = held.groupBy(RANGES).applyInPandas(pool, schema)
        if ranges == 1:
            return held.drop(RANGES)
        ranges = -(-ranges // FAN_IN)
        held = held.withColumn(RANGES, F.floor(F.col(RANGES) / FAN_IN).cast("int"))


def fit(df: DataFrame, score: str, y: str, weight: str | None = None) -> Isotonic:
    """The fitted step function as a model: each block's mean from its lowest to its highest
    score. 0/1 labels of n rows have some n^(1/3) blocks; more than ``MOST_STEPS`` are an error."""
    found = blocks(df, score, y, weight).limit(MOST_STEPS + 1).toPandas().sort_values("low")
    if len(found) > MOST_STEPS:
        raise ValueError(f"the fit has more than {MOST_STEPS} steps")
    mean = (found["wy"] / found["w"]).tolist()
    xs, ys = [], []
    for a, b, v in zip(found["low"].tolist(), found["high"].tolist(), mean):
        xs += [a] if a == b else [a, b]
        ys += [v] if a == b else [v, v]
    return Isotonic(xs, ys)
