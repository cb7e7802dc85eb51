"""Gradient boosted trees on binned features, with monotone limits and exact attributions.

Each round grows one tree per class on softmax gradients, a level at a time. For a level the
tasks add up gradient histograms per (node, feature, bin); the histograms of a node meet in
one task, which finds its best split, and one row per node reaches the driver. What moves has
the size of nodes x features x bins, never of the rows, and what the driver sees of a level
stays below ``GATHERED`` bytes, however many tasks there are.

A monotone limit is kept the way bounds are handed down: a split on a limited feature must
order its two values, and what lies below each side stays on its side of their middle. With
the limit on one class and its opposite on the others, that class's probability itself is
monotone in the feature, for every row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.session import cut_lineage

CLASSES = len(S.CLASS_IDS)
#: sketch accuracy of the bin bounds, and bytes of a level's histograms that may meet on the driver
ACCURACY, GATHERED = 10_000, 256 << 10
STATE = "x binary, y int, w double, h long, m binary"
SPLIT = "key int, feature int, bin int, gain double, gl double, hl double, gr double, hr double, vl double, vr double"


@dataclass
class Tree:
    """Parallel lists: ``feature`` (-1: leaf), ``bin`` (rows up to it go left), ``left`` (right
    is the next one), ``value``, ``cover`` (summed curvature of the training rows)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, gain: float, sides: list[tuple[float, float]]) -> int:
        """Give ``node`` two children of (value, cover); the left one's number."""
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, bin, at, gain
        for value, cover in sides:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.value.append(value)
            self.cover.append(cover)
            self.gain.append(0.0)
        return at

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        feature, bound, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            right = x[every, np.maximum(feature[at], 0)] > bound[at]
            at = np.where(inner, left[at] + right, at)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BoostedTrees:
    """``edges[f]``: rising bin bounds of feature f, a value's bin is the number of bounds
    below it. ``rounds[r][c]``: the tree of class c."""

    edges: list[list[float]]
    base: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8)
        for f, bounds in enumerate(self.edges):
            out[:, f] = np.searchsorted(bounds, values[:, f], "left")
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += np.array(tree.value)[tree.leaves_of(x)]
        return out

    def probabilities(self, vector: str) -> Column:
        """The class probabilities of a vector column as an array."""
        model = self

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                if len(values):
                    yield pd.Series(list(softmax(model.margins(model.binned(np.stack(values.to_numpy()))))))
                else:
                    yield pd.Series([], dtype=object)

        return score(vector_to_array(F.col(vector)))

    def attributions(self, vector: str, of_class: Column) -> Column:
        """Exact Shapley values of a row's margin of class ``of_class``, one per feature, then
        the margin's base value: they add up to the margin."""
        model = self

        @F.pandas_udf("array<double>")
        def explain(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            tables = [leaf_tables(model, c) for c in range(CLASSES)]
            for values, classes in batches:
                out = np.zeros((len(values), len(model.edges) + 1))
                if len(values):
                    x, wanted = model.binned(np.stack(values.to_numpy())), classes.to_numpy()
                    for c in range(CLASSES):
                        mine = wanted == c
                        out[mine] = shapley(tables[c], x[mine], model.base[c])
                yield pd.Series(list(out))

        return explain(vector_to_array(F.col(vector)), of_class.cast("int"))

    def against(self, vector: str, limits: list[tuple[int, int]]) -> Column:
        """For each (feature, sign) the steps between neighbouring bins of that feature, the
        row's others unchanged, at which the last class's probability moves the other way."""
        model = self

        @F.pandas_udf("array<int>")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                out = np.zeros((len(values), len(limits)), np.int32)
                if len(values):
                    x = model.binned(np.stack(values.to_numpy()))
                    for j, (f, sign) in enumerate(limits):
                        before = None
                        for b in range(len(model.edges[f]) + 1):
                            x_moved = x.copy()
                            x_moved[:, f] = b
                            p = softmax(model.margins(x_moved))[:, -1]
                            if before is not None:
                                out[:, j] += sign * (p - before) < -1e-12
                            before = p
                yield pd.Series(list(out))

        return count(vector_to_array(F.col(vector)))

    def importances(self) -> np.ndarray:
        """Share of each feature in the summed gains."""
        total = np.zeros(len(self.edges))
        for trees in self.rounds:
            for tree in trees:
                for f, gain in zip(tree.feature, tree.gain):
                    if f >= 0:
                        total[f] += gain
        return total / total.sum() if total.any() else total

    def to_json(self) -> str:
        return json.dumps({"edges": self.edges, "base": self.base, "rounds": [[vars(t) for t in trees] for trees in self.rounds]})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        held = json.loads(text)
        return BoostedTrees(held["edges"], held["base"], [[Tree(**t) for t in trees] for trees in held["rounds"]])


# ------------------------------------------------------------ attributions --
@lru_cache(maxsize=None)
def coalition_weights(d: int) -> np.ndarray:
    """(2^d, d): what the value of each coalition of d players counts for each player."""
    out = np.zeros((1 << d, d))
    for s in range(1 << d):
        size = s.bit_count()
        for j in range(d):
            if s >> j & 1:
                out[s, j] = math.factorial(size - 1) * math.factorial(d - size) / math.factorial(d)
            else:
                out[s, j] = -math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
    return out


def leaf_tables(model: BoostedTrees, c: int) -> list[tuple]:
    """Per leaf of class ``c``: features of its path, their bin ranges, the Shapley values for
    each pattern of ranges held, and the leaf's part of the base value.

    A coalition that lacks a feature follows both sides of its splits in proportion to their
    training rows, so a coalition's value is the leaf's times a product over features."""
    out = []
    for trees in model.rounds:
        tree = trees[c]
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            f = tree.feature[node]
            if f >= 0:
                for side in (0, 1):
                    child = tree.left[node] + side
                    low, high, share = path.get(f, (-1, 255, 1.0))
                    held = (max(low, tree.bin[node]), high) if side else (low, min(high, tree.bin[node]))
                    below = tree.cover[tree.left[node]] + tree.cover[tree.left[node] + 1]
                    todo.append((child, {**path, f: (*held, share * tree.cover[child] / below)}))
                continue
            features = list(path)
            d = len(features)
            value = np.full((1 << d, 1 << d), tree.value[node])
            bits = np.arange(1 << d)
            for j, name in enumerate(features):
                holds, asked = (bits >> j & 1)[:, None], (bits >> j & 1)[None, :]
                value *= np.where(asked == 1, holds, path[name][2])
            out.append((features, [path[f][0] for f in features], [path[f][1] for f in features], value @ coalition_weights(d), value[0, 0]))
    return out


def shapley(tables: list[tuple], x: np.ndarray, base: float) -> np.ndarray:
    """Rows of attributions and, last, the base value."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, -1] = base
    for features, low, high, values, expected in tables:
        out[:, -1] += expected
        pattern = np.zeros(len(x), np.int64)
        for j, f in enumerate(features):
            pattern |= ((x[:, f].astype(np.int64) > low[j]) & (x[:, f] <= high[j])).astype(np.int64) << j
        for j, f in enumerate(features):
            out[:, f] += values[pattern, j]
    return out


# ------------------------------------------------------------------ training --
def bin_bounds(df: DataFrame, vector: str, width: int, bins: int) -> list[list[float]]:
    """Quantiles of every feature from one mergeable sketch each, in one pass."""
    shares = [i / bins for i in range(1, bins)]
    cells = df.select(F.posexplode(vector_to_array(F.col(vector))).alias("f", "v")).where(~F.isnan("v"))
    # one group per feature, its sketch merged map-side: no task sees a feature's values whole
    found = cells.groupBy("f").agg(F.percentile_approx("v", shares, max(ACCURACY, 4 * bins)).alias("bounds"))
    bounds = {r["f"]: sorted(set(r["bounds"] or [])) for r in found.collect()}
    return [bounds.get(f, []) for f in range(width)]


def _state(batch: pa.RecordBatch, width: int) -> tuple:
    x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    margins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(-1, CLASSES)
    return x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), margins


def _advanced(margins: np.ndarray, x: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    out = margins.copy()
    for of_round in trees:
        for c, tree in enumerate(of_round):
            out[:, c] += np.array(tree.value)[tree.leaves_of(x)]
    return out


def drawn(h: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Rows of a round: a multiplicative hash of the row's own hash and the round."""
    mixed = (h.astype(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def histograms(state: DataFrame, width: int, bins: int, recent: list, growing: list[Tree], open_nodes: dict, turn: int, share: float) -> DataFrame:
    """``key, part, hist``: per task and open node, the summed gradients and curvatures per
    (feature, bin). ``open_nodes``: (class, node) -> key."""
    size = width * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        columns = np.arange(width) * bins
        for batch in batches:
            x, y, w, h, margins = _state(batch, width)
            used = drawn(h, turn, share) if share < 1 else np.ones(len(y), bool)
            x, y, w = x[used], y[used], w[used]
            if not len(y):
                continue
            p = softmax(_advanced(margins[used], x, recent))
            flat = x.astype(np.int64) + columns
            for c, tree in enumerate(growing):
                nodes = tree.leaves_of(x)
                g, curve = w * (p[:, c] - (y == c)), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-16)
                for node in np.unique(nodes):
                    key = open_nodes.get((c, int(node)))
                    if key is None:
                        continue
                    mine = nodes == node
                    at = flat[mine].ravel()
                    held = np.stack([np.bincount(at, np.repeat(v[mine], width), size) for v in (g, curve)])
                    total[key] = total[key] + held if key in total else held
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
            names=["key", "part", "hist"],
        )

    return state.mapInArrow(run, "key int, part int, hist binary")


def best_splits(parts: DataFrame, width: int, bins: int, bounds: dict, signs: dict, settings: dict, tasks: int) -> list:
    """The best allowed split of each node. Histograms of a node meet by its key and are added
    in the order of their tasks, so that reruns agree. They meet on the driver while ``tasks``
    times their size stays within ``settings["gathered"]`` bytes, else in tasks; the splits
    are the same."""
    penalty, least = settings["penalty"], settings["least_cover"]
    if tasks * len(bounds) * width * bins * 16 <= settings["gathered"]:
        met: dict[int, np.ndarray] = {}
        for r in sorted(parts.collect(), key=lambda r: (r["key"], r["part"])):
            held = np.frombuffer(r["hist"], np.float64)
            met[r["key"]] = met[r["key"]] + held if r["key"] in met else held
        names = [c.split()[0] for c in SPLIT.split(", ")]
        splits = {k: one_split(h.reshape(2, width, bins), *bounds[k], signs[k], penalty, least) for k, h in met.items()}
        return [dict(zip(names, (k, *s))) for k, s in splits.items() if s is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, hist in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                held = np.frombuffer(hist, np.float64)
                total[key] = total[key] + held if key in total else held
        rows = []
        for key, held in total.items():
            split = one_split(held.reshape(2, width, bins), *bounds[key], signs[key], penalty, least)
            if split is not None:
                rows.append((key, *split))
        columns = list(zip(*rows)) if rows else [[]] * 10
        kinds = [pa.int32()] * 3 + [pa.float64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SPLIT.split(", ")])

    # as many tasks as there are nodes at most: a node is one task's work
    tasks = max(1, min(len(bounds), parts.sparkSession.sparkContext.defaultParallelism))
    met = parts.repartition(tasks, "key").sortWithinPartitions("key", "part")
    return met.mapInArrow(run, SPLIT).collect()


def one_split(hist: np.ndarray, low: float, high: float, sign: np.ndarray, penalty: float, least: float):
    """Feature, bin, gain and both sides' sums and values of the best split, or None. Values
    stay within (low, high); ``sign`` per feature: 1 rising, -1 falling, 0 free."""
    g, h = hist[0, 0].sum(), hist[1, 0].sum()
    gl, hl = hist[0].cumsum(axis=1)[:, :-1], hist[1].cumsum(axis=1)[:, :-1]
    gr, hr = g - gl, h - hl
    value = lambda a, b: np.clip(-a / (b + penalty), low, high)
    score = lambda a, b, v: -(2 * a * v + (b + penalty) * v * v)
    vl, vr = value(gl, hl), value(gr, hr)
    gain = score(gl, hl, vl) + score(gr, hr, vr) - score(g, h, value(g, h))
    ordered = sign[:, None] * (vr - vl) >= 0
    gain = np.where((hl >= least) & (hr >= least) & ordered, gain, -np.inf)
    best = int(gain.argmax())
    f, b = divmod(best, gain.shape[1])
    if not gain[f, b] > 1e-12:
        return None
    return f, b, *(float(a[f, b]) for a in (gain, gl, hl, gr, hr, vl, vr))


def refreshed(state: DataFrame, width: int, recent: list) -> DataFrame:
    """The state with the margins of the recent rounds added, in the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _, _, margins = _state(batch, width)
            moved = _advanced(margins, x, recent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m.tobytes() for m in moved], pa.binary())], names=batch.schema.names)

    return cut_lineage(state.mapInArrow(run, STATE))


def feature_names(df: DataFrame, vector: str) -> list[str]:
    """Names of a vector's entries as its assembler left them."""
    attributes = df.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    named = sorted((a["idx"], a["name"]) for group in attributes.values() for a in group)
    return [name for _, name in named]


def fit(
    df: DataFrame, vector: str, y: str, weight: str | None = None, trends: dict[str, int] | None = None,
    rounds: int = 40, depth: int = 4, rate: float = 0.15, bins: int = 32, share: float = 0.8,
    penalty: float = 1.0, least_cover: float = 1.0, refresh: int = 8, gathered: int = GATHERED,
) -> BoostedTrees:
    """Boosted trees on rows with a feature vector and a class ``y`` (rows without are left
    out); all rows take part, ``share`` of them per round.

    ``trends``: feature name -> sign that the last class's probability must follow. Margins
    are stored every ``refresh`` rounds, so that a pass applies few trees; a lost executor
    costs a re-read of that table. ``bins`` is at most 256.
    """
    known = df.where(F.col(y).isNotNull())
    first = known.select(vector).first()
    if first is None:
        return BoostedTrees([], [0.0] * CLASSES)
    width = len(first[0])
    names = feature_names(df, vector)
    signs = np.array([(trends or {}).get(n, 0) for n in (names or [""] * width)])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    shares = {r["y"]: r["w"] for r in known.groupBy(F.col(y).cast("int").alias("y")).agg(F.sum(w).alias("w")).collect()}
    whole = sum(shares.values()) or 1.0
    model = BoostedTrees(bin_bounds(known, vector, width, bins), [math.log(max(shares.get(c, 0.0) / whole, 1e-6)) for c in S.CLASS_IDS])
    start = np.array(model.base).tobytes()

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = model.binned(batch.column(0).flatten().to_numpy().reshape(n, width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[1:], pa.array([start] * n, pa.binary())], names=["x", "y", "w", "h", "m"]
                )

    values = vector_to_array(F.col(vector))
    narrow = known.select(values.alias("v"), F.col(y).cast("int").alias("y"), w.alias("w"), F.xxhash64(values).alias("h"))
    state, recent = cut_lineage(narrow.mapInArrow(prepared, STATE)), []
    settings = {"penalty": penalty, "least_cover": least_cover, "gathered": gathered}
    tasks = state.rdd.getNumPartitions()
    of_class = {c: signs if c == CLASSES - 1 else -signs for c in range(CLASSES)}
    for turn in range(rounds):
        trees = [Tree() for _ in range(CLASSES)]
        limits = {(c, 0): (-math.inf, math.inf) for c in range(CLASSES)}
        for _ in range(depth):
            if not limits:
                break
            keys = {node: key for key, node in enumerate(limits)}
            bounds = {keys[n]: limits[n] for n in limits}
            parts = histograms(state, width, bins, recent, trees, keys, turn, share)
            found = {r["key"]: r for r in best_splits(parts, width, bins, bounds, {keys[n]: of_class[n[0]] for n in limits}, settings, tasks)}
            below = {}
            for (c, node), key in keys.items():
                if key not in found:
                    continue
                r, (low, high) = found[key], limits[c, node]
                at = trees[c].split(node, r["feature"], r["bin"], r["gain"], [(r["vl"], r["hl"]), (r["vr"], r["hr"])])
                middle, sign = (r["vl"] + r["vr"]) / 2, of_class[c][r["feature"]]
                below[c, at] = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
                below[c, at + 1] = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
            limits = below
        for tree in trees:
            tree.value = [rate * v for v in tree.value]
        model.rounds.append(trees)
        recent.append(trees)
        if len(recent) == refresh and turn + 1 < rounds:
            state, recent = refreshed(state, width, recent), []
    return model
