"""Boosted trees, their limits and attributions, the network, and isotonic fits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import boosting, explain, isotonic, network
from transitlake.operators.learners import Learner, assemble

NAMES = ["depth_snr", "impact", "c", "d"]
TRENDS = {"depth_snr": 1, "impact": -1}


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    margins = np.stack([-2 * x[:, 0] + x[:, 2], np.sin(2 * x[:, 2]) + x[:, 1] / 2, 2 * x[:, 0] - x[:, 1] + 0.3 * x[:, 0] * x[:, 3]], 1)
    return x, (margins + rng.gumbel(size=(n, 3))).argmax(axis=1)


@pytest.fixture(scope="module")
def table(spark):
    x, y = sample(3000)
    rows = [(i, *map(float, x[i]), int(y[i]), 1.0) for i in range(len(x))]
    return assemble(spark.createDataFrame(rows, "row_id long, depth_snr double, impact double, c double, d double, y int, w double"), NAMES)


@pytest.fixture(scope="module")
def trees(table):
    return boosting.fit(table.where("row_id < 2000"), "features", "y", trends=TRENDS, rounds=12, depth=3, refresh=5)


def accuracy(p, y):
    return (p.argmax(axis=1) == y).mean()


def test_limits_hold_on_every_row(trees):
    x, _ = sample(3000)
    for f, sign in ((0, 1), (1, -1)):
        grid = np.linspace(-4, 4, 81)
        moved = np.repeat(x[2000:2200], len(grid), axis=0)
        moved[:, f] = np.tile(grid, 200)
        p = boosting.softmax(trees.margins(trees.binned(moved)))[:, 2].reshape(200, len(grid))
        assert (sign * np.diff(p, axis=1) >= -1e-12).all() and np.abs(np.diff(p, axis=1)).max() > 0.01


def test_as_good_as_one_against_the_rest(table, trees):
    x, y = sample(3000)
    mine = accuracy(boosting.softmax(trees.margins(trees.binned(x[2000:]))), y[2000:])
    other = Learner("one_vs_rest", {"maxIter": 12, "maxDepth": 3}).fit(table.where("row_id < 2000"))
    p = other.predict(table.where("row_id >= 2000")).orderBy("row_id").select("p_fp", "p_cand", "p_conf").toPandas().to_numpy()
    assert mine > 0.65 and mine >= accuracy(p, y[2000:]) - 0.02


def test_histograms_find_the_split_that_brute_force_finds():
    rng = np.random.default_rng(3)
    x, g, h = rng.integers(0, 8, size=(200, 3)), rng.normal(size=200), rng.uniform(0.5, 1, 200)
    hist = np.zeros((2, 3, 8))
    for f in range(3):
        hist[0, f], hist[1, f] = np.bincount(x[:, f], g, 8), np.bincount(x[:, f], h, 8)
    found = boosting.one_split(hist, -math.inf, math.inf, np.array([0, 1, -1]), 1.0, 1.0)
    best = None
    for f, b in itertools.product(range(3), range(7)):
        left = x[:, f] <= b
        a, c, d, e = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
        if min(c, e) < 1 or (0, 1, -1)[f] * (-d / (e + 1) + a / (c + 1)) < 0:
            continue
        gain = a * a / (c + 1) + d * d / (e + 1) - (a + d) ** 2 / (c + e + 1)
        if best is None or gain > best[0] + 1e-12:
            best = gain, f, b
    assert (found[0], found[1]) == best[1:] and math.isclose(found[2], best[0])


def conditional(tree, node, row, known):
    """The tree's value where features outside ``known`` follow both sides by cover."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left = tree.left[node]
    if f in known:
        return conditional(tree, left + (row[f] > tree.bin[node]), row, known)
    a, b = tree.cover[left], tree.cover[left + 1]
    return (a * conditional(tree, left, row, known) + b * conditional(tree, left + 1, row, known)) / (a + b)


def test_attributions_are_shapley_values(table, trees):
    few = table.where("row_id < 25")
    got = explain.with_shapley(few, trees, F.lit(2)).orderBy("row_id").collect()
    x, _ = sample(3000)
    bins = trees.binned(x[:25])
    margins = trees.margins(bins)
    for r, row, margin in zip(got, bins, margins[:, 2]):
        assert math.isclose(sum(r.shap_values) + r.shap_base, margin, abs_tol=1e-9)
        worth = {
            s: sum(conditional(of_round[2], 0, row, s) for of_round in trees.rounds)
            for k in range(5) for s in map(frozenset, itertools.combinations(range(4), k))
        }
        for f in range(4):
            value = 0.0
            for s in (s for s in worth if f not in s):
                share = math.factorial(len(s)) * math.factorial(3 - len(s)) / math.factorial(4)
                value += share * (worth[s | {f}] - worth[s])
            assert math.isclose(r.shap_values[f], value, abs_tol=1e-9)
    long = explain.per_feature(explain.with_shapley(few, trees, F.lit(2)), NAMES)
    assert long.count() == 25 * 4 and explain.global_attribution(long).count() == 4
    best = explain.with_shapley(few, trees, F.lit(2)).select(explain.strongest(NAMES, k=2).alias("top")).first()["top"]
    sizes = sorted((abs(v) for v in got[0].shap_values), reverse=True)
    assert len(best) == 2 and [abs(t["shap"]) for t in best] == sizes[:2]
    plan = explain.with_shapley(few, trees, F.lit(2)).select(explain.strongest(NAMES))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_same_model_from_other_partitions(table, trees):
    again = boosting.fit(table.where("row_id < 2000").repartition(3), "features", "y", trends=TRENDS, rounds=3, depth=3, refresh=5)
    for a, b in zip(again.rounds, trees.rounds):
        assert [t.feature for t in a] == [t.feature for t in b] and [t.bin for t in a] == [t.bin for t in b]
    assert boosting.BoostedTrees.from_json(trees.to_json()) == trees


def test_histograms_meet_in_tasks_or_on_the_driver(table):
    few = table.where("row_id < 600")
    one, other = (boosting.fit(few, "features", "y", rounds=2, depth=2, gathered=g) for g in (0, boosting.GATHERED))
    assert one == other


@pytest.fixture
def collected(monkeypatch):
    """Rows and bytes of binary cells that each ``collect`` brings to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect

    def spied(df):
        rows = collect(df)
        seen.append((len(rows), sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", spied)
    return seen


def test_driver_sees_no_histograms_of_many_tasks(table, collected):
    few = table.where("row_id < 1600").repartition(40)
    assert len(boosting.fit(few, "features", "y", rounds=1, depth=4).rounds) == 1
    assert max(size for _, size in collected) <= 256 << 10


def test_driver_sees_two_partial_sums(spark, collected):
    parts = spark.createDataFrame([(i, np.array([i, 1.0]).tobytes()) for i in range(60)], "part int, held binary")
    assert network.added(parts, 60).tolist() == [sum(range(60)), 60.0]
    assert [n for n, _ in collected] == [1]


def test_trees_of_odd_input(spark, table):
    none = boosting.fit(table.limit(0), "features", "y")
    assert none.rounds == []
    one = boosting.fit(table.withColumn("y", F.lit(1)), "features", "y", rounds=1, depth=2)
    assert np.allclose(boosting.softmax(one.margins(one.binned(np.zeros((1, 4)))))[0, 1], 1, atol=1e-3)
    labelled = table.withColumn("y", F.when(F.col("row_id") < 500, F.col("y")))
    assert len(boosting.fit(labelled, "features", "y", weight="w", rounds=1, depth=1).rounds) == 1


def test_focal_slope():
    rng = np.random.default_rng(1)
    x, y, w, layers = rng.normal(size=(20, 4)), rng.integers(0, 3, 20), rng.random(20), [4, 5, 3]
    point = rng.normal(size=4 * 5 + 5 + 5 * 3 + 3)
    for gamma in (0.0, 1.0, 2.0):
        held = network.focal(x, y, w, point, layers, gamma)
        for i in range(len(point)):
            moved = point.copy()
            moved[i] += 1e-6
            assert abs((network.focal(x, y, w, moved, layers, gamma)[0] - held[0]) / 1e-6 - held[1 + i]) < 1e-3


def test_network_learns(table):
    x, y = sample(3000)
    model = network.fit(table.where("row_id < 2000"), "features", "y", weight="w", hidden=(12,), rounds=25)
    p = table.where("row_id >= 2000").select("row_id", model.probabilities("features").alias("p")).orderBy("row_id").toPandas().p
    assert accuracy(np.stack(p.to_numpy()), y[2000:]) > 0.68
    assert network.Network.from_json(model.to_json()) == model
    assert len(network.fit(table.limit(0), "features", "y").point) > 0


def test_partial_sums_meet_in_tasks(spark):
    rows = [(i, np.array([i, 1.0]).tobytes()) for i in range(300)]
    parts = spark.createDataFrame(rows, "part int, held binary")
    assert network.added(parts, 300).tolist() == [sum(range(300)), 300.0]


def plain_isotonic(points):
    """Score -> fitted value, by pooling neighbours until the means rise."""
    blocks = []
    for x, y, w in sorted(points):
        if blocks and blocks[-1][2][-1] == x:
            blocks[-1][0] += w * y
            blocks[-1][1] += w
        else:
            blocks.append([w * y, w, [x]])
        # the last block may have changed: pool from the back
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w2, xs = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][2] += xs
    return {x: s / w for s, w, xs in blocks for x in xs}


@pytest.mark.parametrize("digits", [2, 9])
def test_isotonic_is_one_pass_over_all_points(spark, digits):
    rng = np.random.default_rng(digits)
    scores = np.round(rng.random(20_000), digits)
    labels = (rng.random(20_000) < scores**2).astype(float)
    weights = rng.integers(1, 4, 20_000).astype(float)
    merged = {}
    for x, y, w in zip(scores, labels, weights):
        s, n = merged.get(x, (0.0, 0.0))
        merged[x] = (s + w * y, n + w)
    want = plain_isotonic([(x, s / n, n) for x, (s, n) in merged.items()])
    df = spark.createDataFrame(list(zip(scores.tolist(), labels.tolist(), weights.tolist())), "s double, y double, w double")
    odd = spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, 0.0)], "s double, y double, w double")
    model = isotonic.fit(df.unionByName(odd), "s", "y", "w")
    got = np.interp(list(want), model.scores, model.values)
    assert np.allclose(got, list(want.values()), atol=1e-12)
    shown = df.limit(50).select("s", model.predict(F.col("s")).alias("v")).collect()
    assert all(math.isclose(r.v, want[r.s], abs_tol=1e-12) for r in shown)
    assert isotonic.Isotonic.from_json(model.to_json()) == model


def test_isotonic_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(0.3, 1.0), (0.3, 0.0)], "s double, y double")
    assert isotonic.fit(df, "s", "y") == isotonic.Isotonic([0.3], [0.5])
    assert isotonic.fit(df.limit(0), "s", "y") == isotonic.Isotonic([], [])
