"""Importance resampling, whitening and line quality against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.llm import line_quality, queries, resampling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")


def test_position_table_is_crc32():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(300_000))
    spans = [(0, len(raw))]
    for _ in range(1500):
        start = rng.randrange(len(raw) - 1)
        spans.append((start, min(len(raw), start + rng.choice([1, 2, 5, 63, 64, 65, 128, 129, 500, 5000, 70_000]))))
    found = resampling.PositionTable().crc(np.frombuffer(raw, np.uint8), *map(np.array, zip(*spans)))
    assert found.tolist() == [zlib.crc32(raw[a:b]) for a, b in spans]
    assert len(resampling.PositionTable().crc(np.zeros(1, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def plain_features(text, shortest, longest):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def plain_resample(rows, target, buckets, shortest, longest, percent, least, seed):
    s, t = Counter(), Counter()
    own = [plain_features(text, shortest, longest) for _, text in rows]
    for _, crcs in own:
        s.update(c % buckets for c in crcs)
    for text in target:
        t.update(c % buckets for c in plain_features(text, shortest, longest)[1])
    whole = [float(sum(c.values()) + buckets) for c in (s, t)]
    gain = [math.floor(1000 * math.log((float(t[k] + 1) * whole[0]) / (float(s[k] + 1) * whole[1]))) for k in range(buckets)]
    out = []
    for (i, _), (n, crcs) in zip(rows, own):
        weight = sum(gain[c % buckets] for c in crcs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    taken = len(order) * percent // 100
    ranks = {id(r): k + 1 for k, r in enumerate(order[:taken])}
    return [(*r, ranks.get(id(r))) for r in out]


@pytest.mark.parametrize(("shortest", "longest", "buckets"), [(1, 1, 10_000), (1, 2, 300), (2, 3, 1000)])
def test_resampling_is_brute_force(spark, shortest, longest, buckets):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(300)] + ["é", "字字", "İ", "x_y", "a-b", "x" * 200]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " -- \x00\x7f"), (None, "one two " * 12), (1003, "a" * 1_200_000 + " b" * 30)]
    rows += [(1004, "same words " * 20), (1005, "same words " * 20), (1006, ("long words " * 60_000))]
    target = ["W1 W2 W3 w4", None, "", "É é 字字 " + "z" * 400] * 5
    df = spark.createDataFrame([(i, t, 1, 2.0, "b") for i, t in rows], "doc_id long, text string, rank int, bucket double, _row string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, buckets=buckets, shortest=shortest, longest=longest, percent=23)
    assert got.columns == ["doc_id", "bucket", "_row", "n_words", "n_features", "weight", "score", "rank"]
    found = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(found, key=key) == sorted(plain_resample(rows, target, buckets, shortest, longest, 23, 20, 2024), key=key)


def test_resampling_of_repeats_ties_and_nothing(spark):
    df = spark.createDataFrame([(7, "many " * 25)] * 10, "doc_id long, text string")
    goal = spark.createDataFrame([("many",)], "text string")
    ranks = sorted(r["rank"] or 0 for r in resampling.resample(df, goal, percent=30).collect())
    assert ranks == [0] * 7 + [1, 2, 3]
    assert resampling.resample(df.limit(0), goal).collect() == []
    assert resampling.resample(df, goal.limit(0)).count() == 10


def test_inertia_slices_spectra():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 40):
        x = rng.normal(size=(5 * d + 3, d)) * np.linspace(1, 3, d)
        v = (x.T @ x).reshape(d, d)
        want = np.linalg.eigvalsh(v)[::-1]
        for shift in rng.uniform(-1, want[0] * 1.1, 20):
            assert whitening.above(v, shift) == (want > shift).sum()
        values, vectors = whitening.leading(v, 32)
        assert np.allclose(values, want[:32], rtol=1e-10) and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    # zeros on the diagonal need pivots of two rows
    assert whitening.above(np.array([[0.0, 2, 0], [2, 0, 0], [0, 0, -1]]), 0) == 1


def test_clusters_and_missing_rank():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    e = np.array([5.0] * 7 + [3.0] * 2 + [3 - 1e-9] + [1.0] * 5 + [1e-3] * 3 + [0] * 22)
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 32)
    assert len(values) == 18 and np.allclose(values, e[:18], atol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(18)).max() < 1e-12 and np.abs(v @ vectors - vectors * values).max() < 1e-10
    assert len(whitening.leading(np.zeros((3, 3)), 3)[0]) == 0 and np.allclose(whitening.leading(2 * np.eye(6), 3)[0], 2)


def plain_whitened(vectors, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, len(values))
    return ((n * x - s) ** 2).sum(axis=1), centred @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).astype(np.float32).tolist(), 1) for i in range(300)]
    good += [(7, good[7][1], 1), (None, good[9][1], 1)]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, 1), (901, [], 1), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (903, [nan] * 6, 1), (904, [1.0, -inf, 1.0, 1.0, 1.0, 1.0], 1)]
    bad += [(905, [1.0] * 5, 1), (906, [1e30] * 6, 1)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, component int")
    got = whitening.whiten(df, components=4).collect()
    deviation, white, explained = plain_whitened([v for _, v, _ in good], 4)
    assert len(got) == 4 * len(good)
    rows = {}
    for r in got:
        assert r.n == len(good) and r.identity_error < 1e-10
        rows.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for (i, _, _), d, w in zip(good, deviation, white):
        mine = rows[(i, int(d))]
        assert np.allclose([abs(mine[c].whitened) for c in (1, 2, 3, 4)], np.abs(w), atol=1e-9)
        assert np.allclose([mine[c].explained for c in (1, 2, 3, 4)], explained, rtol=1e-10)
    one_sign = [np.sign(rows[(i, int(d))][1].whitened * w[0]) for (i, _, _), d, w in zip(good, deviation, white) if abs(w[0]) > 1e-6]
    assert len(set(one_sign)) == 1


def test_whitening_of_little_and_of_much(spark):
    schema = "vec_id long, embedding array<double>"
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    for df in (equal, equal.limit(0), equal.limit(1)):
        found = whitening.whiten(df)
        assert found.collect() == [] and found.columns == ["vec_id", *[c.split()[0] for c in whitening.OUTPUT.split(", ")]]
    # differences whose squares a long cannot hold: exact arithmetic, null where the sum is beyond it
    large = spark.createDataFrame([(i, [1e12 * i, 1e11 * (i % 3)]) for i in range(10)], schema)
    got = whitening.whiten(large).collect()
    assert len(got) == 20 and all(r.deviation is None for r in got) and got[0].identity_error < 1e-6


def test_marginals_are_sums_over_labellings():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 5, 2]
    starts, n = np.cumsum(sizes) - sizes, sum(sizes)
    evidence, ties = 2 * rng.normal(size=n), rng.normal(size=(2, 2))
    good, joint, normal = line_quality.marginals(evidence, starts, ties)
    for s, k in zip(starts, sizes):
        mass = {}
        for y in itertools.product((0, 1), repeat=k):
            mass[y] = math.exp(sum(evidence[s + i] * y[i] for i in range(k)) + sum(ties[y[i - 1], y[i]] for i in range(1, k)))
        total = sum(mass.values())
        assert math.isclose(normal[s : s + k].sum(), math.log(total))
        for i in range(k):
            assert math.isclose(good[s + i], sum(m for y, m in mass.items() if y[i]) / total)
            for a, b in itertools.product((0, 1), repeat=2):
                want = sum(m for y, m in mass.items() if y[i - 1] == a and y[i] == b) / total if i else 0
                assert math.isclose(joint[s + i, a, b], want, abs_tol=1e-12)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(5)
    sizes = [4, 1, 6]
    starts, n = np.cumsum(sizes) - sizes, sum(sizes)
    lines, label = rng.normal(size=(n, line_quality.WIDTH)), np.repeat([1.0, 0.0, 1.0], sizes)
    weight, point = np.repeat([1.0, 2.0, 0.5], sizes), 0.1 * rng.normal(size=3 * line_quality.WIDTH + 4)
    ask = lambda p: line_quality.objective(p, lines, starts, label, weight, 0.3)
    value, slope = ask(point)
    for i in range(len(point)):
        moved = point.copy()
        moved[i] += 1e-6
        assert abs((ask(moved)[0] - value) / 1e-6 - slope[i]) < 1e-3


def junk_and_prose(rng, n):
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = [rng.choice(["the", "of", "river", "stone", "was", "seen"]) for _ in range(rng.randrange(5, 20))]
            lines.append(" ".join(words).capitalize() + "." if good else " ".join(w + "$$$" for w in words))
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_line_quality_on_held_out_rows(spark):
    rows = junk_and_prose(random.Random(9), 500)
    odd = [(900, None), (901, ""), (902, "\n" * 300_000), (903, "word " * 400_000), (None, "x"), (3, rows[3][1]), (904, "a$$$\n" * 3000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(i, t, 1.0) for i, t in odd], "doc_id long, text string, score double")
    labels = [(i, q) for i, _, q in rows] + [(None, 1), (901, None), (5, 1), (5, None)]
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    got = line_quality.score(docs, told).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: q for i, _, q in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    # labels of held-out rows are not looked at
    flipped = spark.createDataFrame([(i, 1 - q if q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels], "doc_id long, quality int")
    again = {(r.doc_id, r.score) for r in line_quality.score(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert line_quality.score(docs.limit(0), told).collect() == []
    assert {r.score for r in line_quality.score(docs.limit(5), told.limit(0)).collect()} == {0.5}


def test_registered_queries(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    drawn = queries.QUERIES["op11_resampling"](spark, data)
    assert drawn.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    want = [(r[0], *r[2:]) for r in plain_resample(list(docs.items()), target, 10_000, 1, 1, 10, 20, 2024)]
    assert sorted(map(tuple, drawn.collect())) == sorted(want)
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r.embedding}
    white = queries.QUERIES["op12_whitening"](spark, data)
    deviation, plain, explained = plain_whitened(list(vectors.values()), 32)
    found = {(r.vec_id, r.component): r for r in white.collect()}
    assert len(found) == 32 * len(vectors)
    for i, d, w in zip(vectors, deviation, plain):
        assert found[i, 1].deviation == d and np.allclose([abs(found[i, c + 1].whitened) for c in range(32)], np.abs(w), atol=1e-7)
    assert np.allclose([found[0, c + 1].explained for c in range(32)], explained)
    judged = queries.QUERIES["op13_line_quality"](spark, data)
    assert judged.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = judged.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert np.mean([r.predicted == quality[r.doc_id] for r in rows if r.doc_id in quality]) > 0.95


def test_counting_and_ranking_see_the_same_ranges(spark):
    """Sketches meet in any order, so bounds found anew in each job may differ."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 4000).alias("score"))
    plan = resampling.drawn(rows, F.lit(True), 25, "doc_id")
    assert "percentile_approx" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["rank"], r.score) for r in plan.where("rank IS NOT NULL").collect()) == [(k + 1, 3999 - k) for k in range(1000)]
