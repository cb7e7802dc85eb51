import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions import decide
from transitlake.operators import dedup, discover, metrics, quality, ranks, releases, sampling, skymatch


def triples(rows, n=400, seed=1, levels=12):
    pick = random.Random(seed)
    data = []
    for i in range(n):
        raw = [pick.randint(1, levels) for _ in range(3)]
        data.append((i, f"s{pick.randint(0, 40)}", pick.randint(0, 2), *[v / sum(raw) for v in raw]))
    schema = "row_id int, star_id string, y int, p_fp double, p_cand double, p_conf double"
    return rows(schema, *data), np.array([[d[2], *d[3:]] for d in data])


# ------------------------------------------------------------------ ranks --
@pytest.mark.parametrize("ranges", [2, 16, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(rows, ranges, descending):
    pick = random.Random(3)
    data = [("g", float(v), pick.randint(0, 5)) for v in range(50)] + [("h", 7.0, 2)]
    got = ranks.running_totals(rows("g string, v double, n int", *data), ["g"], "v", ["n"], descending, ranges)
    for r in got.collect():
        group = [d for d in data if d[0] == r["g"]]
        want = sum(d[2] for d in group if (d[1] >= r["v"] if descending else d[1] <= r["v"]))
        assert r["n_run"] == want and r["n_all"] == sum(d[2] for d in group)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_equal_numpy(rows, accuracy):
    pick = random.Random(5)
    heavy = [float(pick.choice([1, 2, 3])) for _ in range(700)]
    a = [pick.gauss(0, 1) for _ in range(2000)]
    data = [("a", v, None) for v in a] + [("b", v, -v) for v in heavy] + [(None, 4.0, None)]
    shares = [0.001, 0.25, 0.5, 0.999]
    df = rows("g string, v double, w double", *data)
    got = {(r["g"], r["column"], r["share"]): r["value"] for r in ranks.percentiles(df, ["v", "w"], shares, ["g"], accuracy).collect()}
    for g, column, values in (("a", "v", a), ("b", "v", heavy), ("b", "w", [-v for v in heavy]), (None, "v", [4.0])):
        for share in shares:
            assert got[(g, column, share)] == pytest.approx(np.percentile(values, share * 100), abs=1e-12)
    assert len(got) == 4 * len(shares)


def test_percentiles_of_many_groups_and_none(rows):
    df = rows("g int, v double", *[(i % 7, float(i)) for i in range(300)])
    many = ranks.percentiles(df, ["v"], [0.5], ["g"], few_groups=False).collect()
    assert len(many) == 7
    for r in many:
        assert r["value"] == np.median([float(i) for i in range(300) if i % 7 == r["g"]])
    assert ranks.percentiles(df, ["v"], [0.5]).first()["value"] == 149.5
    assert ranks.percentiles(df.where("v < 0"), ["v"], [0.5]).count() == 0


def test_exact_ranks(rows):
    df = rows("g string, v double", *[("x", float(v)) for v in random.Random(2).sample(range(1000), 200)])
    got = [r["rank"] for r in ranks.exact_ranks(df, ["g"], "v").orderBy("v").collect()]
    assert got == list(range(1, 201))


# ------------------------------------------------------------------ dedup --
def test_keep_rules(rows):
    df = rows("star_id string, period double, t0_bjd double, feed_ord int, rowid int",
              ("a", None, 1.0, 0, 2), ("a", None, 1.0, 0, 1), ("a", None, 1.0, 1, 0), ("a", 2.0, 1.0, 0, 9))
    assert sorted(r["rowid"] for r in dedup.drop_repeats(df).collect()) == [1, 9]
    last = dedup.keep_last(df, ["star_id", "period"], ["feed_ord", "rowid"]).collect()
    assert sorted(r["rowid"] for r in last) == [0, 9]


def test_hot_key_is_limited_before_the_shuffle(rows):
    df = rows("star_id string, period double, t0_bjd double, feed_ord int, rowid int", *[("hot", 1.0, 1.0, 0, i) for i in range(50)])
    plan = dedup.drop_repeats(df)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in before_shuffle


def test_hosts_by_position(rows):
    df = rows("n int, hostname string, ra_deg double, dec_deg double", (1, None, 1.0, 2.0), (2, None, 1.0, 2.0), (3, "h", 1.0, 2.0), (4, "h", 5.0, 2.0))
    assert sorted(r["n"] for r in dedup.one_per_host(df, ["n"]).collect()) == [1, 3]


# -------------------------------------------------------------------- sky --
def separation(a, b):
    v = lambda p: np.array([math.cos(math.radians(p[1])) * math.cos(math.radians(p[0])), math.cos(math.radians(p[1])) * math.sin(math.radians(p[0])), math.sin(math.radians(p[1]))])
    return 2 * math.degrees(math.asin(min(1, np.linalg.norm(v(a) - v(b)) / 2))) * 3600


@pytest.mark.parametrize("radius", [2.0, 30.0])
def test_sky_match_equals_brute_force(rows, radius):
    pick = random.Random(11)
    spots = [(359.9999, 10.0), (120.0, 89.9999), (0.0001, -45.0), (10.0, 0.0)]
    spots += [(pick.uniform(0, 0.05), pick.uniform(-0.05, 0.05)) for _ in range(150)] + [(10.0, 0.0)] * 40
    catalog = [(0.0001, 10.0), (300.0, 89.9999), (359.99995, -45.0), (10.0, 0.0), (10.0, 0.0)]
    catalog += [(pick.uniform(0, 0.05), pick.uniform(-0.05, 0.05)) for _ in range(150)]
    df = rows("n int, ra_deg double, dec_deg double", *[(i, *s) for i, s in enumerate(spots)], (999, None, 1.0))
    cat = rows("source_id bigint, ra double, dec double, parallax double, phot_g_mean_mag double",
               *[(i, *c, float(i), 1.0) for i, c in enumerate(catalog)])
    got = {r["n"]: r["gaia_source_id"] for r in skymatch.nearest_on_sky(df, cat, skymatch.GAIA_PAYLOAD, "source_id", radius).collect()}
    assert len(got) == len(spots) + 1 and got[999] is None
    for i, s in enumerate(spots):
        near = min((round(separation(s, c), 7), j) for j, c in enumerate(catalog))
        assert got[i] == (near[1] if near[0] < radius else None)


def test_sky_match_is_an_equi_join(rows):
    df = rows("ra_deg double, dec_deg double", (1.0, 1.0))
    cat = rows("source_id bigint, ra double, dec double, parallax double, phot_g_mean_mag double", (1, 1.0, 1.0, 0.0, 0.0))
    plan = skymatch.match_catalogs(df, cat)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names(rows):
    df = rows("mission string, ra_deg double, dec_deg double", ("Kepler", 1.0, 1.0), ("K2", 1.0, 1.0), ("Kepler", 50.0, None))
    ref = rows("mission string, ra double, dec double, pos int, a string, b string",
               ("Kepler", 1.0095, 1.0, 2, "later", None), ("Kepler", 0.9951, 1.0, 1, None, "first"), ("K2", 1.01, 1.02, 1, "far", None))
    got = [tuple(r) for r in skymatch.name_by_box(df, ref, ["a", "b"], "pos").select("mission", "dec_deg", "object_name").collect()]
    assert sorted(got, key=str) == sorted([("Kepler", 1.0, "first"), ("K2", 1.0, "Unlabeled Object"), ("Kepler", None, "Unlabeled Object")], key=str)


# ---------------------------------------------------------------- metrics --
def brute_ap(y, p):
    positives, total = y.sum(), 0.0
    for s in np.unique(p):
        at = (y & (p == s)).sum()
        total += at / positives * (y & (p >= s)).sum() / (p >= s).sum()
    return total


def test_average_precision_and_auc(rows):
    df, table = triples(rows)
    y = table[:, 0]
    scored = metrics.score_table(df)
    got = {r["class"]: r["average_precision"] for r in metrics.average_precision(scored).collect()}
    for c in range(3):
        assert got[c] == pytest.approx(brute_ap(y == c, table[:, c + 1]))
    pairs = []
    for i in range(3):
        for j in range(3):
            if i != j:
                a, b = table[y == i, i + 1], table[y == j, i + 1]
                pairs.append(np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b)))
    assert metrics.ovo_auc(scored).first()[0] == pytest.approx(np.mean(pairs))


def test_average_precision_ignores_monotone_transform(rows):
    df, _ = triples(rows)
    bent = df.withColumns({p: F.pow(p, F.lit(3.0)) for p in S.PROBABILITIES})
    one = lambda d: sorted(r["average_precision"] for r in metrics.average_precision(metrics.score_table(d)).collect())
    assert one(df) == pytest.approx(one(bent))


def test_missing_class(rows):
    df = rows("y int, p_fp double, p_cand double, p_conf double", (0, 0.6, 0.2, 0.2), (1, 0.5, 0.3, 0.2))
    scored = metrics.score_table(df)
    got = {r["class"]: r["average_precision"] for r in metrics.average_precision(scored).collect()}
    assert got[2] is None and metrics.macro_average_precision(scored).first()[0] == 1.0
    assert {r["class"]: r["q"] for r in metrics.conformal_quantiles(df).collect()}[2] == 1.0
    assert metrics.confusion(df, decide.likeliest_class()).count() == 3


def test_conformal_quantiles(rows):
    df, table = triples(rows, 300)
    got = {r["class"]: r["q"] for r in metrics.conformal_quantiles(df).collect()}
    for c in range(3):
        s = np.sort(1 - table[table[:, 0] == c, c + 1])
        k = min(max(math.ceil((len(s) + 1) * 0.9), 1), len(s))
        assert got[c] == pytest.approx(s[k - 1])


def test_equal_weights_when_scores_are_zero(rows):
    got = metrics.ensemble_weights(rows("model string, pr_auc_macro double", ("a", 0.0), ("b", None))).collect()
    assert [r["weight"] for r in got] == [0.5, 0.5]


# -------------------------------------------------------------- decisions --
def test_veto(rows):
    df = rows("p_fp double, p_cand double, p_conf double, ror double, impact double",
              (0.2, 0.2, 0.6, 1.0, None), (0.2, 0.2, 0.6, 0.1, 1.2), (0.2, 0.2, 0.6, 0.1, 1.1), (0.0, 0.0, 0.0, 2.0, 0.0))
    got = decide.apply_veto(df).collect()
    assert [r["veto_hit"] for r in got] == [True, True, False, False]
    assert got[0]["p_conf"] == pytest.approx(0.18 / 0.58) and got[3]["p_conf"] == 0.0
    for r in got[:3]:
        assert r["p_fp"] + r["p_cand"] + r["p_conf"] == pytest.approx(1)


def test_decisions(rows):
    df = rows("p_fp double, p_cand double, p_conf double", (0.4, 0.4, 0.2), (0.1, 0.3, 0.6))
    assert [r[0] for r in df.select(decide.likeliest_class()).collect()] == [0, 2]
    assert [r[0] for r in df.select(decide.threshold_class({0: 0.4, 1: 0.3, 2: 0.9})).collect()] == [1, 1]
    assert [r[0] for r in df.select(decide.threshold_class({0: 0.9, 1: 0.9, 2: 0.9})).collect()] == [0, 2]
    assert [r[0] for r in df.select(decide.conformal_set({0: 0.6, 2: 0.5})).collect()] == [[0], [2]]
    p = np.array([[0.4, 0.4, 0.2], [0.1, 0.3, 0.6]])
    assert [r[0] for r in df.select(decide.cheapest_class()).collect()] == list((p @ np.array(S.COSTS)).argmin(1))
    assert [r[0] for r in df.select(decide.cheapest_class(transpose=True)).collect()] == list((p @ np.array(S.COSTS).T).argmin(1))


def test_score_with_missing_terms(rows):
    df = rows("p_fp double, p_cand double, p_conf double, dur_consistency double", (0.1, 0.2, 0.7, None), (0.1, 0.2, 0.7, 1.0))
    got = [r[0] for r in df.select(decide.discovery_score(df)).collect()]
    assert got == pytest.approx([0.7 + 0.08 - 0.06, 0.7 + 0.08 - 0.06 - 0.05])


def test_rationale(rows):
    df = rows(
        "p_fp double, p_cand double, p_conf double, veto_hit boolean, p_conf_before_veto double, p_conf_after_veto double, "
        "prediction_set array<int>, top_features array<struct<feature:string,shap:double>>",
        (0.1, 0.2, 0.7, True, 0.9, 0.7, [1, 2], [("depth_snr", 0.25), ("impact", -0.5)]),
    )
    text = df.select(decide.rationale({})).first()[0]
    assert text == (
        "Physics veto reduced Confirmed P from 0.900 → 0.700 (b > 1+ror or ror ≥ 1). "
        "Conformal set includes Candidate, Confirmed (uncertainty-aware). "
        "Top drivers: depth_snr (+0.25), impact (−0.50) Best threshold margin: Confirmed (+0.200)."
    )


def test_ranking_pages_and_views(rows):
    df = rows("star_id string, p_fp double, p_cand double, p_conf double, is_kepler int, is_k2 int, is_tess int, ra_deg double, dec_deg double, dist_pc double, depth_snr double",
              ("a", 0.05, 0.0, 0.95, 1, 0, 0, 10.0, 5.0, 2.0, 0.0), ("b", 0.3, 0.3, 0.4, 0, 1, 0, 10.0, None, 2.0, 90.0), ("c", 0.5, 0.3, 0.2, 0, 0, 1, 1.0, 1.0, None, 0.0))
    full = discover.with_decisions(df, {}, {})
    assert [r["star_id"] for r in discover.ranked(full, ["star_id"]).collect()] == ["a", "b", "c"]
    assert [r["star_id"] for r in discover.page(full, discover.ranking(["star_id"]), 2, 1).collect()] == ["b"]
    assert [r["star_id"] for r in discover.universe_table(full).collect()] == ["a"]
    assert discover.candidate_table(full).columns == S.CANDIDATE_COLUMNS
    seen = discover.universe_view(rows("RA double, DEC double, koi_period string, source string, p_conf double", (1.0, 2.0, "x", "tess", 0.7)), {2: 0.6, 1: 0.3}).first()
    assert seen["mission"] == "TESS" and seen["label"] == "Confirmed" and seen["period"] is None and seen["ra_deg"] == 1.0


# --------------------------------------------------------------- sampling --
def test_folds_keep_stars_together(rows):
    df, _ = triples(rows, 600)
    folded = sampling.group_folds(df, 5)
    assert folded.count() == 600 and folded.select("star_id", "fold").distinct().count() == df.select("star_id").distinct().count()
    assert {r["fold"] for r in folded.select("fold").distinct().collect()} == set(range(5))
    assert folded.orderBy("row_id").select("fold").collect() == sampling.group_folds(df.repartition(7), 5).orderBy("row_id").select("fold").collect()


def test_hold_out_without_groups(rows):
    df, _ = triples(rows, 600)
    split = sampling.hold_out(df.drop("star_id"))
    assert 40 < split.where("split = 'test'").count() < 140


def test_oversample(rows):
    df = rows("n int, y int", *[(i, 0) for i in range(1000)], *[(i, 1) for i in range(300)])
    got = {r["y"]: r["count"] for r in sampling.oversample(df).groupBy("y").count().collect()}
    assert got[0] == 1000 and 930 < got[1] < 1070
    level = rows("n int, y int", *[(i, i % 2) for i in range(100)])
    assert sampling.oversample(level).count() == 100


def test_release_shift(rows):
    df = rows("release string, feature string, shap double", ("v1", "a", 1.0), ("v2", "a", -3.0), ("v2", "b", 2.0))
    got = {(r["release"], r["feature"]): r["shift"] for r in releases.attribution_shift(df).collect()}
    assert got == {("v1", "a"): None, ("v2", "a"): 2.0, ("v2", "b"): 2.0}


def test_missing_groups_keep_their_rows(rows):
    from transitlake.operators import metrics as M
    from transitlake.operators import ranks as R
    from transitlake.operators import sampling as P

    df = rows("g string, v int", ("a", 1), (None, 2), (None, 3), ("a", 5))
    got = sorted((r["g"] or "", r["v"], r["rank"]) for r in R.exact_ranks(df, ["g"], "v").collect())
    assert got == [("", 2, 1), ("", 3, 2), ("a", 1, 1), ("a", 5, 2)]
    stars = rows("star_id string, y int", ("a", 1), ("b", None), (None, 0), ("b", None), ("c", 2))
    assert P.group_folds(stars, 3).count() == 5 and P.hold_out(stars).count() == 5
    scored = rows(
        "mission string, y int, p_fp double, p_cand double, p_conf double",
        ("K", 0, 0.9, 0.05, 0.05), (None, 1, 0.1, 0.8, 0.1), (None, 2, 0.1, 0.2, 0.7),
    )
    assert sorted((r["mission"] or "", r["rows"]) for r in M.mission_metrics(scored).collect()) == [("", 2), ("K", 1)]


def test_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from transitlake.session import checkpoint_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(session)


def test_balanced_folds_beat_the_hash_deal(spark):
    rng = random.Random(4)
    rows = []
    for star in range(2000):
        kind = rng.random()
        for _ in range(rng.choice([1, 1, 2, 5, 40 if kind > 0.95 else 3])):
            rows.append((len(rows), f"s{star}" if star else None, rng.choice([0, 1, 2]) if kind < 0.5 else int(kind > 0.9)))
    rows += [(10_000, "lonely", None), (10_001, "s1", None)]
    df = spark.createDataFrame(rows, "row_id int, star_id string, y int")
    folded = sampling.balanced_folds(df, 5).collect()
    assert sorted(r.row_id for r in folded) == [r[0] for r in rows]
    of_star = {}
    for r in folded:
        assert of_star.setdefault(r.star_id, r.fold) == r.fold

    def worst(found):
        out = 0
        for c in (0, 1, 2):
            whole = sum(r.y == c for r in found)
            out = max([out, *(abs(sum(r.y == c and r.fold == f for r in found) / whole - 0.2) for f in range(5))])
        return out

    assert worst(folded) < 0.01 < worst(sampling.group_folds(df, 5).collect())
    again = {r.row_id: r.fold for r in sampling.balanced_folds(df.repartition(7), 5).collect()}
    assert again == {r.row_id: r.fold for r in folded}
    assert sampling.balanced_folds(df.limit(0), 5).count() == 0


def test_pages_read_one_range(spark, tmp_path):
    from transitlake.operators.pages import PageIndex, build_index

    rows = [(i, (i * 7919) % 1000 / 10 if i % 50 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, score double")
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    index = build_index(df, order, str(tmp_path / "pages"), 100)
    want = [r.id for r in df.orderBy(*order).collect()]
    for number, size in ((1, 10), (7, 33), (31, 33), (100, 10), (101, 10), (1, 5000)):
        got = PageIndex(spark, str(tmp_path / "pages")).page(number, size).orderBy("rank").collect()
        assert [r.id for r in got] == want[(number - 1) * size : number * size]
        assert all(r.total == 1000 for r in got) and [r["rank"] for r in got] == list(range((number - 1) * size + 1, (number - 1) * size + 1 + len(got)))
    assert len(index.parts) > 5 and index.total == 1000
    files = {r[0] for r in index.page(90, 10).select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1
    assert build_index(df.limit(0), order, str(tmp_path / "none")).page(1, 10).count() == 0


def test_page_index_has_as_many_parts_as_the_cluster(spark, tmp_path):
    """The bounds of a partition are sampled on the driver: more rows, larger partitions."""
    from transitlake.operators.pages import build_index
    from transitlake.operators.ranks import range_count

    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3000).alias("score"))
    index = build_index(df, [F.col("score").desc()], str(tmp_path / "pages"), 10)
    assert len(index.parts) <= range_count(df) < 300 and index.total == 3000
    for number, size in ((1, 10), (7, 33), (300, 10), (301, 10), (2, 1000)):
        got = index.page(number, size).orderBy("rank").collect()
        want = list(range((number - 1) * size, min(number * size, 3000)))
        assert [3000 - 1 - r.score for r in got] == want and [r["rank"] - 1 for r in got] == want


def test_fingerprint_of_any_layout(spark):
    rows = [(1, 1.5, "a", True), (2, None, "", None), (2, None, "", None), (3, -1e-30, "é|~", False), (4, 1e300, None, True), (5, float("nan"), "5:x", True)]
    schema = "a int, b double, c string, d boolean"
    base = tuple(quality.fingerprint(spark.createDataFrame(rows, schema)).first())
    other = spark.createDataFrame(rows[::-1], schema).repartition(4).select("d", "b", "a", "c")
    assert tuple(quality.fingerprint(other).first()) == base
    for change in (rows[1:], [*rows, rows[1]], [(1, 1.5000000000000002, "a", True), *rows[1:]], [(1, 1.5, "a", False), *rows[1:]]):
        assert tuple(quality.fingerprint(spark.createDataFrame(change, schema)).first()) != base
    assert quality.fingerprint(spark.createDataFrame([], schema)).first()["rows"] == 0


def test_hold_out_without_stars_is_stratified(spark):
    df = spark.createDataFrame([(i, 0 if i < 100 else 1 if i < 900 else None) for i in range(1000)], "id int, y int")
    split = sampling.hold_out(df)
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts[0, "test"] == 15 and counts[1, "test"] == 120 and counts[None, "test"] == 15 and sum(counts.values()) == 1000


def test_histogram_of_a_constant(spark):
    got = {r["bin"]: r for r in quality.histogram(spark.range(7).selectExpr("3.0D AS v"), ["v"], 4).collect()}
    assert got[2]["n"] == 7 and (got[0]["bin_from"], got[3]["bin_to"]) == (2.5, 3.5)


def test_catalogs_are_not_copied(spark):
    """The catalog's branch of the plan has neither a generator nor an aggregation."""
    df = spark.range(50).selectExpr("id AS n", "CAST(id AS DOUBLE) AS ra_deg", "CAST(id AS DOUBLE) AS dec_deg")
    cat = spark.range(5000).selectExpr("id AS source_id", "id * 0.01D AS ra", "id * 0.01D AS dec", "1.0D AS parallax", "1.0D AS phot_g_mean_mag")
    plan = skymatch.nearest_on_sky(df, cat, skymatch.GAIA_PAYLOAD, "source_id")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    ours = next(i for i, line in enumerate(lines) if "Range (0, 5000" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(lines[ours])
    for line in reversed(lines[:ours]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Generate" in x or "Aggregate" in x for x in above)


def test_missing_keys_are_spread(spark):
    df = spark.range(4000).selectExpr("id", "CAST(NULL AS STRING) AS k", "id % 3 AS v").unionByName(spark.sql("SELECT 9999L AS id, 'a' AS k, 1L AS v"))
    side = spark.sql("SELECT 'a' AS k, 5 AS w UNION ALL SELECT NULL, 6")
    got = skymatch.left_on(df, side, ["k"])
    assert got.columns == ["k", "id", "v", "w"] or set(got.columns) == {"k", "id", "v", "w"}
    assert [(r.id, r.w) for r in got.where("w IS NOT NULL").collect()] == [(9999, 5)] and got.count() == 4001


def test_radix_selection_is_exact(spark):
    from transitlake.operators import radix

    rng = np.random.default_rng(8)
    odd = [0.0, -0.0, 1.0, 5e-324, -5e-324, 1e300, -1e300, 1e-300, 7.25, None, float("nan")]
    values = [*odd, *rng.normal(size=700).tolist(), *np.round(rng.normal(size=700), 1).tolist(), *[3.0] * 500]
    groups = [rng.choice(["a", "b", None]) for _ in values]
    rows = [(g, i % 2, v, float(i)) for i, (g, v) in enumerate(zip(groups, values))]
    df = spark.createDataFrame(rows, "g string, h int, v double, w double").repartition(5)
    ranks_of = lambda n, k: F.array(F.floor((n - 1) * F.lit([0.0, 0.37, 1.0][k])) + 1)
    got = {(r["g"], r["h"], r["column"], r["which"]): (r["n"], r["position"], r["value"]) for r in radix.order_statistics(df, ["v", "w"], [0.0, 0.37, 1.0], ranks_of, ["g", "h"]).collect()}
    for g in ("a", "b", None):
        for h in (0, 1):
            for at, column in ((2, "v"), (3, "w")):
                mine = sorted(r[at] for r in rows if r[0] == g and r[1] == h and r[at] is not None and not math.isnan(r[at]))
                for k, share in enumerate((0.0, 0.37, 1.0)):
                    place = math.floor((len(mine) - 1) * share) + 1
                    assert got[g, h, column, k] == (len(mine), place, mine[place - 1])
    assert radix.order_statistics(df.limit(0), ["v"], [0.5], ranks_of).collect() == []
    nothing = df.withColumn("v", F.lit(None).cast("double"))
    assert radix.order_statistics(nothing, ["v"], [0.5], ranks_of, ["h"]).collect() == []
    several = radix.order_statistics(df, ["w"], [0.5], lambda n, k: F.array(F.lit(2), F.lit(3), F.lit(2)).cast("array<bigint>"), [])
    assert sorted(r["value"] for r in several.collect()) == [1.0, 1.0, 2.0]


def test_radix_passes_send_one_arrow_column_for_all_values(spark):
    from transitlake.operators import radix

    df = spark.createDataFrame([("a", 1.0, None), ("b", -0.0, 2.0), (None, 3.0, None)], "g string, _v0 double, _v1 double")
    counts = radix.digit_counts(df, ["g"], 2, {("a",): 0, ("b",): 1, (None,): 2}, 0, {})
    assert sorted((r["g"], r["slot"], r["n"]) for r in counts.collect()) == [(0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 0, 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Project [g#" in plan and "AS _cells#" in plan and "MapInArrow run(g#" in plan and "_v1#" not in plan.split("MapInArrow")[1].split("\n")[0]


def test_round_double_is_round(spark):
    from transitlake.functions.numbers import round_double

    rng = np.random.default_rng(6)
    ties = [k / 64 * s for k in range(-200, 200) for s in (1.0, 1e-6, 1e-9)] + [k + 0.5 for k in (0.0, 7.0, 2.0**41)]
    odd = [0.0, -0.0, -1e-12, 1e300, -1e300, 5e-324, 2.0**40, 2.0**52 + 1, float("inf"), float("-inf"), float("nan"), None, 0.1234565, 1.0000005, 2.5e-7, 1099511.6277755]
    values = [*odd, *ties, *rng.normal(size=2000).tolist(), *np.exp(rng.uniform(-30, 40, 2000)).tolist(), *(rng.integers(-(10**6), 10**6, 2000) / 2e6).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (6, 9):
        got = df.select(round_double(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b")).collect()
        assert [str(r["a"]) for r in got] == [str(r["b"]) for r in got]
