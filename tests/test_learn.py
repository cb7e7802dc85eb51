import pytest
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.operators import explain, metrics, sampling
from transitlake.operators.learners import Learner, assemble, impute
from transitlake.plans import adapters, learn

FEATURES = [f"f{i}" for i in range(8)]
QUICK = {
    "boosted": Learner("boosted", {"rounds": 2, "depth": 2, "trends": {"f0": 1, "f1": -1}}),
    "forest": Learner("forest", {"numTrees": 3, "maxDepth": 3}),
    "linear": Learner("linear", {"maxIter": 10}),
    "network": Learner("network", {"hidden": (4,), "rounds": 3}),
}


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = adapters.vectors(spark, data)
    physical = {
        "ror": F.abs(F.col("f0")) * 5, "impact": F.abs(F.col("f1")) * 5, "depth_snr": F.col("f2"),
        "mission": F.when(F.col("row_id") % 3 == 0, "TESS").otherwise("Kepler"),
        "is_tess": (F.col("row_id") % 3 == 0).cast("int"),
    }
    return rows.withColumns(physical)


@pytest.fixture(scope="module")
def training(vectors):
    return learn.train(vectors, QUICK, FEATURES, k=2)


def sums_to_one(df):
    worst = df.agg(F.max(F.abs(sum(F.col(p) for p in S.PROBABILITIES) - 1))).first()[0]
    return worst < 1e-9


def test_every_row_has_one_prediction_per_model(training, vectors):
    rows = vectors.count()
    assert training.oof.count() == rows * len(QUICK)
    assert training.oof.select("row_id", "model").distinct().count() == rows * len(QUICK)
    assert sums_to_one(training.oof) and sums_to_one(training.mixed) and sums_to_one(training.calibrated)


def test_report_and_weights(training):
    got = {r["model"]: r for r in training.report.collect()}
    assert set(got) == set(QUICK)
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1)
    for r in got.values():
        assert 0 < r["oof_pr_auc_macro"] <= 1 and 0 <= r["oof_roc_auc_ovo"] <= 1 and r["cv_pr_std"] >= 0


def test_stacking(training):
    from transitlake.operators.ensemble import stacked_features

    wide, _ = stacked_features(training.oof, list(QUICK), ["row_id", "y"])
    assert sums_to_one(training.stacker.predict(wide))


def test_conformal_coverage(training):
    from transitlake.functions.decide import conformal_set

    inside = F.array_contains(conformal_set(training.bundle.quantiles), F.col("y").cast("int"))
    assert training.calibrated.agg(F.avg(inside.cast("int"))).first()[0] >= 0.9


def test_scoring_save_and_load(spark, training, vectors, tmp_path):
    scored = training.bundle.score(vectors)
    assert scored.count() == vectors.count() and sums_to_one(scored)
    assert scored.where("veto_hit and p_conf_after_veto > p_conf_before_veto").count() == 0
    training.bundle.save(spark, str(tmp_path / "release"))
    again = learn.load_bundle(spark, str(tmp_path / "release")).score(vectors)
    both = scored.select("row_id", "p_conf").join(again.select("row_id", F.col("p_conf").alias("q")), "row_id")
    assert both.where(F.abs(F.col("p_conf") - F.col("q")) > 1e-12).count() == 0
    loaded = learn.load_bundle(spark, str(tmp_path / "release"))
    ready = assemble(impute(vectors, FEATURES, {}), FEATURES)
    assert sums_to_one(loaded.stacked(ready)) and loaded.stacker.names == training.stacker.names


def test_one_row_and_request_names(rows, training):
    row = rows("row_id int, f0 double, b_impact double, radius_ratio_rp_over_rs double", (1, 0.1, 5.0, 0.1))
    got = training.bundle.score(row).first()
    assert got["veto_hit"] and got["impact"] == 5.0 and len(got["threshold_margins"]) == 3


def test_explanations(spark, training, vectors):
    few = vectors.where("row_id < 20")
    parts = training.bundle.explain(few)
    assert parts.count() == few.count() * len(FEATURES)
    records = learn.explained(training.bundle, few).collect()
    assert len(records) == few.count()
    for r in records:
        sizes = [abs(t["shap"]) for t in r["top_features"]]
        assert len(sizes) == S.EXPLAINED_FEATURES and sizes == sorted(sizes, reverse=True)
        assert "Best threshold margin" in r["rationale"]
    assert explain.global_attribution(parts).count() == len(FEATURES)
    assert learn.importances(training.bundle, spark).count() == 2 * len(FEATURES)


def test_occlusion_of_known_model(rows):
    df = rows("row_id int, a double, b double", (1, 1.0, 5.0), (2, 0.0, 5.0))
    from pyspark.ml.functions import vector_to_array

    def predict(x):
        a = vector_to_array("features")[0]
        return x.withColumns({"p_fp": F.lit(0.1), "p_cand": F.lit(0.0), "p_conf": 0.5 + 0.3 * a})

    got = explain.occlusion(df, ["a", "b"], {"a": 0.0, "b": 1.0}, predict)
    values = {(r["row_id"], r["feature"]): r["shap"] for r in got.collect()}
    assert values == {(1, "a"): pytest.approx(0.3), (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 0.0}


def test_trend_audit(rows):
    df = rows("depth_snr double, impact double, p_conf double", *[(float(i), float(i), i / 100) for i in range(100)])
    got = {r["feature"]: r for r in explain.trend_audit(df).collect()}
    assert got["depth_snr"]["violations"] == 0
    assert got["impact"]["violations"] == got["impact"]["steps"] > 0


def test_hold_out_evaluation(training, vectors):
    split = sampling.hold_out(vectors)
    held = learn.hold_out_scores(training.bundle, split.where("split = 'test'"))
    row = held.scores().first()
    assert 0 < row["pr_auc_macro"] <= 1 and 0 <= row["roc_auc_ovo"] <= 1
    rows = held.scored.count()
    assert 0 < rows < vectors.count() and held.confusion().agg(F.sum(sum(F.col(f"pred_{c}") for c in S.CLASS_IDS))).first()[0] == rows
    assert held.by_mission().select("mission").distinct().count() == 2


def test_other_learners(vectors):
    ready = assemble(impute(vectors, FEATURES, {}), FEATURES)
    network = Learner("network", {"hidden": (4,), "rounds": 3}).fit(ready)
    assert sums_to_one(network.predict(ready)) and network.importances(FEATURES) == []
    trees = Learner("one_vs_rest", {"maxIter": 1, "maxDepth": 2}).fit(ready)
    assert sums_to_one(trees.predict(ready)) and len(trees.importances(FEATURES)) == len(FEATURES)


def test_unknown_learner(vectors):
    with pytest.raises(ValueError):
        Learner("magic").fit(vectors)


def test_impute(rows):
    df = rows("a double, b string", (None, "x"), (float("nan"), "2"))
    got = impute(df, ["a", "b", "c"], {"a": 7.0, "b": 1.0}).collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(7.0, 1.0, 0.0), (7.0, 2.0, 0.0)]


def test_metrics_of_perfect_scores(rows):
    df = rows("y int, p_fp double, p_cand double, p_conf double", (0, 0.8, 0.1, 0.1), (1, 0.1, 0.8, 0.1), (2, 0.1, 0.1, 0.8))
    table = metrics.score_table(df)
    assert metrics.macro_average_precision(table).first()[0] == 1.0
    assert metrics.ovo_auc(table).first()[0] == 1.0


def test_explore_and_export(spark, training, vectors, tmp_path):
    from transitlake.plans import discovery
    from transitlake.sources.readers import read_json_lines

    pool = vectors.where("row_id < 60").withColumnRenamed("mission", "source_mission")
    positions = vectors.select(
        "star_id", F.col("row_id").alias("n"), (F.col("row_id") * 1.0).alias("ra_deg"), F.lit(1.0).alias("dec_deg"),
        F.when(F.col("row_id") % 2 == 0, 5.0).alias("dist_pc"), F.lit(1.5).alias("rade_Re"),
    )
    tables = discovery.explore(training.bundle, pool, positions, ["n"], top_k=10)
    rows = pool.count()
    assert tables["explanations"].count() == rows and tables["candidates"].count() == 10
    assert tables["universe"].where("dist_pc is null").count() == 0
    discovery.export(tables, str(tmp_path / "out"))
    back = read_json_lines(spark, str(tmp_path / "out" / "explanations"))
    assert back.count() == rows
    assert discovery.summary(training.bundle, tables["explanations"]).first()["rows_evaluated"] == rows


def test_metric_rows(training):
    got = {(r["metric"], r["mission"]): r["value"] for r in learn.metric_rows(training).collect()}
    assert {"oof.weighted_pr_auc_macro", "oof.calibrated_pr_auc_macro", "ece", "pr_auc_macro"} == {m for m, _ in got}
    assert all(0 <= v <= 1 for v in got.values())
