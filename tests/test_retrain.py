import random

import pytest

from transitlake.operators.learners import Learner
from transitlake.plans import learn, retrain
from transitlake.sources.writers import write_release
from transitlake.streaming.ingest import IngestTable

QUICK = {"boosted": Learner("boosted", {"rounds": 1, "depth": 2})}
FEATURES = ["period", "depth_ppm", "dur_h"]


def upload(rows, seed, stars):
    rng, labels = random.Random(seed), ["fp", "cand", "confirmed"]
    schema = "star_id string, period string, depth_ppm string, dur_h string, ror string, impact string, is_tess string, label_int string"
    made = []
    for i in stars:
        c = i % 3
        numbers = (1 + c + rng.random(), 300 + 200 * c + 150 * rng.random(), 2 + rng.random(), 0.05 + 0.02 * c, 0.2)
        made.append((f"s{i}", *map(str, numbers), str(i % 2), labels[c]))
    return rows(schema, *made)


def test_upload_to_release_and_comparison(spark, rows, tmp_path):
    table, folder = IngestTable(spark, str(tmp_path / "t")), str(tmp_path / "releases")
    table.append(upload(rows, 1, range(60)), 0)
    # an earlier release, by hand: one metric that the next has too, one attribution
    earlier = rows("metric string, mission string, value double", ("n_features", "All", 2.0))
    shaps = rows("feature string, n long, shap double", ("dur_h", 60, 0.25))
    write_release({"attributions": shaps}, earlier, folder, "v1")
    scorable = retrain.training_rows(table)
    second = retrain.retrain(table, upload(rows, 2, range(50, 90)), 1, folder, QUICK, FEATURES, k=2, test=scorable, tag="v2")

    tables = retrain.compared(spark, folder)
    found = {(r["release"], r["metric"], r["mission"]): r for r in tables["deltas"].collect()}
    assert found["v1", "n_features", "All"]["delta"] is None and found["v2", "n_features", "All"]["delta"] == 1
    assert sum(r["value"] for (v, m, _), r in found.items() if v == "v2" and m.startswith("weight.")) == pytest.approx(1)
    for name in ("threshold.0", "conformal_q.2", "oof.weighted_pr_auc_macro", "ece"):
        assert found["v2", name, "All"]["value"] is not None
    assert found["v2", "holdout.pr_auc_macro", "All"]["value"] > 0.5

    shift = {(r["release"], r["feature"]): r for r in tables["shift"].collect()}
    assert set(shift) == {("v1", "dur_h"), *(("v2", f) for f in FEATURES)}
    assert shift["v2", "dur_h"]["shift"] == pytest.approx(shift["v2", "dur_h"]["value"] - 0.25)
    assert shift["v2", "period"]["shift"] == shift["v2", "period"]["value"]
    assert {r["release"] for r in tables["card"].collect()} == {"v2"}

    log = {(r["stage"], r["metric"]): r["value"] for r in spark.read.parquet(f"{folder}/quality_log").collect()}
    assert log["read", "batch 1"] == 40
    # models of the release, read again, score with the table's running medians
    again = learn.load_bundle(spark, f"{folder}/release=v2/bundle")
    assert again.medians["dur_h"] == table.medians()["dur_h"] == second.trained.bundle.medians["dur_h"]
    cells = spark.read.parquet(f"{folder}/release=v2/confusion").collect()
    assert cells
