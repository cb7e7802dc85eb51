import json

import pytest
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.operators import quality
from transitlake.plans.build import build_unified, map_catalog
from transitlake.sources import readers, writers

KOI_TEXT = """# remark
# another
rowid,kepid,koi_disposition,koi_period,koi_period_err1,koi_period_err2,koi_time0bk,koi_time0,koi_duration,koi_depth,koi_ror,note
1,10797460,CONFIRMED,9.48803557,2.775e-05,-2.775e-05,170.5,2455003.5,2.9575,615.8,0.022344,"a, quoted"
2,10797460,candidate ,54.4,abc,-0.1,,2455004.5,4.5,874.8,0.03,short
3,11,REFUTED,1.0,0.1,-0.1,1.0,2.0,1.0,1.0,0.1,x
4,12,FALSE POSITIVE,1.0,0.1,-0.1,1.0,2.0,1.0,1.0,0.1,too,many,fields
5,13,FALSE POSITIVE,2.0
"""


@pytest.fixture
def koi_file(tmp_path):
    path = tmp_path / "koi.csv"
    path.write_text(KOI_TEXT)
    return str(path)


def test_read_delimited(spark, koi_file):
    df = readers.read_delimited(spark, koi_file)
    got = {r["rowid"]: r for r in df.collect()}
    assert set(got) == {"1", "2", "3", "5"}
    assert got["1"]["note"] == "a, quoted"
    assert got["5"]["koi_depth"] is None


@pytest.mark.parametrize("separator", [",", "\t", ";"])
def test_separator_is_found(spark, tmp_path, separator):
    path = tmp_path / "t.csv"
    path.write_text("# x\n" + separator.join(["a", "b", "c"]) + "\n" + separator.join("123") + "\n")
    assert readers.read_delimited(spark, str(path)).first().asDict() == {"a": "1", "b": "2", "c": "3"}


def test_unsplittable_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("only\n1\n")
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(path))


def test_map_koi(spark, koi_file):
    mapped = map_catalog(readers.read_delimited(spark, koi_file), S.KOI)
    got = {r["rowid"]: r for r in mapped.collect()}
    assert got[1]["t0_bjd"] == 170.5 and got[2]["t0_bjd"] == 2455004.5
    assert got[2]["period_err1"] is None
    assert got[1]["is_kepler"] == 1 and got[1]["is_tess"] == 0
    assert got[1]["a_over_rs"] is None and got[1]["star_id"] == "10797460"
    errors = 2 * len(S.KOI.measured)
    assert len(mapped.columns) == 5 + 3 + len(S.KOI.measured) + errors + len(S.KOI.plain)


def test_missing_required_column(rows):
    with pytest.raises(ValueError, match="kepid"):
        map_catalog(rows("rowid string", ("1",)), S.KOI)


def test_k2_star_falls_back(rows):
    raw = rows(
        "rowid string, hostname string, epic_hostname string, disposition string",
        ("1", None, "EPIC 7", "CONFIRMED"), ("2", "K2-3", "EPIC 8", "CANDIDATE"), ("3", None, None, "CANDIDATE"),
    )
    got = {r["rowid"]: r["star_id"] for r in map_catalog(raw, S.K2).collect()}
    assert got[1] == "EPIC 7" and got[2] == "K2-3" and got[3].startswith("anon_")


def test_catalog_widths():
    # unified columns per catalog besides labels and bookkeeping
    width = lambda c: 3 + 3 * len(c.measured) + len(c.plain)
    assert [width(c) for c in (S.KOI, S.TOI, S.K2)] == [34, 27, 40]
    assert len(S.FEATURE_COLUMNS) == 65


def test_build_from_files(spark, koi_file, tmp_path):
    toi = tmp_path / "toi.csv"
    toi.write_text("rowid\ttid\ttfopwg_disp\tpl_orbper\tst_rad\n1\t5\tPC\t3.0\t1.0\n2\t6\tKP\t4.0\t0.9\n")
    unified = build_unified(spark, {"koi": koi_file, "toi": str(toi)}, gaia=str(tmp_path / "absent.parquet"))
    got = {(r["mission"], r["rowid"]): r for r in unified.collect()}
    assert set(got) == {("Kepler", 1), ("Kepler", 2), ("Kepler", 5), ("TESS", 1), ("TESS", 2)}
    assert got[("TESS", 2)]["label"] == "Confirmed" and got[("Kepler", 2)]["label_int"] == 1
    assert "geom_transit_prob" in unified.columns


def test_optional_source(spark, tmp_path):
    assert readers.read_optional(spark, None) is None
    assert readers.read_optional(spark, str(tmp_path / "none.csv")) is None
    assert readers.read_optional(spark, str(tmp_path / "none.parquet")) is None


def test_json_lines_and_settings(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"row_index": 1, "star_id": "a", "proba": [0.1, 0.2, 0.7]}\n{broken\n')
    got = readers.read_json_lines(spark, str(path)).collect()
    assert len(got) == 1 and got[0]["proba"] == [0.1, 0.2, 0.7]
    settings = tmp_path / "m.json"
    settings.write_text(json.dumps({"medians": {"a": 1.5, "b": 2}}, indent=2))
    found = {r["key"]: r["value"] for r in readers.read_settings(spark, str(settings), "medians").collect()}
    assert found == {"a": 1.5, "b": 2.0}


def test_writers(spark, rows, tmp_path):
    df = rows(
        "mission string, feed_ord int, rowid int, star_id string, period double, ror double, s array<int>",
        *[("Kepler", 0, i, f"s{i}", float(i), 0.1, [i, 1]) for i in range(60)],
    )
    writers.write_unified(df, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).where("mission = 'Kepler'").count() == 60
    writers.write_preview(df, str(tmp_path / "p"), ["feed_ord", "rowid"])
    preview = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert preview.count() == 50 and preview.agg(F.max(F.col("rowid").cast("int"))).first()[0] == 49
    assert preview.orderBy(F.col("rowid").cast("int")).first()["s"] == "[0,1]"
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 60
    writers.append_log(rows("stage string, metric string, value bigint", ("a", "b", 1)), str(tmp_path / "l"))
    writers.append_log(rows("stage string, metric string, value bigint", ("a", "b", 2)), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    writers.write_medians(df, str(tmp_path / "m"), ["period"])
    assert spark.read.json(str(tmp_path / "m")).first()["value"] == 29.5
    writers.write_roles(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 5


def test_versions_and_releases(spark, rows, tmp_path):
    df = rows("a int", (1,))
    folder = str(tmp_path / "v")
    assert writers.latest_version(spark, folder) is None
    writers.write_version(df, folder, "v20250101-000000-UTC")
    writers.write_version(df, folder, "v20250201-000000-UTC")
    assert writers.latest_version(spark, folder) == "v20250201-000000-UTC"
    metrics = rows("metric string, mission string, value double", ("pr_auc_macro", "All", 0.8))
    tag = writers.write_release({"scored": df}, metrics, str(tmp_path / "rel"), notes="first")
    assert spark.read.parquet(str(tmp_path / "rel" / "releases")).first()["release"] == tag


def test_roles():
    roles = quality.column_roles(["rowid", "period", "period_err_mean", "depth_snr", "is_kepler", "label", "label_int"])
    assert roles["uncertainty_bundles"] == ["period_err_mean"]
    assert roles["engineered_features"] == ["depth_snr"]
    assert roles["raw_features"][:3] == ["rowid", "period", "depth_snr"]
    assert "gaia_gmag" in roles["raw_features"]


def test_name_table(spark, tmp_path):
    path = tmp_path / "names.json"
    path.write_text(json.dumps([{"ra": 1.0, "dec": 2.0, "toi": "7.01"}, {"ra": 3.0, "dec": 2.0, "toi": None}], indent=1))
    got = readers.read_names(spark, str(path), "TESS").orderBy("order").collect()
    assert [r["ra"] for r in got] == [1.0, 3.0] and got[0]["mission"] == "TESS"
