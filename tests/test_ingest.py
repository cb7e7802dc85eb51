import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.operators import dedup, running
from transitlake.sources.readers import read_delimited
from transitlake.streaming import ingest

SAMPLE = (
    "mission,star_id,label_int,period,dur_h,depth_ppm,ror,impact,rad_Rs\n"
    "Kepler,TEST001,Candidate,3.50,2.4,900,0.12,0.35,1.0\n"
    "Kepler,TEST002,,4.50,2.0,800,0.10,0.25,1.0\n"
)
NAMES = SAMPLE.splitlines()[0].split(",")


def upload(spark, tmp_path, text, name="u.csv"):
    path = tmp_path / name
    path.write_text(text)
    return read_delimited(spark, str(path))


def test_upload_without_label_is_pool_only(spark, tmp_path):
    labelled, unlabelled = ingest.prepare(upload(spark, tmp_path, SAMPLE))
    assert [r["star_id"] for r in labelled.collect()] == ["TEST001"]
    pool = unlabelled.collect()
    assert [r["star_id"] for r in pool] == ["TEST002"] and pool[0]["label_int"] is None


def test_normalise_names(spark, tmp_path):
    text = "KepID,koi_period,kepmag,Tmag,koi_score,label_int\n7,1.5,11.0,12.0,0.9, Conf \n"
    row = ingest.normalise_upload(upload(spark, tmp_path, text)).first()
    assert row["star_id"] == "7" and row["period"] == "1.5" and row["mag_Kepler"] == "11.0"
    assert row["label_int"] == 2 and "koi_score" not in row.asDict()
    # several hints, one flag
    assert (row["is_tess"], row["is_k2"], row["is_kepler"]) == (1, 0, 0)


def test_contradicting_rows_are_rejected_and_counted(spark, tmp_path):
    text = "star_id,period,ror,label_int,is_tess,is_k2\na,1.5,0.1,Candidate,1,0\nb,2.5,0.1,,0,1\nc,3.5,0.1,Candidate,1,1\nd,-1,0.1,Candidate,1,0\n"
    table = ingest.IngestTable(spark, str(tmp_path / "table"))
    table.append(upload(spark, tmp_path, text), 0)
    table.append(upload(spark, tmp_path, text), 0)  # a replay changes nothing
    assert [r["star_id"] for r in table.current().collect()] == ["a"]
    rejects = spark.read.parquet(str(tmp_path / "table" / "rejects")).collect()
    assert [(r["star_id"], r["reject_reason"]) for r in rejects] == [("c", "a row carries more than one mission flag")]
    log = {r["stage"]: r["value"] for r in table.quality_log().collect()}
    assert log == {"read": 4, "labelled": 1, "without_label": 1, "rejected": 1, "filtered": 1}
    with pytest.raises(Exception, match="more than one mission flag"):
        table.append(upload(spark, tmp_path, text), 1, strict=True)


def test_anonymous_ids_are_stable(rows):
    a = ingest.normalise_upload(rows("period string", ("1",), ("2",))).orderBy("period").collect()
    b = ingest.normalise_upload(rows("period string", ("2",), ("1",))).orderBy("period").collect()
    assert [r["star_id"] for r in a] == [r["star_id"] for r in b]
    assert a[0]["star_id"] != a[1]["star_id"] and a[0]["star_id"].startswith("anon_")


@pytest.mark.parametrize("label, want", [("fp", 0), ("False Positive", 0), (" CAND ", 1), ("2", 2), ("1.0", 1), ("??", None)])
def test_upload_labels(rows, label, want):
    got = ingest.normalise_upload(rows("star_id string, label_int string", ("a", label))).first()
    assert got["label_int"] == want


def test_batches_equal_one_shot(rows):
    schema = "star_id string, period double, value int, ingest_seq bigint"
    data = [("a", 1.0, 1, 1), ("b", None, 2, 1), ("a", 1.0, 3, 2), ("b", None, 4, 3), ("c", 2.0, 5, 3)]
    merged = None
    for seq in (1, 2, 3):
        merged = ingest.merge_batch(merged, rows(schema, *[d for d in data if d[3] == seq]))
    whole = ingest.merge_batch(None, rows(schema, *data))
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    assert {r["star_id"]: r["value"] for r in merged.collect()} == {"a": 3, "b": 4, "c": 5}


def test_upsert_takes_new_columns(rows):
    old = rows("star_id string, period double, ingest_seq bigint", ("a", 1.0, 1))
    new = rows("star_id string, period double, ingest_seq bigint, extra int", ("a", 1.0, 2, 9), ("b", 1.0, 2, 8))
    got = {r["star_id"]: r["extra"] for r in dedup.upsert(old, new).collect()}
    assert got == {"a": 9, "b": 8}


def test_stream_of_files(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in NAMES])
    table = ingest.IngestTable(spark, str(folder))
    assert table.current() is None
    run = lambda: table.ingest_new_files(str(source), str(tmp_path / "cp"))

    (source / "a.csv").write_text(SAMPLE)
    run()
    assert table.current().count() == 1 and table.pool().count() == 1
    run()
    assert table.current().count() == 1
    (source / "b.csv").write_text(SAMPLE.replace("Candidate", "Confirmed").replace("TEST002,,", "TEST003,fp,"))
    run()
    got = {r["star_id"]: r["label_int"] for r in table.current().collect()}
    assert got == {"TEST001": 2, "TEST003": 0}

    before = sorted(map(str, table.current().select("star_id", "label_int", "period").collect()))
    table.compact("v20250101-000000-UTC")
    after = sorted(map(str, table.current().select("star_id", "label_int", "period").collect()))
    assert before == after
    # a replayed batch changes nothing
    table.append(spark.read.schema(schema).option("header", True).csv(str(source / "b.csv")), 1)
    assert sorted(map(str, table.current().select("star_id", "label_int", "period").collect())) == before
    assert table.pool().count() == 1


def test_process_catalog(rows):
    raw = rows(
        "rowid string, tid string, tfopwg_disp string, pl_orbper string, pl_tranmid string",
        ("1", "5", "PC", "3.0", "1.0"), ("2", "5", "PC", "3.0", "1.0"), ("3", "6", "??", "3.0", "1.0"),
    )
    got = ingest.process_catalog(raw, S.TOI).collect()
    assert [r["rowid"] for r in got] == [1]
    assert ingest.with_mission(ingest.process_catalog(raw, S.TOI)).select(F.col("mission")).first()[0] == "TESS"


def test_upload_faults(rows):
    """A given star id with a renamed column, given flags with hints, labels out of range."""
    raw = rows(
        "star_id string, tmag string, koi_period string, is_k2 string, label_int string",
        (None, "1", "2", "1", "7"), ("s", "1", "2", None, "-1"), ("t", "1", "2", "1", "1"),
    )
    got = sorted(ingest.normalise_upload(raw).collect(), key=lambda r: r["star_id"])
    assert got[0]["star_id"].startswith("anon_") and [r["star_id"] for r in got[1:]] == ["s", "t"]
    assert [(r["is_tess"], r["is_k2"], r["is_kepler"]) for r in got] == [(0, 1, 0), (0, 0, 0), (0, 1, 0)]
    assert [r["label_int"] for r in got] == [None, None, 1]
    both = rows("star_id string, is_k2 string, is_tess string", ("a", "1", "1"))
    with pytest.raises(Exception, match="more than one mission flag"):
        ingest.normalise_upload(both).collect()


def test_folder_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rowid,kepid\n1,10\n2,20\n")
    (tmp_path / "b.csv").write_text("# remark\nkepid,rowid,more\n30,3,x\n")
    got = read_delimited(spark, str(tmp_path)).collect()
    assert sorted((r["rowid"], r["kepid"], r["more"]) for r in got) == [("1", "10", None), ("2", "20", None), ("3", "30", "x")]


def test_stream_reads_each_header_and_keeps_the_last_line(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    head = "star_id,label_int,period,depth_ppm,ror,dur_h,impact,rad_Rs"
    lines = [f"K{i % 8},{i % 3},1.5,{1000 + i},0.1,2,0.1,1" for i in range(40)]
    (source / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    (source / "b.csv").write_text("label_int,star_id,toi_period,depth_ppm,ror,dur_h,impact,rad_Rs\n2,Z,9.5,700,0.1,2,0.1,1\n")
    table = ingest.IngestTable(spark, str(tmp_path / "t"))
    table.ingest_new_files(str(source), str(tmp_path / "cp"))
    got = {r["star_id"]: (r["label_int"], r["period"], r["is_tess"]) for r in table.current().collect()}
    assert got == {**{f"K{i}": ((32 + i) % 3, 1.5, 0) for i in range(8)}, "Z": (2, 9.5, 1)}
    assert sum(r["value"] for r in table.counts().collect()) == 41
    medians = spark.read.json(table.refresh_medians(["period"])).collect()
    assert [(r["key"], r["value"]) for r in medians] == [("period", 1.5)]


def test_clipping_stays_inside_a_file(rows):
    schema = "star_id string, period string, depth_ppm string, ror string, dur_h string, _file string"
    small = [(f"a{i}", "1", "100", "0.1", "2", "a") for i in range(40)]
    large = [(f"b{i}", "1", "90000", "0.1", "2", "b") for i in range(40)]
    alone = ingest.engineer(ingest.normalise_upload(rows(schema, *large)))
    together = ingest.engineer(ingest.normalise_upload(rows(schema, *small, *large)))
    pick = lambda df: sorted(r["depth_ppm"] for r in df.where("_file = 'b'").collect())
    assert pick(alone) == pick(together)


def test_catalog_file_enters_the_table(spark, rows, tmp_path):
    raw = rows(
        "rowid string, tid string, tfopwg_disp string, pl_orbper string, pl_tranmid string",
        ("1", "5", "PC", "3.0", "1.0"), ("3", "6", "CP", "4.0", "1.0"),
    )
    table = ingest.IngestTable(spark, str(tmp_path / "t"))
    table.append_catalog(raw, S.TOI, 1)
    table.append_catalog(raw.withColumn("tfopwg_disp", F.lit("FP")), S.TOI, 2)
    assert sorted((r["star_id"], r["label_int"]) for r in table.current().collect()) == [("5", 0), ("6", 0)]


def median(values):
    held = sorted(values)
    return (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2


def test_running_medians_are_exact(spark, rows, tmp_path):
    """Signs, halves, tiny steps, far magnitudes, values that leave again and missing ones."""
    rng = random.Random(3)
    near = [1.5 + i * 2.0**-52 for i in range(40)]
    draw = lambda: (rng.uniform(-5, 5), rng.choice(near), 10 ** rng.uniform(-300, 300), rng.choice([0.0, -0.0, None]), None)
    frame = lambda held: rows("a double, b double, c double, d double, e double", *held)
    folder, held = str(tmp_path), []
    for batch in range(3):
        gone = [held.pop(rng.randrange(len(held))) for _ in range(len(held) // 2)]
        new = [draw() for _ in range(rng.randrange(30, 61))]
        running.write_changes(running.changes(frame(new), frame(gone) if gone else None, list("abcde")), folder, batch)
        held += new
    got = running.medians(spark.read.parquet(f"{folder}/bins"), spark.read.parquet(f"{folder}/values"))
    assert got == {c: median([v[i] for v in held if v[i] is not None]) for i, c in enumerate("abcd")}


def test_changes_of_rows_beside_their_former_ones(rows):
    """As if the rows that leave came in a table of their own."""
    new = rows("k int, a double, b double, _a double, _b double", (1, 1.0, 2.0, None, None), (2, 1.0, None, 3.0, 2.0), (3, 4.0, 5.0, 4.0, None))
    gone = rows("a double, b double", (3.0, 2.0), (4.0, None))
    told = lambda df: sorted(map(tuple, df.collect()))
    beside = told(running.changes(new, None, ["a", "b"], {"a": "_a", "b": "_b"}))
    assert beside == told(running.changes(new, gone, ["a", "b"])) == [("a", 1.0, 2), ("a", 3.0, -1), ("b", 5.0, 1)]


def test_values_are_shuffled_once(spark, rows, tmp_path, monkeypatch):
    """The counting puts a value in one task; the files keep those tasks, each in order."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: pytest.fail("values are shuffled again"))
    running.write_changes(running.changes(rows("a double", *[(float(i % 70),) for i in range(100)]), None, ["a"]), str(tmp_path), 0)
    for file in (tmp_path / "values" / "batch_id=0").glob("*.parquet"):
        held = [r.value for r in spark.read.parquet(str(file)).collect()]
        assert held == sorted(held)
    assert running.medians(spark.read.parquet(f"{tmp_path}/bins"), spark.read.parquet(f"{tmp_path}/values")) == {"a": 24.5}


def test_medians_follow_the_table(spark, rows, tmp_path):
    """Upserts over several batches, a replay and a compaction: as if read anew."""
    rng = random.Random(4)
    table = ingest.IngestTable(spark, str(tmp_path / "t"))
    schema = "star_id string, period string, depth_ppm string, dur_h string, ror string, label_int string"
    batches = []
    for _ in range(3):
        stars = [(f"s{rng.randrange(30)}", rng.choice(["1.5", "2.5", None]), str(rng.randrange(100, 999)), str(rng.uniform(1, 9)), "0.1", "Candidate") for _ in range(25)]
        batches.append(rows(schema, *dict((s[:2], s) for s in stars).values()))
    fresh = lambda: {c: median([r[c] for r in table.current().collect() if r[c] is not None]) for c in ("depth_ppm", "dur_h")}
    known = lambda: {c: v for c, v in table.medians().items() if c in ("depth_ppm", "dur_h")}
    assert table.medians() == {}
    for number, batch in enumerate(batches):
        table.append(batch, number)
        assert known() == fresh()
        if number == 1:
            table.append(batches[0], 0)
            table.compact()
            assert known() == fresh()
    table.refresh_medians(["dur_h"])
    assert {r["key"]: r["value"] for r in table.latest_medians().collect()} == {"dur_h": fresh()["dur_h"]}


def test_refresh_reads_no_rows_of_the_table(spark, rows, tmp_path):
    table = ingest.IngestTable(spark, str(tmp_path / "t"))
    table.append(rows("star_id string, period string, ror string, label_int string", ("a", "1.5", "0.1", "Candidate")), 0)
    (tmp_path / "t" / "log").rename(tmp_path / "away")
    assert table.medians()["period"] == 1.5
