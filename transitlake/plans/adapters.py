"""Shape general-purpose tables into catalog-like inputs.

The operators take column names, so any table can feed them; these adapters turn
order lines into three catalog feeds, customers and suppliers into two position
tables, and so on. Every adapter reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.labels import mission_flags

LINE_KEY = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
]
FEED_ORDER = ["feed_ord", *LINE_KEY]
RETURN_FLAGS = {"A": "Kepler", "R": "TESS", "N": "K2"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _by_mission(values: dict[str, Column]) -> Column:
    flag = F.col("l_returnflag")
    out = F.when(flag == "A", values["Kepler"]).when(flag == "R", values["TESS"])
    return out.when(flag == "N", values["K2"])


def _dispositions(texts: list[str]) -> Column:
    status = F.col("o_orderstatus")
    return F.when(status == "F", texts[0]).when(status == "O", texts[1]).when(status == "P", texts[2])


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """All three feeds in one scan, ``mission`` and ``feed_ord`` telling them apart."""
    c = F.col
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    joined = lines.join(orders, c("l_orderkey") == c("o_orderkey"))
    long_text = _dispositions(["False  Positive", " candidate", "CONFIRMED"])
    short_text = _dispositions(["FP", "PC ", "cp"])
    refuted = (c("o_orderpriority") == "4-NOT SPECIFIED") & (c("o_orderstatus") == "P")
    not_tess = c("l_returnflag") != "R"
    return joined.select(
        _by_mission({m: F.lit(i) for i, m in enumerate(S.MISSIONS)}).alias("feed_ord"),
        _by_mission({m: F.lit(m) for m in S.MISSIONS}).alias("mission"),
        *LINE_KEY,
        c("l_partkey").cast("string").alias("star_id"),
        F.when(refuted, "REFUTED")
        .otherwise(_by_mission({"Kepler": long_text, "TESS": short_text, "K2": long_text}))
        .alias("label_raw"),
        F.nullif(c("l_quantity"), F.lit(50.0)).alias("period"),
        F.datediff(c("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("t0_bjd"),
        (1 + c("l_tax") * 100).alias("dur_h"),
        (F.nullif(c("l_tax"), F.lit(0.0)) * 10).alias("dur_h_err1"),
        (c("l_tax") * -10).alias("dur_h_err2"),
        (c("l_extendedprice") / 10).alias("depth_ppm"),
        (c("l_extendedprice") * c("l_discount") / 20).alias("depth_ppm_err1"),
        (-c("l_extendedprice") * c("l_discount") / 20).alias("depth_ppm_err2"),
        F.when(not_tess, F.sqrt("l_extendedprice") / 300).alias("ror"),
        F.when(not_tess, c("l_discount") * 15).alias("impact"),
        F.when(not_tess, 80 + c("l_tax") * 150).alias("incl_deg"),
        (0.5 + c("l_discount") * 20).alias("rad_Rs"),
        F.nullif(0.5 + c("l_tax") * 10, F.lit(0.5)).alias("mass_Ms"),
        (3500 + c("l_quantity") * 100).alias("teff_K"),
        (3.5 + c("l_discount") * 10).alias("logg_cgs"),
        (c("l_tax") * 5).alias("ecc"),
        (2 + c("l_quantity")).alias("a_over_rs"),
        (0.5 + c("l_quantity") / 10).alias("rade_Re"),
        (c("l_extendedprice") / 500).alias("insol_S"),
        F.nullif(c("l_quantity") * 20, F.lit(200.0)).alias("eqt_K"),
        (c("l_discount") * 100 - 5).alias("pm_ra_masyr"),
        (c("l_tax") * 100 - 4).alias("pm_dec_masyr"),
        (8 + c("l_tax") * 50).alias("mag_T"),
        (9 + c("l_discount") * 40).alias("mag_Kepler"),
    )


def separate_feeds(spark: SparkSession, folder: str) -> list[DataFrame]:
    """One frame per catalog; the TESS one lacks the columns that catalog lacks."""
    every = feeds(spark, folder)
    out = []
    for mission in S.MISSIONS:
        one = every.where(F.col("mission") == mission).withColumns(mission_flags(mission))
        out.append(one.drop("ror", "impact", "incl_deg") if mission == "TESS" else one)
    return out


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Probability triples with a true class, and the columns decisions look at."""
    c = F.col
    total = 3 + c("l_quantity") + c("l_discount") * 500 + c("l_tax") * 600
    y = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        c("l_partkey").cast("string").alias("star_id"),
        y.alias("y"),
        F.when(c("l_linestatus") == "F", "Kepler").otherwise("TESS").alias("mission"),
        ((1 + c("l_quantity")) / total).alias("p_fp"),
        ((1 + c("l_discount") * 500) / total).alias("p_cand"),
        ((1 + c("l_tax") * 600) / total).alias("p_conf"),
        (F.sqrt("l_extendedprice") / 300).alias("ror"),
        (c("l_discount") * 15).alias("impact"),
        F.nullif(c("l_extendedprice") / 5000, F.lit(0.0)).alias("depth_snr"),
        F.nullif(c("l_discount"), F.lit(0.0)).alias("geom_transit_prob"),
        F.nullif(c("l_tax") * 10, F.lit(0.0)).alias("dur_consistency"),
        F.nullif(c("l_quantity"), F.lit(50.0)).alias("period"),
        (0.5 + c("l_quantity") / 10).alias("rade_Re"),
    )


def graded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Real binary labels with a length score."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    longest = documents.agg(F.max("n_chars").alias("m")).scalar()
    return labels.join(documents, "doc_id").select(
        "doc_id", "quality", F.round(F.col("n_chars") / longest, 3).alias("score")
    )


def _ra(key: str) -> Column:
    return F.pmod(F.col(key) * 137.50776405, F.lit(360.0))


def _dec(key: str) -> Column:
    turn = F.col(key) * 0.6180339887
    return F.degrees(F.asin(2 * (turn - F.floor(turn)) - 1))


def sky_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("star_id"),
        _by_segment().alias("mission"),
        _ra("c_custkey").alias("ra_deg"),
        _dec("c_custkey").alias("dec_deg"),
        (F.nullif(F.col("c_nationkey"), F.lit(0)) * 10.0).alias("dist_pc"),
        F.col("c_acctbal").alias("value"),
    )


def _by_segment() -> Column:
    return (
        F.when(F.col("c_mktsegment") == "BUILDING", "Kepler")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "TESS")
        .otherwise("K2")
    )


def sky_catalog(spark: SparkSession, folder: str) -> DataFrame:
    shift = F.when(F.col("s_suppkey") % 2 == 0, 0.0002).otherwise(0.01)
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("source_id"),
        F.pmod(_ra("s_suppkey") + shift, F.lit(360.0)).alias("ra"),
        _dec("s_suppkey").alias("dec"),
        F.col("s_acctbal").alias("parallax"),
        F.col("s_nationkey").cast("double").alias("phot_g_mean_mag"),
        F.col("s_name").alias("name"),
    )


def event_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events as upload rows: a (star, period) key per user and event type."""
    kinds = F.xxhash64("event_type")
    return table(spark, folder, "events").select(
        F.to_date("ts").alias("day"),
        F.col("user_id").cast("string").alias("star_id"),
        F.col("event_type").alias("period"),
        F.col("value"),
        F.col("ts"),
        F.col("event_id").alias("ingest_seq"),
        kinds.alias("kind"),
    ).drop("kind")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """64 numeric features, three classes, groups of rows sharing a star."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("vec_id") % 50).cast("string").alias("star_id"),
        (F.col("label") % 3).alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)],
    )
