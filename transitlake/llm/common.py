"""What the operators share: tables, intermediate tables, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.session import checkpoint_folder

#: a word: a run of characters other than the six ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"
#: rows and bytes that one Arrow batch may hold, so that a Python worker's memory is bounded
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: the
    lineage ends there, and a lost executor costs a re-read."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As :func:`stored`, in as many buckets of ``key`` as shuffles have partitions: grouping by
    ``key`` reads them where they lie, and only what they meet is shuffled."""
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved: the files are enough from here on, the name is given back
    spark.sql(f"DROP TABLE {name}")
    return found


def without(df: DataFrame, *names: str) -> DataFrame:
    """Input columns that carry an output's name give way to the output."""
    return df.drop(*names)


def blank_null(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Words of a text, none in a null."""
    return F.regexp_count(blank_null(column), F.lit(WORD)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone: reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)
