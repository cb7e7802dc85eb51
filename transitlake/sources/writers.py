"""Writers. Every write goes to a new path: a job never overwrites what it reads."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.operators import quality


def version_tag(now: dt.datetime | None = None) -> str:
    """Tags sort by time."""
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("v%Y%m%d-%H%M%S-UTC")


def write_unified(df: DataFrame, path: str) -> None:
    """Parquet partitioned by mission, so per-mission reads touch only their part."""
    df.write.mode("errorifexists").partitionBy("mission").parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def write_csv(df: DataFrame, path: str) -> None:
    _flat(df).write.mode("errorifexists").option("header", True).csv(path)


def write_preview(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None, rows: int = 50) -> None:
    """The first rows in a stated order, as one CSV part."""
    head = df.orderBy(*order).limit(rows)
    write_csv(head.select(*(columns or df.columns)), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_roles(df: DataFrame, path: str) -> None:
    roles = quality.column_roles(df.columns)
    rows = [(role, names) for role, names in roles.items()]
    df.sparkSession.createDataFrame(rows, "role string, columns array<string>").write.mode("errorifexists").json(path)


def append_log(log: DataFrame, path: str) -> None:
    """Data-quality rows: ``stage, metric, value``."""
    stamped = log.select("stage", "metric", F.col("value").cast("double").alias("value"), F.current_timestamp().alias("at"))
    stamped.write.mode("append").parquet(path)


def write_medians(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    quality.medians(df, columns or numeric).write.mode("errorifexists").json(path)


def write_version(df: DataFrame, folder: str, tag: str | None = None) -> str:
    """A full copy of a table under ``version=<tag>``; older versions stay as backups.
    The tag enters the index last, so a half-written version is never picked up."""
    tag = tag or version_tag()
    df.write.mode("errorifexists").parquet(f"{folder}/version={tag}")
    row = df.sparkSession.createDataFrame([(tag,)], "tag string")
    row.write.mode("append").parquet(f"{folder}/index")
    return tag


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """Newest tag in the index of ``folder``."""
    try:
        return spark.read.parquet(f"{folder}/index").agg(F.max("tag")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def write_release(tables: dict[str, DataFrame], metrics: DataFrame, folder: str, tag: str | None = None, notes: str = "") -> str:
    """Result tables under ``release=<tag>`` and metric rows in the ``releases`` table.

    The newest release is the largest tag in that table, so no pointer file can go
    stale. ``metrics`` holds ``metric, mission, value``.
    """
    tag = tag or version_tag()
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/release={tag}/{name}")
    rows = metrics.select(F.lit(tag).alias("release"), "metric", "mission", "value", F.lit(notes).alias("notes"))
    rows.write.mode("append").parquet(f"{folder}/releases")
    return tag


