"""Session settings and the lineage-cutting helper."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "transitlake", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def tune(spark: SparkSession) -> None:
    """Fall back to split projections where one generated method would be too large
    for HotSpot to compile (8000 bytes): the wide feature stages run several times
    faster that way. A value set by the user is left alone."""
    if spark.conf.get(METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local run may go without the setting; it uses its own warehouse folder. A
    cluster without it is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that a lost executor
    costs a re-read and not a recomputation of everything above it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: lineage ends there as with
    :func:`cut_lineage`, and later passes read just the columns that they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: independent jobs that the driver submits at once
AT_ONCE = 8


def side_by_side(jobs: list[Callable]) -> list:
    """The results of independent calls, submitted from threads, so that the stages of one
    fill the gaps of the others."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(job)) for job in jobs]
        return [r.result() for r in running]
