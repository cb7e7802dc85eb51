"""Release comparison: metric rows are ``release, metric, mission, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_releases(releases: DataFrame, n: int = 2) -> DataFrame:
    """The newest release tags, newest first (tags sort by time)."""
    return releases.select("release").distinct().orderBy(F.desc("release")).limit(n)


def metric_deltas(metrics: DataFrame, keys=("metric", "mission")) -> DataFrame:
    """Change of each metric against the previous release, NULL for the first.
    One row per release and metric, so each window stays short."""
    earlier = Window.partitionBy(*keys).orderBy("release")
    previous = F.lag("value").over(earlier)
    return metrics.select(
        "release", *keys, "value", previous.alias("previous"), (F.col("value") - previous).alias("delta")
    )


def attribution_shift(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and release, and its change; a
    feature that is new counts from zero once an earlier release exists."""
    means = attributions.groupBy("release", "feature").agg(F.avg(F.abs("shap")).alias("value"))
    first = means.agg(F.min("release").alias("r")).scalar()
    history = Window.partitionBy("feature").orderBy("release")
    base = F.coalesce(F.lag("value").over(history), F.when(F.col("release") > first, 0.0))
    return means.select("release", "feature", "value", (F.col("value") - base).alias("shift"))


def summary_card(metrics: DataFrame) -> DataFrame:
    """Latest release only."""
    newest = metrics.agg(F.max("release").alias("r")).scalar()
    return metrics.where(F.col("release") == newest)
