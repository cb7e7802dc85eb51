"""Deterministic one-row-per-key operators.

``row_number() = 1`` plans as a limit per key that already runs before the
shuffle, so a key held by a third of all rows sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """First row of each key in the given order; missing keys equal each other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.col(c).asc_nulls_last() for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.col(c).desc_nulls_last() for c in order])


def drop_repeats(df: DataFrame, order=("feed_ord", "rowid")) -> DataFrame:
    """One row per star, period and epoch: the first in feed order."""
    keys = [c for c in ("star_id", "period", "t0_bjd") if c in df.columns]
    return keep_first(df, keys, list(order)) if keys else df


def upsert(current: DataFrame, new: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Union by name, then the latest row per star and period."""
    both = current.unionByName(new, allowMissingColumns=True)
    keys = [c for c in ("star_id", "period") if c in both.columns]
    ties = [F.col(order).desc()] + [F.xxhash64(*[F.col(c) for c in sorted(both.columns)]).asc()]
    return keep_one(both, keys, ties) if keys else both


def one_per_host(df: DataFrame, order: list[str]) -> DataFrame:
    """First row seen per host: catalog id, host name or position."""
    spot = F.concat_ws("_", F.col("ra_deg").cast("string"), F.col("dec_deg").cast("string"))
    named = [F.col(c).cast("string") for c in ("kepid", "hostname") if c in df.columns]
    return keep_first(df.withColumn("_host", F.coalesce(*named, spot)), ["_host"], order).drop("_host")


def stack_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Union by name; a column absent from a feed is missing there."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out
