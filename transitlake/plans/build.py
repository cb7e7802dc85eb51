"""Catalog files or frames to the unified table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.features import add_bundles, add_catalog_features
from transitlake.functions.labels import anonymous_id, mission_flags, with_classes
from transitlake.functions.numbers import clean_numbers, optional, to_number
from transitlake.functions.physics import add_physics
from transitlake.operators.dedup import drop_repeats, stack_feeds
from transitlake.operators.filters import labelled, plausible, positive
from transitlake.operators.quality import require_one_mission, winsorize
from transitlake.operators.skymatch import match_catalogs
from transitlake.session import tune


def map_catalog(raw: DataFrame, catalog: S.Catalog) -> DataFrame:
    """Rename and type one source catalog into unified columns."""
    absent = [c for c in catalog.required if c not in raw.columns]
    if absent:
        raise ValueError(f"{catalog.name}: required columns are missing: {absent}")
    text = lambda name: optional(raw, name, "string")
    star = F.coalesce(*[text(c) for c in catalog.star_id])
    columns = {
        "mission": F.lit(catalog.mission),
        "feed_ord": F.lit(catalog.feed_order),
        "rowid": F.col("rowid").try_cast("bigint"),
        "star_id": F.coalesce(star, anonymous_id(raw)),
        "label_raw": F.col(catalog.disposition).cast("string"),
    }
    for unified, source in catalog.measured.items():
        backup = catalog.fallbacks.get(unified)
        value = to_number(text(source))
        columns[unified] = F.coalesce(value, to_number(text(backup))) if backup else value
        for n in (1, 2):
            name = catalog.error_name(source, n)
            if backup and name not in raw.columns:
                name = catalog.error_name(backup, n)
            columns[f"{unified}_err{n}"] = to_number(text(name))
    for unified, source in catalog.plain.items():
        columns[unified] = to_number(text(source))
    mapped = raw.select(*[value.alias(name) for name, value in columns.items()])
    return mapped.withColumns(mission_flags(catalog.mission))


def enrich(df: DataFrame) -> DataFrame:
    """Labels, bundles and features, then the plausibility filter. Map-only."""
    out = clean_numbers(with_classes(df), S.NUMERIC_INPUTS)
    return plausible(add_catalog_features(add_bundles(out)))


def unify(
    feeds: list[DataFrame],
    clip_outliers: bool = True,
    require_positive: bool = False,
    physics: bool = True,
    gaia: DataFrame | None = None,
    tic: DataFrame | None = None,
    order=("feed_ord", "rowid"),
    approximate: bool = False,
) -> DataFrame:
    """Mapped feeds to the unified table: union, clip per mission, match, keep
    labelled rows, drop repeats, add the physical columns."""
    stacked = stack_feeds([enrich(f) for f in feeds])
    if require_positive:
        stacked = positive(stacked)
    if clip_outliers:
        stacked = winsorize(stacked, by=["mission"], approximate=approximate)
    matched = match_catalogs(require_one_mission(stacked), gaia, tic)
    unique = drop_repeats(labelled(matched), order)
    return add_physics(unique) if physics else unique


def build_unified(spark: SparkSession, paths: dict[str, str], gaia: str | None = None, tic: str | None = None, **options) -> DataFrame:
    """``paths`` maps catalog names (koi, toi, k2) to files or folders."""
    from transitlake.sources.readers import read_delimited, read_optional

    tune(spark)
    feeds = [map_catalog(read_delimited(spark, path), S.CATALOGS[name]) for name, path in paths.items()]
    return unify(feeds, gaia=read_optional(spark, gaia), tic=read_optional(spark, tic), **options)
