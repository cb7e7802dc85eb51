"""Position joins.

A distance condition alone plans as a nested-loop join over every pair. Both
joins here become equi-joins on a grid cell, and the exact condition is checked
on the pairs that share one. A cell is ``CELL`` times as wide as the reach, so a
position lies in one cell and only near an edge in another one; the catalog,
which is the large side, has one cell per row, is never copied and is shuffled
once. Rows at one and the same position are looked up once.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions.geometry import cartesian

ARCSEC = math.pi / 180 / 3600
AXES = ["x", "y", "z"]
#: width of a cell in reaches, and shares into which rows without a key are spread
CELL, SPREAD = 32, 1024


def cell(axes: dict[str, Column], width: float) -> Column:
    """The cell that a point lies in."""
    return F.struct(*[F.floor(c / width).alias(a) for a, c in axes.items()])


def cells_within(axes: dict[str, Column], width: float, reach: float) -> Column:
    """All cells that a point's surroundings touch: one, but near an edge."""
    sides = product(*[[F.floor((c + s) / width).alias(a) for s in (-reach, reach)] for a, c in axes.items()])
    return F.array_distinct(F.array(*[F.struct(*corner) for corner in sides]))


def left_on(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``; rows with a missing key match nothing and are spread over the
    tasks instead of meeting in one."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    spread = F.when(missing, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    joined = df.withColumn("_spread", spread).join(side.withColumn("_spread", F.lit(0).cast("long")), [*keys, "_spread"], "left")
    return joined.drop("_spread")


def nearest_on_sky(
    df: DataFrame,
    catalog: DataFrame,
    payload: dict[str, str],
    source_id: str,
    radius_arcsec: float = 2.0,
    ra: str = "ra_deg",
    dec: str = "dec_deg",
    catalog_ra: str = "ra",
    catalog_dec: str = "dec",
) -> DataFrame:
    """Left join of the nearest catalog source closer than the radius.

    ``payload`` maps catalog columns to output columns; ``sep_arcsec`` is added.
    Ties go to the smallest ``source_id``. Sources at one position are told apart only
    among the pairs, whose minimum is partly taken map-side.
    """
    reach = 2 * math.sin(radius_arcsec * ARCSEC / 2)
    width = reach * CELL
    axes = {a: F.col(a) for a in AXES}
    unit = cartesian(F.col(ra), F.col(dec))
    spots = df.select(ra, dec).dropna().distinct().withColumns(unit)
    spots = spots.withColumn("cell", F.explode(cells_within(axes, width, reach * 1.0001)))

    columns = F.struct(F.col(source_id).alias("_id"), *[F.col(c).alias(f"_p_{c}") for c in payload])
    sources = (
        catalog.where(F.col(catalog_ra).isNotNull() & F.col(catalog_dec).isNotNull())
        .select(columns.alias("source"), F.col(catalog_ra).alias("_ra"), F.col(catalog_dec).alias("_dec"))
        .withColumns(cartesian(F.col("_ra"), F.col("_dec")))
        .select(cell(axes, width).alias("cell"), "source", *[F.col(a).alias(f"_{a}") for a in AXES])
    )
    squares = [F.pow(F.col(a) - F.col(f"_{a}"), F.lit(2)) for a in AXES]
    chord = F.sqrt(squares[0] + squares[1] + squares[2])
    separation = 2 * F.asin(chord / 2) / ARCSEC
    matched = (
        spots.join(sources, "cell")
        .withColumn("sep", separation)
        .where(F.col("sep") < radius_arcsec)
        .groupBy(ra, dec)
        .agg(F.min(F.struct("sep", "source")).alias("_best"))
    )
    return left_on(df, matched, [ra, dec]).select(
        *[F.col(c) for c in df.columns],
        *[F.col(f"_best.source._p_{c}").alias(out) for c, out in payload.items()],
        F.col("_best.sep").alias("sep_arcsec"),
    )


# fixed values: catalog column -> output column
GAIA_PAYLOAD = {"source_id": "gaia_source_id", "parallax": "gaia_parallax", "phot_g_mean_mag": "gaia_gmag"}
TIC_PAYLOAD = {"ID": "tic_id", "Tmag": "tic_Tmag", "rad": "tic_st_rad", "mass": "tic_st_mass"}


def match_catalogs(
    df: DataFrame, gaia: DataFrame | None = None, tic: DataFrame | None = None, radius_arcsec: float = 2.0
) -> DataFrame:
    """Attach Gaia-like and TIC-like columns; an absent catalog is skipped."""
    for catalog, payload, key in ((gaia, GAIA_PAYLOAD, "source_id"), (tic, TIC_PAYLOAD, "ID")):
        if catalog is not None:
            df = nearest_on_sky(df, catalog, payload, key, radius_arcsec).drop("sep_arcsec")
    return df


def unmatched_counts(df: DataFrame) -> DataFrame:
    """Rows without a match, per catalog attached: ``stage, metric, value``."""
    found = {n: c for n, c in (("gaia", "gaia_source_id"), ("tic", "tic_id")) if c in df.columns}
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(n) for n, c in found.items()])
    return counts.select(
        F.explode(F.create_map(*[x for n in found for x in (F.lit(n), F.col(n))])).alias("metric", "value")
    ).select(F.lit("unmatched").alias("stage"), "metric", "value")


def name_by_box(
    df: DataFrame,
    reference: DataFrame,
    names: list,
    order: str,
    box: float = 0.01,
    default: str = "Unlabeled Object",
) -> DataFrame:
    """Name of the first reference row (by ``order``) whose position differs by
    less than ``box`` degrees in both coordinates; ``mission`` must agree.

    ``names`` are columns or expressions over the reference, best first.
    """
    width, reach = CELL * box, box * 1.0001
    spots = df.select("mission", "ra_deg", "dec_deg").dropna().distinct()
    touched = cells_within({"i": F.col("ra_deg"), "j": F.col("dec_deg")}, width, reach)
    spots = spots.withColumn("_cell", F.explode(touched))
    picked = F.coalesce(*[F.col(n) if isinstance(n, str) else n for n in names])
    boxes = reference.select(
        F.col("mission").alias("_mission"), F.col("ra").alias("_ra"), F.col("dec").alias("_dec"),
        F.struct(F.col(order).alias("_order"), picked.alias("_name")).alias("_ref"),
        cell({"i": F.col("ra"), "j": F.col("dec")}, width).alias("_box"),
    )
    same_box = (F.col("mission") == F.col("_mission")) & (F.col("_cell") == F.col("_box"))
    near = (F.abs(F.col("_ra") - F.col("ra_deg")) < box) & (F.abs(F.col("_dec") - F.col("dec_deg")) < box)
    named = (
        spots.join(boxes, same_box)
        .where(near)
        .groupBy("mission", "ra_deg", "dec_deg")
        .agg(F.min("_ref").alias("_ref"))
        .withColumn("object_name", F.col("_ref._name"))
        .drop("_ref")
    )
    return left_on(df, named, ["mission", "ra_deg", "dec_deg"]).select(
        *df.columns, F.coalesce("object_name", F.lit(default)).alias("object_name")
    )


def attach_positions(scored: DataFrame, positions: DataFrame, order: list[str]) -> DataFrame:
    """Left join of one position row per star; columns of ``scored`` win."""
    from transitlake.operators.dedup import keep_first

    extra = [c for c in positions.columns if c not in scored.columns and c not in order]
    one = keep_first(positions, ["star_id"], order).select("star_id", *extra)
    return left_on(scored, one, ["star_id"]).select(*scored.columns, *extra)
