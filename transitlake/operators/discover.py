"""Discovery tables: score, rank, place and page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.decide import (
    conformal_set,
    discovery_score,
    label_by_confirmed,
    likeliest_class,
    margins,
    passes_gate,
    rationale,
    triple,
    unit_probability,
)
from transitlake.functions.geometry import cartesian
from transitlake.functions.labels import class_name, first_alias, mission_from_flags, mission_from_text
from transitlake.functions.numbers import to_number
from transitlake.operators.filters import placeable

RANKING = ["passes_gate", "discovery_score", "p_conf", "p_cand"]


def with_decisions(df: DataFrame, thresholds: dict[int, float], quantiles: dict[int, float]) -> DataFrame:
    """Class, gate, margins, conformal set and score of every row."""
    return df.withColumns(
        {
            "pred": likeliest_class(),
            "pred_text": class_name(likeliest_class()),
            "proba": triple(),
            "threshold_margins": margins(thresholds),
            "prediction_set": conformal_set(quantiles),
            "passes_gate": passes_gate(),
            "p_exoplanet": unit_probability(F.col("p_conf")),
            "discovery_score": discovery_score(df),
        }
    )


def ranking(ties: list[str]) -> list:
    return [F.col(c).desc_nulls_last() for c in RANKING] + [F.col(c).asc() for c in ties]


def ranked(df: DataFrame, ties: list[str]) -> DataFrame:
    return df.orderBy(*ranking(ties))


def top(df: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """The k best; plans as a per-task top-k and never as a full sort."""
    return ranked(df, ties).limit(k)


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list, number: int = 1, size: int = 100) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def explanation_records(df: DataFrame, thresholds: dict[int, float], index: str = "row_index") -> DataFrame:
    """Nested record per row, ready for JSON lines. Needs the columns of
    :func:`with_decisions`, of the veto and ``top_features``."""
    fields = [
        "star_id", "pred", "pred_text", "proba", "threshold_margins", "prediction_set", "rationale",
        "p_conf_before_veto", "p_conf_after_veto", "top_features",
    ]
    return df.withColumn("rationale", rationale(thresholds)).select(index, *fields)


def explanations_for(records: DataFrame, star_id: str | None = None, row_index: int | None = None, k: int = 50) -> DataFrame:
    if star_id is not None:
        records = records.where(F.col("star_id") == star_id)
    if row_index is not None:
        records = records.where(F.col("row_index") == row_index)
    return records.orderBy("row_index").limit(k)


def candidate_table(df: DataFrame) -> DataFrame:
    """The exported columns; an absent one is missing."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in S.CANDIDATE_COLUMNS])


def universe_table(df: DataFrame) -> DataFrame:
    """Rows that can be placed in space, with Cartesian positions."""
    if "mission" not in df.columns:
        flags = set(S.MISSION_FLAGS.values()) <= set(df.columns)
        df = df.withColumn("mission", mission_from_flags() if flags else F.lit("Unknown"))
    placed = placeable(df).withColumns(cartesian(F.col("ra_deg"), F.col("dec_deg"), F.col("dist_pc")))
    return placed.select(*[F.col(c) if c in placed.columns else F.lit(None).cast("double").alias(c) for c in S.UNIVERSE_COLUMNS])


def universe_view(df: DataFrame, thresholds: dict[int, float] | None = None) -> DataFrame:
    """Map rows from any table whose columns go by one of the known names."""
    found = {target: first_alias(df, names) for target, names in S.COLUMN_ALIASES.items()}
    chance = first_alias(df, S.PROBABILITY_ALIASES)
    number = lambda name: to_number(F.col(name)) if name else F.lit(None).cast("double")
    mission = F.col(found["mission"]) if found["mission"] else F.lit("Kepler")
    if thresholds is not None and chance:
        label = label_by_confirmed(number(chance), thresholds.get(2, 0.5), thresholds.get(1, 0.5))
    else:
        label = F.col(found["label"]) if found["label"] else F.lit("Candidate")
    numbers = ["ra_deg", "dec_deg", "dist_pc", "period", "rade_Re", "depth_ppm"]
    rows = df.select(
        mission_from_text(mission).alias("mission"),
        label.alias("label"),
        *[number(found[n]).alias(n) for n in numbers],
        number(chance).alias("p_exoplanet"),
    )
    return placeable(rows, distance=False)


def cloud_extent(df: DataFrame) -> DataFrame:
    """Centroid, greatest distance from it, bounding box, its centre and size."""
    axes = ["x", "y", "z"]
    box = df.agg(
        F.struct(
            *[F.avg(a).alias(f"{a}_mean") for a in axes],
            *[F.min(a).alias(f"{a}_min") for a in axes],
            *[F.max(a).alias(f"{a}_max") for a in axes],
        ).alias("b")
    )
    placed = df.select(*axes).withColumn("_b", box.scalar())
    away = sum((F.pow(F.col(a) - F.col(f"_b.{a}_mean"), F.lit(2)) for a in axes[1:]),
               F.pow(F.col("x") - F.col("_b.x_mean"), F.lit(2)))
    farthest = placed.agg(F.sqrt(F.max(away)).alias("max_dist"))
    sizes = [F.col(f"b.{a}_max") - F.col(f"b.{a}_min") for a in axes]
    return box.select(
        "b.*",
        *[((F.col(f"b.{a}_min") + F.col(f"b.{a}_max")) / 2).alias(f"{a}_centre") for a in axes],
        F.greatest(*sizes).alias("extent"),
        farthest.scalar().alias("max_dist"),
    )


def placeable_count(df: DataFrame) -> DataFrame:
    ready = F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull() & F.col("dist_pc").isNotNull()
    return df.agg(F.count_if(ready).alias("placed"), F.count("*").alias("total"))
