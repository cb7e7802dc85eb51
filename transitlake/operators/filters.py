"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.decide import passes_gate
from transitlake.functions.labels import first_alias


def _or_missing(name: str, condition: Column) -> Column:
    return F.col(name).isNull() | condition


def plausible(df: DataFrame) -> DataFrame:
    """Keep rows whose radius ratio, impact and inclination are possible or missing."""
    out = df
    if "ror" in df.columns:
        out = out.where(_or_missing("ror", F.col("ror") < 1.0))
    if {"ror", "impact"} <= set(df.columns):
        grazing = F.col("impact") <= 1.0 + F.col("ror")
        out = out.where(_or_missing("impact", _or_missing("ror", grazing)))
    if "incl_deg" in df.columns:
        out = out.where(_or_missing("incl_deg", F.col("incl_deg").between(0, 90)))
    return out


def positive(df: DataFrame, names=("period", "dur_h", "depth_ppm", "rad_Rs")) -> DataFrame:
    """Keep rows where every named column is above zero; missing rows go."""
    for name in names:
        if name in df.columns:
            df = df.where(F.col(name) > 0)
    return df


def labelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("label_int").isNotNull())


def split_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return labelled(df), df.where(F.col("label_int").isNull())


def placeable(df: DataFrame, distance: bool = True) -> DataFrame:
    return df.dropna(subset=["ra_deg", "dec_deg"] + (["dist_pc"] if distance else []))


def gated(df: DataFrame) -> DataFrame:
    return df.where(passes_gate())


def browse(
    df: DataFrame, mission: str | None = None, gate: bool | None = None, text: str | None = None
) -> DataFrame:
    """Candidate list filters: mission, gate state, text in star id or rationale."""
    flags = {m.lower(): f for m, f in S.MISSION_FLAGS.items()}
    flag = flags.get(mission.strip().lower()) if mission else None
    if flag in df.columns:
        df = df.where(F.coalesce(F.col(flag), F.lit(0)) == 1)
    if gate is not None and "passes_gate" in df.columns:
        df = df.where(F.col("passes_gate") == gate)
    if text:
        hits = [
            F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
            for c in ("star_id", "rationale")
            if c in df.columns
        ]
        df = df.where(F.greatest(*hits, F.lit(False)))
    return df


def view(
    df: DataFrame,
    mission: str | None = None,
    label: str | None = None,
    min_probability: float | None = None,
    min_radius: float | None = None,
    max_period: float | None = None,
) -> DataFrame:
    """Map view filters; a missing number passes."""
    if mission is not None:
        df = df.where(F.col("mission") == mission)
    if label is not None:
        name = first_alias(df, ["pred_text", "label"])
        both = [F.col(c) for c in ("pred_text", "label") if c in df.columns]
        df = df.where((F.coalesce(*both) if len(both) > 1 else F.col(name)) == label)
    if min_probability is not None:
        df = df.where(_or_missing("p_exoplanet", F.col("p_exoplanet") >= min_probability))
    if min_radius is not None:
        df = df.where(_or_missing("rade_Re", F.col("rade_Re") >= min_radius))
    if max_period is not None:
        df = df.where(_or_missing("period", F.col("period") <= max_period))
    return df
