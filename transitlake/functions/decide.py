"""Decisions on probability triples ``p_fp, p_cand, p_conf``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.labels import class_name
from transitlake.functions.numbers import clip, optional, ratio

P = S.PROBABILITIES


def triple() -> Column:
    return F.array(*[F.col(p) for p in P])


def arg_best(values: Column) -> Column:
    """Index of the largest array element, the lowest index on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def breaks_physics(df: DataFrame) -> Column:
    ror, impact = optional(df, "ror"), optional(df, "impact")
    too_large = F.coalesce(ror >= 1.0, F.lit(False))
    misses = F.coalesce(impact > 1.0 + F.coalesce(ror, F.lit(0.0)), F.lit(False))
    return too_large | misses


def apply_veto(df: DataFrame) -> DataFrame:
    """Damp the Confirmed probability of impossible rows and renormalise.

    Keeps the value before the veto as ``p_conf_before_veto`` and adds
    ``p_conf_after_veto`` and ``veto_hit``.
    """
    damped = F.when(breaks_physics(df), F.col("p_conf") * S.VETO_DAMPING).otherwise(F.col("p_conf"))
    out = df.withColumns({"p_conf_before_veto": F.col("p_conf"), "_damped": damped})
    total = F.col("p_fp") + F.col("p_cand") + F.col("_damped")
    out = out.withColumn("_total", F.when(total == 0, 1.0).otherwise(total))
    out = out.withColumns(
        {
            "p_fp": F.col("p_fp") / F.col("_total"),
            "p_cand": F.col("p_cand") / F.col("_total"),
            "p_conf": F.col("_damped") / F.col("_total"),
        }
    )
    return out.withColumns(
        {
            "p_conf_after_veto": F.col("p_conf"),
            "veto_hit": F.col("p_conf_before_veto") > F.col("p_conf") + 1e-9,
        }
    ).drop("_damped", "_total")


def likeliest_class() -> Column:
    return arg_best(triple())


def margins(thresholds: dict[int, float]) -> Column:
    """How far each probability lies above its class threshold (0.5 if unset)."""
    return F.array(*[F.col(p) - float(thresholds.get(c, 0.5)) for c, p in enumerate(P)])


def threshold_class(thresholds: dict[int, float]) -> Column:
    above = margins(thresholds)
    return F.when(F.array_max(above) >= 0, arg_best(above)).otherwise(likeliest_class())


def conformal_set(quantiles: dict[int, float]) -> Column:
    """Classes whose non-conformity stays within the class quantile."""
    members = [
        F.when(1.0 - F.col(p) <= float(quantiles[c]), F.lit(c))
        for c, p in enumerate(P)
        if c in quantiles
    ]
    return F.array_compact(F.array(*members)) if members else F.array().cast("array<int>")


def expected_costs(costs=S.COSTS, transpose: bool = False) -> Column:
    """Expected cost of each choice. ``costs[true][chosen]``; ``transpose`` reads
    the table as ``[chosen][true]``."""
    cells = [
        [costs[j][k] if transpose else costs[k][j] for k in S.CLASS_IDS] for j in S.CLASS_IDS
    ]
    return F.array(*[sum(F.col(P[k]) * row[k] for k in S.CLASS_IDS) for row in cells])


def cheapest_class(costs=S.COSTS, transpose: bool = False) -> Column:
    expected = expected_costs(costs, transpose)
    return (F.array_position(expected, F.array_min(expected)) - 1).cast("int")


def label_by_confirmed(p: Column, confirmed: float, candidate: float) -> Column:
    """Three-way label from the Confirmed probability alone."""
    chosen = F.when(p >= confirmed, S.CONFIRMED).when(p >= candidate, S.CANDIDATE)
    return class_name(chosen.otherwise(S.FALSE_POSITIVE))


def passes_gate() -> Column:
    return (F.col("p_conf") >= S.GATE_CONFIRMED) | (F.col("p_cand") >= S.GATE_CANDIDATE)


def unit_probability(c: Column) -> Column:
    return clip(c.try_cast("double"), 0.0, 1.0)


def discovery_score(df: DataFrame) -> Column:
    """Weighted sum used for ranking; a missing term adds nothing."""
    weights = S.RANKING_WEIGHTS
    zero = F.lit(0.0)
    mismatch = 1.0 - ratio(F.lit(1.0), 1.0 + F.abs(optional(df, "dur_consistency")))
    terms = [
        F.coalesce(optional(df, name), zero) * weights[name]
        for name in [*reversed(P), "depth_snr", "geom_transit_prob"]
    ]
    return sum(terms[1:], terms[0]) + weights["dur_consistency"] * F.coalesce(mismatch, zero)


def rationale(thresholds: dict[int, float]) -> Column:
    """One sentence per finding; reads ``veto_hit, p_conf_before_veto,
    p_conf_after_veto, prediction_set, top_features`` and the probabilities."""
    # fixed values: the sentences are output text
    above = margins(thresholds)
    names = F.transform(F.col("prediction_set"), class_name)
    drivers = F.transform(
        F.slice(F.col("top_features"), 1, S.RATIONALE_FEATURES),
        lambda f: F.format_string(
            "%s (%s%.2f)",
            f["feature"],
            F.when(f["shap"] >= 0, "+").otherwise("−"),
            F.abs(f["shap"]),
        ),
    )
    return F.concat_ws(
        " ",
        F.when(
            F.col("veto_hit"),
            F.format_string(
                "Physics veto reduced Confirmed P from %.3f → %.3f (b > 1+ror or ror ≥ 1).",
                F.col("p_conf_before_veto"),
                F.col("p_conf_after_veto"),
            ),
        ),
        F.when(
            F.size(names) > 1,
            F.concat(
                F.lit("Conformal set includes "), F.array_join(names, ", "),
                F.lit(" (uncertainty-aware)."),
            ),
        ),
        F.when(
            F.size("top_features") > 0,
            F.concat(F.lit("Top drivers: "), F.array_join(drivers, ", ")),
        ),
        F.format_string(
            "Best threshold margin: %s (+%.3f).", class_name(arg_best(above)), F.array_max(above)
        ),
    )
