"""Score a pool, explain it and export ranked candidates and placed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.decide import rationale
from transitlake.operators import discover, explain, filters
from transitlake.operators.skymatch import attach_positions
from transitlake.plans.learn import Bundle
from transitlake.session import cut_lineage
from transitlake.sources import writers

POSITION_COLUMNS = ["ra_deg", "dec_deg", "dist_pc", "rade_Re"]


def explore(
    bundle: Bundle, pool: DataFrame, positions: DataFrame | None = None, position_order: list[str] | None = None,
    row_limit: int | None = None, top_k: int | None = None, key: str = "row_id",
) -> dict[str, DataFrame]:
    """``explanations``, ``candidates``, ``universe`` and ``gated`` tables of a pool.

    ``row_limit`` and ``top_k`` are off unless asked for. Scored rows are written to
    the checkpoint folder once, because four tables are made from them.
    """
    if row_limit is not None:
        pool = discover.first_rows(pool, row_limit, [key])
    top = explain.top_features(bundle.explain(pool, key), key)
    scored = bundle.score(pool).join(top, key)
    scored = cut_lineage(scored.withColumn("rationale", rationale(bundle.thresholds)))
    placed = scored
    if positions is not None:
        wanted = [c for c in POSITION_COLUMNS if c in positions.columns and c not in scored.columns]
        side = positions.select("star_id", *wanted, *[c for c in position_order if c != "star_id"])
        placed = attach_positions(scored, side, position_order)
    best = discover.top(placed, top_k, ["star_id", key]) if top_k else discover.ranked(placed, ["star_id", key])
    return {
        "explanations": discover.explanation_records(scored, bundle.thresholds, key),
        "candidates": discover.candidate_table(best),
        "universe": discover.universe_table(placed),
        "gated": filters.gated(placed),
    }


def summary(bundle: Bundle, scored: DataFrame) -> DataFrame:
    """One row: rows evaluated, gate thresholds, ranking weights, class thresholds."""
    pairs = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (str(k), float(v))])
    return scored.agg(F.count("*").alias("rows_evaluated")).select(
        "rows_evaluated",
        pairs({"Confirmed": S.GATE_CONFIRMED, "Candidate": S.GATE_CANDIDATE}).alias("gate_thresholds"),
        pairs(S.RANKING_WEIGHTS).alias("ranking_weights"),
        pairs(bundle.thresholds).alias("best_thresholds"),
    )


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """JSON lines for explanations and placed objects, CSV for candidates."""
    writers.write_json(tables["explanations"], f"{folder}/explanations")
    writers.write_csv(tables["candidates"], f"{folder}/candidates")
    writers.write_json(tables["universe"], f"{folder}/universe")
    writers.write_csv(tables["gated"], f"{folder}/discovery_candidates")
