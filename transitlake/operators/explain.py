"""Local attributions: exact Shapley values of boosted trees, and occlusion (how far a
probability moves when one feature is replaced by its median) for any model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.decide import likeliest_class, triple
from transitlake.operators.boosting import BoostedTrees
from transitlake.operators.learners import VECTOR
from transitlake.operators.ranks import RANGES, with_ranges


def with_shapley(df: DataFrame, model: BoostedTrees, of_class: Column) -> DataFrame:
    """Add ``shap_values`` (one per feature of the vector) and ``shap_base``: with the base,
    a row's values add up to its margin of the class. Map-only."""
    width = len(model.edges)
    out = df.withColumn("_all", model.attributions(VECTOR, of_class))
    parts = {"shap_values": F.slice("_all", 1, width), "shap_base": F.get("_all", F.lit(width))}
    return out.withColumns(parts).drop("_all")


def per_feature(df: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """``key, feature, shap`` of rows with ``shap_values``: one row per row and feature. Map-only."""
    names = F.array(*[F.lit(f) for f in features])
    return df.select(key, F.posexplode("shap_values").alias("_j", "shap")).select(
        key, F.get(names, F.col("_j")).alias("feature"), "shap"
    )


def strongest(features: list[str], values: str = "shap_values", k: int = S.EXPLAINED_FEATURES) -> Column:
    """The k strongest entries of a row's array of attributions, within the row."""
    names = F.array(*[F.lit(f) for f in features])
    entries = F.transform(
        F.arrays_zip(F.col(values).alias("shap"), names.alias("feature")),
        lambda e: F.struct((-F.abs(e["shap"])).alias("order"), e["feature"].alias("feature"), e["shap"].alias("shap")),
    )
    best = F.slice(F.array_sort(entries), 1, k)
    return F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["shap"].alias("shap")))


def occlusion(
    df: DataFrame, features: list[str], medians: dict[str, float], predict: Callable[[DataFrame], DataFrame],
    key: str = "row_id", of_class: int | None = None,
) -> DataFrame:
    """``key, feature, shap``: one row per input row and feature.

    ``df`` has imputed features; ``predict`` turns rows with a feature vector into
    rows with probabilities. ``of_class`` fixes the class looked at, else it is
    each row's likeliest one. Map-only: rows x features are scored where they are.
    """
    start = df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    base = predict(start.withColumn(VECTOR, array_to_vector("_x")))
    chosen = likeliest_class() if of_class is None else F.lit(of_class)
    base = base.withColumn("_class", chosen).withColumn("_base", F.get(triple(), F.col("_class")))
    base = base.select(key, "_x", "_class", "_base")
    neutral = F.array(*[F.lit(float(medians.get(f) or 0.0)) for f in features])
    hidden = (
        base.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        .withColumn("_neutral", neutral)
        .withColumn(
            "_x",
            F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.get("_neutral", i)).otherwise(v)),
        )
        .withColumn(VECTOR, array_to_vector("_x"))
        .select(key, "_class", "_base", "_j", VECTOR)
    )
    moved = F.col("_base") - F.get(triple(), F.col("_class"))
    names = F.array(*[F.lit(f) for f in features])
    return predict(hidden).select(key, F.get(names, F.col("_j")).alias("feature"), moved.alias("shap"))


def top_features(attributions: DataFrame, key: str = "row_id", k: int = S.EXPLAINED_FEATURES) -> DataFrame:
    """The k strongest features of each row as an array of structs. A row has as
    many entries as there are features, so the arrays stay short."""
    entry = F.struct((-F.abs(F.col("shap"))).alias("order"), "feature", "shap")
    gathered = attributions.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    best = F.transform(F.slice("_all", 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["shap"].alias("shap")))
    return gathered.select(key, best.alias("top_features"))


def global_attribution(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs"), F.avg("shap").alias("mean")
    )


def row_trends(
    df: DataFrame, model: BoostedTrees, features: list[str], trends: dict[str, int] = S.EXPECTED_TRENDS
) -> DataFrame:
    """Per limited feature: ``feature, expected, rows`` and ``violations``, the rows whose
    last class's probability moves against the expected sign somewhere as the feature alone
    passes through all of its bins. Map-only up to the counts."""
    audited = {f: s for f, s in trends.items() if f in features}
    wrong = model.against(VECTOR, [(features.index(f), s) for f, s in audited.items()])
    named = F.arrays_zip(
        F.array(*[F.lit(f) for f in audited]).alias("feature"), F.array(*[F.lit(s) for s in audited.values()]).alias("expected"), wrong.alias("wrong")
    )
    each = df.select(F.explode(named).alias("_r")).select("_r.*")
    return each.groupBy("feature", "expected").agg(F.count("*").alias("rows"), F.count_if(F.col("wrong") > 0).alias("violations"))


def trend_audit(df: DataFrame, p: str = "p_conf", trends: dict[str, int] = S.EXPECTED_TRENDS, bins: int = 16) -> DataFrame:
    """Per audited feature: steps between neighbouring value ranges where the mean
    probability moves against the expected sign."""
    out = None
    for feature, sign in trends.items():
        if feature not in df.columns:
            continue
        rows = df.select(F.col(feature).cast("double").alias("v"), F.col(p).alias("p")).where("v is not null")
        means = with_ranges(rows, "v", bins).groupBy(RANGES).agg(F.avg("p").alias("m"))
        step = (F.col("m") - F.lag("m").over(Window.orderBy(RANGES))) * sign  # at most ``bins`` rows
        found = means.withColumn("step", step).agg(
            F.lit(feature).alias("feature"), F.lit(sign).alias("expected"),
            F.count("step").alias("steps"), F.count_if(F.col("step") < 0).alias("violations"),
        )
        out = found if out is None else out.unionByName(found)
    return out
