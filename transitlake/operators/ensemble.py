"""Combining and calibrating the outputs of several models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.operators import isotonic, metrics
from transitlake.operators.learners import VECTOR, _normalised, _spread, assemble
from transitlake.operators.ranks import attach
from transitlake.session import side_by_side

P = S.PROBABILITIES


def weighted_average(models: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``model, p_*`` rows to one weighted triple per key. One row per model in
    ``weights``; a model without a weight adds nothing."""
    weighted = attach(models, weights.select("model", F.col("weight").alias("_w")), ["model"])
    sums = [F.sum(F.col("_w") * F.col(p)).alias(p) for p in P]
    return weighted.groupBy(*keys).agg(*sums)


def model_report(oof: DataFrame) -> DataFrame:
    """Per model: out-of-fold scores, and mean and deviation over the folds."""
    whole = metrics.score_table(oof, ["model"])
    overall = metrics.macro_average_precision(whole, ["model"]).withColumnRenamed("pr_auc_macro", "oof_pr_auc_macro")
    roc = metrics.ovo_auc(whole, ["model"]).withColumnRenamed("roc_auc_ovo", "oof_roc_auc_ovo")
    per_fold = metrics.macro_average_precision(metrics.score_table(oof, ["model", "fold"]), ["model", "fold"])
    folds = metrics.fold_summary(per_fold, "pr_auc_macro", ["model"])
    folds = folds.select("model", F.col("mean").alias("cv_pr_mean"), F.col("std").alias("cv_pr_std"))
    return overall.join(roc, "model").join(folds, "model")


def stacked_features(oof: DataFrame, models: list[str], keys: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per key with the triples of all models side by side."""
    names = [f"{p}_{m}" for m in models for p in P]
    cells = [F.max(F.when(F.col("model") == m, F.col(p))).alias(f"{p}_{m}") for m in models for p in P]
    return oof.groupBy(*keys).agg(*cells), names


@dataclass
class Stacker:
    """Multinomial logistic model on the concatenated triples of all models."""

    names: list[str]
    model: object = None

    def fit(self, df: DataFrame, y: str = "y", inverse_penalty: float = 2.0) -> Stacker:
        rows = df.count()
        weights = metrics.class_weights(df, y).select(y, F.col("weight").alias("_w"))
        train = assemble(attach(df, weights, [y]), self.names).withColumn("_y", F.col(y).cast("double"))
        self.model = LogisticRegression(
            featuresCol=VECTOR, labelCol="_y", weightCol="_w", probabilityCol="_prob", predictionCol="_pred",
            rawPredictionCol="_raw", family="multinomial", regParam=1.0 / (inverse_penalty * max(rows, 1)),
        ).fit(train)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(assemble(df, self.names))
        return _spread(scored, "_prob", ["_prob", "_pred", "_raw", VECTOR])


@dataclass
class Calibrator:
    """Cross-fitted one-versus-rest logistic score, made monotone by isotonic regression,
    normalised, averaged over folds: a fold is a list of (logistic, isotonic) per class."""

    folds: list[list[tuple]] | None = None

    def fit(self, df: DataFrame, y: str = "y", key: str = "row_id", k: int = 3) -> Calibrator:
        data, part = assemble(df, P), F.pmod(F.xxhash64(key), F.lit(k))

        def pair(i: int, c: int) -> tuple:
            is_class = (F.col(y) == c).cast("double")
            logistic = LogisticRegression(
                featuresCol=VECTOR, labelCol="_is", probabilityCol="_prob", predictionCol="_pred",
                rawPredictionCol="_raw", regParam=1e-4,
            ).fit(data.where(part != i).withColumn("_is", is_class))
            scored = logistic.transform(data.where(part == i).withColumn("_is", is_class))
            return logistic, isotonic.fit(scored.withColumn("_score", vector_to_array("_prob")[1]), "_score", "_is")

        tasks = [(i, c) for i in range(k) for c in S.CLASS_IDS]
        made = dict(zip(tasks, side_by_side([partial(pair, *t) for t in tasks])))
        self.folds = [[made[i, c] for c in S.CLASS_IDS] for i in range(k)]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out, scores = assemble(df, P), {}
        for i, pairs in enumerate(self.folds):
            for c, (logistic, _) in enumerate(pairs):
                scores[i, c] = f"_score_{i}_{c}"
                out = logistic.transform(out).withColumn(scores[i, c], vector_to_array("_prob")[1]).drop("_prob", "_pred", "_raw")
        made = {f"_cal_{i}_{c}": self.folds[i][c][1].predict(F.col(name)) for (i, c), name in scores.items()}
        out = out.withColumns(made)
        sums = [F.lit(0.0)] * len(P)
        for i in range(len(self.folds)):
            raw = [F.greatest(F.col(f"_cal_{i}_{c}"), F.lit(0.0)) for c in S.CLASS_IDS]
            sums = [s + p for s, p in zip(sums, _normalised(raw))]
        mean = {p: s / len(self.folds) for p, s in zip(P, sums)}
        return out.withColumns(mean).drop(VECTOR, *made, *scores.values())
