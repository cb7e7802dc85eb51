"""Base learners, all giving the same three probability columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.numbers import finite
from transitlake.operators import boosting, network
from transitlake.operators.boosting import BoostedTrees
from transitlake.operators.network import Network

SEED = 42
VECTOR = "features"


def impute(df: DataFrame, features: list[str], medians: dict[str, float]) -> DataFrame:
    """Absent or missing features become the stored median, else 0."""
    filled = {}
    for name in features:
        default = F.lit(float(medians.get(name) or 0.0))
        value = finite(F.col(name).try_cast("double")) if name in df.columns else None
        filled[name] = default if value is None else F.coalesce(value, default)
    return df.withColumns(filled)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=VECTOR).transform(df)


def _normalised(raw: list[Column]) -> list[Column]:
    """Scale to sum 1; three zeros become equal shares."""
    total = sum(raw[1:], raw[0])
    return [F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(raw))) for p in raw]


def _spread(df: DataFrame, vector: str, drop: list[str]) -> DataFrame:
    values = vector_to_array(F.col(vector))
    out = df.withColumn("_p", values)
    triple = {p: F.coalesce(F.get("_p", F.lit(c)), F.lit(0.0)) for c, p in enumerate(S.PROBABILITIES)}
    return out.withColumns(triple).drop("_p", *drop)


@dataclass
class Learner:
    """``kind`` is boosted, network, forest, linear or one_vs_rest; ``settings`` go to its fit.

    Boosted trees follow ``S.EXPECTED_TRENDS`` on the features of those names, unless the
    settings say otherwise; a network is trained with focal loss."""

    kind: str
    settings: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, y: str = "y", weight: str | None = None) -> FittedLearner:
        weighted = {"weightCol": weight} if weight else {}
        common = {"featuresCol": VECTOR, "predictionCol": "_pred", "rawPredictionCol": "_raw"}
        if self.kind == "boosted":
            options = {"trends": S.EXPECTED_TRENDS, **self.settings}
            return FittedLearner(self.kind, [boosting.fit(df, VECTOR, y, weight, **options)])
        if self.kind == "network":
            return FittedLearner(self.kind, [network.fit(df, VECTOR, y, weight, **self.settings)])
        if self.kind == "one_vs_rest":
            models = []
            for c in S.CLASS_IDS:
                options = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, **self.settings}
                learner = GBTClassifier(
                    labelCol="_is", featuresCol=VECTOR, predictionCol=f"_pred{c}", seed=SEED, **options, **weighted
                )
                learner.setProbabilityCol(f"_prob{c}").setRawPredictionCol(f"_raw{c}")
                models.append(learner.fit(df.withColumn("_is", (F.col(y) == c).cast("double"))))
            return FittedLearner(self.kind, models)
        target = df.withColumn("_y", F.col(y).cast("double"))
        common["probabilityCol"] = "_prob"
        if self.kind == "forest":
            options = {"numTrees": 100, "maxDepth": 8, **self.settings}
            learner = RandomForestClassifier(labelCol="_y", seed=SEED, **common, **options, **weighted)
        elif self.kind == "linear":
            options = {"maxIter": 100, "regParam": 1e-3, **self.settings}
            learner = LogisticRegression(labelCol="_y", **common, **options, **weighted)
        else:
            raise ValueError(f"unknown learner {self.kind!r}")
        return FittedLearner(self.kind, [learner.fit(target)])


@dataclass
class FittedLearner:
    kind: str
    models: list[Model | BoostedTrees | Network]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``p_fp, p_cand, p_conf``. Map-only."""
        drop = ["_raw", "_prob", "_pred"]
        if self.kind in OWN_KINDS:
            scored = df.withColumn("_p", self.models[0].probabilities(VECTOR))
            return scored.withColumns({p: F.get("_p", F.lit(c)) for c, p in enumerate(S.PROBABILITIES)}).drop("_p")
        if self.kind != "one_vs_rest":
            return _spread(self.models[0].transform(df), "_prob", drop)
        out = df
        for c, model in enumerate(self.models):
            out = model.transform(out).drop(f"_raw{c}", f"_pred{c}")
            out = out.withColumn(f"_prob{c}", vector_to_array(f"_prob{c}")[1])
        triple = _normalised([F.col(f"_prob{c}") for c in S.CLASS_IDS])
        return out.withColumns(dict(zip(S.PROBABILITIES, triple))).drop(*[f"_prob{c}" for c in S.CLASS_IDS])

    def importances(self, features: list[str]) -> list[tuple[str, float]]:
        """Mean tree importance per feature; empty for learners without trees."""
        if self.kind == "boosted":
            return list(zip(features, self.models[0].importances().tolist()))
        vectors = [m.featureImportances.toArray() for m in self.models if hasattr(m, "featureImportances")]
        if not vectors:
            return []
        return [(f, float(sum(v[i] for v in vectors) / len(vectors))) for i, f in enumerate(features)]


#: kinds whose model is a small text of its own
OWN_KINDS = {"boosted": BoostedTrees, "network": Network}
DEFAULT_LEARNERS = {kind: Learner(kind) for kind in ("boosted", "forest", "linear", "network")}


def mission_weights(df: DataFrame, target: str = "is_tess", settings: dict | None = None) -> DataFrame:
    """Adds ``mission_weight`` = 0.5 + P(TESS-like) from a balanced logistic model;
    expects the assembled vector."""
    flagged = df.withColumn("_t", F.coalesce(F.col(target).cast("double"), F.lit(0.0)))
    share = flagged.agg(F.avg("_t").alias("s")).first()["s"]
    if share in (None, 0.0, 1.0):
        return df.withColumn("mission_weight", F.lit(1.0))
    balance = F.when(F.col("_t") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    weighted = flagged.withColumn("_w", balance)
    names = {"featuresCol": VECTOR, "predictionCol": "_pred", "rawPredictionCol": "_raw", "probabilityCol": "_prob"}
    options = {"maxIter": 50, "regParam": 1e-3, **(settings or {})}
    model = LogisticRegression(labelCol="_t", weightCol="_w", **names, **options).fit(weighted)
    scored = model.transform(df)
    return scored.withColumn("mission_weight", 0.5 + vector_to_array("_prob")[1]).drop("_pred", "_raw", "_prob")
