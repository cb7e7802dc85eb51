"""Training, evaluation, batch scoring and explanation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.decide import apply_veto, cheapest_class, likeliest_class
from transitlake.operators import discover, explain, metrics, sampling
from transitlake.operators.ensemble import Calibrator, Stacker, model_report, stacked_features, weighted_average
from transitlake.operators.isotonic import Isotonic
from transitlake.operators.learners import (
    DEFAULT_LEARNERS,
    OWN_KINDS,
    VECTOR,
    FittedLearner,
    Learner,
    assemble,
    impute,
    mission_weights,
)
from transitlake.operators.quality import medians as column_medians
from transitlake.operators.quality import usable_features
from transitlake.session import cut_lineage, side_by_side

P = S.PROBABILITIES

def settings(df: DataFrame, key: str, value: str) -> dict:
    """A small table (per feature, class or model) as a dict."""
    return {r[key]: r[value] for r in df.select(key, value).collect()}


def prepare(df: DataFrame, features: list[str], medians: dict[str, float], keep: list[str]) -> DataFrame:
    """Imputed features, the vector and the named other columns."""
    kept = [c for c in keep if c in df.columns and c not in features]
    filled = impute(df.select(*kept, *[c for c in features if c in df.columns]), features, medians)
    return assemble(filled, features)


def out_of_fold(df: DataFrame, learners: dict[str, Learner], k: int = 5, weighted: bool = True) -> DataFrame:
    """Every row scored once per model by a fit that never saw its star:
    ``row_id, model, fold, y, p_*``. ``df`` is a prepared frame with ``fold``."""
    carried = [c for c in ("row_id", "fold", "y", "mission", "ror", "impact") if c in df.columns]
    mission = "mission_weight" if "mission_weight" in df.columns else None

    def part(fold: int, name: str, learner: Learner) -> DataFrame:
        train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        if weighted:
            train = sampling.with_training_weight(train, "y", mission)
        scored = learner.fit(train, "y", "weight" if weighted else None).predict(test)
        return scored.select(*carried, F.lit(name).alias("model"), *P)

    tasks = [(fold, name, learner) for fold in range(k) for name, learner in learners.items()]
    return reduce(DataFrame.unionByName, side_by_side([partial(part, *t) for t in tasks]))


@dataclass
class Bundle:
    """All that scoring needs. Everything but the models is a few numbers."""

    features: list[str]
    medians: dict[str, float]
    weights: dict[str, float]
    models: dict[str, FittedLearner]
    calibrator: Calibrator
    thresholds: dict[int, float]
    quantiles: dict[int, float]
    costs: list = field(default_factory=lambda: S.COSTS)
    stacker: Stacker | None = None

    def stacked(self, df: DataFrame) -> DataFrame:
        """The stacked model's probabilities for rows with a feature vector. Map-only."""
        out, names = df, []
        for name, model in self.models.items():
            names += [f"{p}_{name}" for p in P]
            out = model.predict(out).withColumnsRenamed({p: f"{p}_{name}" for p in P})
        return self.stacker.predict(out.drop(VECTOR)).drop(*names)

    def raw(self, df: DataFrame) -> DataFrame:
        """Weighted ensemble for rows with a feature vector. Map-only."""
        out, sums = df, [F.lit(0.0)] * len(P)
        for i, (name, model) in enumerate(self.models.items()):
            weight = self.weights.get(name, 0.0)
            if weight <= 0:
                continue
            out = model.predict(out).withColumnsRenamed({p: f"_{p}_{i}" for p in P})
            sums = [s + F.col(f"_{p}_{i}") * weight for s, p in zip(sums, P)]
        made = [f"_{p}_{i}" for i in range(len(self.models)) for p in P]
        return out.withColumns(dict(zip(P, sums))).drop(*made)

    def score(self, df: DataFrame) -> DataFrame:
        """Impute, ensemble, veto, calibrate, decide. Map-only; one row is the same
        as a billion. Request field names are accepted."""
        renamed = df.withColumnsRenamed(
            {a: c for a, c in S.REQUEST_ALIASES.items() if a in df.columns and c not in df.columns}
        )
        filled = assemble(impute(renamed, self.features, self.medians), self.features)
        vetoed = apply_veto(self.raw(filled).drop(VECTOR))
        calibrated = self.calibrator.predict(vetoed)
        decided = discover.with_decisions(calibrated, self.thresholds, self.quantiles)
        return decided.withColumn("pred_cost", cheapest_class(self.costs))

    def trees(self):
        """The boosted member, or None."""
        return next((m.models[0] for m in self.models.values() if m.kind == "boosted"), None)

    def attributed(self, df: DataFrame, of_class: int | None = None) -> DataFrame:
        """Rows with exact Shapley values (``shap_values``, ``shap_base``) of the boosted
        member, for one class or for each row's likeliest one by the ensemble. Map-only."""
        filled = assemble(impute(df, self.features, self.medians), self.features)
        if of_class is not None:
            return explain.with_shapley(filled, self.trees(), F.lit(of_class)).drop(VECTOR)
        scored = self.raw(filled).withColumn("_class", likeliest_class()).drop(*P)
        return explain.with_shapley(scored, self.trees(), F.col("_class")).drop(VECTOR, "_class")

    def explain(self, df: DataFrame, key: str = "row_id", of_class: int | None = None) -> DataFrame:
        """``key, feature, shap``; a bundle without boosted trees is explained by occlusion."""
        if self.trees() is not None:
            return explain.per_feature(self.attributed(df, of_class), self.features, key)
        filled = impute(df, self.features, self.medians)
        return explain.occlusion(filled, self.features, self.medians, self.raw, key, of_class)

    def card(self) -> dict:
        return {
            "features": self.features, "medians": self.medians, "weights": self.weights,
            "thresholds": self.thresholds, "conformal_q": self.quantiles, "costs": self.costs,
            "kinds": {n: m.kind for n, m in self.models.items()},
            "calibrator_folds": len(self.calibrator.folds), "stacked": self.stacker.names if self.stacker else None,
        }

    def save(self, spark, folder: str) -> None:
        """Models and settings below one release folder."""
        for name, fitted in self.models.items():
            for i, model in enumerate(fitted.models):
                if fitted.kind in OWN_KINDS:
                    write_text(spark, model.to_json(), f"{folder}/models/{name}/{i}")
                else:
                    model.write().save(f"{folder}/models/{name}/{i}")
        for i, pairs in enumerate(self.calibrator.folds):
            for c, (logistic, isotonic) in enumerate(pairs):
                logistic.write().save(f"{folder}/calibrator/{i}/{c}/logistic")
                write_text(spark, isotonic.to_json(), f"{folder}/calibrator/{i}/{c}/isotonic")
        if self.stacker is not None:
            self.stacker.model.write().save(f"{folder}/stacker")
        write_text(spark, json.dumps(self.card()), f"{folder}/card")


def write_text(spark, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_text(spark, path: str) -> str:
    return spark.read.text(path).first()[0]


def load_bundle(spark, folder: str) -> Bundle:
    from pyspark.ml.classification import (
        GBTClassificationModel,
        LogisticRegressionModel,
        RandomForestClassificationModel,
    )

    card = json.loads(read_text(spark, f"{folder}/card"))
    readers = {"one_vs_rest": GBTClassificationModel, "forest": RandomForestClassificationModel, "linear": LogisticRegressionModel}
    models = {}
    for name, kind in card["kinds"].items():
        places = [f"{folder}/models/{name}/{i}" for i in range(len(S.CLASS_IDS) if kind == "one_vs_rest" else 1)]
        own = OWN_KINDS.get(kind)
        models[name] = FittedLearner(kind, [own.from_json(read_text(spark, p)) if own else readers[kind].load(p) for p in places])
    folds = [
        [
            (
                LogisticRegressionModel.load(f"{folder}/calibrator/{i}/{c}/logistic"),
                Isotonic.from_json(read_text(spark, f"{folder}/calibrator/{i}/{c}/isotonic")),
            )
            for c in S.CLASS_IDS
        ]
        for i in range(card["calibrator_folds"])
    ]
    stacker = Stacker(card["stacked"], LogisticRegressionModel.load(f"{folder}/stacker")) if card["stacked"] else None
    ints = lambda d: {int(k): v for k, v in d.items()}
    return Bundle(
        card["features"], card["medians"], card["weights"], models, Calibrator(folds),
        ints(card["thresholds"]), ints(card["conformal_q"]), card["costs"], stacker,
    )


@dataclass
class Training:
    bundle: Bundle
    oof: DataFrame
    mixed: DataFrame
    calibrated: DataFrame
    report: DataFrame
    stacker: Stacker


def train(
    df: DataFrame,
    learners: dict[str, Learner] = DEFAULT_LEARNERS,
    features: list[str] | None = None,
    medians: dict[str, float] | None = None,
    k: int = 5,
    refit_learners: bool = True,
) -> Training:
    """Cross-validated training on rows with ``row_id, star_id, y``.

    Stages that later steps read several times are cut once: the folded feature
    frame, the out-of-fold table and the calibrated table.
    """
    features = features or usable_features(df)
    medians = medians or settings(column_medians(df, features), "key", "value")
    keep = ["row_id", "star_id", "y", "mission", "is_tess", "ror", "impact", "depth_snr", "geom_transit_prob",
            "dur_consistency", "period_rel_err", "depth_ppm_rel_err", "dur_h_rel_err"]
    folded = sampling.group_folds(prepare(df, features, medians, keep), k)
    if "is_tess" in folded.columns:
        folded = mission_weights(folded)
    folded = cut_lineage(folded)

    oof = cut_lineage(out_of_fold(folded, learners, k))
    report = cut_lineage(metrics.ensemble_weights(model_report(oof), "oof_pr_auc_macro"))
    weights = settings(report, "model", "weight")

    keys = [c for c in ("row_id", "fold", "y", "mission") if c in oof.columns]
    mixed = weighted_average(oof, report.select("model", "weight"), keys)
    physical = [c for c in ("ror", "impact") if c in folded.columns]
    if physical:
        mixed = mixed.join(folded.select("row_id", *physical), "row_id")
    mixed = cut_lineage(apply_veto(mixed))
    wide, names = stacked_features(oof, list(learners), ["row_id", "y"])
    stacker = Stacker(names).fit(wide)

    # cross-fitted: a row is calibrated by maps learned without its fold
    calibrated = cut_lineage(cross_calibrate(mixed))
    curve = metrics.score_table(calibrated)
    thresholds = settings(metrics.best_f1_thresholds(curve), "class", "threshold")
    quantiles = settings(metrics.conformal_quantiles(calibrated), "class", "q")

    final = {}
    if refit_learners:
        mission = "mission_weight" if "mission_weight" in folded.columns else None
        everything = sampling.with_training_weight(folded, "y", mission, refit=True)
        everything = cut_lineage(everything)
        fits = [partial(learner.fit, everything, "y", "weight") for learner in learners.values()]
        final = dict(zip(learners, side_by_side(fits)))
    bundle = Bundle(features, medians, weights, final, Calibrator().fit(mixed), thresholds, quantiles, stacker=stacker)
    return Training(bundle, oof, mixed, calibrated, report, stacker)


def cross_calibrate(mixed: DataFrame, parts: int = 2) -> DataFrame:
    """Calibrate each half of the folds by a calibrator fitted on the other."""
    out = None
    for i in range(parts):
        part = F.pmod(F.col("fold"), F.lit(parts))
        calibrator = Calibrator().fit(mixed.where(part != i))
        scored = calibrator.predict(mixed.where(part == i))
        out = scored if out is None else out.unionByName(scored)
    return out


@dataclass
class HoldOut:
    """Scored test rows, kept, and the tables made of them."""

    scored: DataFrame

    def scores(self) -> DataFrame:
        """One row: macro average precision and one-against-one AUC."""
        curve = metrics.score_table(self.scored)
        return metrics.macro_average_precision(curve).select(
            "pr_auc_macro", metrics.ovo_auc(curve).scalar().alias("roc_auc_ovo")
        )

    def confusion(self) -> DataFrame:
        """True class by likeliest class."""
        return metrics.confusion(self.scored, likeliest_class())

    def by_mission(self) -> DataFrame:
        """Average precision per mission and class."""
        return metrics.mission_class_metrics(self.scored)


def hold_out_scores(bundle: Bundle, test: DataFrame) -> HoldOut:
    """Score the test set once, with the stored medians."""
    kept = [c for c in ("row_id", "y", "mission") if c in test.columns]
    return HoldOut(cut_lineage(bundle.score(test).select(*kept, *P)))


def evaluate(bundle: Bundle, test: DataFrame) -> DataFrame:
    """Hold-out scores with the stored medians: one row."""
    return hold_out_scores(bundle, test).scores()


def explained(bundle: Bundle, df: DataFrame, index: str = "row_id") -> DataFrame:
    """Scored rows with their strongest features and a rationale."""
    if bundle.trees() is not None:
        # attributions are made beside the rows: nothing is joined
        attributed = bundle.attributed(df).withColumn("top_features", explain.strongest(bundle.features))
        scored = bundle.score(attributed.drop("shap_values", "shap_base"))
        return discover.explanation_records(scored, bundle.thresholds, index)
    scored = bundle.score(df)
    top = explain.top_features(bundle.explain(df, index), index)
    return discover.explanation_records(scored.join(top, index), bundle.thresholds, index)


def importances(bundle: Bundle, spark) -> DataFrame:
    """Tree importances per model, strongest 100."""
    rows = [(m, f, v) for m, fitted in bundle.models.items() for f, v in fitted.importances(bundle.features)]
    table = spark.createDataFrame(rows, "model string, feature string, importance double")
    return table.orderBy(F.desc("importance"), "model", "feature").limit(100)


def metric_rows(trained: Training, test: DataFrame | None = None) -> DataFrame:
    """Everything a release is compared by, as ``metric, mission, value`` rows."""
    def one(table: DataFrame, name: str, value: str) -> DataFrame:
        return table.select(F.lit(name).alias("metric"), F.lit("All").alias("mission"), F.col(value).alias("value"))

    curves = {"oof.weighted_pr_auc_macro": trained.mixed, "oof.calibrated_pr_auc_macro": trained.calibrated}
    out = None
    for name, table in curves.items():
        row = one(metrics.macro_average_precision(metrics.score_table(table)), name, "pr_auc_macro")
        out = row if out is None else out.unionByName(row)
    out = out.unionByName(one(metrics.calibration_error(metrics.reliability(trained.calibrated)), "ece", "ece"))
    if "mission" in trained.calibrated.columns:
        found = metrics.mission_metrics(trained.calibrated)
        out = out.unionByName(
            found.select(F.lit("pr_auc_macro").alias("metric"), "mission", F.col("pr_auc_macro").alias("value"))
        )
    if test is not None:
        scores = evaluate(trained.bundle, test)
        for value in ("pr_auc_macro", "roc_auc_ovo"):
            out = out.unionByName(one(scores, f"holdout.{value}", value))
    return out
