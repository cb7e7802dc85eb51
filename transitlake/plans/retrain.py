"""One plan from an upload to a release: ingest, medians, training, metrics, comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.operators import releases
from transitlake.operators.learners import DEFAULT_LEARNERS, Learner
from transitlake.operators.quality import usable_features
from transitlake.plans import learn
from transitlake.session import written
from transitlake.sources.writers import append_log, version_tag, write_release
from transitlake.streaming.ingest import IngestTable, with_mission


@dataclass
class Release:
    tag: str
    trained: learn.Training


def training_rows(table: IngestTable) -> DataFrame:
    """Current rows with ``row_id`` (a digest of their key), ``y`` and ``mission``."""
    now = with_mission(table.current())
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("star_id", "period") if c in now.columns])
    return now.withColumns({"row_id": F.md5(key), "y": F.col("label_int").cast("int")})


def setting_rows(bundle: learn.Bundle, spark: SparkSession) -> DataFrame:
    """What a model decides by, as ``metric, mission, value`` rows: thresholds and conformal
    quantiles per class, weight of each model, number of features."""
    named = {
        **{f"threshold.{c}": v for c, v in bundle.thresholds.items()},
        **{f"conformal_q.{c}": v for c, v in bundle.quantiles.items()},
        **{f"weight.{m}": v for m, v in bundle.weights.items()},
        "n_features": len(bundle.features),
    }
    rows = [(k, "All", None if v is None else float(v)) for k, v in named.items()]
    return spark.createDataFrame(rows, "metric string, mission string, value double")


def attributions(bundle: learn.Bundle, rows: DataFrame) -> DataFrame:
    """``feature, n, shap``: mean absolute attribution of each feature for each row's
    likeliest class. One row a feature is what a release keeps."""
    return bundle.explain(rows).groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.abs("shap")).alias("shap"))


def retrain(
    table: IngestTable,
    uploads: DataFrame | list[DataFrame],
    batch_id: int,
    folder: str,
    learners: dict[str, Learner] = DEFAULT_LEARNERS,
    features: list[str] | None = None,
    k: int = 5,
    test: DataFrame | None = None,
    tag: str | None = None,
) -> Release:
    """Append ``uploads`` to the table, refresh its medians, train on its current rows, and
    write a release below ``folder``: models and settings, hold-out confusion (of ``test``),
    attributions, metric rows, and the batch's entries of the quality log.

    A replay of a batch that failed on the way repeats it whole: the batch replaces itself,
    and a release is listed only when all of it is written.
    """
    spark, tag = table.spark, tag or version_tag()
    table.append(uploads, batch_id)
    table.refresh_medians()
    medians = table.medians()
    rows = written(training_rows(table))
    features = features or usable_features(rows)
    # a feature without a single value has no median: zero stands in, as at scoring
    trained = learn.train(rows, learners, features, {f: medians.get(f, 0.0) for f in features}, k)
    bundle = trained.bundle
    bundle.save(spark, f"{folder}/release={tag}/bundle")
    tables = {"attributions": attributions(bundle, rows), "report": trained.report, "importances": learn.importances(bundle, spark)}
    found = learn.metric_rows(trained).unionByName(setting_rows(bundle, spark))
    if test is not None:
        held = learn.hold_out_scores(bundle, test)
        tables["confusion"] = held.confusion()
        scores = held.scores()
        for value in scores.columns:
            found = found.unionByName(scores.select(F.lit(f"holdout.{value}").alias("metric"), F.lit("All").alias("mission"), F.col(value).alias("value")))
    log = table.quality_log().where(F.col("metric") == f"batch {batch_id}")
    append_log(log, f"{folder}/quality_log")
    write_release(tables, found, folder, tag)
    return Release(tag, trained)


def compared(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``deltas`` of every metric and ``shift`` of every attribution between the listed
    releases, and the newest release's ``card``."""
    metrics = spark.read.parquet(f"{folder}/releases")
    listed = metrics.select("release").distinct()
    stored = spark.read.option("basePath", folder).parquet(f"{folder}/release=*/attributions")
    # few rows: one a release
    shaps = stored.withColumn("release", F.col("release").cast("string")).join(F.broadcast(listed), "release", "left_semi")
    return {
        "deltas": releases.metric_deltas(metrics),
        "shift": releases.attribution_shift(shaps),
        "card": releases.summary_card(metrics),
    }
