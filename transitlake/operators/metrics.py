"""Evaluation of probability triples.

Every score metric starts from one table: distinct scores per (group, class)
with the number of rows of each true class, plus running totals in descending
score order. Ties are merged before the shuffle and no window spans a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.operators.radix import order_statistics
from transitlake.operators.ranks import running_totals

COUNTS = [f"n{c}" for c in S.CLASS_IDS]


def score_table(
    df: DataFrame, by: list[str] | None = None, y: str = "y", classes: list[int] = S.CLASS_IDS,
    scores: list[str] = S.PROBABILITIES,
) -> DataFrame:
    """``by..., class, score`` with ``n<k>, n<k>_run, n<k>_all`` per true class k."""
    by = by or []
    cells = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(s).alias("score")) for c, s in zip(classes, scores)]
    )
    counted = (
        df.select(*by, F.col(y).alias("_y"), F.explode(cells).alias("_s"))
        .select(*by, "_y", "_s.class", "_s.score")
        .where(F.col("score").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*by, "class", "score")
        .agg(*[F.count_if(F.col("_y") == k).alias(n) for k, n in zip(S.CLASS_IDS, COUNTS)])
    )
    return running_totals(counted, [*by, "class"], "score", COUNTS, descending=True)


def _own(suffix: str) -> Column:
    """The count column that belongs to the row's class."""
    out = F.when(F.col("class") == 0, F.col(f"n0{suffix}"))
    for c in S.CLASS_IDS[1:]:
        out = out.when(F.col("class") == c, F.col(f"n{c}{suffix}"))
    return out.cast("double")


def _any(suffix: str) -> Column:
    return sum((F.col(f"{n}{suffix}") for n in COUNTS[1:]), F.col(f"{COUNTS[0]}{suffix}")).cast("double")


def pr_curve(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score, as a table."""
    return table.select(
        *(by or []),
        "class",
        "score",
        (_own("_run") / _any("_run")).alias("precision"),
        F.try_divide(_own("_run"), _own("_all")).alias("recall"),
        F.try_divide(_own(""), _own("_all")).alias("recall_step"),
    )


def average_precision(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., class, average_precision``; NULL for a class without rows."""
    by = by or []
    return (
        pr_curve(table, by)
        .groupBy(*by, "class")
        .agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))
    )


def macro_average_precision(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return average_precision(table, by).groupBy(*by).agg(F.avg("average_precision").alias("pr_auc_macro"))


def pairwise_auc(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC of class against each other class, on that class's score."""
    by = by or []
    sums = []
    for other in S.CLASS_IDS:
        below = F.col(f"n{other}_all") - F.col(f"n{other}_run") + F.col(f"n{other}") / 2
        pairs = _own("_all") * F.col(f"n{other}_all")
        sums.append(F.try_divide(F.sum(_own("") * below), F.max(pairs)).alias(f"_auc{other}"))
    wide = table.groupBy(*by, "class").agg(*sums)
    pairs = F.array(
        *[F.struct(F.lit(o).alias("other"), F.col(f"_auc{o}").alias("auc")) for o in S.CLASS_IDS]
    )
    return (
        wide.select(*by, "class", F.explode(pairs).alias("p"))
        .select(*by, "class", "p.other", "p.auc")
        .where(F.col("class") != F.col("other"))
    )


def ovo_auc(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One-versus-one macro ROC-AUC: mean over ordered class pairs."""
    by = by or []
    return pairwise_auc(table, by).groupBy(*by).agg(F.avg("auc").alias("roc_auc_ovo"))


def best_f1_thresholds(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score with the highest F1 per class; the lowest such score on ties."""
    by = by or []
    p, r = F.col("precision"), F.col("recall")
    # rounded so that the tie rule does not hang on the last bit
    f1 = F.round(2 * p * r / (p + r + 1e-9), 12)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("minus")))
    return (
        pr_curve(table, by)
        .groupBy(*by, "class")
        .agg(best.alias("b"))
        .select(
            *by,
            "class",
            F.when(F.col("b.f1") > 0, -F.col("b.minus")).otherwise(0.5).alias("threshold"),
            F.col("b.f1").alias("f1"),
        )
    )


def mission_metrics(df: DataFrame, y: str = "y") -> DataFrame:
    """Rows and macro average precision per mission."""
    scores = macro_average_precision(score_table(df, ["mission"], y), ["mission"])
    rows = df.groupBy("mission").agg(F.count("*").alias("rows"))
    scores = scores.withColumnRenamed("mission", "_of")
    joined = rows.join(scores, F.col("mission").eqNullSafe(F.col("_of")), "left")
    return joined.select("mission", "rows", "pr_auc_macro")


def mission_class_metrics(df: DataFrame, y: str = "y") -> DataFrame:
    """Average precision of every class per mission, beside the mission's rows."""
    scores = average_precision(score_table(df, ["mission"], y), ["mission"])
    rows = df.groupBy(F.col("mission").alias("_of")).agg(F.count("*").alias("rows"))
    joined = scores.join(rows, F.col("mission").eqNullSafe(F.col("_of")))
    return joined.select("mission", "class", "rows", "average_precision")


def class_weights(df: DataFrame, y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Balanced weights ``n / (k * n_class)``: ``by..., y, n, weight``."""
    whole = Window.partitionBy(*(by or []))
    counts = df.where(F.col(y).isNotNull()).groupBy(*(by or []), y).agg(F.count("*").alias("n"))
    balanced = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    return counts.withColumn("weight", balanced)


def confusion(df: DataFrame, predicted: Column, y: str = "y") -> DataFrame:
    """Full class grid: ``y`` and one column per predicted class."""
    cells = [
        F.count_if(F.col("_pred") == c).alias(f"pred_{c}") for c in S.CLASS_IDS
    ]
    counted = df.select(F.col(y).alias("y"), predicted.alias("_pred")).groupBy("y").agg(*cells)
    grid = df.sparkSession.range(len(S.CLASS_IDS)).select(F.col("id").cast("int").alias("y"))
    filled = [F.coalesce(F.col(f"pred_{c}"), F.lit(0)).alias(f"pred_{c}") for c in S.CLASS_IDS]
    return grid.join(counted, "y", "left").select("y", *filled)


def binary_truth(label: Column, p: Column) -> Column:
    """1 for Confirmed, 0 for False Positive, else whether p reaches one half."""
    text = F.lower(label.cast("string"))
    return (
        F.when(text.contains("confirmed"), 1)
        .when(text.contains("false"), 0)
        .otherwise(F.coalesce((p >= 0.5).cast("int"), F.lit(0)))
    )


def binary_confusion(df: DataFrame, tau: float, p: str = "p_exoplanet", label: str = "label") -> DataFrame:
    rows = df.select(
        binary_truth(F.col(label), F.col(p)).alias("t"),
        F.coalesce((F.col(p) >= tau).cast("int"), F.lit(0)).alias("h"),
    )
    hit = lambda t, h: F.count_if((F.col("t") == t) & (F.col("h") == h))
    return rows.agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")
    )


def threshold_scan(df: DataFrame, p: str = "p_exoplanet", label: str = "label", steps: int = 100) -> DataFrame:
    """Counts and Youden's J at thresholds 0, 1/steps, ..., 1.

    Rows are counted once by the highest threshold they reach; the scan then sums
    at most ``steps + 2`` rows.
    """
    score = F.col(p)
    guess = F.floor(score * steps)
    reached = (
        guess
        + F.when((guess + 1) / steps <= score, 1).otherwise(0)
        - F.when(guess / steps > score, 1).otherwise(0)
    )
    reached = F.coalesce(F.greatest(F.least(reached, F.lit(steps)), F.lit(-1)), F.lit(-1))
    counted = (
        df.select(reached.cast("int").alias("step"), binary_truth(F.col(label), score).alias("t"))
        .groupBy("step")
        .agg(F.sum("t").alias("pos"), (F.count("*") - F.sum("t")).alias("neg"))
    )
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(counted, "step", "left").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.col("step").desc())
    everything = Window.partitionBy()
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    scanned = full.select(
        "step",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("pos").over(everything) - tp).alias("fn"),
        (F.sum("neg").over(everything) - fp).alias("tn"),
    ).where("step >= 0")
    rate = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    return scanned.select(
        (F.col("step") / steps).alias("tau"),
        "tp", "fp", "fn", "tn",
        (rate("tp", "fn") + rate("tn", "fp") - 1).alias("youden"),
    )


def best_youden(scan: DataFrame) -> DataFrame:
    ranked = scan.withColumn("youden", F.round("youden", 12))
    return ranked.agg(F.max(F.struct("youden", (-F.col("tau")).alias("m"))).alias("b")).select(
        (-F.col("b.m")).alias("tau"), F.col("b.youden").alias("youden")
    )


def reliability(df: DataFrame, bins: int = 12, y: str = "y") -> DataFrame:
    """Per class and equal-width bin: count, mean confidence and accuracy. An
    empty bin shows its midpoint and no accuracy."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.col(s).alias("p"), (F.col(y) == c).cast("int").alias("hit"))
            for c, s in enumerate(S.PROBABILITIES)
        ]
    )
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    counted = (
        df.select(F.explode(cells).alias("c"))
        .select("c.*")
        .where("p is not null")
        .groupBy("class", at.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("hit").alias("accuracy"))
    )
    grid = df.sparkSession.range(len(S.CLASS_IDS)).select(
        F.col("id").cast("int").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return grid.join(counted, ["class", "bin"], "left").select(
        "class",
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("confidence", (F.col("bin") + 0.5) / bins).alias("confidence"),
        "accuracy",
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Count-weighted mean gap between confidence and accuracy over all classes."""
    used = bins.where("n > 0")
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    return used.agg((F.sum(gap) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"))


def calibration_curve(df: DataFrame, bins: int = 10, p: str = "p_exoplanet", label: str = "label") -> DataFrame:
    """Observed positive share per probability bin, placed at bin centres."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))).cast("int")
    counted = (
        df.where(F.col(p).isNotNull())
        .groupBy(at.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(binary_truth(F.col(label), F.col(p))).alias("observed"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counted, "bin", "left").select(
        ((F.col("bin") + 0.5) / bins).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), "observed"
    )


def conformal_quantiles(df: DataFrame, alpha: float = S.CONFORMAL_ALPHA, y: str = "y") -> DataFrame:
    """Per class the k-th smallest ``1 - p_true``, k = ceil((n+1)(1-alpha)) kept
    within 1..n; a class without rows gets 1."""
    truth = F.get(F.array(*[F.col(p) for p in S.PROBABILITIES]), F.col(y))
    scored = df.select(F.col(y).cast("int").alias("class"), (1.0 - truth).alias("score"))

    def kth(n: Column, _: int) -> Column:
        k = F.ceil((n + 1) * F.lit(1 - alpha))
        return F.when(n > 0, F.array(F.greatest(F.least(k, n), F.lit(1)).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        )

    found = order_statistics(scored.where("class is not null"), ["score"], [1 - alpha], kth, ["class"])
    grid = df.sparkSession.range(len(S.CLASS_IDS)).select(F.col("id").cast("int").alias("class"))
    return grid.join(found.select("class", "value"), "class", "left").select(
        "class", F.coalesce("value", F.lit(1.0)).alias("q")
    )


def fold_summary(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Mean and population deviation of a score over folds."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def ensemble_weights(df: DataFrame, score: str = "pr_auc_macro") -> DataFrame:
    """Weights proportional to the squared score, equal when all are zero.
    One row per model, so the window is small."""
    squares = F.pow(F.coalesce(F.col(score), F.lit(0.0)), F.lit(2))
    whole = Window.partitionBy()
    total = F.sum(squares).over(whole)
    equal = F.lit(1.0) / F.count("*").over(whole)
    return df.withColumn("weight", F.when(total > 0, squares / total).otherwise(equal))


def class_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    """Rows per split and class, in total and per mission."""
    fine = df.groupBy("split", "mission", y).agg(F.count("*").alias("_n"))
    total = fine.groupBy("split", y).agg(F.sum("_n").alias("n")).withColumn("mission", F.lit("All"))
    return fine.select("split", "mission", y, F.col("_n").alias("n")).unionByName(total)
