"""Folds, hold-outs, oversampling and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.numbers import clip, finite, mean_of_present, optional, sigmoid
from transitlake.operators.metrics import class_weights
from transitlake.operators.ranks import attach, exact_ranks, running_totals
from transitlake.session import cut_lineage

SEED = 42


def dealt_hash(*parts: Column) -> Column:
    """60 bits of an md5 over the parts joined by ``|``: any engine can repeat the draw."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def group_folds(
    df: DataFrame, k: int = 5, group: str = "star_id", y: str = "y", seed: int = SEED,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number: all rows of a star share it, and within each majority
    class the stars are dealt out evenly in hash order.

    Rows are first counted per (star, class), so a star with a third of all rows
    is one row from there on; the ranks are exact without a one-task sort. Stars
    without a class, and rows without a star, are dealt out like the others.
    """
    counted = df.groupBy(group, y).agg(F.count("*").alias("_rows"))
    known = F.when(F.col(y).isNotNull(), F.struct("_rows", (-F.col(y)).alias("_minus")))
    majority = F.max(known)
    stars = counted.groupBy(group).agg((-majority["_minus"]).alias("_class"))
    hashed = dealt_hash(F.col(group), F.lit(seed))
    # hash collisions share a rank block: merge them before ranking
    slots = stars.withColumn("_hash", hashed).select("_class", "_hash").distinct()
    dealt = exact_ranks(slots, ["_class"], "_hash").withColumn(
        name, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")
    )
    dealt = dealt.withColumnsRenamed({"_class": "_of_class", "_hash": "_of_hash"})
    same = F.col("_class").eqNullSafe(F.col("_of_class")) & (F.col("_hash") == F.col("_of_hash"))
    of_star = stars.withColumn("_hash", hashed).join(dealt, same)
    of_star = of_star.select(F.col(group).alias("_group"), name)
    return df.join(of_star, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


#: distinct class counts of stars that the dealing may look at
MOST_SIGNATURES = 200_000


def dealt_remainders(signatures: list[tuple[tuple[int, ...], int]], k: int) -> list[list[int]]:
    """For each (class counts, stars): the folds of the stars left over when the others are
    dealt out evenly. Large stars go first; each goes to the fold whose class counts then
    stray least from even shares, no two of one signature to the same fold."""
    classes = len(signatures[0][0]) if signatures else 0
    whole = [max(1, sum(s[c] * m for s, m in signatures)) for c in range(classes)]
    held = [[sum(s[c] * (m // k) for s, m in signatures) for c in range(classes)] for _ in range(k)]
    rows = [sum(h) for h in held]
    out: list[list[int]] = [[] for _ in signatures]
    for i in sorted(range(len(signatures)), key=lambda i: (-sum(signatures[i][0]), signatures[i])):
        counts, stars = signatures[i]
        for _ in range(stars % k):
            def stray(f: int) -> tuple[float, int, int]:
                # growth of the summed squared shares, which even folds make least
                return sum(((held[f][c] + counts[c]) / whole[c]) ** 2 - (held[f][c] / whole[c]) ** 2 for c in range(classes)), rows[f], f

            fold = min((f for f in range(k) if f not in out[i]), key=stray)
            out[i].append(fold)
            rows[fold] += sum(counts)
            held[fold] = [a + b for a, b in zip(held[fold], counts)]
    return out


def balanced_folds(
    df: DataFrame, k: int = 5, group: str = "star_id", y: str = "y", classes: list[int] = S.CLASS_IDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold number: all rows of a star share it, and every class is spread over the
    folds in nearly equal shares.

    Stars are reduced to their class counts. The stars of one such signature are dealt out in
    hash order, ``k`` at a time; where the few left over go is decided on the table of
    signatures, which grows with the variety of stars and not with the rows. Rows without a
    class count for nothing, rows without a star are one star.
    """
    spark = df.sparkSession
    counts = {f"_n{c}": F.count_if(F.col(y) == c) for c in classes}
    stars = cut_lineage(df.groupBy(F.col(group).alias("_star")).agg(*[v.alias(n) for n, v in counts.items()]))
    named = list(counts)
    found = stars.groupBy(*named).agg(F.count("*").alias("_m")).limit(MOST_SIGNATURES + 1).collect()
    if len(found) > MOST_SIGNATURES:
        raise ValueError(f"stars have more than {MOST_SIGNATURES} different class counts")
    signatures = sorted((tuple(r[n] for n in named), r["_m"]) for r in found)
    extra = dealt_remainders(signatures, k)
    rows = [(*s, m - m % k, e) for (s, m), e in zip(signatures, extra)]
    table = spark.createDataFrame(rows, ", ".join([*(f"_s{n} long" for n in named), "_even long", "_extra array<int>"]))
    hashed = stars.withColumn("_hash", dealt_hash(F.col("_star"), F.lit(seed)))
    slots = exact_ranks(hashed.select(*named, "_hash").distinct(), named, "_hash").withColumnsRenamed({"_hash": "_h", **{n: f"_r{n}" for n in named}})
    ranked = hashed.join(slots, [*[F.col(n) == F.col(f"_r{n}") for n in named], F.col("_hash") == F.col("_h")])
    met = ranked.join(F.broadcast(table), [F.col(n) == F.col(f"_s{n}") for n in named])
    at = F.col("rank") - 1
    fold = F.when(at < F.col("_even"), F.pmod(at, F.lit(k))).otherwise(F.get("_extra", (at - F.col("_even")).cast("int")))
    # two stars of one hash share a rank: the last ranks are then not reached, none is left out
    dealt = met.select("_star", F.coalesce(fold, F.lit(0)).cast("int").alias(name))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_star"))).drop("_star")


def hold_out(df: DataFrame, parts: int = 7, group: str = "star_id", y: str = "y", seed: int = SEED) -> DataFrame:
    """Add ``split``: about one star in ``parts`` goes to ``test``. Without a group column 15
    in 100 rows of every class do, in the order of a content hash; equal rows stay together."""
    if group in df.columns:
        folds = group_folds(df, parts, group, y, seed, "_part")
        return folds.withColumn("split", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")
    # every class gives up its own 15 in 100: content hashes are ranked inside the class
    marked = df.withColumn("_content", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)))
    sizes = marked.groupBy(y, "_content").agg(F.count("*").alias("_rows"))
    runs = running_totals(sizes, [y], "_content", ["_rows"])
    split = F.when(F.col("_rows_run") <= F.floor(F.col("_rows_all") * 0.15 + 0.5), "test").otherwise("train")
    dealt = runs.select(F.col(y).alias("_of_class"), F.col("_content").alias("_of_content"), split.alias("split"))
    same = F.col(y).eqNullSafe(F.col("_of_class")) & (F.col("_content") == F.col("_of_content"))
    return marked.join(dealt, same).drop("_content", "_of_class", "_of_content")


def oversample(
    df: DataFrame, y: str = "y", ratio: float = 1.5, seed: int = SEED, keys: list[str] | None = None
) -> DataFrame:
    """Repeat rows so that every class nears the size of the largest one, when the
    largest is more than ``ratio`` times the smallest. Map-only apart from the
    class counts; a row is repeated where it is, its last copy by a draw over ``keys``
    (all columns by default)."""
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()
    large, small = F.max("_n").over(whole), F.min("_n").over(whole)
    times = counts.select(y, F.when(large / small > ratio, large / F.col("_n")).otherwise(1.0).alias("_times"))
    draw = dealt_hash(*[F.col(f"`{c}`") for c in (keys or df.columns)], F.lit(seed)) / F.lit(float(1 << 60))
    base = F.floor("_times")
    copies = base + (draw < F.col("_times") - base).cast("int")
    return (
        attach(df, times, [y])
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .drop("_copy", "_times")
    )


def inverse_error_weight(error: Column) -> Column:
    return F.lit(1.0) / F.coalesce(F.when(finite(error) > 0, error), F.lit(1.0))


def with_physics_weight(df: DataFrame, name: str = "physics_weight") -> DataFrame:
    """Product of three squashed z-scores, within 0.5..2; a missing value or column
    counts as average. The moments are one row, read as a scalar."""
    signs = {"depth_snr": 1, "geom_transit_prob": 1, "dur_consistency": -1}
    used = {c: s for c, s in signs.items() if c in df.columns}
    if not used:
        return df.withColumn(name, F.lit(0.5))
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in used], *[F.stddev_pop(c).alias(f"{c}_std") for c in used]
        ).alias("m")
    ).scalar()
    out = df.withColumn("_m", moments)
    weight = F.lit(1.0)
    for c, sign in signs.items():
        if c in used:
            spread = F.col(f"_m.{c}_std")
            spread = F.when(spread.isNull() | F.isnan(spread) | (spread < 1e-9), 1.0).otherwise(spread)
            z = (F.col(c) - F.coalesce(F.col(f"_m.{c}_mean"), F.lit(0.0))) / spread
            weight = weight * sigmoid(sign * F.coalesce(z, F.lit(0.0)))
        else:
            weight = weight * 0.5
    return out.withColumn(name, clip(weight, 0.5, 2.0)).drop("_m")


def with_class_weight(df: DataFrame, y: str = "y", name: str = "class_weight") -> DataFrame:
    weights = class_weights(df, y).select(y, F.col("weight").alias(name))
    return attach(df, weights, [y])


def uncertainty_weight(df: DataFrame) -> Column:
    """``1 / (1 + mean relative error)`` over period, depth and duration."""
    errors = [optional(df, f"{c}_rel_err") for c in ("period", "depth_ppm", "dur_h")]
    return F.lit(1.0) / (1.0 + F.coalesce(mean_of_present(errors), F.lit(0.0)))


def with_training_weight(df: DataFrame, y: str = "y", mission_weight: str | None = None, refit: bool = False) -> DataFrame:
    """Class x physics x mission weight, at refit also x uncertainty weight."""
    out = with_physics_weight(with_class_weight(df, y))
    product = F.col("class_weight") * F.col("physics_weight")
    if mission_weight:
        product = product * F.col(mission_weight)
    if refit:
        product = product * uncertainty_weight(df)
    return out.withColumn("weight", product)


def with_classical_weight(df: DataFrame, y: str = "y", error: str = "depth_ppm_err_mean") -> DataFrame:
    """Class weight x inverse measurement error."""
    weighted = with_class_weight(df, y)
    return weighted.withColumn("weight", F.col("class_weight") * inverse_error_weight(optional(df, error)))


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-score per column; a constant column gives 0, missing gives 0."""
    moments = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]).alias("m")
    ).scalar()
    out = df.withColumn("_m", moments)
    new = {}
    for c in columns:
        spread = F.col("_m")[c]["std"]
        spread = F.when(spread.isNull() | (spread < 1e-9), 1.0).otherwise(spread)
        new[f"{c}_z"] = F.coalesce((F.col(c) - F.col("_m")[c]["mean"]) / spread, F.lit(0.0))
    return out.withColumns(new).drop("_m")


