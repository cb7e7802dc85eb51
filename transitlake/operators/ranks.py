"""Running totals and exact order statistics that never sort a group in one task.

A window over a whole class or mission would pull a third of the table, or all
of it, into a single task. Here the order column is first cut into value ranges
of about equal size (bounds from a mergeable quantile sketch), the small table
of range totals is prefix-summed, and only then does a window run, inside each
range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.numbers import finite
from transitlake.operators import radix
from transitlake.session import cut_lineage, written

SKETCH_ACCURACY = 10_000
RANGES, RANGES_MIN = "_range", 16


def range_count(df: DataFrame) -> int:
    """Number of value ranges: a power of two that grows with the cluster."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 2 ** math.ceil(math.log2(max(wanted, RANGES_MIN)))


def with_ranges(df: DataFrame, order: str, ranges: int | None = None, kept: bool = False) -> DataFrame:
    """Add ``_range``: the index of the value range that ``order`` falls in.

    The bounds are one lazily evaluated array of ``ranges - 1`` numbers; the
    position is found by halving, so it costs log2(ranges) comparisons per row.
    They depend on the order in which the tasks' sketches meet: a caller that reads the
    result in several jobs has them ``kept``, so that all see the same ranges.
    """
    ranges = ranges or range_count(df)
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(SKETCH_ACCURACY, 4 * ranges)
    sketched = df.agg(F.percentile_approx(order, shares, accuracy).alias("bounds"))
    bounds = (written(sketched) if kept else sketched).scalar()
    halving, at = [], F.lit(0)
    for e in reversed(range(ranges.bit_length() - 1)):
        beyond = F.get("_bounds", at + (2**e - 1)) < F.col(order)
        halving.append((at + F.when(beyond, 2**e).otherwise(0)).alias(f"_at{e}"))
        at = F.col(f"_at{e}")
    searched = df.withColumn("_bounds", bounds).select("*", *halving)
    return searched.select(*df.columns, at.alias(RANGES))


def running_totals(
    df: DataFrame,
    by: list[str],
    order: str,
    measures: list[str],
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """For each measure add ``<m>_run`` (running total, own row included) and
    ``<m>_all`` (group total). ``(by, order)`` must be unique: aggregate first, so
    that heavy ties are merged before anything is shuffled. A missing value of ``by``
    is a group like any other.
    """
    cut = with_ranges(df, order, ranges)
    # one key that is never NULL, so that the join and the window share their partitioning
    whole_key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    cut = cut.withColumn("_group", whole_key)
    keys = ["_group", RANGES]
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    # one row per (group, range): small enough for a plain window
    totals = cut.groupBy(*keys).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy(direction(RANGES)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_all") for m in measures],
    )
    # the join and the window share their partitioning: one shuffle
    inside = (
        Window.partitionBy(*keys)
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = cut.join(offsets, keys)
    runs = {f"{m}_run": F.sum(m).over(inside) + F.col(f"{m}_before") for m in measures}
    return joined.withColumns(runs).drop(RANGES, "_group", *[f"{m}_before" for m in measures])


def exact_ranks(df: DataFrame, by: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """Add ``rank`` 1..n inside each group; ``(by, order)`` must be unique."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), by, order, ["_one"], False, ranges)
    return counted.withColumn("rank", F.col("_one_run")).drop("_one", "_one_run", "_one_all")


def attach(
    df: DataFrame, side: DataFrame, by: list[str], few_groups: bool = True
) -> DataFrame:
    """Add the columns of ``side`` (one row per ``by`` group) to every row.

    Without groups the side is one row and is read as a scalar. ``few_groups``
    promises that the ``by`` columns come from fixed lists (mission, class, model,
    fold): then the side has a known small size and is broadcast. Otherwise the
    join runs on a salted key, so that no group lands in one task whole.
    """
    extra = [c for c in side.columns if c not in by]
    if not by:
        return df.withColumns({c: side.select(c).scalar() for c in extra})
    renamed = side.withColumnsRenamed({b: f"_side_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_side_{b}")) for b in by]
    if few_groups:
        return df.join(F.broadcast(renamed), same).drop(*[f"_side_{b}" for b in by])
    salts = range_count(df)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    copies = renamed.withColumn("_side_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same.append(F.col("_salt") == F.col("_side_salt"))
    return salted.join(copies, same).drop("_salt", "_side_salt", *[f"_side_{b}" for b in by])


def order_statistics(
    df: DataFrame,
    columns: list[str],
    shares: list[float],
    positions,
    by: list[str] | None = None,
    accuracy: int = SKETCH_ACCURACY,
    few_groups: bool = True,
) -> DataFrame:
    """Exact values at chosen ranks, for many columns at once.

    ``shares`` (0..1) says roughly where the wanted ranks lie; ``positions(n, k)``
    gives, for share number ``k``, an array column of 1-based ranks among the
    ``n`` non-missing values. Result: ``by..., column, which, n, position, value``.

    Pass 1 sketches every column and brackets each share. Pass 2 keeps the values
    inside a bracket, a few rows in a thousand, and one marker for what lies on its
    outer side, merged map-side into a count; only that is shuffled. A group smaller
    than the sketch resolution keeps all its values. A rank outside its bracket
    raises an error, so the answer is exact or absent. Both passes run when this is
    called; what they leave behind is small and kept in the checkpoint folder.
    """
    by = by or []
    margin = 8.0 / accuracy
    edges = [(max(s - margin, 0.0), min(s + margin, 1.0)) for s in shares]
    infinite = F.lit(float("inf"))
    values = df.select(
        *by, *[finite(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)]
    )

    # pass 1: one sketch per column, then one row per (group, column)
    sketch = [e for pair in edges for e in pair]
    sketches = values.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(i).alias("slot"),
                F.count(f"_v{i}").alias("total"),
                F.percentile_approx(f"_v{i}", sketch, accuracy).alias("edges"),
            ).alias(f"_s{i}")
            for i in range(len(columns))
        ]
    )
    small = F.col("total") < accuracy
    low, high = [], []
    for k, (lowest, highest) in enumerate(edges):
        at = lambda n: F.get("edges", F.lit(n))
        low.append(F.when(small | F.lit(lowest <= 0), -infinite).otherwise(at(2 * k)))
        high.append(F.when(small | F.lit(highest >= 1), infinite).otherwise(at(2 * k + 1)))
    side = (
        sketches.select(*by, F.explode(F.array(*[f"_s{i}" for i in range(len(columns))])).alias("_s"))
        .select(*by, "_s.*")
        .select(*by, "slot", "total", F.array(*low).alias("low"), F.array(*high).alias("high"))
    )
    # one row per (group, column); written once, so that later steps do not repeat pass 1
    side = cut_lineage(side)

    # pass 2: one narrow row per value, so the generated code does not grow with
    # the number of columns
    long = values.select(
        *by, F.posexplode(F.array(*[f"_v{i}" for i in range(len(columns))])).alias("slot", "value")
    ).where(F.col("value").isNotNull())

    def cell(k: int) -> Column:
        value, low, high = F.col("value"), F.col("low")[k], F.col("high")[k]
        if shares[k] > 0.5:
            kept = F.when(value > high, infinite).when(value >= low, value)
        else:
            kept = F.when(value < low, -infinite).when(value <= high, value)
        return F.struct(F.lit(k).alias("which"), kept.alias("value"))

    group = [*by, "slot", "which"]
    counted = (
        attach(long, side, [*by, "slot"], few_groups)
        .select(*by, "slot", F.explode(F.array(*[cell(k) for k in range(len(shares))])).alias("_cell"))
        .select(*by, "slot", "_cell.which", "_cell.value")
        .where(F.col("value").isNotNull())
        .groupBy(*group, "value")
        .agg(F.count("*").alias("n"))
    )
    counted = cut_lineage(counted)

    # which value range holds each wanted rank: one row per (group, range)
    cut = with_ranges(counted, "value")
    everything = Window.partitionBy(*group)
    earlier = everything.orderBy(RANGES).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        cut.groupBy(*group, RANGES)
        .agg(F.sum("n").alias("here"))
        .withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
        .withColumn("kept", F.sum("here").over(everything))
    )
    before, position, total = F.col("before"), F.col("position"), F.col("total")
    from_top = F.get(F.array(*[F.lit(s > 0.5) for s in shares]), F.col("which"))
    wanted = F.get(F.array(*[positions(total, k) for k in range(len(shares))]), F.col("which"))
    targets = (
        attach(ranges, side.drop("low", "high"), [*by, "slot"], few_groups)
        .withColumn("before", before + F.when(from_top, total - F.col("kept")).otherwise(0))
        .withColumn("position", F.explode(wanted))
        .where((position > before) & (position <= before + F.col("here")))
        .select(*group, RANGES, "position", "before", "total")
    )

    # only those ranges are sorted
    keys = [*group, RANGES]
    renamed = targets.withColumnsRenamed({c: f"_t_{c}" for c in keys})
    hits = cut.join(renamed, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in keys])
    upto = (
        Window.partitionBy(*keys, "position")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run, value = F.col("run"), F.col("value")
    error = F.raise_error(F.lit("a rank fell outside its bracket; raise accuracy"))
    names = F.array(*[F.lit(c) for c in columns])
    return (
        hits.withColumn("run", F.sum("n").over(upto) + before)
        .where((run >= position) & (run - F.col("n") < position))
        .select(
            *by,
            F.get(names, F.col("slot")).alias("column"),
            "which",
            total.alias("n"),
            "position",
            F.when(F.abs(value) < infinite, value).otherwise(error.cast("double")).alias("value"),
        )
    )


def percentiles(
    df: DataFrame,
    columns: list[str],
    shares: list[float],
    by: list[str] | None = None,
    accuracy: int = SKETCH_ACCURACY,
    few_groups: bool = True,
    kept: bool = False,
) -> DataFrame:
    """Exact percentiles with linear interpolation, missing values ignored.

    Result: ``by..., column, share, value``; a column without values has no row. Groups from
    fixed lists are answered by radix selection, others by sketches and brackets.
    """
    by = by or []
    listed = F.array(*[F.lit(float(s)) for s in shares])

    def around(n: Column, k: int) -> Column:
        at = (n - 1) * F.lit(float(shares[k]))
        return F.when(n > 0, F.array_distinct(F.array(F.floor(at) + 1, F.ceil(at) + 1))).otherwise(
            F.array().cast("array<bigint>")
        )

    if few_groups:
        found = radix.order_statistics(df, columns, shares, around, by, kept)
    else:
        found = order_statistics(df, columns, shares, around, by, accuracy, few_groups)
    at = (F.col("n") - 1) * F.get(listed, F.col("which"))
    return (
        found.groupBy(*by, "column", "which")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.first("n").alias("n"))
        .select(
            *by,
            "column",
            F.get(listed, F.col("which")).alias("share"),
            (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("value"),
        )
    )


def percentiles_wide(
    df: DataFrame,
    columns: list[str],
    shares: list[float],
    by: list[str] | None = None,
    approximate: bool = False,
    accuracy: int = SKETCH_ACCURACY,
    few_groups: bool = True,
    kept: bool = False,
) -> DataFrame:
    """One row per group, one array column (one entry per share) per input column.

    ``approximate`` takes the sketch's own answer: one pass, rank error at most
    ``1/accuracy``.
    """
    by = by or []
    if approximate:
        return df.groupBy(*by).agg(
            *[
                F.percentile_approx(F.col(c).cast("double"), [float(s) for s in shares], accuracy).alias(c)
                for c in columns
            ]
        )
    long = percentiles(df, columns, shares, by, accuracy, few_groups, kept)
    cell = lambda c, s: F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value")))
    return long.groupBy(*by).agg(
        *[F.array(*[cell(c, float(s)) for s in shares]).alias(c) for c in columns]
    )
