"""Profiles, clipping, histograms and data-quality records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.numbers import clip
from transitlake.operators.ranks import attach, percentiles, percentiles_wide


def class_counts(df: DataFrame, by=("mission",), label: str = "label") -> DataFrame:
    """Rows per group and class, with subtotals and the grand total (NULL keys
    marked by ``level``: 0 detail, then 1 per rolled-up column from the right).

    Counted once at full detail; the subtotals come from that small result.
    """
    keys = [*by, label]
    fine = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rolled = fine.rollup(*keys).agg(F.sum("_n").alias("n"), F.grouping_id().alias("gid"))
    return rolled.select(*keys, F.bit_count("gid").alias("level"), "n")


def present_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), *[F.count(c).alias(f"{c}_present") for c in columns]
    )


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, one column per input: the share of missing values."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def usable_features(df: DataFrame, listed=S.FEATURE_COLUMNS, limit: float = 0.98) -> list[str]:
    """Listed columns that exist and are missing in less than ``limit`` of the rows.
    Runs one aggregation; only its single row reaches the driver."""
    found = [c for c in listed if c in df.columns]
    shares = missing_shares(df, found).first()
    return [c for c in found if shares[c] is not None and shares[c] < limit]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def winsorize(
    df: DataFrame,
    columns: list[str] = S.CLIPPED_COLUMNS,
    by: list[str] | None = None,
    low: float = 0.001,
    high: float = 0.999,
    approximate: bool = False,
) -> DataFrame:
    """Clip each column to its percentiles, per group. Missing stays missing.

    The bounds are one small row per group (groups are missions), so the clip itself is
    map-only.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    bounds = percentiles_wide(df, columns, [low, high], by, approximate)
    bounds = bounds.select(*(by or []), F.struct(*columns).alias("_bounds"))
    clipped = {
        c: clip(F.col(c).cast("double"), F.col("_bounds")[c][0], F.col("_bounds")[c][1])
        for c in columns
    }
    return attach(df, bounds, by or []).withColumns(clipped).drop("_bounds")


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact median of each column: ``by..., key, value``."""
    found = percentiles(df, columns, [0.5], by)
    return found.select(*(by or []), F.col("column").alias("key"), "value")


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, which for a constant column are set
    half a unit apart from it; the last bin is closed. Empty bins are listed with a zero
    count."""
    apart = {c: F.when(F.min(c) == F.max(c), 0.5).otherwise(0.0) for c in columns}
    ends = [F.struct((F.min(c) - apart[c]).alias("lo"), (F.max(c) + apart[c]).alias("hi")).alias(c) for c in columns]
    ranges = df.agg(F.struct(*ends).alias("r"))
    placed = df.select(*columns).withColumn("_r", ranges.scalar())

    def place(c: str):
        lo, hi = F.col("_r")[c]["lo"], F.col("_r")[c]["hi"]
        at = F.floor((F.col(c) - lo) * bins / (hi - lo))
        return F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(c).isNotNull(), F.least(at, F.lit(bins - 1))).cast("int").alias("bin"),
        )

    counted = (
        placed.select(F.explode(F.array(*[place(c) for c in columns])).alias("p"))
        .select("p.column", "p.bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )
    edges = ranges.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col("r")[c]["lo"].alias("lo"), F.col("r")[c]["hi"].alias("hi")) for c in columns])
        ).alias("e")
    ).select("e.*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_from"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def flag_violations(df: DataFrame) -> DataFrame:
    """Count of rows where not exactly one mission flag is set."""
    total = sum((F.coalesce(F.col(f), F.lit(0)) for f in S.MISSION_FLAGS.values()), F.lit(0))
    return df.agg(F.count_if(total != 1).alias("violations"))


def require_one_mission(df: DataFrame) -> DataFrame:
    """The same rows; a row without exactly one mission flag fails the job that
    reads it, so no extra pass is needed."""
    total = sum((F.coalesce(F.col(f), F.lit(0)) for f in S.MISSION_FLAGS.values()), F.lit(0))
    first = next(iter(S.MISSION_FLAGS.values()))
    fault = F.raise_error(F.lit("a row must carry exactly one mission flag")).cast("int")
    return df.withColumn(first, F.when(total == 1, F.col(first)).otherwise(fault))


def drop_log(df: DataFrame) -> DataFrame:
    """Rows that a label filter will drop, per raw label: ``stage, metric, value``."""
    return (
        df.where(F.col("label_int").isNull())
        .groupBy(F.coalesce(F.col("label_raw"), F.lit("(missing)")).alias("metric"))
        .agg(F.count("*").alias("value"))
        .select(F.lit("unmapped_label").alias("stage"), "metric", "value")
    )


def cell_text(name: str, kind: str) -> Column:
    """A cell as a text that any engine can make: null is ``~``, a text has its length before
    it, days and microseconds stand for dates and times, and a number is its whole part and
    two more digits in base 2^62, so that doubles are told apart down to 2^-124."""
    c = F.col(f"`{name}`")
    if kind == "string":
        shown = F.concat(F.length(c).cast("string"), F.lit(":"), c)
    elif kind == "boolean":
        shown = c.cast("int").cast("string")
    elif kind == "date":
        shown = F.unix_date(c).cast("string")
    elif kind in ("timestamp", "timestamp_ntz"):
        shown = F.unix_micros(c.cast("timestamp")).cast("string")
    elif kind in ("float", "double"):
        size = F.abs(c.cast("double"))
        big = size >= 2.0**62
        size = F.when(big, size * 2.0**-62).otherwise(size)
        whole = F.floor(size)
        first = F.floor((size - whole) * 2.0**62)
        second = F.floor(((size - whole) * 2.0**62 - first) * 2.0**62)
        mark = F.concat(F.when(c < 0, "-").otherwise(""), F.when(big, "b").otherwise(""))
        exact = F.concat(mark, F.concat_ws(".", *[x.cast("string") for x in (whole, first, second)]))
        # beyond 2^124 a double is a name of its own
        shown = F.when(F.isnan(c), "nan").when(F.abs(c.cast("double")) >= 2.0**124, c.cast("double").cast("string")).otherwise(exact)
    elif kind.startswith(("array", "map", "struct")):
        shown = F.to_json(c)
    elif kind == "binary":
        shown = F.hex(c)
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("~"))


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows, digest_high, digest_low``: the sums of both halves of every row's md5, as texts.

    Equal under row order, partitioning, file layout and column order; merges map-side to
    one row, and repeated rows count."""
    kinds = dict(df.dtypes)
    row = F.md5(F.concat_ws("|", *[cell_text(c, kinds[c]) for c in sorted(df.columns)]).cast("binary"))
    half = lambda start: F.conv(F.substring(row, start, 16), 16, 10).cast("decimal(20,0)")
    return df.select(half(1).alias("high"), half(17).alias("low")).agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(c).cast("decimal(38,0)"), F.lit(0)).cast("string").alias(f"digest_{c}") for c in ("high", "low")],
    )


def column_roles(columns: list[str]) -> dict[str, list[str]]:
    """Role of every column, by name."""
    bundles = [c for c in columns if c.endswith(tuple(S.BUNDLE_SUFFIXES))]
    flags = list(S.MISSION_FLAGS.values())
    raw = [c for c in columns if c not in {*bundles, *flags, *S.LABEL_COLUMNS}]
    engineered = S.ENGINEERED_DOUBLES + S.ENGINEERED_FLAGS
    return {
        "raw_features": raw + [c for c in S.CATALOG_MATCH_COLUMNS if c not in raw],
        "uncertainty_bundles": bundles,
        "engineered_features": [c for c in engineered if c in columns],
        "mission_flags": flags,
        "label_columns": S.LABEL_COLUMNS,
    }
