"""Exact medians of a table that grows, kept as signed counts.

Each batch adds one row per column and value with the number of rows that came to hold it,
less those that ceased to (rows replaced by a newer one of their key). Beside it lies a
summary that counts the same by the value's first digits. Summaries add up, so a refresh
adds the small ones of all batches, sees in which bin each median lies, and opens of the
values just that bin, a few digits at a time. Rounding to k digits keeps the order, so bins
of a level are in the order of their values and a bin holds at most some thousand of the
next level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.numbers import finite

#: decimal digits known after each level; 17 tell any two doubles apart
DIGITS = (3, 6, 9, 12, 15, 17)
CHANGES = "column string, value double, n long"


def leading(value: str | Column, digits: int) -> Column:
    """A double rounded to its first decimal digits."""
    return F.format_string(f"%.{digits - 1}e", value).cast("double")


def changes(arrived: DataFrame, replaced: DataFrame | None, columns: list[str], former: dict[str, str] | None = None) -> DataFrame:
    """``column, value, n``: by how much the number of rows with that value grew. Missing
    values and those that came and went are left out. The rows that leave are those of
    ``replaced``, or lie beside the new ones, in the columns that ``former`` names."""

    def melted(df: DataFrame, cells: list[tuple[str, str, int]]) -> DataFrame:
        cell = lambda c: finite(F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double")
        rows = F.array(*[F.struct(F.lit(c).alias("column"), cell(held).alias("value"), F.lit(sign).cast("long").alias("n")) for c, held, sign in cells])
        return df.select(F.explode(rows).alias("p")).select("p.*").where("value IS NOT NULL")

    both = melted(arrived, [(c, c, 1) for c in columns] + [(c, held, -1) for c, held in (former or {}).items()])
    if replaced is not None:
        both = both.unionByName(melted(replaced, [(c, c, -1) for c in columns]))
    return both.groupBy("column", "value").agg(F.sum("n").alias("n")).where("n != 0")


def write_changes(found: DataFrame, folder: str, batch_id: int) -> None:
    """Values in the order of each file, so that a later filter opens few pages of it, and the
    summary. The files are those of the counting: the values are not shuffled again."""
    values, bins = f"{folder}/values/batch_id={batch_id}", f"{folder}/bins/batch_id={batch_id}"
    ordered = found.sortWithinPartitions("column", "value")
    ordered.write.mode("overwrite").parquet(values)
    kept = found.sparkSession.read.schema(CHANGES).parquet(values)
    summary(kept, DIGITS[0]).coalesce(1).write.mode("overwrite").parquet(bins)


def summary(values: DataFrame, digits: int) -> DataFrame:
    """``column, bin, n, low, high``: signed counts per leading digits, and the bin's ends."""
    return values.groupBy("column", leading("value", digits).alias("bin")).agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def merged(bins: DataFrame) -> DataFrame:
    """Summaries of several batches as one."""
    return bins.groupBy("column", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _holding(bins: DataFrame, ranks: Callable[[Column], Column] | None, wanted: list[dict]) -> list[dict]:
    """The bins that hold the wanted ranks. At the first level the ranks follow from the
    totals; below it a rank counts inside the bin of the level above (``path``)."""
    place = ["column", "path"]
    upto = Window.partitionBy(*place).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = bins.withColumn("_upto", F.sum("n").over(upto))
    if ranks is not None:
        totals = bins.groupBy(*place).agg(F.sum("n").alias("_total")).where("_total > 0")
        asked = totals.select(*place, F.explode(ranks(F.col("_total"))).alias("rank"), F.lit(None).cast("int").alias("which"))
    else:
        asked = bins.sparkSession.createDataFrame([(w["column"], w["path"], w["rank"], w["which"]) for w in wanted], "column string, path double, rank long, which int")
    # two ranks a column
    met = running.join(F.broadcast(asked.withColumnsRenamed({"column": "_c", "path": "_p"})), (F.col("column") == F.col("_c")) & F.col("path").eqNullSafe(F.col("_p")))
    here = (F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("n"))
    picked = met.where(here).select("column", "bin", "low", "high", "which", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"))
    return [r.asDict() for r in picked.collect()]


def medians(bins: DataFrame, values: DataFrame) -> dict[str, float]:
    """Exact median of each column from the bins and values of all batches. ``bins`` are read
    whole, of ``values`` only what lies in the bins that hold the middle rows."""
    middle = lambda n: F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1)
    first = merged(bins).withColumn("path", F.lit(None).cast("double"))
    wanted = [{**w, "which": i} for i, w in enumerate(_holding(first, middle, []))]
    for level, digits in enumerate(DIGITS[1:], 1):
        open_bins = [w for w in wanted if w["low"] < w["high"]]
        if not open_bins:
            break
        above = leading("value", DIGITS[level - 1])
        inside = F.lit(False)
        for column, low, high in sorted({(w["column"], w["low"], w["high"]) for w in open_bins}):
            inside |= (F.col("column") == column) & F.col("value").between(low, high)
        parts = (
            values.where(inside)
            .groupBy("column", above.alias("path"), leading("value", digits).alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        found = _holding(parts, None, [{**w, "path": w["bin"]} for w in open_bins])
        wanted = [w for w in wanted if w["low"] == w["high"]] + found
    pairs: dict[str, list[float]] = {}
    for w in wanted:
        pairs.setdefault(w["column"], []).append(w["low"])
    return {column: sum(pair) / len(pair) for column, pair in sorted(pairs.items())}
