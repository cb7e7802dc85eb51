"""Pages of a ranked table from a stored rank index.

The table is written once in rank order: range partitions of the order, each sorted, with
every row's number inside its partition. A small table counts the partitions' rows. A page
then reads the one or two partitions that its ranks lie in, however deep it is, and the
total is the sum of the counts. The number of partitions follows the cluster, not the table:
their bounds come from rows that Spark brings to the driver, a hundred and more a partition.
Inside a large partition the page's row numbers are a filter on files that are in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.operators.ranks import range_count

PART, PLACE = "_part", "_place"


def build_index(df: DataFrame, order: list[Column], path: str, rows_per_part: int = 100_000) -> PageIndex:
    """Write the index of ``df`` below ``path``. One range shuffle; no task sorts more than
    its range. Rows equal in ``order`` keep the order in which they were written. A partition
    has some ``rows_per_part`` rows, more in a table beyond ``range_count`` partitions."""
    parts = max(1, min(-(-df.count() // rows_per_part), range_count(df)))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = placed.withColumn("_id", F.monotonically_increasing_id())
    # the upper bits of the id number the partition, the lower 33 its rows
    stored = numbered.withColumn(PART, F.shiftright("_id", 33).cast("int")).withColumn(PLACE, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1).cast("long")))
    stored = stored.drop("_id")
    stored.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    # an empty table leaves no file to read the columns from
    spark = df.sparkSession
    spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(f"{path}/shape")
    counts = spark.read.schema(stored.schema).parquet(f"{path}/rows").groupBy(PART).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return PageIndex(spark, path)


class PageIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")
        # one row per partition
        self.parts = [tuple(r) for r in spark.read.parquet(f"{path}/counts").orderBy(PART).select(PART, "n", "before").collect()]

    @property
    def total(self) -> int:
        return sum(n for _, n, _ in self.parts)

    def page(self, number: int = 1, size: int = 100) -> DataFrame:
        """Rows of ranks ``(number - 1) * size + 1`` to ``number * size`` with their ``rank`` and
        the table's ``total``; empty beyond the end."""
        start, stop = (number - 1) * size, number * size
        held = [(part, before) for part, n, before in self.parts if before < stop and before + n > start]
        # the partition filter is on literals, so other partitions' files are not opened
        chosen = self.rows.where(F.col(PART).isin([p for p, _ in held]))
        # row numbers that any of them may hold, for the files' statistics
        chosen = chosen.where(F.col(PLACE).between(min((start - b for _, b in held), default=0), max((stop - b for _, b in held), default=0)))
        offset = F.lit(0)
        for part, before in held:
            offset = F.when(F.col(PART) == part, before).otherwise(offset)
        rank = offset + F.col(PLACE) + 1
        ranked = chosen.withColumn("rank", rank).where((F.col("rank") > start) & (F.col("rank") <= stop))
        return ranked.withColumn("total", F.lit(self.total).cast("long")).drop(PART, PLACE)
