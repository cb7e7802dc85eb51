"""File readers. Text columns stay text; typing is a later, NULL-safe step."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = [",", "\t", ";"]
OVERFLOW = "_overflow"


#: where a row stood: what "the last row of the last file" means
PLACE = ["_file", "_changed", "_block", "_line"]


def header_lines(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """First line of every file that is not a ``#`` remark; one line a file reaches the driver."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    kept = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = F.min_by("value", F.struct("block", "line"))
    return {r["file"]: r["header"] for r in kept.groupBy("file").agg(first.alias("header")).collect()}


def sniff_separator(header: str) -> str:
    """First separator that gives more than one column."""
    for separator in SEPARATORS:
        if len(next(csv.reader([header], delimiter=separator))) > 1:
            return separator
    raise ValueError("no known separator splits the header")


def _with_header(spark: SparkSession, paths: str | list[str], header: str, separator: str | None, keep_long: bool, placed: bool) -> DataFrame:
    separator = separator or sniff_separator(header)
    names = [n.strip() for n in next(csv.reader([header], delimiter=separator))]
    fields = [T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]]
    raw = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("enforceSchema", True)
        .option("comment", "#")
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(paths)
    )
    if placed:
        raw = raw.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_modification_time").alias("_changed"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    return (raw if keep_long else raw.where(F.col(OVERFLOW).isNull())).drop(OVERFLOW)


def read_by_header(
    spark: SparkSession, paths: str | list[str], separator: str | None = None, keep_long: bool = False, placed: bool = False
) -> list[DataFrame]:
    """Files grouped by header, each group read by its own: a column is never taken for
    another because two files order their columns differently."""
    groups: dict[str, list[str]] = {}
    for file, header in sorted(header_lines(spark, paths).items()):
        groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError(f"{paths}: no header line")
    return [_with_header(spark, files, header, separator, keep_long, placed) for header, files in groups.items()]


def read_delimited(
    spark: SparkSession, path: str | list[str], separator: str | None = None, keep_long: bool = False, placed: bool = False
) -> DataFrame:
    """Delimited text with a header and leading ``#`` remarks, all columns STRING.

    A folder's files may differ in the order and number of their columns; they are united
    by name. Short rows are filled with NULL, quoted fields may hold the separator. Rows with
    too many fields are dropped, or cut to the header with ``keep_long``. ``placed`` adds where
    each row stood (``PLACE``). The only driver work is one header line a file.
    """
    out, *more = read_by_header(spark, path, separator, keep_long, placed)
    for group in more:
        out = out.unionByName(group, allowMissingColumns=True)
    return out


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Parquet or delimited text by extension; None when there is no such path."""
    if not path:
        return None
    try:
        if path.rstrip("/").endswith(".csv"):
            return read_delimited(spark, path)
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


EXPLANATION_SCHEMA = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("star_id", T.StringType()),
        T.StructField("pred", T.IntegerType()),
        T.StructField("pred_text", T.StringType()),
        T.StructField("proba", T.ArrayType(T.DoubleType())),
        T.StructField("threshold_margins", T.ArrayType(T.DoubleType())),
        T.StructField("prediction_set", T.ArrayType(T.IntegerType())),
        T.StructField("rationale", T.StringType()),
        T.StructField("p_conf_before_veto", T.DoubleType()),
        T.StructField("p_conf_after_veto", T.DoubleType()),
        T.StructField(
            "top_features",
            T.ArrayType(
                T.StructType([T.StructField("feature", T.StringType()), T.StructField("shap", T.DoubleType())])
            ),
        ),
    ]
)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = EXPLANATION_SCHEMA) -> DataFrame:
    """One record per line; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_settings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A JSON document's object member as ``key, value`` rows (medians, weights)."""
    document = spark.read.schema(f"`{name}` map<string,double>").option("multiLine", True).json(path)
    return document.select(F.explode(name).alias("key", "value"))


def read_names(spark: SparkSession, path: str, mission: str, multiline: bool = True) -> DataFrame:
    """Name table of one mission with an explicit file order for first-match rules."""
    rows = spark.read.option("multiLine", multiline).json(path)
    position = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    return rows.select("*", F.lit(mission).alias("mission"), position.alias("order"))
