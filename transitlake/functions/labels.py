"""Label, mission and identifier expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S


def _lookup(table: dict, key: Column) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())
    return F.create_map(*pairs)[key]


def tidy_label(c: Column) -> Column:
    """Upper case, every run of blanks (also no-break ones) to one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(c.cast("string")), "[\\u00A0\\s]+", " "))


def class_of_disposition(c: Column) -> Column:
    """Class id of a catalog disposition, NULL when the code is unknown."""
    return _lookup(S.DISPOSITIONS, tidy_label(c))


def class_of_upload(c: Column) -> Column:
    """Class id of an uploaded label: the number of a class passes, known text is
    mapped, anything else is no label."""
    text = c.cast("string")
    number = text.try_cast("double").try_cast("int")
    number = F.when(number.between(0, len(S.CLASS_NAMES) - 1), number)
    return F.coalesce(number, _lookup(S.UPLOAD_LABELS, F.lower(F.trim(text))))


def class_name(c: Column) -> Column:
    return _lookup(dict(enumerate(S.CLASS_NAMES)), c.cast("int"))


def with_classes(df: DataFrame, raw: str = "label_raw") -> DataFrame:
    """Add ``label_int`` and ``label`` from the raw disposition text."""
    with_ids = df.withColumn("label_int", class_of_disposition(F.col(raw)))
    return with_ids.withColumn("label", class_name(F.col("label_int")))


def mission_flags(mission: str) -> dict[str, Column]:
    return {f: F.lit(int(m == mission)) for m, f in S.MISSION_FLAGS.items()}


def mission_from_flags() -> Column:
    out = None
    for mission, f in S.MISSION_FLAGS.items():
        hit = F.col(f) == 1
        out = F.when(hit, mission) if out is None else out.when(hit, mission)
    return out.otherwise("Unknown")


def mission_from_text(c: Column) -> Column:
    """Any text naming TESS or K2; everything else, missing included, is Kepler."""
    text = F.lower(c.cast("string"))
    return (
        F.when(text.contains("tess"), "TESS").when(text.contains("k2"), "K2").otherwise("Kepler")
    )


def anonymous_id(df: DataFrame) -> Column:
    """Identifier for rows without one: a hash of the content, so it does not
    change when the same file is read again or in another order."""
    return F.concat(F.lit("anon_"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def first_alias(df: DataFrame, names: list[str]) -> str | None:
    """First of ``names`` that is a column of ``df``."""
    return next((n for n in names if n in df.columns), None)
