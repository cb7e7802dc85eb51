"""Missing-value-safe arithmetic: NULL is the only missing value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL (NaN sorts above infinity)."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c: Column) -> Column:
    """Text that is not a number becomes NULL instead of an error."""
    return finite(c.try_cast("double"))


def round_double(c: Column, digits: int) -> Column:
    """``round`` of a double. Spark's own writes the number as decimal text and reads it back;
    that is left to numbers next to a tie or too large for the product to show the tie. Elsewhere
    a whole number over a power of ten is the double nearest to that decimal, as it is there."""
    scale = 10.0**digits
    shifted = c * scale
    whole = F.rint(shifted)
    plain = (F.abs(shifted) < 2.0**40) & (F.abs(shifted - whole) < 0.499)
    return F.when(plain, whole / scale + 0.0).otherwise(F.round(c, digits))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where a zero denominator gives NULL. Inputs are finite already."""
    return F.try_divide(numerator, denominator)


def clip(c: Column, low=None, high=None) -> Column:
    """Bound ``c`` on either side. NULL stays NULL; a NULL bound does not bind."""
    out = c
    if high is not None:
        out = F.least(out, as_column(high))
    if low is not None:
        out = F.greatest(out, as_column(low))
    # least and greatest skip NULLs, so a missing value must be kept missing
    return F.when(c.isNotNull(), out)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def safe_log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def mean_of_present(columns: list[Column]) -> Column:
    """Row-wise mean over the non-missing values; NULL when all are missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, present)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def present(df: DataFrame, *names: str) -> bool:
    """True when every named column exists (exact spelling)."""
    return set(names) <= set(df.columns)


def optional(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column if it exists, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def clean_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Numeric coercion plus NaN/Inf removal over the named columns that exist."""
    return df.withColumns({n: to_number(F.col(n)) for n in names if n in df.columns})
