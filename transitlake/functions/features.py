"""Catalog features: uncertainty bundles and the first set of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.numbers import flag, present, ratio


def add_bundles(df: DataFrame, bases: list[str] = S.BUNDLE_BASES) -> DataFrame:
    """Mean error, relative error and a missing flag for each measured column."""
    new = {}
    for base in bases:
        low, high = f"{base}_err1", f"{base}_err2"
        if not present(df, base, low, high):
            continue
        mean = (F.abs(F.col(low)) + F.abs(F.col(high))) / 2
        new[f"{base}_err_mean"] = mean
        new[f"{base}_rel_err"] = ratio(mean, F.abs(F.col(base)))
        new[f"{base}_missing"] = F.col(base).isNull().cast("int")
    return df.withColumns(new) if new else df


def add_catalog_features(df: DataFrame) -> DataFrame:
    """Derived columns whose inputs exist. Run after :func:`add_bundles`."""
    c = F.col
    new = {}
    if present(df, "ror"):
        new["depth_from_ror_ppm"] = c("ror") * c("ror") * 1e6
        if present(df, "depth_ppm"):
            gap = F.abs(c("depth_ppm") - new["depth_from_ror_ppm"])
            new["depth_consistency"] = ratio(gap, c("depth_ppm"))
    if present(df, "dur_h", "period"):
        new["dur_frac"] = ratio(c("dur_h") / 24.0, c("period"))
    for short, base in (("depth", "depth_ppm"), ("dur", "dur_h")):
        if present(df, base, f"{base}_err_mean"):
            new[f"{short}_snr"] = ratio(c(base), c(f"{base}_err_mean"))
    if present(df, "pm_ra_masyr", "pm_dec_masyr"):
        new["pm_tot"] = F.hypot(c("pm_ra_masyr"), c("pm_dec_masyr"))
    if present(df, "ecc"):
        new["ecc_flag"] = flag(c("ecc") > 0)
    if present(df, "impact"):
        new["high_b"] = flag(c("impact") > 0.8)
    if present(df, "rade_Re", "rad_Rs", "ror"):
        expected = ratio(c("rade_Re"), c("rad_Rs") * S.SUN_RADIUS_IN_EARTHS)
        new["ror_from_radii"] = expected
        new["ror_consistency"] = ratio(F.abs(c("ror") - expected), c("ror"))
    return df.withColumns(new) if new else df
