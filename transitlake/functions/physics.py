"""Physical columns derived from star and orbit parameters.

Absent inputs count as missing. Each step is one ``withColumns`` so that a
quantity used by several later ones (star mass, orbit size) is computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.numbers import clip, flag, optional, present, ratio, safe_log10

TEMPORARY = ["_mass", "_orbit", "_radius"]


def star_mass(mass: Column, logg: Column, radius: Column) -> Column:
    """Catalog mass, else the mass implied by surface gravity (cm/s2) and radius,
    both in solar masses."""
    gravity_si = F.pow(F.lit(10.0), logg) * 0.01
    implied = gravity_si * F.pow(radius * S.SUN_RADIUS, F.lit(2)) / S.GRAVITY / S.SUN_MASS
    return F.coalesce(mass, implied)


def orbit_size(mass: Column, period: Column) -> Column:
    """Semi-major axis in metres from the third law (planet mass neglected)."""
    cube = S.GRAVITY * S.SUN_MASS / (4 * math.pi**2) * mass * F.pow(period * S.DAY_SECONDS, F.lit(2))
    return F.cbrt(cube)


def transit_probability(radius_m: Column, orbit_m: Column, ror: Column, ecc: Column) -> Column:
    size = F.lit(1.0) + F.coalesce(ror, F.lit(0.0))
    shape = F.lit(1.0) - F.pow(F.coalesce(ecc, F.lit(0.0)), F.lit(2))
    probability = ratio(radius_m, orbit_m) * size / F.when(shape > 0, shape)
    return F.when(orbit_m > 0, clip(probability, high=1.0))


def transit_hours(
    period: Column, radius_m: Column, orbit_m: Column, ror: Column, impact: Column, incl: Column
) -> Column:
    """Expected transit duration in hours."""
    outer = F.pow(F.lit(1.0) + F.coalesce(ror, F.lit(0.0)), F.lit(2))
    chord = clip(outer - F.pow(clip(impact, low=0.0), F.lit(2)), low=0.0)
    days = (period / math.pi) * ratio(radius_m, F.when(orbit_m > 0, orbit_m)) * F.sqrt(chord)
    return ratio(days * 24.0, F.sin(F.radians(incl)))


def reduced_motion(magnitude: Column, motion_masyr: Column) -> Column:
    return magnitude + 5.0 * safe_log10(F.abs(motion_masyr) / 1000.0) + 5.0


def add_physics(df: DataFrame) -> DataFrame:
    get = lambda name: optional(df, name)
    radius, ror, period = get("rad_Rs"), get("ror"), get("period")
    mass, orbit, radius_m = F.col("_mass"), F.col("_orbit"), F.col("_radius")

    out = df.withColumns(
        {
            "_mass": star_mass(get("mass_Ms"), get("logg_cgs"), radius),
            "_radius": radius * S.SUN_RADIUS,
            "Rp_Re_from_ror": ror * radius * (S.SUN_RADIUS / S.EARTH_RADIUS),
            "H_G": reduced_motion(get("mag_T"), get("pm_tot")),
            "H_K": reduced_motion(get("mag_Kepler"), get("pm_tot")),
            "bls_sn_proxy": ratio(get("depth_ppm"), get("depth_ppm_err_mean")),
            "giant_flag": F.greatest(flag(get("logg_cgs") < 3.8), flag(get("pm_tot") < 3.0)),
        }
    ).withColumn("_orbit", orbit_size(mass, period))

    volume = 4.0 * math.pi * F.pow(radius_m, F.lit(3))
    new = {
        "rho_star_cgs": ratio(3.0 * S.SUN_MASS * mass, volume) * 1e-3,
        "a_AU": orbit / S.ASTRO_UNIT,
        "a_over_rs_phys": ratio(orbit, radius_m),
        "geom_transit_prob": transit_probability(radius_m, orbit, ror, get("ecc")),
        "Teq_phys_K": get("teff_K")
        * F.sqrt(ratio(radius_m, 2.0 * orbit))
        * (1 - S.ALBEDO) ** 0.25,
        "dur_model_h": transit_hours(
            period, radius_m, orbit, ror, get("impact"), get("incl_deg")
        ),
    }
    out = out.withColumns(new)

    late = {}
    if present(df, "a_over_rs"):
        gap = F.abs(F.col("a_over_rs") - F.col("a_over_rs_phys"))
        late["a_over_rs_consistency"] = ratio(gap, F.col("a_over_rs_phys"))
    if present(df, "eqt_K"):
        late["eqt_K"] = F.coalesce(F.col("eqt_K"), F.col("Teq_phys_K"))
    hours = F.when(get("dur_h") > 0, get("dur_h"))
    late["dur_consistency"] = ratio(F.abs(get("dur_h") - F.col("dur_model_h")), hours)
    size = F.coalesce(F.col("Rp_Re_from_ror"), get("rade_Re"))
    late["valley_flag"] = flag(safe_log10(size) < 0.26 + 0.11 * safe_log10(get("insol_S")))
    late["low_prob_flag"] = flag(F.col("geom_transit_prob") < 0.005)
    out = out.withColumns(late)

    return out.withColumns(
        {
            "dur_outlier_flag": flag(F.col("dur_consistency") > 0.5),
            "physics_veto_flag": F.greatest(
                flag(F.col("dur_consistency") > 1.0), flag(F.col("geom_transit_prob") < 1e-3)
            ),
        }
    ).drop(*TEMPORARY)
