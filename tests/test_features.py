import math

import pytest
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions import labels
from transitlake.functions.features import add_bundles, add_catalog_features
from transitlake.functions.geometry import cartesian
from transitlake.functions.numbers import clip, finite, mean_of_present, to_number
from transitlake.functions.physics import add_physics
from transitlake.operators import filters, quality

GOLDEN_SCHEMA = (
    "n int, period double, period_err1 double, period_err2 double, dur_h double, dur_h_err1 double, dur_h_err2 double, "
    "depth_ppm double, depth_ppm_err1 double, depth_ppm_err2 double, ror double, ror_err1 double, ror_err2 double, "
    "impact double, label_raw string"
)
GOLDEN = [
    (2, 9.48803557, 2.775e-05, -2.775e-05, 2.9575, 0.0819, -0.0819, 615.8, 19.5, -19.5, 0.022344, 0.000832, -0.000528, 0.146, "CONFIRMED"),
    (4, 19.89913995, None, None, 1.7822, 0.0341, -0.0341, 10829.0, 171.0, -171.0, 0.154046, None, None, 0.969, "CANDIDATE"),
    (5, 1.736952453, None, None, 2.40641, 0.00537, -0.00537, 8079.2, 12.8, -12.8, 0.387394, None, None, 1.276, "FALSE POSITIVE"),
    (12, 2.470613377, None, None, 1.74319, 0.00107, -0.00107, 14231.0, 4.2, -4.2, 0.123871, None, None, 0.818, "CONFIRMED"),
]
EXPECTED = {
    2: dict(period_rel_err=2.924736084226126e-06, ror_err_mean=0.00068, depth_from_ror_ppm=499.254336,
            depth_consistency=0.1892589542, dur_frac=0.0129878483, depth_snr=31.5794871795, dur_snr=36.1111111111,
            high_b=0, label_int=2),
    4: dict(depth_from_ror_ppm=23730.170116, depth_consistency=1.1913537830, dur_frac=0.0037317358,
            depth_snr=63.3274853801, dur_snr=52.2639296188, high_b=1, label_int=1),
    5: dict(depth_from_ror_ppm=150074.111236, depth_consistency=17.5753677636, dur_frac=0.0577258653,
            depth_snr=631.1875, dur_snr=448.1210428305, high_b=1, label_int=0),
    12: dict(depth_consistency=0.0782112740, dur_frac=0.0293987385, depth_snr=3388.3333333, dur_snr=1629.1495327,
             high_b=1, label_int=2),
}


def test_golden_rows(rows):
    df = filters.plausible(add_catalog_features(add_bundles(labels.with_classes(rows(GOLDEN_SCHEMA, *GOLDEN)))))
    got = {r["n"]: r.asDict() for r in df.collect()}
    assert set(got) == set(EXPECTED)
    for n, values in EXPECTED.items():
        for name, value in values.items():
            assert got[n][name] == pytest.approx(value, rel=1e-8), (n, name)


def test_missing_and_zero_inputs(rows):
    df = rows(
        "period double, period_err1 double, period_err2 double, dur_h double, depth_ppm double, ror double, ecc double",
        (0.0, 0.1, -0.1, 1.0, 0.0, 0.1, None), (None, None, 0.1, 1.0, 5.0, None, 0.2),
    )
    a, b = add_catalog_features(add_bundles(df)).collect()
    assert a["dur_frac"] is None and a["depth_consistency"] is None and a["period_rel_err"] is None
    assert a["ecc_flag"] == 0 and b["ecc_flag"] == 1 and b["period_missing"] == 1 and b["period_err_mean"] is None
    assert b["depth_from_ror_ppm"] is None


@pytest.mark.parametrize(
    "raw, want",
    [(" candidate", 1), ("False  Positive", 0), ("Confirmed ", 2), ("false positive", 0), ("kp", 2), ("APC", 1), ("REFUTED", None), (None, None)],
)
def test_labels(rows, raw, want):
    row = labels.with_classes(rows("label_raw string", (raw,))).first()
    assert row["label_int"] == want and row["label"] == (None if want is None else S.CLASS_NAMES[want])


def test_numbers(rows):
    df = rows("t string, v double", ("1e3", float("inf")), ("x", float("nan")), (None, 2.0), ("-Infinity", -1.0))
    got = df.select(to_number(F.col("t")).alias("t"), finite(F.col("v")).alias("v"), clip(F.col("v"), 0.0, 1.0).alias("c")).collect()
    assert [r["t"] for r in got] == [1000.0, None, None, None]
    assert [r["v"] for r in got] == [None, None, 2.0, -1.0]
    assert got[2]["c"] == 1.0 and got[3]["c"] == 0.0
    two = rows("a double, b double", (1.0, None), (None, None))
    assert [r[0] for r in two.select(mean_of_present([F.col("a"), F.col("b")])).collect()] == [1.0, None]


def test_missions(rows):
    df = rows("m string", ("TESS Sector",), ("my K2",), ("other",), (None,))
    assert [r[0] for r in df.select(labels.mission_from_text(F.col("m"))).collect()] == ["TESS", "K2", "Kepler", "Kepler"]
    flags = rows("is_kepler int, is_k2 int, is_tess int", (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0))
    assert [r[0] for r in flags.select(labels.mission_from_flags()).collect()] == ["Kepler", "K2", "TESS", "Unknown"]


def test_earth_like_physics(rows):
    df = rows(
        "period double, rad_Rs double, mass_Ms double, logg_cgs double, ror double, ecc double, impact double, "
        "incl_deg double, dur_h double, teff_K double, eqt_K double, a_over_rs double, mag_T double, pm_tot double",
        (365.25, 1.0, 1.0, 4.438, 0.00916, 0.0, 0.0, 90.0, 13.0, 5772.0, None, 215.0, 10.0, 100.0),
        (365.25, 1.0, None, 4.438, 0.00916, 0.0, 0.0, 90.0, 13.0, 5772.0, 300.0, 215.0, 10.0, 0.0),
    )
    sun, implied = add_physics(df).collect()
    assert sun["a_AU"] == pytest.approx(1.0, rel=1e-3)
    assert sun["rho_star_cgs"] == pytest.approx(1.41, rel=1e-2)
    assert sun["Rp_Re_from_ror"] == pytest.approx(1.0, rel=1e-2)
    assert sun["dur_model_h"] == pytest.approx(13.1, rel=2e-2) and sun["dur_outlier_flag"] == 0
    assert sun["geom_transit_prob"] == pytest.approx(0.00469, rel=1e-2) and sun["low_prob_flag"] == 1
    assert sun["eqt_K"] == sun["Teq_phys_K"] and implied["eqt_K"] == 300.0
    assert sun["a_over_rs_consistency"] < 0.01 and sun["H_G"] == pytest.approx(10 - 5 + 5)
    assert implied["a_AU"] == pytest.approx(1.0, rel=5e-3) and implied["H_G"] is None


def test_physics_with_nothing(rows):
    row = add_physics(rows("x int", (1,))).first()
    assert row["a_AU"] is None and row["geom_transit_prob"] is None and row["physics_veto_flag"] == 0


def test_cartesian(rows):
    df = rows("ra double, dec double, d double", (90.0, 0.0, 2.0), (0.0, 90.0, 3.0))
    got = df.select(*[v.alias(k) for k, v in cartesian(F.col("ra"), F.col("dec"), F.col("d")).items()]).collect()
    assert tuple(got[0]) == pytest.approx((0, 2, 0), abs=1e-12) and tuple(got[1]) == pytest.approx((0, 0, 3), abs=1e-12)


def test_filters(rows):
    df = rows("ror double, impact double, incl_deg double", (None, 9.0, None), (1.0, 0.1, 80.0), (0.1, 1.1, 90.0), (0.1, 1.2, 90.0), (0.1, None, 91.0))
    assert [tuple(r) for r in filters.plausible(df).collect()] == [(None, 9.0, None), (0.1, 1.1, 90.0)]
    assert filters.positive(rows("period double, rad_Rs double", (1.0, 1.0), (0.0, 1.0), (None, 1.0))).count() == 1


def test_browse_and_view(rows):
    df = rows(
        "star_id string, rationale string, passes_gate boolean, is_tess int, mission string, label string, p_exoplanet double, rade_Re double, period double",
        ("TIC-1", "Best", True, 1, "TESS", "Confirmed", 0.9, None, 3.0),
        ("k2", None, False, 0, "K2", "Candidate", None, 2.0, None),
    )
    assert filters.browse(df, "tess", True, "BEST").count() == 1
    assert filters.browse(df, text="tic").count() == 1 and filters.browse(df, "TESS", False).count() == 0
    assert filters.view(df, min_probability=0.95, max_period=5.0).first()["star_id"] == "k2"
    assert filters.view(df, "TESS", "Confirmed", 0.5, 10.0, 5.0).count() == 1


def test_winsorize_and_profiles(rows):
    df = rows("mission string, period double, ror double", *[("A", float(i), None) for i in range(1001)], ("B", 5.0, 1.0))
    got = quality.winsorize(df, ["period", "ror"], ["mission"])
    a = got.where("mission = 'A'").agg(F.min("period"), F.max("period"), F.count("ror")).first()
    assert tuple(a) == (pytest.approx(1.0), pytest.approx(999.0), 0)
    assert got.where("mission = 'B'").first()["ror"] == 1.0
    assert quality.usable_features(df, ["period", "ror", "absent"]) == ["period"]
    assert quality.drop_empty_columns(rows("a int, b int", (1, None), (2, None))).columns == ["a"]
    near = quality.winsorize(df, ["period"], ["mission"], approximate=True)
    assert near.where("mission = 'A'").agg(F.max("period")).first()[0] in (998.0, 999.0)


def test_fingerprint_ignores_order(rows):
    a = rows("a int, b string", (1, "x"), (2, None))
    b = rows("a int, b string", (2, None), (1, "x"))
    c = rows("a int, b string", (2, None), (1, "y"))
    one = lambda d: tuple(quality.fingerprint(d).first())
    assert one(a) == one(b) != one(c)


def test_one_mission_is_required(rows):
    good = rows("is_kepler int, is_k2 int, is_tess int", (1, 0, 0))
    bad = rows("is_kepler int, is_k2 int, is_tess int", (1, 0, 1))
    assert quality.require_one_mission(good).count() == 1
    assert quality.flag_violations(bad).first()[0] == 1
    with pytest.raises(Exception, match="exactly one mission flag"):
        quality.require_one_mission(bad).collect()


def test_implied_mass_uses_surface_gravity_of_the_sun():
    gravity = S.GRAVITY * S.SUN_MASS / S.SUN_RADIUS**2 * 100
    assert math.log10(gravity) == pytest.approx(4.438, abs=1e-3)
