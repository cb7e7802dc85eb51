"""Column names, label codes, catalog layouts, constants.

Everything in this file is a value that results depend on; no logic lives here
beyond small helpers that expand a naming rule (for example ``<column>_err1``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------- classes --
# fixed values
CLASS_NAMES = ["False Positive", "Candidate", "Confirmed"]
FALSE_POSITIVE, CANDIDATE, CONFIRMED = 0, 1, 2
CLASS_IDS = [FALSE_POSITIVE, CANDIDATE, CONFIRMED]
PROBABILITIES = ["p_fp", "p_cand", "p_conf"]

# fixed values: disposition code -> class id
DISPOSITIONS = {
    "CONFIRMED": CONFIRMED,
    "CANDIDATE": CANDIDATE,
    "FALSE POSITIVE": FALSE_POSITIVE,
    "CP": CONFIRMED,
    "KP": CONFIRMED,
    "PC": CANDIDATE,
    "APC": CANDIDATE,
    "FP": FALSE_POSITIVE,
}
# fixed values: label text in uploads -> class id
UPLOAD_LABELS = {
    "fp": FALSE_POSITIVE,
    "false positive": FALSE_POSITIVE,
    "candidate": CANDIDATE,
    "cand": CANDIDATE,
    "confirmed": CONFIRMED,
    "conf": CONFIRMED,
}

# -------------------------------------------------------------- missions --
# fixed values; the position is the feed order used by keep-first rules
MISSIONS = ["Kepler", "TESS", "K2"]
MISSION_FLAGS = {"Kepler": "is_kepler", "K2": "is_k2", "TESS": "is_tess"}

# --------------------------------------------------------------- columns --
# fixed values
BUNDLE_BASES = ["period", "t0_bjd", "dur_h", "depth_ppm", "ror", "a_over_rs"]
NUMERIC_INPUTS = [
    "period", "dur_h", "depth_ppm", "ror", "rade_Re", "a_over_rs", "impact", "ecc", "incl_deg",
    "insol_S", "eqt_K", "teff_K", "logg_cgs", "feh_dex", "rad_Rs", "mass_Ms", "age_Gyr",
    "ra_deg", "dec_deg", "pm_ra_masyr", "pm_dec_masyr", "dist_pc", "mag_T", "mag_Kepler",
]
ENGINEERED_DOUBLES = [
    "depth_from_ror_ppm", "depth_consistency", "dur_frac", "depth_snr", "dur_snr", "pm_tot",
]
ENGINEERED_FLAGS = ["ecc_flag", "high_b"]
PHYSICS_DOUBLES = [
    "rho_star_cgs", "a_AU", "a_over_rs_phys", "a_over_rs_consistency", "Rp_Re_from_ror",
    "geom_transit_prob", "Teq_phys_K", "dur_model_h", "dur_consistency", "H_G", "H_K",
]
PHYSICS_FLAGS = ["giant_flag", "valley_flag", "low_prob_flag", "dur_outlier_flag"]

BUNDLE_SUFFIXES = ["_err_mean", "_rel_err", "_missing"]
BUNDLE_COLUMNS = [base + suffix for base in BUNDLE_BASES for suffix in BUNDLE_SUFFIXES]

CLIPPED_COLUMNS = NUMERIC_INPUTS + ENGINEERED_DOUBLES
FEATURE_COLUMNS = (
    CLIPPED_COLUMNS + ENGINEERED_FLAGS + BUNDLE_COLUMNS + PHYSICS_DOUBLES + PHYSICS_FLAGS
)
CATALOG_MATCH_COLUMNS = [
    "gaia_parallax", "gaia_gmag", "tic_Tmag", "tic_st_rad", "tic_st_mass",
]
LABEL_COLUMNS = ["label", "label_int"]
# fixed values: columns of the exported candidates and of the map
CANDIDATE_COLUMNS = [
    "star_id", "pred_text", "p_conf", "p_cand", "p_fp", "discovery_score", "passes_gate",
    "threshold_margins", "prediction_set", "depth_snr", "geom_transit_prob", "dur_consistency", "ror",
    "impact", "incl_deg", "period", "dur_h", "depth_ppm", "is_kepler", "is_k2", "is_tess", "ra_deg",
    "dec_deg", "rationale",
]
UNIVERSE_COLUMNS = [
    "star_id", "mission", "pred_text", "p_exoplanet", "p_conf", "p_cand", "p_fp", "ra_deg", "dec_deg",
    "dist_pc", "rade_Re", "period", "x", "y", "z",
]
# fixed values: answers that must never reach training
LEAKING_COLUMNS = [
    "label_text", "human_vetting_notes", "is_confirmed_truth", "disposition", "koi_score",
    "tfopwg_disp",
]
# fixed values: upload column -> unified column
UPLOAD_RENAMES = {
    "koi_period": "period", "toi_period": "period", "kepmag": "mag_Kepler", "tmag": "mag_T",
}
UPLOAD_STAR_IDS = ["kepid", "epic", "tic", "id", "star"]
# fixed values: request field -> unified column
REQUEST_ALIASES = {
    "duration_hours": "dur_h", "radius_ratio_rp_over_rs": "ror", "b_impact": "impact",
}
# fixed values: canonical column -> names under which it may arrive, best first
COLUMN_ALIASES = {
    "ra_deg": ["ra_deg", "ra", "RA", "koi_ra", "RAJ2000", "RA_deg"],
    "dec_deg": ["dec_deg", "dec", "DEC", "koi_dec", "DEJ2000", "Dec_deg"],
    "period": ["period", "period_days", "koi_period", "tce_period", "P"],
    "rade_Re": ["rade_Re", "radius_re", "koi_prad", "prad", "Rp_Rearth"],
    "depth_ppm": ["depth_ppm", "koi_depth", "depth"],
    "mission": ["mission", "koi_mission", "sector_mission", "msn", "source", "catalog"],
    "label": [
        "label", "pred_text", "disposition", "pdisposition", "koi_pdisposition",
        "koi_disposition", "tce_disposition",
    ],
    "dist_pc": ["dist_pc", "dist", "distance_pc", "d_pc"],
}
PROBABILITY_ALIASES = ["p_exoplanet", "p_conf", "proba_confirmed"]

# ------------------------------------------------------------- constants --
# fixed values (SI units unless the name says otherwise)
GRAVITY = 6.67430e-11
SUN_RADIUS = 6.957e8
SUN_MASS = 1.98847e30
EARTH_RADIUS = 6.371e6
ASTRO_UNIT = 1.495978707e11
DAY_SECONDS = 86400.0
SUN_RADIUS_IN_EARTHS = 109.2
ALBEDO = 0.3

# fixed values: decisions
GATE_CONFIRMED, GATE_CANDIDATE = 0.90, 0.95
VETO_DAMPING = 0.3
CONFORMAL_ALPHA = 0.10
COSTS = [[0.0, 0.5, 2.0], [0.5, 0.0, 1.0], [1.0, 0.5, 0.0]]
RANKING_WEIGHTS = {
    "p_conf": 1.00, "p_cand": 0.40, "p_fp": -0.60, "depth_snr": 0.15,
    "geom_transit_prob": 0.10, "dur_consistency": -0.10,
}
# fixed values: expected sign of the effect on the Confirmed probability
EXPECTED_TRENDS = {
    "depth_snr": 1, "geom_transit_prob": 1, "dur_consistency": -1, "a_over_rs_consistency": -1,
    "impact": -1, "low_prob_flag": -1, "dur_outlier_flag": -1, "depth_consistency": -1,
}
EXPLAINED_FEATURES, RATIONALE_FEATURES = 8, 5


# -------------------------------------------------------------- catalogs --
@dataclass(frozen=True)
class Catalog:
    """How one source catalog maps onto the unified columns.

    ``measured`` columns carry two error columns named by ``error_names``;
    ``plain`` columns carry none. ``star_id`` and ``fallbacks`` list source
    columns in order of preference.
    """

    name: str
    mission: str
    star_id: list[str]
    disposition: str
    error_names: str
    measured: dict[str, str]
    plain: dict[str, str]
    required: list[str]
    fallbacks: dict[str, str] = field(default_factory=dict)

    @property
    def feed_order(self) -> int:
        return MISSIONS.index(self.mission)

    def error_name(self, source: str, n: int) -> str:
        return self.error_names.format(column=source, n=n)


# fixed values: source column names of the three catalogs
KOI = Catalog(
    name="koi",
    mission="Kepler",
    star_id=["kepid"],
    disposition="koi_disposition",
    error_names="{column}_err{n}",
    measured={
        "period": "koi_period", "t0_bjd": "koi_time0bk", "dur_h": "koi_duration",
        "depth_ppm": "koi_depth", "ror": "koi_ror",
    },
    fallbacks={"t0_bjd": "koi_time0"},
    plain={
        "rade_Re": "koi_prad", "a_over_rs": "koi_dor", "impact": "koi_impact",
        "ecc": "koi_eccen", "incl_deg": "koi_incl", "insol_S": "koi_insol",
        "eqt_K": "koi_teq", "teff_K": "koi_steff", "logg_cgs": "koi_slogg",
        "feh_dex": "koi_smet", "rad_Rs": "koi_srad", "mass_Ms": "koi_smass",
        "age_Gyr": "koi_sage", "ra_deg": "ra", "dec_deg": "dec", "mag_Kepler": "koi_kepmag",
    },
    required=[
        "rowid", "kepid", "koi_disposition", "koi_period", "koi_time0bk", "koi_duration",
        "koi_depth",
    ],
)
TOI = Catalog(
    name="toi",
    mission="TESS",
    star_id=["tid"],
    disposition="tfopwg_disp",
    error_names="{column}err{n}",
    measured={
        "period": "pl_orbper", "t0_bjd": "pl_tranmid", "dur_h": "pl_trandurh",
        "depth_ppm": "pl_trandep",
    },
    plain={
        "rade_Re": "pl_rade", "insol_S": "pl_insol", "eqt_K": "pl_eqt", "teff_K": "st_teff",
        "logg_cgs": "st_logg", "rad_Rs": "st_rad", "mag_T": "st_tmag", "dist_pc": "st_dist",
        "ra_deg": "ra", "dec_deg": "dec", "pm_ra_masyr": "st_pmra", "pm_dec_masyr": "st_pmdec",
    },
    required=["rowid", "tid", "tfopwg_disp"],
)
K2 = Catalog(
    name="k2",
    mission="K2",
    star_id=["hostname", "epic_hostname"],
    disposition="disposition",
    error_names="{column}err{n}",
    measured={
        "period": "pl_orbper", "t0_bjd": "pl_tranmid", "dur_h": "pl_trandur",
        "depth_ppm": "pl_trandep", "ror": "pl_ratror", "a_over_rs": "pl_ratdor",
    },
    plain={
        "impact": "pl_imppar", "ecc": "pl_orbeccen", "incl_deg": "pl_orbincl",
        "rade_Re": "pl_rade", "insol_S": "pl_insol", "eqt_K": "pl_eqt", "teff_K": "st_teff",
        "logg_cgs": "st_logg", "feh_dex": "st_met", "rad_Rs": "st_rad", "mass_Ms": "st_mass",
        "age_Gyr": "st_age", "ra_deg": "ra", "dec_deg": "dec", "pm_ra_masyr": "sy_pmra",
        "pm_dec_masyr": "sy_pmdec", "dist_pc": "sy_dist", "mag_T": "sy_tmag",
        "mag_Kepler": "sy_kepmag",
    },
    required=["rowid", "hostname", "disposition"],
)
CATALOGS = {c.name: c for c in (KOI, TOI, K2)}
