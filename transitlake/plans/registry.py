"""The registered queries and, where SQL can say it, the check query for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions import decide
from transitlake.functions.features import add_bundles, add_catalog_features
from transitlake.functions.geometry import cartesian
from transitlake.functions.labels import class_name, with_classes
from transitlake.functions.numbers import mean_of_present, round_double
from transitlake.functions.physics import add_physics
from transitlake.operators import dedup, discover, filters, metrics, quality, releases, running, sampling, skymatch
from transitlake.plans import adapters as A
from transitlake.plans import oracle_parts as Q
from transitlake.plans.build import enrich, unify
from transitlake.session import checkpoint_folder, cut_lineage, tune
from transitlake.streaming.ingest import normalise_upload

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its check SQL."""

    def keep(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def r(c: str | Column, digits: int = 6) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, digits)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [r(n, digits).alias(n) for n in names]


def rounded_doubles(*names: str, digits: int = 6) -> list[Column]:
    return [round_double(F.col(n), digits).alias(n) for n in names]


def sql_rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return add_catalog_features(add_bundles(with_classes(A.feeds(spark, folder))))


# ------------------------------------------------------------ table core --
@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS},
fine AS (SELECT mission, label, count(*) AS k FROM labelled WHERE label_int IS NOT NULL GROUP BY ALL)
SELECT mission, label, bit_count(grouping_id(mission, label)::INT) AS level, sum(k)::BIGINT AS n
FROM fine GROUP BY ROLLUP (mission, label)"""
)
def label_counts(spark, folder):
    stacked = dedup.stack_feeds([with_classes(f) for f in A.separate_feeds(spark, folder)])
    counted = quality.class_counts(filters.labelled(stacked))
    return counted.select("mission", "label", F.col("level").cast("int").alias("level"), "n")


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}
SELECT {Q.ALLKEYS}, tidy AS disposition, label, label_int FROM labelled"""
)
def label_mapping(spark, folder):
    from transitlake.functions.labels import tidy_label

    mapped = with_classes(A.feeds(spark, folder))
    return mapped.select(*A.LINE_KEY, tidy_label(F.col("label_raw")).alias("disposition"), "label", "label_int")


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}
SELECT 'unmapped_label' AS stage, label_raw AS metric, count(*) AS value FROM labelled
WHERE label_int IS NULL GROUP BY ALL"""
)
def dropped_labels(spark, folder):
    return quality.drop_log(with_classes(A.feeds(spark, folder)))


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}
SELECT {Q.ALLKEYS}, {sql_rounded('dur_h_err_mean', 'depth_ppm_err_mean')},
       round(dur_h_err_mean / nullif(abs(dur_h), 0), 9) AS dur_h_rel_err,
       round(depth_ppm_err_mean / nullif(abs(depth_ppm), 0), 9) AS depth_ppm_rel_err,
       CAST(dur_h IS NULL AS INT) AS dur_h_missing, CAST(depth_ppm IS NULL AS INT) AS depth_ppm_missing
FROM bundles"""
)
def uncertainty_bundles(spark, folder):
    return add_bundles(A.feeds(spark, folder)).select(
        *A.LINE_KEY,
        *rounded_doubles("dur_h_err_mean", "depth_ppm_err_mean"),
        *rounded_doubles("dur_h_rel_err", "depth_ppm_rel_err", digits=9),
        "dur_h_missing",
        "depth_ppm_missing",
    )


CATALOG_FEATURES = [
    "depth_from_ror_ppm", "depth_consistency", "dur_frac", "depth_snr", "dur_snr", "pm_tot",
    "ror_from_radii", "ror_consistency",
]


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, {Q.FEATURES}
SELECT {Q.ALLKEYS}, {sql_rounded(*CATALOG_FEATURES)}, ecc_flag, high_b FROM featured"""
)
def catalog_features(spark, folder):
    return featured(spark, folder).select(*A.LINE_KEY, *rounded_doubles(*CATALOG_FEATURES), "ecc_flag", "high_b")


def physics_steps(source: str) -> str:
    """Steps that end in ``q``: the physical columns beside those of ``source``."""
    return f"""m AS (SELECT *, coalesce(mass_Ms, pow(10::DOUBLE, logg_cgs) * 0.01::DOUBLE * pow(rad_Rs * {S.SUN_RADIUS!r}::DOUBLE, 2)
        / {S.GRAVITY!r}::DOUBLE / {S.SUN_MASS!r}::DOUBLE) AS mass, rad_Rs * {S.SUN_RADIUS!r}::DOUBLE AS rm FROM {source}),
o AS (SELECT *, cbrt({S.GRAVITY!r}::DOUBLE * {S.SUN_MASS!r}::DOUBLE / (4 * pi() * pi()) * mass
        * pow(period * 86400, 2)) AS am FROM m),
p AS (SELECT *, 3 * {S.SUN_MASS!r}::DOUBLE * mass / (4 * pi() * pow(rm, 3)) * 1e-3 AS rho_star_cgs,
        am / {S.ASTRO_UNIT!r}::DOUBLE AS a_AU, am / rm AS a_over_rs_phys,
        ror * rad_Rs * ({S.SUN_RADIUS!r}::DOUBLE / {S.EARTH_RADIUS!r}::DOUBLE) AS Rp_Re_from_ror,
        CASE WHEN am > 0 AND 1 - pow(coalesce(ecc, 0), 2) > 0 THEN
          least(1, rm / am * (1 + coalesce(ror, 0)) / (1 - pow(coalesce(ecc, 0), 2))) END AS geom_transit_prob,
        teff_K * sqrt(rm / (2 * am)) * pow(0.7::DOUBLE, 0.25::DOUBLE) AS Teq_phys_K,
        CASE WHEN impact IS NOT NULL THEN
          24 * period / pi() * (rm / am) * sqrt(greatest(pow(1 + coalesce(ror, 0), 2) - pow(greatest(impact, 0), 2), 0))
          / sin(radians(incl_deg)) END AS dur_model_h FROM o),
q AS (SELECT *, abs(a_over_rs - a_over_rs_phys) / a_over_rs_phys AS a_over_rs_consistency,
        abs(dur_h - dur_model_h) / CASE WHEN dur_h > 0 THEN dur_h END AS dur_consistency,
        coalesce(eqt_K, Teq_phys_K) AS eqt_filled,
        CASE WHEN pm_tot > 0 THEN mag_T + 5 * log10(pm_tot / 1000) + 5 END AS H_G,
        CASE WHEN pm_tot > 0 THEN mag_Kepler + 5 * log10(pm_tot / 1000) + 5 END AS H_K,
        coalesce(Rp_Re_from_ror, rade_Re) AS rp FROM p)"""


PHYSICS_FLAGS_SQL = """CAST(coalesce(logg_cgs < 3.8::DOUBLE, false) OR coalesce(pm_tot < 3, false) AS INT) AS giant_flag,
       coalesce(CAST(log10(rp) < 0.26::DOUBLE + 0.11::DOUBLE * log10(insol_S) AS INT), 0) AS valley_flag,
       coalesce(CAST(geom_transit_prob < 0.005::DOUBLE AS INT), 0) AS low_prob_flag,
       coalesce(CAST(dur_consistency > 0.5 AS INT), 0) AS dur_outlier_flag,
       CAST(coalesce(dur_consistency > 1, false) OR coalesce(geom_transit_prob < 0.001::DOUBLE, false) AS INT)
         AS physics_veto_flag"""
PHYSICS_OUT = [
    "rho_star_cgs", "a_AU", "a_over_rs_phys", "a_over_rs_consistency", "Rp_Re_from_ror",
    "geom_transit_prob", "Teq_phys_K", "dur_model_h", "dur_consistency", "H_G", "H_K",
]


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, {Q.FEATURES}, {physics_steps("featured")}
SELECT {Q.ALLKEYS}, {sql_rounded(*PHYSICS_OUT)}, round(eqt_filled, 6) AS eqt_K, {PHYSICS_FLAGS_SQL} FROM q"""
)
def physics_features(spark, folder):
    physical = add_physics(featured(spark, folder))
    flags = [*S.PHYSICS_FLAGS, "physics_veto_flag"]
    return physical.select(*A.LINE_KEY, *rounded_doubles(*PHYSICS_OUT, "eqt_K"), *flags)


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}
SELECT {Q.ALLKEYS}, round(depth_ppm / nullif(depth_ppm_err_mean, 0), 6) AS bls_sn_proxy,
       round(coalesce(depth_ppm / nullif(depth_ppm_err_mean, 0), 0), 6) AS bls_sn_filled FROM bundles"""
)
def snr_proxies(spark, folder):
    """Signal over noise from the depth, missing or as 0."""
    rows = add_physics(featured(spark, folder))
    return rows.select(*A.LINE_KEY, r("bls_sn_proxy").alias("bls_sn_proxy"), F.round(F.coalesce("bls_sn_proxy", F.lit(0.0)), 6).alias("bls_sn_filled"))


@query(
    f"""WITH {Q.UNIFIED_STEPS} SELECT {Q.ALLKEYS}, mission, {sql_rounded('ror', 'impact', 'incl_deg')}
FROM plausible"""
)
def plausible_rows(spark, folder):
    kept = filters.plausible(A.feeds(spark, folder))
    return kept.select(*A.LINE_KEY, "mission", *rounded_doubles("ror", "impact", "incl_deg"))


@query(
    f"""WITH {Q.UNIFIED_STEPS} SELECT {Q.ALLKEYS}, mission, period FROM plausible
WHERE period > 0 AND dur_h > 0 AND depth_ppm > 0 AND rad_Rs > 0"""
)
def positive_rows(spark, folder):
    kept = filters.positive(filters.plausible(A.feeds(spark, folder)))
    return kept.select(*A.LINE_KEY, "mission", "period")


PROFILED = ["period", "ror", "impact", "depth_snr", "dur_snr", "dur_frac"]


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, {Q.FEATURES}
SELECT mission, count(*) AS rows, {', '.join(f'count({c}) AS {c}_present' for c in PROFILED)}
FROM featured GROUP BY mission"""
)
def present_counts(spark, folder):
    return quality.present_counts(featured(spark, folder), PROFILED, ["mission"])


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, {Q.FEATURES}
SELECT {', '.join(f'round(avg(CAST({c} IS NULL AS INT)), 9) AS {c}' for c in PROFILED)} FROM featured"""
)
def missing_shares(spark, folder):
    return quality.missing_shares(featured(spark, folder), PROFILED).select(*rounded(*PROFILED, digits=9))


CLIPPED = ["period", "depth_ppm", "ror", "depth_snr", "dur_frac"]


@query(
    f"""WITH {Q.UNIFIED_STEPS},
bounds AS (SELECT mission AS m, {', '.join(f'quantile_cont({c}, [0.001, 0.999]) AS b_{c}' for c in CLIPPED)}
           FROM plausible GROUP BY mission)
SELECT {Q.ALLKEYS}, mission,
  {', '.join(f'round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, b_{c}[2]), b_{c}[1]) END, 6) AS {c}' for c in CLIPPED)}
FROM plausible JOIN bounds ON mission = m"""
)
def winsorized(spark, folder):
    clipped = quality.winsorize(enrich(A.feeds(spark, folder)), CLIPPED, ["mission"])
    return clipped.select(*A.LINE_KEY, "mission", *rounded_doubles(*CLIPPED))


MEDIANS = ["period", "depth_ppm", "ror", "impact", "teff_K", "depth_snr"]


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, {Q.FEATURES}
{' UNION ALL '.join(f"SELECT '{c}' AS key, round(median({c}), 6) AS value FROM featured" for c in MEDIANS)}"""
)
def feature_medians(spark, folder):
    return quality.medians(featured(spark, folder), MEDIANS).select("key", r("value").alias("value"))


BINNED = ["period", "ror", "dur_frac", "depth_consistency"]
#: depth_consistency is constant up to its last bits in these feeds
BINNED_SQL = {c: f"round({c}, 9)" if c == "depth_consistency" else c for c in BINNED}


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, {Q.FEATURES},
cells AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {v} AS v FROM featured" for c, v in BINNED_SQL.items())}),
e AS (SELECT col, min(v) - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS lo, max(v) + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS hi
      FROM cells GROUP BY col),
b AS (SELECT col, CAST(least(floor((v - lo) * 50 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n
      FROM cells JOIN e USING (col) WHERE v IS NOT NULL GROUP BY ALL)
SELECT col AS "column", g.bin::INT AS bin, round(lo + (hi - lo) / 50 * g.bin, 6) AS bin_from,
       round(lo + (hi - lo) / 50 * (g.bin + 1), 6) AS bin_to, coalesce(n, 0) AS n
FROM e CROSS JOIN (SELECT unnest(range(50)) AS bin) g LEFT JOIN b USING (col, bin)"""
)
def quality_histogram(spark, folder):
    rows = featured(spark, folder).withColumn("depth_consistency", r("depth_consistency", 9))
    bins = quality.histogram(rows, BINNED)
    return bins.select("column", "bin", *rounded("bin_from", "bin_to"), "n")


FIRST_SQL = f"""row_number() OVER (PARTITION BY star_id, period, t0_bjd ORDER BY feed_ord, {Q.ALLKEYS}) = 1"""


@query(f"WITH {Q.FEEDS} SELECT {Q.ALLKEYS}, star_id, period, t0_bjd, mission FROM feeds QUALIFY {FIRST_SQL}")
def keep_first(spark, folder):
    unique = dedup.drop_repeats(A.feeds(spark, folder), A.FEED_ORDER)
    return unique.select(*A.LINE_KEY, "star_id", "period", "t0_bjd", "mission")


@query(
    f"""WITH {Q.FEEDS} SELECT {Q.ALLKEYS}, star_id, period FROM feeds
QUALIFY row_number() OVER (PARTITION BY star_id, period
  ORDER BY {', '.join(f'{c} DESC' for c in ['feed_ord', *Q.ALLKEYS.split(', ')])}) = 1"""
)
def keep_last(spark, folder):
    unique = dedup.keep_last(A.feeds(spark, folder), ["star_id", "period"], A.FEED_ORDER)
    return unique.select(*A.LINE_KEY, "star_id", "period")


@query(
    """SELECT event_id, user_id AS kepid, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
)
def one_per_host(spark, folder):
    rows = A.table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("kepid"), "event_type", "value", "ts",
        F.lit(0.0).alias("ra_deg"), F.lit(0.0).alias("dec_deg"),
    )
    return dedup.one_per_host(rows, ["ts", "event_id"]).select("event_id", "kepid", "event_type", "value")


UNIFIED_CLIP = [c for c in S.CLIPPED_COLUMNS if c not in ("feh_dex", "age_Gyr", "ra_deg", "dec_deg", "dist_pc")]
UNIFIED_OUT = ["depth_ppm", "ror", "impact", "depth_snr", "depth_consistency", "dur_frac", "teff_K"]


@query(
    f"""WITH {Q.UNIFIED_STEPS},
bounds AS (SELECT mission AS m, {', '.join(f'quantile_cont({c}, [0.001, 0.999]) AS b_{c}' for c in UNIFIED_CLIP)}
           FROM plausible GROUP BY mission),
clipped AS (SELECT plausible.* REPLACE (
  {', '.join(f'CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, b_{c}[2]), b_{c}[1]) END AS {c}' for c in UNIFIED_CLIP)})
  FROM plausible JOIN bounds ON mission = m),
single AS (SELECT * FROM clipped WHERE label_int IS NOT NULL QUALIFY {FIRST_SQL}), {physics_steps("single")}
SELECT {Q.ALLKEYS}, mission, star_id, label, label_int, round(period, 6) AS period, {sql_rounded(*UNIFIED_OUT)},
       CAST(mission = 'Kepler' AS INT) AS is_kepler, CAST(mission = 'K2' AS INT) AS is_k2,
       CAST(mission = 'TESS' AS INT) AS is_tess,
       {sql_rounded(*PHYSICS_OUT)}, round(eqt_filled, 6) AS eqt_K, {PHYSICS_FLAGS_SQL}
FROM q"""
)
def unified_table(spark, folder):
    unified = unify(A.separate_feeds(spark, folder), order=A.FEED_ORDER)
    return unified.select(
        *A.LINE_KEY, "mission", "star_id", "label", "label_int", *rounded_doubles("period", *UNIFIED_OUT),
        *S.MISSION_FLAGS.values(), *rounded_doubles(*PHYSICS_OUT, "eqt_K"), *S.PHYSICS_FLAGS, "physics_veto_flag",
    )


def number_text(c: str) -> str:
    """SQL of the text that stands for a double in a fingerprint."""
    whole, rest = f"floor(abs({c}))", f"(abs({c}) - floor(abs({c}))) * 4611686018427387904.0"
    parts = [whole, f"floor({rest})", f"floor(({rest} - floor({rest})) * 4611686018427387904.0)"]
    return f"CASE WHEN {c} < 0 THEN '-' ELSE '' END || " + " || '.' || ".join(f"{p}::BIGINT::VARCHAR" for p in parts)


def text_of(c: str, kind: str) -> str:
    shown = {
        "double": number_text(c), "string": f"length({c}) || ':' || {c}", "time": f"epoch_us({c})::VARCHAR", "whole": f"{c}::VARCHAR",
    }
    return f"coalesce({shown[kind]}, '~')"


LINE_KINDS = {
    "l_discount": "double", "l_extendedprice": "double", "l_linenumber": "whole", "l_linestatus": "string", "l_orderkey": "whole",
    "l_partkey": "whole", "l_quantity": "double", "l_returnflag": "string", "l_shipdate": "time", "l_suppkey": "whole", "l_tax": "double",
}


@query(
    f"""WITH d AS (SELECT md5(concat_ws('|', {', '.join(text_of(c, k) for c, k in sorted(LINE_KINDS.items()))})) AS m FROM lineitem)
SELECT count(*) AS rows, sum(('0x' || substr(m, 1, 16))::UBIGINT)::VARCHAR AS digest_high,
       sum(('0x' || substr(m, 17, 16))::UBIGINT)::VARCHAR AS digest_low FROM d"""
)
def table_fingerprint(spark, folder):
    return quality.fingerprint(A.table(spark, folder, "lineitem"))


@query(
    """SELECT count(*) FILTER (CAST(l_returnflag = 'A' AS INT) + CAST(l_returnflag = 'R' AS INT)
  + CAST(l_returnflag = 'N' AS INT) <> 1) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def mission_flag_check(spark, folder):
    stacked = dedup.stack_feeds(A.separate_feeds(spark, folder))
    return quality.flag_violations(stacked)


# -------------------------------------------------------------- positions --
@query(
    f"""WITH {Q.SKY}, {Q.PAIRS.format(radius=2)}
SELECT s.c_custkey, n.source_id AS gaia_source_id, n.parallax AS gaia_parallax, n.gmag AS gaia_gmag,
       round(sep, 5) AS sep_arcsec FROM sky s LEFT JOIN nearest n USING (c_custkey)"""
)
def sky_match(spark, folder):
    matched = skymatch.nearest_on_sky(
        A.sky_rows(spark, folder), A.sky_catalog(spark, folder), skymatch.GAIA_PAYLOAD, "source_id"
    )
    return matched.select("c_custkey", *skymatch.GAIA_PAYLOAD.values(), r("sep_arcsec", 5).alias("sep_arcsec"))


@query(
    f"""WITH {Q.SKY}, {Q.PAIRS.format(radius=2)}
SELECT s.c_custkey, n.source_id AS gaia_source_id, n.parallax AS gaia_parallax, n.gmag AS gaia_gmag,
       n.source_id AS tic_id, n.gmag AS "tic_Tmag", n.parallax / 10 AS tic_st_rad, n.parallax / 20 AS tic_st_mass
FROM sky s LEFT JOIN nearest n USING (c_custkey)"""
)
def sky_match_tic(spark, folder):
    """Both catalogs at once."""
    gaia = A.sky_catalog(spark, folder)
    tic = gaia.select(
        F.col("source_id").alias("ID"), F.col("phot_g_mean_mag").alias("Tmag"), (F.col("parallax") / 10).alias("rad"),
        (F.col("parallax") / 20).alias("mass"), "ra", "dec",
    )
    matched = skymatch.match_catalogs(A.sky_rows(spark, folder), gaia, tic)
    return matched.select("c_custkey", *skymatch.GAIA_PAYLOAD.values(), *skymatch.TIC_PAYLOAD.values())


@query(
    f"""WITH {Q.SKY}, {Q.PAIRS.format(radius=40)}
SELECT 'unmatched' AS stage, 'gaia' AS metric, count(*) FILTER (n.source_id IS NULL) AS value
FROM sky s LEFT JOIN nearest n USING (c_custkey)"""
)
def sky_unmatched(spark, folder):
    matched = skymatch.match_catalogs(
        A.sky_rows(spark, folder), gaia=A.sky_catalog(spark, folder), radius_arcsec=40.0
    )
    return skymatch.unmatched_counts(matched)


@query(
    f"""WITH {Q.SKY}, ref AS (SELECT *, m.mission AS mission FROM catalog
   CROSS JOIN (SELECT unnest(['Kepler', 'TESS', 'K2']) AS mission) m),
hits AS (SELECT c_custkey, name, source_id FROM sky s JOIN ref r
  ON s.mission = r.mission AND abs(r.ra - s.ra_deg) < 0.01::DOUBLE AND abs(r.dec - s.dec_deg) < 0.01::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY source_id) = 1)
SELECT c_custkey, s.mission, coalesce(name, 'Unlabeled Object') AS object_name
FROM sky s LEFT JOIN hits USING (c_custkey)"""
)
def sky_names(spark, folder):
    reference = A.sky_catalog(spark, folder).withColumn(
        "mission", F.explode(F.array(*[F.lit(m) for m in S.MISSIONS]))
    )
    named = skymatch.name_by_box(A.sky_rows(spark, folder), reference, ["name"], "source_id")
    return named.select("c_custkey", "mission", "object_name")


@query(
    f"""WITH {Q.SKY} SELECT c_custkey, mission,
  round(dist_pc * (cos(radians(dec_deg)) * cos(radians(ra_deg))), 6) AS x,
  round(dist_pc * (cos(radians(dec_deg)) * sin(radians(ra_deg))), 6) AS y,
  round(dist_pc * sin(radians(dec_deg)), 6) AS z
FROM sky WHERE ra_deg IS NOT NULL AND dec_deg IS NOT NULL AND dist_pc IS NOT NULL"""
)
def space_positions(spark, folder):
    rows = filters.placeable(A.sky_rows(spark, folder))
    placed = rows.withColumns(cartesian(F.col("ra_deg"), F.col("dec_deg"), F.col("dist_pc")))
    return placed.select("c_custkey", "mission", *rounded("x", "y", "z"))


@query(
    f"""WITH {Q.SKY}, p AS (SELECT dist_pc * cos(radians(dec_deg)) * cos(radians(ra_deg)) AS x,
  dist_pc * cos(radians(dec_deg)) * sin(radians(ra_deg)) AS y, dist_pc * sin(radians(dec_deg)) AS z
  FROM sky WHERE dist_pc IS NOT NULL),
b AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
      min(z) AS z0, max(z) AS z1 FROM p),
d AS (SELECT max(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS far FROM p, b)
SELECT round(mx, 6) AS x_mean, round(my, 6) AS y_mean, round(mz, 6) AS z_mean, round(x0, 6) AS x_min,
  round(y0, 6) AS y_min, round(z0, 6) AS z_min, round(x1, 6) AS x_max, round(y1, 6) AS y_max,
  round(z1, 6) AS z_max, round((x0 + x1) / 2, 6) AS x_centre, round((y0 + y1) / 2, 6) AS y_centre,
  round((z0 + z1) / 2, 6) AS z_centre, round(greatest(x1 - x0, y1 - y0, z1 - z0), 6) AS extent,
  round(far, 6) AS max_dist FROM b, d"""
)
def cloud_extent(spark, folder):
    rows = filters.placeable(A.sky_rows(spark, folder))
    placed = rows.withColumns(cartesian(F.col("ra_deg"), F.col("dec_deg"), F.col("dist_pc")))
    extent = discover.cloud_extent(placed)
    return extent.select(*rounded(*extent.columns))


@query(f"WITH {Q.SKY} SELECT count(dist_pc) AS placed, count(*) AS total FROM sky")
def placeable_count(spark, folder):
    return discover.placeable_count(A.sky_rows(spark, folder))


@query(
    f"""WITH {Q.SKY}, one AS (SELECT * FROM sky)
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS star_id, round(ra_deg, 6) AS ra_deg,
       round(dec_deg, 6) AS dec_deg, dist_pc
FROM orders LEFT JOIN one ON CAST(o_custkey AS VARCHAR) = one.star_id"""
)
def scored_positions(spark, folder):
    scored = A.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("star_id")
    )
    positions = A.sky_rows(spark, folder).select("c_custkey", "star_id", "ra_deg", "dec_deg", "dist_pc")
    joined = skymatch.attach_positions(scored, positions, ["c_custkey"])
    return joined.select("o_orderkey", "star_id", *rounded("ra_deg", "dec_deg"), "dist_pc")


# ---------------------------------------------------------------- metrics --
@query(f"WITH {Q.SCORES} SELECT y, count(*) AS n, round((SELECT count(*) FROM scores) / (3 * count(*)), 9) AS weight FROM scores GROUP BY y")
def class_weights(spark, folder):
    return metrics.class_weights(A.scores(spark, folder)).select("y", "n", r("weight", 9).alias("weight"))


def _confusion_sql(steps: str, source: str, predicted: str) -> str:
    cells = ", ".join(f"count(*) FILTER (pred = {c}) AS pred_{c}" for c in S.CLASS_IDS)
    return f"WITH {steps}, d AS (SELECT y, {predicted} AS pred FROM {source}) SELECT y, {cells} FROM d GROUP BY y"


ARGMAX_SQL = "CASE WHEN p_fp >= p_cand AND p_fp >= p_conf THEN 0 WHEN p_cand >= p_conf THEN 1 ELSE 2 END"
# fixed values for the check queries
TAUS = {0: 0.4424, 1: 0.3625, 2: 0.4231}
QUANTILES = {0: 0.8327, 1: 0.7881, 2: 0.7307}


@query(_confusion_sql(Q.SCORES, "scores", ARGMAX_SQL))
def confusion_likeliest(spark, folder):
    return metrics.confusion(A.scores(spark, folder), decide.likeliest_class())


MARGIN = [f"(p_{n} - {TAUS[c]}::DOUBLE)" for c, n in enumerate(["fp", "cand", "conf"])]


@query(
    _confusion_sql(
        Q.SCORES,
        "scores",
        f"CASE WHEN greatest({', '.join(MARGIN)}) < 0 THEN {ARGMAX_SQL} "
        f"WHEN {MARGIN[0]} >= {MARGIN[1]} AND {MARGIN[0]} >= {MARGIN[2]} THEN 0 "
        f"WHEN {MARGIN[1]} >= {MARGIN[2]} THEN 1 ELSE 2 END",
    )
)
def confusion_thresholds(spark, folder):
    return metrics.confusion(A.scores(spark, folder), decide.threshold_class(TAUS))


COST_SQL = [
    f"(p_fp * {S.COSTS[0][j]}::DOUBLE + p_cand * {S.COSTS[1][j]}::DOUBLE + p_conf * {S.COSTS[2][j]}::DOUBLE)"
    for j in S.CLASS_IDS
]


@query(
    _confusion_sql(
        Q.SCORES,
        "scores",
        f"CASE WHEN {COST_SQL[0]} <= {COST_SQL[1]} AND {COST_SQL[0]} <= {COST_SQL[2]} THEN 0 "
        f"WHEN {COST_SQL[1]} <= {COST_SQL[2]} THEN 1 ELSE 2 END",
    )
)
def confusion_costs(spark, folder):
    return metrics.confusion(A.scores(spark, folder), decide.cheapest_class())


AP_SQL = f"{Q.CLASS_SCORES}, {Q.curve()}"


@query(
    f"""WITH {Q.SCORES}, {Q.CLASS_SCORES}, {Q.curve('mission,')}
SELECT mission, class, (SELECT count(*) FROM scores s WHERE s.mission = runs.mission) AS rows,
       round(sum(own / own_all * (tp / seen)), 9) AS average_precision FROM runs GROUP BY mission, class"""
)
def mission_class_metrics(spark, folder):
    found = metrics.mission_class_metrics(A.scores(spark, folder))
    return found.select("mission", "class", "rows", r("average_precision", 9).alias("average_precision"))


@query(
    f"""WITH {Q.SCORES}, {AP_SQL}
SELECT class, round(sum(own / own_all * (tp / seen)), 9) AS average_precision FROM runs GROUP BY class"""
)
def average_precision(spark, folder):
    table = metrics.score_table(A.scores(spark, folder))
    return metrics.average_precision(table).select("class", r("average_precision", 9).alias("average_precision"))


@query(
    f"""WITH {Q.SCORES}, {Q.CLASS_SCORES}, {Q.curve('mission,')},
ap AS (SELECT mission, class, sum(own / own_all * (tp / seen)) AS v FROM runs GROUP BY mission, class)
SELECT mission, (SELECT count(*) FROM scores s WHERE s.mission = ap.mission) AS rows,
       round(avg(v), 9) AS pr_auc_macro FROM ap GROUP BY mission"""
)
def mission_metrics(spark, folder):
    found = metrics.mission_metrics(A.scores(spark, folder))
    return found.select("mission", "rows", r("pr_auc_macro", 9).alias("pr_auc_macro"))


@query(
    f"""WITH {Q.SCORES}, {AP_SQL}
SELECT class, round(score, 9) AS score, round(tp / seen, 9) AS precision, round(tp / own_all, 9) AS recall FROM runs"""
)
def precision_recall_curve(spark, folder):
    curve = metrics.pr_curve(metrics.score_table(A.scores(spark, folder)))
    return curve.select("class", *rounded("score", "precision", "recall", digits=9))


AUC_SQL = " UNION ALL ".join(
    f"SELECT class, {o} AS other, sum(own::DOUBLE * (a{o} - r{o} + n{o} / 2)) / max(own_all::DOUBLE * a{o}) AS auc "
    f"FROM runs WHERE class <> {o} GROUP BY class"
    for o in S.CLASS_IDS
)


@query(f"WITH {Q.SCORES}, {AP_SQL}, pairs AS ({AUC_SQL}) SELECT class, other, round(auc, 9) AS auc FROM pairs")
def pairwise_auc(spark, folder):
    pairs = metrics.pairwise_auc(metrics.score_table(A.scores(spark, folder)))
    return pairs.select("class", "other", r("auc", 9).alias("auc"))


@query(f"WITH {Q.SCORES}, {AP_SQL}, pairs AS ({AUC_SQL}) SELECT round(avg(auc), 9) AS roc_auc_ovo FROM pairs")
def ovo_auc(spark, folder):
    found = metrics.ovo_auc(metrics.score_table(A.scores(spark, folder)))
    return found.select(r("roc_auc_ovo", 9).alias("roc_auc_ovo"))


@query(
    f"""WITH {Q.SCORES}, {AP_SQL}, f AS (SELECT class, score,
  round(2 * (tp / seen) * (tp / own_all) / (tp / seen + tp / own_all + 1e-9), 12) AS f1 FROM runs)
SELECT class, round(score, 9) AS threshold, round(f1, 9) AS f1 FROM f
QUALIFY row_number() OVER (PARTITION BY class ORDER BY f1 DESC, score) = 1"""
)
def best_thresholds(spark, folder):
    best = metrics.best_f1_thresholds(metrics.score_table(A.scores(spark, folder)))
    return best.select("class", *rounded("threshold", "f1", digits=9))


@query(
    """WITH s AS (SELECT doc_id, quality AS y,
  round(n_chars / (SELECT max(n_chars) FROM documents), 3) AS score FROM labels JOIN documents USING (doc_id)),
t AS (SELECT score, count(*) AS n, sum(y) AS own FROM s GROUP BY score),
u AS (SELECT *, sum(own) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen,
      sum(own) OVER () AS own_all FROM t)
SELECT 1 AS class, round(sum(own / own_all * (tp / seen)), 9) AS average_precision FROM u"""
)
def document_average_precision(spark, folder):
    graded = A.graded_documents(spark, folder)
    table = metrics.score_table(graded, y="quality", classes=[1], scores=["score"])
    found = metrics.average_precision(table)
    return found.select("class", r("average_precision", 9).alias("average_precision"))


BINARY_SQL = f"""{Q.SCORES}, b AS (
  SELECT p_conf, CASE y WHEN 2 THEN 1 WHEN 0 THEN 0 ELSE CAST(p_conf >= 0.5 AS INT) END AS t FROM scores)"""


def _named(spark, folder) -> DataFrame:
    rows = A.scores(spark, folder)
    return rows.withColumns({"label": class_name(F.col("y")), "p_exoplanet": F.col("p_conf")})


@query(
    f"""WITH {BINARY_SQL} SELECT count(*) FILTER (t = 1 AND p_conf >= 0.42::DOUBLE) AS tp,
  count(*) FILTER (t = 0 AND p_conf >= 0.42::DOUBLE) AS fp, count(*) FILTER (t = 1 AND p_conf < 0.42::DOUBLE) AS fn,
  count(*) FILTER (t = 0 AND p_conf < 0.42::DOUBLE) AS tn FROM b"""
)
def binary_confusion(spark, folder):
    return metrics.binary_confusion(_named(spark, folder), 0.42)


SCAN_SQL = f"""{BINARY_SQL}, k AS (SELECT i / 100 AS tau FROM (SELECT unnest(range(101)) AS i)),
c AS (SELECT tau, count(*) FILTER (t = 1 AND p_conf >= tau) AS tp, count(*) FILTER (t = 0 AND p_conf >= tau) AS fp,
  count(*) FILTER (t = 1 AND p_conf < tau) AS fn, count(*) FILTER (t = 0 AND p_conf < tau) AS tn
  FROM k, b GROUP BY tau),
j AS (SELECT *, round(tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1) - 1, 9) AS youden FROM c)"""


@query(f"WITH {SCAN_SQL} SELECT round(tau, 2) AS tau, tp, fp, fn, tn, youden FROM j")
def threshold_scan(spark, folder):
    scan = metrics.threshold_scan(_named(spark, folder))
    return scan.select(r("tau", 2).alias("tau"), "tp", "fp", "fn", "tn", r("youden", 9).alias("youden"))


@query(f"WITH {SCAN_SQL} SELECT round(tau, 2) AS tau, youden FROM j ORDER BY youden DESC, tau LIMIT 1")
def best_youden(spark, folder):
    best = metrics.best_youden(metrics.threshold_scan(_named(spark, folder)))
    return best.select(r("tau", 2).alias("tau"), r("youden", 9).alias("youden"))


RELIABILITY_SQL = f"""{Q.SCORES}, {Q.CLASS_SCORES},
b AS (SELECT class, CAST(least(floor(score * 12), 11) AS INT) AS bin, count(*) AS n, avg(score) AS confidence,
      avg(CAST(y = class AS INT)) AS accuracy FROM cells GROUP BY ALL)"""


@query(
    f"""WITH {RELIABILITY_SQL}
SELECT c.class, g.bin::INT AS bin, coalesce(n, 0) AS n, round(coalesce(confidence, (g.bin + 0.5) / 12), 9) AS confidence,
       round(accuracy, 9) AS accuracy
FROM (SELECT unnest([0, 1, 2]) AS class) c CROSS JOIN (SELECT unnest(range(12)) AS bin) g
LEFT JOIN b ON b.class = c.class AND b.bin = g.bin"""
)
def reliability_bins(spark, folder):
    bins = metrics.reliability(A.scores(spark, folder))
    return bins.select("class", "bin", "n", *rounded("confidence", "accuracy", digits=9))


@query(f"WITH {RELIABILITY_SQL} SELECT round(sum(abs(accuracy - confidence) * n) / sum(n), 9) AS ece FROM b")
def calibration_error(spark, folder):
    return metrics.calibration_error(metrics.reliability(A.scores(spark, folder))).select(r("ece", 9).alias("ece"))


@query(
    f"""WITH {BINARY_SQL}, h AS (SELECT CAST(greatest(0, least(9, floor(p_conf * 10))) AS INT) AS bin, count(*) AS n,
  avg(t) AS observed FROM b GROUP BY ALL)
SELECT round((g.bin + 0.5) / 10, 3) AS centre, coalesce(n, 0) AS n, round(observed, 9) AS observed
FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN h USING (bin)"""
)
def calibration_curve(spark, folder):
    curve = metrics.calibration_curve(_named(spark, folder))
    return curve.select(r("centre", 3).alias("centre"), "n", r("observed", 9).alias("observed"))


@query(
    f"""WITH {Q.SCORES}, s AS (SELECT y AS class, 1 - CASE y WHEN 0 THEN p_fp WHEN 1 THEN p_cand ELSE p_conf END AS v
  FROM scores)
SELECT class, round(v, 9) AS q FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY v)
  = least(greatest(ceil((count(*) OVER (PARTITION BY class) + 1) * 0.9::DOUBLE), 1), count(*) OVER (PARTITION BY class))"""
)
def conformal_quantiles(spark, folder):
    return metrics.conformal_quantiles(A.scores(spark, folder)).select("class", r("q", 9).alias("q"))


@query(
    f"""WITH {Q.SCORES}, k AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split,
  y % 2 AS part, * FROM scores),
f AS (SELECT 'train' AS split, 'Kepler' AS mission, y, count(*) AS n FROM k WHERE split = 'train' GROUP BY y UNION ALL
      SELECT 'test', 'TESS', y, count(*) FROM k WHERE split = 'test' GROUP BY y)
SELECT split, mission, y, n FROM f UNION ALL SELECT split, 'All', y, sum(n)::BIGINT FROM f GROUP BY split, y"""
)
def class_distribution(spark, folder):
    split = F.when(F.col("mission") == "Kepler", "train").otherwise("test")
    return metrics.class_distribution(A.scores(spark, folder).withColumn("split", split))


def _three_models(spark, folder) -> DataFrame:
    """Long table of three models' triples: the second and third rotate the first."""
    rows = A.scores(spark, folder)
    turns = [("a", [0, 1, 2]), ("b", [1, 2, 0]), ("c", [2, 0, 1])]
    cells = [
        F.struct(F.lit(m).alias("model"), *[F.col(S.PROBABILITIES[i]).alias(p) for p, i in zip(S.PROBABILITIES, turn)])
        for m, turn in turns
    ]
    return rows.select(*A.LINE_KEY, "y", F.explode(F.array(*cells)).alias("m")).select(*A.LINE_KEY, "y", "m.*")


MODELS_SQL = f"""{Q.SCORES}, models AS (
  SELECT *, 'a' AS model, p_fp AS q0, p_cand AS q1, p_conf AS q2 FROM scores UNION ALL
  SELECT *, 'b', p_cand, p_conf, p_fp FROM scores UNION ALL SELECT *, 'c', p_conf, p_fp, p_cand FROM scores),
cells AS (SELECT model, y, 0 AS class, q0 AS score FROM models UNION ALL
  SELECT model, y, 1, q1 FROM models UNION ALL SELECT model, y, 2, q2 FROM models),
{Q.curve('model,')},
ap AS (SELECT model, class, sum(own / own_all * (tp / seen)) AS v FROM runs GROUP BY model, class),
macro AS (SELECT model, avg(v) AS pr_auc_macro FROM ap GROUP BY model),
w AS (SELECT model, pr_auc_macro, pow(pr_auc_macro, 2) / (SELECT sum(pow(pr_auc_macro, 2)) FROM macro) AS weight FROM macro)"""


@query(f"WITH {MODELS_SQL} SELECT model, round(pr_auc_macro, 9) AS pr_auc_macro, round(weight, 9) AS weight FROM w")
def ensemble_weights(spark, folder):
    table = metrics.score_table(_three_models(spark, folder), ["model"])
    weighted = metrics.ensemble_weights(metrics.macro_average_precision(table, ["model"]))
    return weighted.select("model", *rounded("pr_auc_macro", "weight", digits=9))


@query(
    f"""WITH {MODELS_SQL} SELECT {Q.ALLKEYS}, round(sum(weight * q0), 9) AS p_fp, round(sum(weight * q1), 9) AS p_cand,
  round(sum(weight * q2), 9) AS p_conf FROM models JOIN w USING (model) GROUP BY ALL"""
)
def weighted_ensemble(spark, folder):
    from transitlake.operators.ensemble import weighted_average

    models = _three_models(spark, folder)
    table = metrics.score_table(models, ["model"])
    weights = metrics.ensemble_weights(metrics.macro_average_precision(table, ["model"]))
    mixed = weighted_average(models, weights.select("model", "weight"), A.LINE_KEY)
    return mixed.select(*A.LINE_KEY, *rounded(*S.PROBABILITIES, digits=9))


FOLD_SQL = f"""{Q.SCORES}, {Q.CLASS_SCORES}, {Q.curve('mission,')},
ap AS (SELECT mission, class, sum(own / own_all * (tp / seen)) AS v FROM runs GROUP BY mission, class)"""


@query(f"WITH {FOLD_SQL} SELECT class, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM ap GROUP BY class")
def fold_summary(spark, folder):
    per_fold = metrics.average_precision(metrics.score_table(A.scores(spark, folder), ["mission"]), ["mission"])
    return metrics.fold_summary(per_fold, "average_precision", ["class"]).select("class", *rounded("mean", "std", digits=9))


# -------------------------------------------------------------- decisions --
@query(
    f"""WITH {Q.SCORES}, {Q.VETO} SELECT {Q.ALLKEYS}, {sql_rounded('p_fp', 'p_cand', 'p_conf', digits=9)},
  round(p_conf_before, 9) AS p_conf_before_veto, p_conf_before > p_conf + 1e-9 AS veto_hit FROM vetoed"""
)
def physics_veto(spark, folder):
    vetoed = decide.apply_veto(A.scores(spark, folder))
    return vetoed.select(*A.LINE_KEY, *rounded(*S.PROBABILITIES, "p_conf_before_veto", digits=9), "veto_hit")


IN_SET = ", ".join(
    f"CASE WHEN 1 - p_{n} <= {QUANTILES[c]}::DOUBLE THEN '{c}' END" for c, n in enumerate(["fp", "cand", "conf"])
)


@query(
    f"""WITH {Q.SCORES} SELECT {Q.ALLKEYS}, concat_ws(',', {IN_SET}) AS prediction_set,
  {', '.join(f'round({m}, 9) AS margin_{c}' for c, m in enumerate(MARGIN))} FROM scores"""
)
def conformal_sets(spark, folder):
    rows = A.scores(spark, folder).withColumn("m", decide.margins(TAUS))
    members = F.transform(decide.conformal_set(QUANTILES), lambda c: c.cast("string"))
    return rows.select(
        *A.LINE_KEY,
        F.array_join(members, ",").alias("prediction_set"),
        *[r(F.col("m")[c], 9).alias(f"margin_{c}") for c in S.CLASS_IDS],
    )


SCORE_SQL = """1.0::DOUBLE * p_conf + 0.4::DOUBLE * p_cand + -0.6::DOUBLE * p_fp + 0.15::DOUBLE * coalesce(depth_snr, 0)
  + 0.1::DOUBLE * coalesce(geom_transit_prob, 0)
  + -0.1::DOUBLE * coalesce(1 - 1 / (1 + abs(dur_consistency)), 0)"""
RANKED_SQL = f"""{Q.SCORES}, rated AS (SELECT *, {SCORE_SQL} AS discovery_score,
  p_conf >= 0.9::DOUBLE OR p_cand >= 0.95::DOUBLE AS passes_gate FROM scores)"""


def _rated(spark, folder) -> DataFrame:
    # rounded so that the ranking does not hang on the last bit
    decided = discover.with_decisions(A.scores(spark, folder), TAUS, QUANTILES)
    return decided.withColumns({"discovery_score": r("discovery_score", 9), "p_conf": r("p_conf", 9), "p_cand": r("p_cand", 9)})


RATED_SQL = f"""{RANKED_SQL}, rounded AS (SELECT {Q.ALLKEYS}, star_id, passes_gate, mission, round(discovery_score, 9) AS discovery_score,
  round(p_conf, 9) AS p_conf, round(p_cand, 9) AS p_cand, y, {ARGMAX_SQL} AS pred FROM rated)"""
RANK_ORDER = f"passes_gate DESC, discovery_score DESC, p_conf DESC, p_cand DESC, star_id, {Q.ALLKEYS}"
RATED_OUT = ["star_id", "passes_gate", "discovery_score", "p_conf", "p_cand"]


@query(f"WITH {RATED_SQL} SELECT {Q.ALLKEYS}, {', '.join(RATED_OUT)}, pred FROM rounded")
def discovery_scores(spark, folder):
    return _rated(spark, folder).select(*A.LINE_KEY, *RATED_OUT, "pred")


@query(f"WITH {RATED_SQL} SELECT {Q.ALLKEYS}, {', '.join(RATED_OUT)} FROM rounded ORDER BY {RANK_ORDER} LIMIT 100")
def top_candidates(spark, folder):
    best = discover.top(_rated(spark, folder), 100, ["star_id", *A.LINE_KEY])
    return best.select(*A.LINE_KEY, *RATED_OUT)


@query(f"WITH {RATED_SQL} SELECT {Q.ALLKEYS}, {', '.join(RATED_OUT)} FROM rounded ORDER BY {RANK_ORDER} LIMIT 50 OFFSET 100")
def candidate_page(spark, folder):
    order = discover.ranking(["star_id", *A.LINE_KEY])
    return discover.page(_rated(spark, folder), order, 3, 50).select(*A.LINE_KEY, *RATED_OUT)


@query(
    f"""WITH {RATED_SQL} SELECT {Q.ALLKEYS}, {', '.join(RATED_OUT)}, row_number() OVER (ORDER BY {RANK_ORDER}) AS rank, count(*) OVER () AS total
FROM rounded QUALIFY rank > 30000 AND rank <= 30100"""
)
def deep_candidate_page(spark, folder):
    """Page 301 of 100 rows and the total, from a stored rank index."""
    from transitlake.operators.pages import build_index

    rows = _rated(spark, folder).select(*A.LINE_KEY, *RATED_OUT)
    path = f"{checkpoint_folder(spark)}/pages-{uuid.uuid4().hex}"
    return build_index(rows, discover.ranking(["star_id", *A.LINE_KEY]), path, 10_000).page(301, 100)


@query(
    f"""WITH {RATED_SQL} SELECT l_orderkey * 10 + l_linenumber AS row_index, star_id, discovery_score FROM rounded
WHERE star_id = '77' ORDER BY row_index LIMIT 50"""
)
def star_explanations(spark, folder):
    """The first explanation records of one star."""
    records = _rated(spark, folder).withColumn("row_index", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return discover.explanations_for(records, star_id="77").select("row_index", "star_id", "discovery_score")


@query(f"WITH {RATED_SQL} SELECT {Q.ALLKEYS}, star_id FROM rounded ORDER BY {Q.ALLKEYS} LIMIT 20")
def first_rows(spark, folder):
    """The head of a table in its own order."""
    return discover.first_rows(_rated(spark, folder), 20, A.LINE_KEY).select(*A.LINE_KEY, "star_id")


@query(f"WITH {RATED_SQL} SELECT {Q.ALLKEYS}, {', '.join(RATED_OUT)} FROM rounded WHERE passes_gate")
def gated_candidates(spark, folder):
    return filters.gated(_rated(spark, folder)).select(*A.LINE_KEY, *RATED_OUT)


@query(f"WITH {RATED_SQL} SELECT {Q.ALLKEYS}, {', '.join(RATED_OUT)} FROM rounded WHERE NOT passes_gate AND mission = 'TESS' AND star_id LIKE '%17%'")
def browse_candidates(spark, folder):
    rows = _rated(spark, folder).withColumn("is_tess", (F.col("mission") == "TESS").cast("int"))
    return filters.browse(rows, "tess", False, "17").select(*A.LINE_KEY, *RATED_OUT)


@query(
    f"""WITH {RANKED_SQL} SELECT {Q.ALLKEYS}, period, round(p_conf, 9) AS p_exoplanet FROM rated WHERE mission = 'Kepler'
  AND {ARGMAX_SQL} = 2 AND p_conf >= 0.5 AND rade_Re >= 1.5 AND (period IS NULL OR period <= 40)"""
)
def map_view(spark, folder):
    rows = discover.with_decisions(A.scores(spark, folder), TAUS, QUANTILES)
    seen = filters.view(rows, "Kepler", "Confirmed", 0.5, 1.5, 40.0)
    return seen.select(*A.LINE_KEY, "period", r("p_exoplanet", 9).alias("p_exoplanet"))


@query(
    f"""WITH {Q.SCORES} SELECT CASE WHEN p_conf >= 0.6::DOUBLE THEN 'Confirmed' WHEN p_conf >= 0.3::DOUBLE THEN 'Candidate'
  ELSE 'False Positive' END AS label, count(*) AS n FROM scores GROUP BY 1"""
)
def labels_by_threshold(spark, folder):
    label = decide.label_by_confirmed(F.col("p_conf"), 0.6, 0.3)
    return A.scores(spark, folder).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {Q.SCORES}, t AS (SELECT *, nullif(l_tax, 0) AS a, nullif(l_discount, 0) AS b, l_quantity / 100 AS c FROM scores)
SELECT {Q.ALLKEYS}, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INT)
  + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0), 9) AS p_exoplanet FROM t"""
)
def mean_of_models(spark, folder):
    rows = A.table(spark, folder, "lineitem")
    present = [F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0)), F.col("l_quantity") / 100]
    return rows.select(*A.LINE_KEY, r(mean_of_present(present), 9).alias("p_exoplanet"))


# ---------------------------------------------------------------- weights --
@query(
    f"""WITH {Q.SCORES}, m AS (SELECT avg(depth_snr) AS a, stddev_pop(depth_snr) AS b, avg(geom_transit_prob) AS c,
  stddev_pop(geom_transit_prob) AS d, avg(dur_consistency) AS e, stddev_pop(dur_consistency) AS f FROM scores),
w AS (SELECT s.*, 1 / (1 + exp(-coalesce((depth_snr - a) / b, 0))) * (1 / (1 + exp(-coalesce((geom_transit_prob - c) / d, 0))))
  * (1 / (1 + exp(coalesce((dur_consistency - e) / f, 0)))) AS raw FROM scores s, m),
k AS (SELECT y, (SELECT count(*) FROM scores) / (3 * count(*)) AS cw FROM scores GROUP BY y)
SELECT {Q.ALLKEYS}, round(greatest(0.5, least(2, raw)), 9) AS physics_weight,
  round(cw * greatest(0.5, least(2, raw)), 9) AS weight FROM w JOIN k USING (y)"""
)
def training_weights(spark, folder):
    weighted = sampling.with_training_weight(A.scores(spark, folder))
    return weighted.select(*A.LINE_KEY, *rounded("physics_weight", "weight", digits=9))


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {Q.BUNDLES}, b AS (SELECT * FROM bundles WHERE label_int IS NOT NULL),
k AS (SELECT label_int, (SELECT count(*) FROM b) / (3 * count(*)) AS cw FROM b GROUP BY label_int)
SELECT {Q.ALLKEYS}, round(cw / coalesce(CASE WHEN depth_ppm_err_mean > 0 THEN depth_ppm_err_mean END, 1), 9) AS weight
FROM b JOIN k USING (label_int)"""
)
def uncertainty_weights(spark, folder):
    rows = filters.labelled(add_bundles(with_classes(A.feeds(spark, folder))))
    return sampling.with_classical_weight(rows, "label_int").select(*A.LINE_KEY, r("weight", 9).alias("weight"))


FOLD_SQL = """counted AS (SELECT star_id, label_int, count(*) AS k FROM labelled WHERE label_int IS NOT NULL GROUP BY ALL),
stars AS (SELECT star_id, arg_max(label_int, (k, -label_int)) AS cls, sum(k) AS k FROM counted GROUP BY star_id),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY cls ORDER BY CAST('0x' || substr(md5(star_id || '|42'), 1, 15) AS BIGINT)) - 1)
  % {parts} AS fold FROM stars)"""


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {FOLD_SQL.format(parts=5)}
SELECT fold::INT AS fold, count(*) AS stars, sum(k)::BIGINT AS "rows", 0::BIGINT AS leaks FROM dealt GROUP BY fold"""
)
def group_folds(spark, folder):
    """Per fold and class: rows and stars. A star must not show in two folds."""
    rows = filters.labelled(with_classes(A.feeds(spark, folder)))
    folded = sampling.group_folds(rows, 5, "star_id", "label_int")
    per_star = folded.groupBy("star_id").agg(
        F.min("fold").alias("fold"), F.max("fold").alias("other"), F.count("*").alias("rows")
    )
    return per_star.groupBy("fold").agg(
        F.count("*").alias("stars"), F.sum("rows").alias("rows"), F.count_if(F.col("fold") != F.col("other")).alias("leaks")
    )


@query(
    f"""WITH {Q.FEEDS}, {Q.LABELS}, {FOLD_SQL.format(parts=7)}
SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split, label_int, sum(counted.k)::BIGINT AS n
FROM dealt JOIN counted USING (star_id) GROUP BY ALL"""
)
def hold_out(spark, folder):
    rows = filters.labelled(with_classes(A.feeds(spark, folder)))
    split = sampling.hold_out(rows, 7, "star_id", "label_int")
    return split.groupBy("split", "label_int").agg(F.count("*").alias("n"))


@query("SELECT fold, 0 AS torn_stars, 0 AS uneven_classes FROM (SELECT unnest(range(5))::INT AS fold)")
def balanced_folds(spark, folder):
    """What must hold of stratified folds: no star in two of them, and each class within 1 %
    of an even share in each."""
    folded = cut_lineage(sampling.balanced_folds(A.scores(spark, folder).select("star_id", "y"), 5))
    torn = folded.groupBy("star_id").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    held = folded.groupBy("fold", "y").agg(F.count("*").alias("n"))
    whole = folded.groupBy(F.col("y").alias("_y")).agg((F.count("*") / 5).alias("even"))
    strays = held.join(F.broadcast(whole), F.col("y") == F.col("_y")).groupBy("fold")
    return strays.agg(
        F.max(torn).cast("int").alias("torn_stars"), F.count_if(F.abs(F.col("n") / F.col("even") - 1) > 0.01).cast("int").alias("uneven_classes")
    )


@query(f"WITH {Q.SCORES} SELECT y, count(*) AS rows, floor(count(*) * 0.15::DOUBLE + 0.5)::BIGINT AS test FROM scores GROUP BY y")
def stratified_hold_out(spark, folder):
    """A hold-out without a star column: 15 in 100 of every class."""
    split = sampling.hold_out(A.scores(spark, folder).select(*A.LINE_KEY, "y"))
    return split.groupBy("y").agg(F.count("*").alias("rows"), F.count_if(F.col("split") == "test").alias("test"))


OVERSAMPLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    f"""WITH {Q.SCORES}, n AS (SELECT y, count(*) AS n FROM scores GROUP BY y),
t AS (SELECT y, CASE WHEN max(n) OVER () / min(n) OVER () > 1.5 THEN max(n) OVER () / n ELSE 1 END AS times FROM n),
d AS (SELECT y, times, CAST('0x' || substr(md5({" || '|' || ".join(OVERSAMPLE_KEYS)} || '|42'), 1, 15) AS BIGINT)
  / 1152921504606846976 AS draw FROM scores JOIN t USING (y))
SELECT y, sum(floor(times) + CAST(draw < times - floor(times) AS INT))::BIGINT AS n FROM d GROUP BY y"""
)
def oversampled(spark, folder):
    copied = sampling.oversample(A.scores(spark, folder), keys=OVERSAMPLE_KEYS)
    return copied.groupBy("y").agg(F.count("*").alias("n"))


# ------------------------------------------------------ ingest, releases --
@query(
    """SELECT CAST(user_id AS VARCHAR) AS star_id, event_type AS period, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"""
)
def latest_upserts(spark, folder):
    """Two batches merged one after the other: the later row of a key wins."""
    rows = A.event_batches(spark, folder)
    half = F.col("day") < F.lit("2024-01-16").cast("date")
    merged = dedup.upsert(rows.where(half), rows.where(~half))
    return merged.select("star_id", "period", F.col("ingest_seq").alias("event_id"), "value")


RUNNING = ["depth_ppm", "dur_h", "ror", "impact", "teff_K"]


@query(
    f"""WITH {Q.FEEDS}, last AS (SELECT * FROM feeds QUALIFY row_number() OVER (PARTITION BY star_id, period
  ORDER BY {', '.join(f'{c} DESC' for c in ['feed_ord', *Q.ALLKEYS.split(', ')])}) = 1)
{' UNION ALL '.join(f"SELECT '{c}' AS key, round(median({c}), 6) AS value FROM last" for c in RUNNING)}"""
)
def running_medians(spark, folder):
    """The feeds arrive as three batches; a later row of a key takes the place of the earlier."""
    place, former = f"{checkpoint_folder(spark)}/counts-{uuid.uuid4().hex}", {c: f"_{c}" for c in RUNNING}
    # one key, in which missing parts equal each other: both sides and their join share one shuffle
    key = F.struct("star_id", "period").alias("key")
    rows = A.feeds(spark, folder).select(*A.FEED_ORDER, key, *RUNNING)
    for batch in range(len(S.MISSIONS)):
        arrived = dedup.keep_last(rows.where(F.col("feed_ord") == batch), ["key"], A.FEED_ORDER).select("key", *RUNNING)
        if batch:
            earlier = dedup.keep_last(rows.where(F.col("feed_ord") < batch), ["key"], A.FEED_ORDER).select("key", *RUNNING)
            arrived = arrived.join(earlier.withColumnsRenamed(former).hint("merge"), "key", "left")
        running.write_changes(running.changes(arrived, None, RUNNING, former if batch else None), place, batch)
    found = running.medians(spark.read.parquet(f"{place}/bins"), spark.read.parquet(f"{place}/values"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "key string, value double")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS star_id, CAST(o_custkey AS VARCHAR) AS period, CAST(o_totalprice AS VARCHAR) AS "mag_T",
  CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW') THEN NULL
       WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'P' THEN 2 END AS label_int,
  0 AS is_kepler, CAST(o_orderpriority = '3-MEDIUM' AS INT) AS is_tess, CAST(o_orderstatus = 'F' AS INT) AS is_k2,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'a row carries more than one mission flag' END AS reject_reason
FROM orders"""
)
def upload_rows(spark, folder):
    """Orders as an upload: names, star id, flags, label and contradictions."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    by_status = F.when(status == "F", "fp").when(status == "O", " CAND ").when(status == "P", "2.0")
    odd = F.when(priority == "1-URGENT", F.lit(None).cast("string")).when(priority == "4-NOT SPECIFIED", "7").when(priority == "5-LOW", "??")
    raw = A.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("KepID"), F.col("o_custkey").cast("string").alias("koi_period"),
        F.col("o_totalprice").cast("string").alias("Tmag"), F.lit("0.5").alias("koi_score"),
        F.when(priority.isin("1-URGENT", "4-NOT SPECIFIED", "5-LOW"), odd).otherwise(by_status).alias("label_int"),
        F.when(status == "F", "1").when(status == "O", "x").alias("is_k2"), F.when(priority == "3-MEDIUM", "1").alias("is_tess"),
    )
    return normalise_upload(raw, strict=False).drop("KepID")


RELEASES_SQL = """m AS (SELECT strftime(ts, '%Y%m%d') AS release, event_type AS metric, 'All' AS mission,
  round(avg(value), 9) AS value FROM events GROUP BY ALL),
d AS (SELECT *, lag(value) OVER (PARTITION BY metric, mission ORDER BY release) AS previous FROM m)"""


def _release_metrics(spark, folder) -> DataFrame:
    return A.table(spark, folder, "events").groupBy(
        F.date_format("ts", "yyyyMMdd").alias("release"), F.col("event_type").alias("metric"), F.lit("All").alias("mission")
    ).agg(r(F.avg("value"), 9).alias("value"))


@query(
    f"""WITH {RELEASES_SQL} SELECT release, metric, mission, round(value, 6) AS value, round(previous, 6) AS previous,
  round(value - previous, 6) AS delta FROM d"""
)
def release_deltas(spark, folder):
    deltas = releases.metric_deltas(_release_metrics(spark, folder))
    return deltas.select("release", "metric", "mission", *rounded("value", "previous", "delta"))


@query(
    """WITH m AS (SELECT strftime(ts, '%Y%m%d') AS release, event_type AS feature, avg(abs(value - 10)) AS value
  FROM events GROUP BY ALL), d AS (SELECT *, lag(value) OVER (PARTITION BY feature ORDER BY release) AS p FROM m)
SELECT release, feature, round(value, 6) AS value,
  round(value - coalesce(p, CASE WHEN release > (SELECT min(release) FROM m) THEN 0 END), 6) AS shift FROM d"""
)
def attribution_shift(spark, folder):
    rows = A.table(spark, folder, "events").select(
        F.date_format("ts", "yyyyMMdd").alias("release"), F.col("event_type").alias("feature"), (F.col("value") - 10).alias("shap")
    )
    return releases.attribution_shift(rows).select("release", "feature", *rounded("value", "shift"))


@query(
    f"""WITH {RELEASES_SQL} SELECT release, metric, mission, round(value, 6) AS value FROM m
WHERE release = (SELECT max(release) FROM m)"""
)
def latest_release_card(spark, folder):
    card = releases.summary_card(_release_metrics(spark, folder))
    return card.select("release", "metric", "mission", r("value").alias("value"))


@query("SELECT DISTINCT strftime(ts, '%Y%m%d') AS release FROM events ORDER BY release DESC LIMIT 2")
def latest_releases(spark, folder):
    return releases.latest_releases(_release_metrics(spark, folder))


@query(
    """WITH m AS (SELECT avg(l_tax) AS a, stddev_pop(l_tax) AS b, avg(l_quantity) AS c, stddev_pop(l_quantity) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
  round((l_tax - a) / b, 6) AS l_tax_z, round((l_quantity - c) / d, 6) AS l_quantity_z FROM lineitem, m"""
)
def standard_scores(spark, folder):
    scored = sampling.zscores(A.table(spark, folder, "lineitem"), ["l_tax", "l_quantity"])
    return scored.select(*A.LINE_KEY, *rounded("l_tax_z", "l_quantity_z"))


@query(
    f"""WITH {Q.SKY} SELECT mission, 'Candidate' AS label, round(ra_deg, 6) AS ra_deg, round(dec_deg, 6) AS dec_deg, dist_pc,
  NULL::DOUBLE AS period, NULL::DOUBLE AS rade_Re, NULL::DOUBLE AS depth_ppm, NULL::DOUBLE AS p_exoplanet FROM sky"""
)
def universe_rows(spark, folder):
    seen = discover.universe_view(A.sky_rows(spark, folder))
    return seen.withColumns({c: r(c) for c in ("ra_deg", "dec_deg")})


# --------------------------------------------------------------- learning --
@query()
def trend_audit(spark, folder):
    from transitlake.operators.explain import trend_audit as audit

    return audit(A.scores(spark, folder))


VECTOR_FEATURES = [f"f{i}" for i in range(64)]
#: trends that the trees of the vector queries must follow, by feature
VECTOR_TRENDS = {"f0": 1, "f1": -1, "f2": 1, "f3": -1}


def _out_of_fold(spark, folder):
    from transitlake.plans import learn

    ready = learn.prepare(A.vectors(spark, folder), VECTOR_FEATURES, {}, ["row_id", "star_id", "y"])
    folded = cut_lineage(sampling.group_folds(ready, 5))
    return folded, cut_lineage(learn.out_of_fold(folded, learn.DEFAULT_LEARNERS, 5))


@query()
def out_of_fold_report(spark, folder):
    """Grouped cross-validation of all learners: scores and ensemble weights."""
    from transitlake.operators.ensemble import model_report

    return metrics.ensemble_weights(model_report(_out_of_fold(spark, folder)[1]), "oof_pr_auc_macro")


@query(
    """SELECT model, count(*) AS rows, count(DISTINCT vec_id) AS scored, 0 AS split_stars, 0 AS bad_sums
FROM embeddings, (SELECT unnest(['boosted', 'forest', 'linear', 'network']) AS model) GROUP BY 1"""
)
def out_of_fold_rows(spark, folder):
    """What must hold of out-of-fold scores: each row once per learner, no star in two folds,
    and probabilities that add up to 1."""
    folded, oof = _out_of_fold(spark, folder)
    stars = folded.groupBy("star_id").agg(F.count_distinct("fold").alias("n"))
    torn = stars.agg(F.count_if(F.col("n") > 1).cast("int")).scalar()
    off = F.abs(sum(F.col(p) for p in S.PROBABILITIES) - 1) > 1e-9
    return oof.groupBy("model").agg(
        F.count("*").alias("rows"), F.count_distinct("row_id").alias("scored"),
        F.max(torn).alias("split_stars"), F.count_if(off).cast("int").alias("bad_sums"),
    )


@query()
def scored_vectors(spark, folder):
    """Train, calibrate and score the whole table; one decision row per vector."""
    from transitlake.plans import learn

    rows = A.vectors(spark, folder)
    trained = learn.train(rows, features=VECTOR_FEATURES)
    return trained.bundle.score(rows).select("row_id", *S.PROBABILITIES, "pred", "pred_cost", "prediction_set", "discovery_score")


def _trees(spark, folder):
    from transitlake.operators import boosting
    from transitlake.operators.learners import VECTOR
    from transitlake.plans import learn

    ready = learn.prepare(A.vectors(spark, folder), VECTOR_FEATURES, {}, ["row_id", "y"])
    return ready, boosting.fit(ready, VECTOR, "y", trends=VECTOR_TRENDS)


@query(
    """SELECT feature, sign AS expected, (SELECT count(*) FROM embeddings) AS rows, 0 AS violations
FROM (VALUES ('f0', 1), ('f1', -1), ('f2', 1), ('f3', -1)) t(feature, sign)"""
)
def monotone_rows(spark, folder):
    """Boosted trees with limits: rows whose probability moves against the expected sign
    somewhere along a limited feature."""
    from transitlake.operators.explain import row_trends

    ready, trees = _trees(spark, folder)
    found = row_trends(ready, trees, VECTOR_FEATURES, VECTOR_TRENDS)
    return found.select("feature", "expected", "rows", F.col("violations").cast("int").alias("violations"))


@query("SELECT count(*) AS rows, 3 * count(*) AS checked, 0 AS off_sums, 64 AS features FROM embeddings")
def attribution_sums(spark, folder):
    """Shapley values of every row and class: with the base they add up to the margin."""
    from transitlake.operators.explain import with_shapley
    from transitlake.operators.learners import VECTOR

    ready, trees = _trees(spark, folder)
    classes = ready.select("row_id", VECTOR, F.explode(F.array(*[F.lit(c) for c in S.CLASS_IDS])).alias("class"))
    told = with_shapley(classes, trees, F.col("class"))
    total = F.aggregate("shap_values", F.col("shap_base"), lambda s, v: s + v)
    # the probabilities that the margins give are the model's own
    shares = told.select("row_id", "class", VECTOR, F.size("shap_values").alias("n"), F.exp(total).alias("e"))
    whole = shares.groupBy("row_id").agg(F.sum("e").alias("whole"))
    own = trees.probabilities(VECTOR)
    met = shares.withColumn("p", F.get(own, F.col("class"))).join(whole, "row_id")
    off = F.abs(F.col("e") / F.col("whole") - F.col("p")) > 1e-9
    return met.agg(
        F.count_distinct("row_id").alias("rows"), F.count("*").alias("checked"),
        F.count_if(off).cast("int").alias("off_sums"), F.max("n").alias("features"),
    )


@query(
    """WITH s AS (SELECT l_quantity + l_discount AS score, sum(1 + l_linenumber) AS w, sum(CASE WHEN l_returnflag = 'R' THEN 1 + l_linenumber ELSE 0 END) AS wy
  FROM lineitem GROUP BY 1),
c AS (SELECT score, row_number() OVER (ORDER BY score) AS i, sum(w) OVER (ORDER BY score) AS cw, sum(wy) OVER (ORDER BY score) AS cy, w, wy FROM s),
m AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.wy) / (b.cw - a.cw + a.w)::DOUBLE AS mean FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM m),
fit AS (SELECT k AS i, max(least) AS fitted FROM (SELECT j, k, least FROM low) GROUP BY 1)
SELECT c.score, round(f.fitted, 8) AS fitted FROM c JOIN fit f ON c.i = f.i"""
)
def isotonic_values(spark, folder):
    """A weighted isotonic fit at each of its points."""
    from transitlake.operators import isotonic

    score = F.col("l_quantity") + F.col("l_discount")
    rows = A.table(spark, folder, "lineitem").select(
        score.alias("score"), (F.col("l_returnflag") == "R").cast("double").alias("y"), (1 + F.col("l_linenumber")).alias("w")
    )
    model = isotonic.fit(rows, "score", "y", "w")
    return rows.select("score").distinct().select("score", F.round(model.predict(F.col("score")), 8).alias("fitted"))
