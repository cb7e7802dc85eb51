"""SQL fragments shared by the check queries: the adapters, said in plain SQL."""

from __future__ import annotations

FEEDS = """feeds AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS feed_ord,
         CASE l_returnflag WHEN 'A' THEN 'Kepler' WHEN 'R' THEN 'TESS' ELSE 'K2' END AS mission,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
         CAST(l_partkey AS VARCHAR) AS star_id,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'REFUTED'
              WHEN l_returnflag = 'R' THEN
                CASE o_orderstatus WHEN 'F' THEN 'FP' WHEN 'O' THEN 'PC ' WHEN 'P' THEN 'cp' END
              ELSE CASE o_orderstatus WHEN 'F' THEN 'False  Positive' WHEN 'O' THEN ' candidate'
                   WHEN 'P' THEN 'CONFIRMED' END END AS label_raw,
         nullif(l_quantity, 50) AS period,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t0_bjd,
         1 + l_tax * 100 AS dur_h,
         nullif(l_tax, 0) * 10 AS dur_h_err1, l_tax * -10 AS dur_h_err2,
         l_extendedprice / 10 AS depth_ppm,
         l_extendedprice * l_discount / 20 AS depth_ppm_err1,
         -l_extendedprice * l_discount / 20 AS depth_ppm_err2,
         CASE WHEN l_returnflag <> 'R' THEN sqrt(l_extendedprice) / 300 END AS ror,
         CASE WHEN l_returnflag <> 'R' THEN l_discount * 15 END AS impact,
         CASE WHEN l_returnflag <> 'R' THEN 80 + l_tax * 150 END AS incl_deg,
         0.5 + l_discount * 20 AS rad_Rs,
         nullif(0.5 + l_tax * 10, 0.5) AS mass_Ms,
         3500 + l_quantity * 100 AS teff_K,
         3.5 + l_discount * 10 AS logg_cgs,
         l_tax * 5 AS ecc,
         2 + l_quantity AS a_over_rs,
         0.5 + l_quantity / 10 AS rade_Re,
         l_extendedprice / 500 AS insol_S,
         nullif(l_quantity * 20, 200) AS eqt_K,
         l_discount * 100 - 5 AS pm_ra_masyr,
         l_tax * 100 - 4 AS pm_dec_masyr,
         8 + l_tax * 50 AS mag_T,
         9 + l_discount * 40 AS mag_Kepler
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

LABELS = """tidied AS (
  SELECT *, trim(regexp_replace(upper(label_raw), '\\s+', ' ', 'g')) AS tidy FROM feeds),
labels3 AS (
  SELECT *, CASE WHEN tidy IN ('CONFIRMED', 'CP', 'KP') THEN 2
                 WHEN tidy IN ('CANDIDATE', 'PC', 'APC') THEN 1
                 WHEN tidy IN ('FALSE POSITIVE', 'FP') THEN 0 END AS label_int FROM tidied),
labelled AS (
  SELECT *, CASE label_int WHEN 0 THEN 'False Positive' WHEN 1 THEN 'Candidate'
                           WHEN 2 THEN 'Confirmed' END AS label FROM labels3)"""

BUNDLES = """bundles AS (
  SELECT *, (abs(dur_h_err1) + abs(dur_h_err2)) / 2 AS dur_h_err_mean,
         (abs(depth_ppm_err1) + abs(depth_ppm_err2)) / 2 AS depth_ppm_err_mean FROM labelled)"""

FEATURES = """featured AS (
  SELECT *, pow(ror, 2) * 1e6 AS depth_from_ror_ppm,
         abs(depth_ppm - pow(ror, 2) * 1e6) / nullif(depth_ppm, 0) AS depth_consistency,
         (dur_h / 24.0::DOUBLE) / nullif(period, 0) AS dur_frac,
         depth_ppm / nullif(depth_ppm_err_mean, 0) AS depth_snr,
         dur_h / nullif(dur_h_err_mean, 0) AS dur_snr,
         sqrt(pow(pm_ra_masyr, 2) + pow(pm_dec_masyr, 2)) AS pm_tot,
         coalesce(CAST(ecc > 0 AS INT), 0) AS ecc_flag,
         coalesce(CAST(impact > 0.8::DOUBLE AS INT), 0) AS high_b,
         rade_Re / nullif(rad_Rs * 109.2::DOUBLE, 0) AS ror_from_radii,
         abs(ror - rade_Re / nullif(rad_Rs * 109.2::DOUBLE, 0)) / nullif(ror, 0) AS ror_consistency
  FROM bundles)"""

PLAUSIBLE = """plausible AS (
  SELECT * FROM featured
  WHERE (ror IS NULL OR ror < 1.0) AND (impact IS NULL OR ror IS NULL OR impact <= 1.0::DOUBLE + ror)
    AND (incl_deg IS NULL OR incl_deg BETWEEN 0 AND 90))"""

UNIFIED_STEPS = ",\n".join([FEEDS, LABELS, BUNDLES, FEATURES, PLAUSIBLE])

SCORES = """scores AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         CAST(l_partkey AS VARCHAR) AS star_id,
         CASE WHEN l_linestatus = 'F' THEN 'Kepler' ELSE 'TESS' END AS mission,
         (1 + l_quantity) / (3 + l_quantity + l_discount * 500 + l_tax * 600) AS p_fp,
         (1 + l_discount * 500) / (3 + l_quantity + l_discount * 500 + l_tax * 600) AS p_cand,
         (1 + l_tax * 600) / (3 + l_quantity + l_discount * 500 + l_tax * 600) AS p_conf,
         sqrt(l_extendedprice) / 300 AS ror, l_discount * 15 AS impact,
         nullif(l_extendedprice / 5000, 0) AS depth_snr,
         nullif(l_discount, 0) AS geom_transit_prob,
         nullif(l_tax * 10, 0) AS dur_consistency,
         nullif(l_quantity, 50) AS period,
         0.5 + l_quantity / 10 AS rade_Re
  FROM lineitem)"""

CLASS_SCORES = """cells AS (
  SELECT mission, y, 0 AS class, p_fp AS score FROM scores UNION ALL
  SELECT mission, y, 1, p_cand FROM scores UNION ALL
  SELECT mission, y, 2, p_conf FROM scores)"""


def curve(by: str = "", source: str = "cells") -> str:
    """Running counts per class over distinct scores, ``by`` is a prefix like 'mission,'."""
    return f"""ties AS (
  SELECT {by} class, score, count(*) AS n, count(*) FILTER (y = class) AS own,
         count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 2) AS n2
  FROM {source} GROUP BY ALL),
runs AS (
  SELECT *, sum(own) OVER w AS tp, sum(n) OVER w AS seen, sum(own) OVER g AS own_all,
         sum(n0) OVER w AS r0, sum(n1) OVER w AS r1, sum(n2) OVER w AS r2,
         sum(n0) OVER g AS a0, sum(n1) OVER g AS a1, sum(n2) OVER g AS a2
  FROM ties WINDOW w AS (PARTITION BY {by} class ORDER BY score DESC), g AS (PARTITION BY {by} class))"""


VETO = """damped AS (
  SELECT *, CASE WHEN coalesce(ror >= 1, false) OR coalesce(impact > 1.0::DOUBLE + coalesce(ror, 0), false)
            THEN p_conf * 0.3::DOUBLE ELSE p_conf END AS d FROM scores),
vetoed AS (
  SELECT * REPLACE (p_fp / (p_fp + p_cand + d) AS p_fp, p_cand / (p_fp + p_cand + d) AS p_cand,
                    d / (p_fp + p_cand + d) AS p_conf), p_conf AS p_conf_before FROM damped)"""

SKY = """sky AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS star_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Kepler' WHEN 'AUTOMOBILE' THEN 'TESS' ELSE 'K2' END AS mission,
         fmod(c_custkey * 137.50776405::DOUBLE, 360) AS ra_deg,
         degrees(asin(2 * (c_custkey * 0.6180339887::DOUBLE - floor(c_custkey * 0.6180339887::DOUBLE)) - 1)) AS dec_deg,
         nullif(c_nationkey, 0) * 10.0::DOUBLE AS dist_pc, c_acctbal AS value FROM customer),
catalog AS (
  SELECT s_suppkey AS source_id, s_name AS name, s_acctbal AS parallax, CAST(s_nationkey AS DOUBLE) AS gmag,
         fmod(fmod(s_suppkey * 137.50776405::DOUBLE, 360)
              + CASE WHEN s_suppkey % 2 = 0 THEN 0.0002::DOUBLE ELSE 0.01::DOUBLE END, 360) AS ra,
         degrees(asin(2 * (s_suppkey * 0.6180339887::DOUBLE - floor(s_suppkey * 0.6180339887::DOUBLE)) - 1)) AS dec
  FROM supplier)"""

PAIRS = """pairs AS (
  SELECT s.c_custkey, c.source_id, c.parallax, c.gmag,
         2 * asin(sqrt(pow(cos(radians(dec_deg)) * cos(radians(ra_deg)) - cos(radians(dec)) * cos(radians(ra)), 2)
                     + pow(cos(radians(dec_deg)) * sin(radians(ra_deg)) - cos(radians(dec)) * sin(radians(ra)), 2)
                     + pow(sin(radians(dec_deg)) - sin(radians(dec)), 2)) / 2) * 180 / pi() * 3600 AS sep
  FROM sky s, catalog c),
nearest AS (
  SELECT * FROM pairs WHERE sep < {radius}
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY sep, source_id) = 1)"""

ALLKEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
