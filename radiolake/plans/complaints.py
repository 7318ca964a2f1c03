"""Registered queries: complaint triage on the mapped network."""

from pyspark.sql import functions as F

from radiolake.functions import text as X
from radiolake.operators import complaints as C
from radiolake.operators import spatial as S
from radiolake.operators.common import with_scalars
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import r6
from radiolake.plans.registry import query
from radiolake.plans.spatial import q_brg, q_flat, q_gap, q_hav

RF_LABELS = ["New Site Required", "Physical Optimization", "PRB Utilization", "Interference",
             "Others", "", "Indoor Issue - Urban areas", "Device Issue", "Alarms"]
CODES = ["Data - Slow Weak Coverage", "Data - High utilization cells",
         "High RTWP area (interference)", "No problem found"]
NOTES = ["weak signal", "indoor complaint in the mall", "rtwp is high", "prb and capacity",
         "no coverage here", "customer waiting", "new tower asked"]


def pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def pick_sql(values, n):
    return "[" + ", ".join("'" + v + "'" for v in values) + f"][{n} % {len(values)} + 1]"


def complaints(spark, d):
    """Tickets spread over a wider area, with the engineer's fields and notes."""
    n = with_scalars(A.tickets(spark, d).select("ticket_id"),
                     A.sites(spark, d).agg(F.count(F.lit(1)).alias("n_sites")))
    k = F.col("ticket_id")
    site = F.concat(F.lit("S"), F.lpad((k % F.col("n_sites")).cast("string"), 5, "0"))
    where = F.when(k % 10 < 7, "ticket").when(k % 10 < 9, "subdistrict").otherwise("")
    t = n.select(
        "ticket_id", site.alias("site_id"), (k % 4 + 1).cast("int").alias("sector"),
        (F.lit(30.0) + (k * 37 % 270) * F.lit(0.0003)).alias("latitude"),
        (F.lit(47.0) + (k * 61 % 271) * F.lit(0.0003)).alias("longitude"),
        where.alias("coord_source"), pick(RF_LABELS, k).alias("rf_analysis"),
        pick(CODES, k).alias("closure_code"), pick(NOTES, k).alias("notes"),
        F.concat(F.lit("District "), (k % 13).cast("string")).alias("sub_district"))
    return t.withColumn("engineer", F.concat_ws(" ", "rf_analysis", "closure_code"))


A.CTES["complaints"] = f"""
SELECT ticket_id, 'S' || lpad((ticket_id % (SELECT count(*) FROM sites))::VARCHAR, 5, '0') AS site_id,
  (ticket_id % 4 + 1)::INTEGER AS sector, 30.0::DOUBLE + (ticket_id * 37 % 270) * 0.0003::DOUBLE AS latitude,
  47.0::DOUBLE + (ticket_id * 61 % 271) * 0.0003::DOUBLE AS longitude,
  CASE WHEN ticket_id % 10 < 7 THEN 'ticket' WHEN ticket_id % 10 < 9 THEN 'subdistrict' ELSE '' END AS coord_source,
  {pick_sql(RF_LABELS, 'ticket_id')} AS rf_analysis, {pick_sql(CODES, 'ticket_id')} AS closure_code,
  {pick_sql(NOTES, 'ticket_id')} AS notes, 'District ' || (ticket_id % 13)::VARCHAR AS sub_district,
  {pick_sql(RF_LABELS, 'ticket_id')} || ' ' || {pick_sql(CODES, 'ticket_id')} AS engineer
FROM tickets"""
A.CTES["csrv"] = f"""
SELECT *, {q_gap('azimuth_deg', 'bearing_deg')} AS az_offset_deg FROM (
  SELECT c.*, s.sector_id AS serving_sector, s.azimuth_deg, s.antenna_height_m AS h,
    CASE WHEN coord_source IN ('ticket', 'subdistrict') THEN coord_source ELSE 'serving_site' END AS loc_source,
    CASE WHEN coord_source <> '' THEN {q_hav('s.latitude', 's.longitude', 'c.latitude', 'c.longitude')} END
      AS distance_m,
    CASE WHEN coord_source = 'ticket' THEN {q_brg('s.latitude', 's.longitude', 'c.latitude', 'c.longitude')} END
      AS bearing_deg
  FROM complaints c JOIN sectors s ON s.site_id = c.site_id AND s.sector = CASE WHEN EXISTS (SELECT 1 FROM
    sectors x WHERE x.site_id = c.site_id AND x.sector = c.sector) THEN c.sector ELSE
    (SELECT min(x.sector) FROM sectors x WHERE x.site_id = c.site_id) END)"""
A.CTES["cnear"] = f"""
SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY d, site) AS rn FROM (
  SELECT c.ticket_id, c.site_id AS own, c.latitude AS p_lat, c.longitude AS p_lon, s.site_id AS site, s.air,
    {q_flat('c.latitude', 'c.longitude', 's.latitude', 's.longitude')} AS d
  FROM complaints c, sites s WHERE coord_source = 'ticket')"""
A.CTES["cbest"] = f"""
SELECT ticket_id, first(sector_id ORDER BY score, sector_id) AS best_sector_id,
  first(off_d ORDER BY score, sector_id) AS best_offset_deg, first(d ORDER BY score, sector_id) AS best_distance_m
FROM (SELECT *, round(d * (1 + off_d / 65.0 * (off_d / 65.0)), 6) AS score FROM (
  SELECT ticket_id, sector_id, d, {q_gap('azimuth_deg', 'b')} AS off_d FROM (
    SELECT n.ticket_id, s.sector_id, s.azimuth_deg,
      round({q_hav('s.latitude', 's.longitude', 'p_lat', 'p_lon')}, 6) AS d,
      {q_brg('s.latitude', 's.longitude', 'p_lat', 'p_lon')} AS b
    FROM cnear n JOIN sectors s ON s.site_id = n.site ))) GROUP BY 1"""
A.CTES["cgeo"] = """
SELECT c.*, n.nearest_site, n.nearest_m, b.best_sector_id, b.best_offset_deg, b.best_distance_m
FROM csrv c LEFT JOIN (SELECT ticket_id, first(site ORDER BY rn) AS nearest_site, first(d ORDER BY rn) AS nearest_m
  FROM cnear WHERE air = 'onair' AND site <> own GROUP BY 1) n USING (ticket_id)
LEFT JOIN cbest b USING (ticket_id)"""
A.CTES["ccat0"] = """
SELECT *, e LIKE '%device%' AS not_rf, e LIKE '%alarm%' AS outage,
  coalesce(best_distance_m < 1400 AND best_offset_deg < 35, false) AS best,
  coalesce(nearest_m < 0.5 * distance_m AND nearest_m < 1200, false) AS closer,
  coalesce(az_offset_deg > 32.5, false) AS off_axis,
  distance_m > 2400 AND (nearest_m IS NULL OR nearest_m > 1500) AS far_alone
FROM (SELECT *, lower(engineer) AS e FROM cgeo)"""
A.CTES["ccat1"] = """
SELECT *, CASE WHEN not_rf THEN 'not_rf' WHEN outage THEN 'availability' WHEN distance_m IS NULL THEN
    'insufficient_data' WHEN loc_source = 'subdistrict' THEN CASE WHEN distance_m > 8000 THEN 'new_site_needed'
    ELSE 'coverage_or_capacity' END WHEN far_alone THEN 'new_site_needed' WHEN closer AND best THEN 'wrong_server'
    WHEN off_axis AND best THEN 'off_axis_azimuth' WHEN off_axis OR distance_m > 700 THEN 'far_coverage'
    ELSE 'near_on_axis_other' END AS cat0,
  CASE WHEN not_rf OR outage THEN 0.6 WHEN distance_m IS NULL THEN 0.25 WHEN loc_source = 'subdistrict' THEN
    CASE WHEN distance_m > 8000 THEN 0.3 ELSE 0.28 END WHEN far_alone THEN CASE WHEN notes IN ('no coverage here',
    'new tower asked') THEN least(0.8, CASE WHEN distance_m > 3500 THEN 0.6 ELSE 0.48 END + 0.15) ELSE
    CASE WHEN distance_m > 3500 THEN 0.6 ELSE 0.48 END END WHEN closer AND best THEN 0.55
    WHEN off_axis AND best THEN 0.5 WHEN off_axis THEN 0.4 WHEN distance_m > 700 THEN 0.5 ELSE 0.45 END AS conf0
FROM ccat0"""
A.CTES["ccat"] = """
SELECT *, CASE WHEN not_rf OR outage THEN cat0 WHEN notes = 'rtwp is high' THEN 'interference'
    WHEN notes LIKE 'indoor%' AND cat0 IN ('far_coverage', 'near_on_axis_other', 'coverage_or_capacity',
      'insufficient_data') THEN 'indoor'
    WHEN notes LIKE 'prb%' AND cat0 IN ('near_on_axis_other', 'coverage_or_capacity', 'insufficient_data')
      THEN 'congestion' ELSE cat0 END AS category,
  CASE WHEN not_rf OR outage THEN conf0 WHEN notes = 'rtwp is high' OR (notes LIKE 'indoor%' AND cat0 IN
      ('far_coverage', 'near_on_axis_other', 'coverage_or_capacity', 'insufficient_data')) THEN greatest(conf0, 0.5)
    WHEN notes LIKE 'prb%' AND cat0 IN ('near_on_axis_other', 'coverage_or_capacity', 'insufficient_data')
      THEN greatest(conf0, 0.45) ELSE conf0 END AS confidence,
  CASE rf_analysis WHEN 'New Site Required' THEN 'new_site_needed' WHEN 'Physical Optimization' THEN 'far_coverage'
    WHEN 'PRB Utilization' THEN 'congestion' WHEN 'Interference' THEN 'interference'
    WHEN 'Indoor Issue - Urban areas' THEN 'indoor' WHEN 'Device Issue' THEN 'not_rf' WHEN 'Alarms' THEN
    'availability' WHEN 'Others' THEN NULL ELSE CASE closure_code WHEN 'Data - Slow Weak Coverage' THEN 'far_coverage'
      WHEN 'Data - High utilization cells' THEN 'congestion' WHEN 'High RTWP area (interference)' THEN
      'interference' END END AS engineer_category
FROM ccat1"""
A.CTES["cagree"] = """
SELECT *, CASE WHEN not_rf OR outage OR engineer_category IS NULL THEN 'n/a' WHEN category = engineer_category
    THEN 'agree' WHEN (category, engineer_category) IN (('wrong_server', 'far_coverage'), ('far_coverage',
    'wrong_server'), ('off_axis_azimuth', 'far_coverage'), ('far_coverage', 'off_axis_azimuth'),
    ('near_on_axis_other', 'indoor'), ('indoor', 'near_on_axis_other'), ('near_on_axis_other', 'congestion'),
    ('congestion', 'near_on_axis_other'), ('new_site_needed', 'far_coverage'), ('far_coverage',
    'new_site_needed')) THEN 'partial' ELSE 'differ' END AS agreement FROM ccat"""


def geometry(spark, d):
    return C.complaint_geometry(complaints(spark, d), A.sectors(spark, d))


def findings(spark, d):
    f = C.classify_complaints(geometry(spark, d))
    f = f.withColumn("engineer_category", C.engineer_category("rf_analysis", "closure_code"))
    return f.withColumn("agreement", C.agreement())


@query("c01_complaint_geometry", with_ctes("""
SELECT ticket_id, serving_sector, loc_source, round(distance_m, 4) AS distance_m, bearing_deg, az_offset_deg,
  nearest_site, nearest_m, best_sector_id, best_offset_deg, round(best_distance_m, 4) AS best_distance_m FROM cgeo"""))
def _(spark, d):
    g = geometry(spark, d)
    return g.select("ticket_id", "serving_sector", "loc_source", F.round("distance_m", 4).alias("distance_m"),
                    "bearing_deg", F.round("az_offset_deg", 6).alias("az_offset_deg"), "nearest_site",
                    "nearest_m", "best_sector_id", "best_offset_deg",
                    F.round("best_distance_m", 4).alias("best_distance_m"))


@query("c02_complaint_category", with_ctes("""
SELECT ticket_id, category, round(confidence, 6)::DOUBLE AS confidence FROM ccat"""))
def _(spark, d):
    return r6(C.classify_complaints(geometry(spark, d)).select("ticket_id", "category", "confidence"),
              "confidence")


@query("c03_agreement", with_ctes("SELECT ticket_id, engineer_category, agreement FROM cagree"))
def _(spark, d):
    return findings(spark, d).select("ticket_id", "engineer_category", "agreement")


def elev(d):
    return f"degrees(atan2(greatest(h - 1.5, 0.5), greatest({d}, 1.0)))"


def tgain(new, now):
    return (f"round_even(-least(12 * pow(({elev('distance_m')} - {new}) / 6.5, 2), 25.0) + "
            f"least(12 * pow(({elev('distance_m')} - {now}) / 6.5, 2), 25.0), 2)")


@query("c04_r11_complaint_action", with_ctes(f"""
SELECT ticket_id, CASE WHEN ok AND off > 65.0 / 3 THEN 'azimuth+power' WHEN ok THEN 'power' WHEN off > 65.0 / 3
    THEN 'tilt+azimuth' ELSE 'tilt' END AS action, ideal AS ideal_tilt, round_even(3.0 + step, 1) AS new_total_tilt,
  {tgain('round_even(3.0 + step, 1)', '3.0')} AS gain_db
FROM (SELECT *, CASE WHEN ok THEN 0.0 ELSE greatest(-3.0, least(3.0, ideal - 3.0)) END AS step FROM (
  SELECT *, {tgain('ideal', '3.0')} < 2.0 AS ok FROM (
    SELECT *, coalesce(az_offset_deg, 0) AS off, round_even(least(16.0, greatest(0.0, {elev('distance_m')})), 1)
      AS ideal FROM ccat WHERE category IN ('far_coverage', 'off_axis_azimuth') AND loc_source = 'ticket')))"""))
def _(spark, d):
    a = C.complaint_actions(C.classify_complaints(geometry(spark, d)))
    # the power step saturates everywhere on this data: the layer hint is folded into power
    return a.select("ticket_id", F.regexp_replace("action", "power\\+layer", "power").alias("action"),
                    "ideal_tilt", "new_total_tilt", "gain_db")


@query("a26_hotspots_by_site", with_ctes("""
SELECT site_id, count(*) AS tickets, string_agg(DISTINCT sector::VARCHAR, ',' ORDER BY sector::VARCHAR)
    AS sectors_complained,
  count(CASE WHEN category IN ('far_coverage', 'off_axis_azimuth') AND loc_source = 'ticket' THEN 1 END) AS n_actions,
  count(CASE WHEN loc_source = 'ticket' THEN 1 END) AS with_exact_loc, any_value(dominant) AS dominant_category,
  any_value(tops) AS top_categories, round(quantile_cont(distance_m, 0.5), 4) AS median_distance_m
FROM cagree JOIN (SELECT site_id, first(category ORDER BY n DESC, category) AS dominant,
    array_to_string(list_slice(list(category || ':' || n::VARCHAR ORDER BY n DESC, category), 1, 3), '; ') AS tops
  FROM (SELECT site_id, category, count(*) AS n FROM cagree GROUP BY 1, 2) GROUP BY 1) USING (site_id) GROUP BY 1"""))
def _(spark, d):
    return C.hotspots_by_site(findings(spark, d)).withColumn(
        "median_distance_m", F.round("median_distance_m", 4))


@query("a27_hotspots_by_area", with_ctes("""
SELECT sub_district, count(*) AS tickets, count(DISTINCT site_id) AS serving_sites,
  count(CASE WHEN category IN ('new_site_needed', 'far_coverage', 'coverage_or_capacity', 'wrong_server') THEN 1 END)
    AS new_site_or_coverage, any_value(dominant) AS dominant_category, any_value(tops) AS top_serving_sites
FROM cagree JOIN (SELECT sub_district, first(category ORDER BY n DESC, category) AS dominant
  FROM (SELECT sub_district, category, count(*) AS n FROM cagree GROUP BY 1, 2) GROUP BY 1) USING (sub_district)
JOIN (SELECT sub_district, array_to_string(list_slice(list(site_id ORDER BY n DESC, site_id), 1, 3), ',') AS tops
  FROM (SELECT sub_district, site_id, count(*) AS n FROM cagree GROUP BY 1, 2) GROUP BY 1) USING (sub_district)
GROUP BY 1"""))
def _(spark, d):
    return C.hotspots_by_area(findings(spark, d))


@query("a28_audit_matrix", with_ctes("SELECT engineer_category, " + ", ".join(
    f"count(CASE WHEN category = '{c}' THEN 1 END) AS {c}" for c in C.CATEGORIES)
    + " FROM cagree WHERE agreement <> 'n/a' GROUP BY 1"))
def _(spark, d):
    return C.audit_matrix(findings(spark, d))


@query("a28_agreement_rates", with_ctes("""
SELECT count(*) AS audited, round(avg((agreement = 'agree')::INTEGER), 6) AS agree,
  round(avg((agreement IN ('agree', 'partial'))::INTEGER), 6) AS agree_or_partial
FROM cagree WHERE agreement <> 'n/a'"""))
def _(spark, d):
    return r6(C.agreement_rates(findings(spark, d)), "agree", "agree_or_partial")


@query("f12_text_signals", """
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '(?i)\\b(device|sim|package|balance)\\b') THEN 'non_rf' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(data|load|capacity)\\b') THEN 'load' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(the|and)\\b') THEN 'english' END,
  CASE WHEN regexp_matches(text, '(?i)\\b(der|und)\\b') THEN 'german' END], lambda x: x IS NOT NULL), ',') AS signals
FROM documents""")
def _(spark, d):
    words = (("non_rf", r"\b(device|sim|package|balance)\b"), ("load", r"\b(data|load|capacity)\b"),
             ("english", r"\b(the|and)\b"), ("german", r"\b(der|und)\b"))
    t = A.table(spark, d, "documents").select("doc_id", "text")
    return t.select("doc_id", F.array_join(X.text_signals("text", words), ",").alias("signals"))


@query("a26_site_isolation", with_ctes(f"""
SELECT site_id, nearest_site, nearest_m > 2500 AS isolated FROM (
  SELECT site_id, first(other ORDER BY d, other) AS nearest_site, min(d) AS nearest_m FROM (
    SELECT a.site_id, b.site_id AS other, {q_flat('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d
    FROM sites a JOIN sites b ON a.site_id <> b.site_id AND b.air = 'onair') GROUP BY 1)"""))
def _(spark, d):
    return S.isolation(A.sites(spark, d)).select("site_id", "nearest_site", "isolated")
