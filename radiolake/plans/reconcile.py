"""Registered queries: drawing, tracker and previous list of sites reconciled."""

from pyspark.sql import functions as F

from radiolake.operators import reconcile as R
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import r6
from radiolake.plans.network import params
from radiolake.plans.registry import query
from radiolake.plans.spatial import q_hav


def site_lists(spark, d):
    """Three lists that disagree: turned, extra and missing arrows, marks for no position, swapped and
    mistyped positions, sites that are off, planned, on the border or in one list only."""
    p = params(spark, d).select("site_id", "sector_num", "cell_id", "band", "latitude", "longitude",
                                "azimuth_deg", "status")
    p = p.withColumn("n", F.substring("site_id", 3, 9).cast("int"))
    n = F.col("n")
    lat, lon, az = F.col("latitude"), F.col("longitude"), F.col("azimuth_deg")
    s = p.filter(n % 4 != 0).select("site_id", "n", "sector_num", "latitude", "longitude",
                                    "azimuth_deg").distinct()
    s = s.withColumn("name", F.concat(F.when(n % 17 == 0, "20m_ARBRoad_").otherwise("20m_Marbad_"),
                                      "site_id"))
    s = s.withColumn("latitude", F.when(n % 8 == 1, 30.0).otherwise(
        lat + F.when(n % 9 == 0, 0.03).when(n % 9 == 1, 0.003).otherwise(0.0)))
    s = s.withColumn("longitude", F.when(n % 8 == 1, 47.0).otherwise(lon))
    shared = ["site_id", "name", "latitude", "longitude", (n % 9 == 2).alias("planned")]
    arrows = s.filter(~((n % 6 == 2) & (F.col("sector_num") == 3))).select(
        *shared, F.col("sector_num").alias("seq"), (az + n % 5 * 9).alias("azimuth_deg"))
    arrows = arrows.unionByName(s.filter((n % 6 == 1) & (F.col("sector_num") == 1)).select(
        *shared, F.lit(4).alias("seq"), (az + 60).alias("azimuth_deg")))
    c = p.filter(n % 5 != 0)
    swap, typo = F.col("cell_id").endswith("1"), F.col("cell_id").endswith("2")
    cells = c.select(
        "site_id", "sector_num", F.concat(F.lit("Town_"), "site_id").alias("name"),
        F.when(F.col("band") == "L1800", "lte").otherwise("gsm").alias("tech"),
        F.when(n % 13 != 0, F.when((F.col("band") == "L800") & (n % 3 == 0), 0.0).otherwise(az))
        .alias("azimuth_deg"),
        F.when(n % 15 != 1, F.when(swap, lon).when(typo, 37.5).otherwise(lat)).alias("latitude"),
        F.when(n % 15 != 1, F.when(swap, lat).otherwise(lon)).alias("longitude"),
        (F.col("status") == "Active").alias("active"))
    return arrows, cells, p.filter(n % 3 != 0).select("site_id")


A.CTES["rec_cell"] = "SELECT *, substr(site_id, 3)::INTEGER AS n FROM params"
A.CTES["rec_arrow"] = """
SELECT site_id, n, la, lo, (az::INTEGER + n % 5 * 9) % 360 AS a FROM rec_drawn WHERE NOT (n % 6 = 2 AND sector_num = 3)
UNION ALL SELECT site_id, n, la, lo, (az::INTEGER + 60) % 360 FROM rec_drawn WHERE n % 6 = 1 AND sector_num = 1"""
A.CTES["rec_drawn"] = """
SELECT DISTINCT site_id, n, sector_num, azimuth_deg AS az, CASE WHEN n % 8 = 1 THEN 30.0::DOUBLE ELSE latitude + CASE
    WHEN n % 9 = 0 THEN 0.03::DOUBLE WHEN n % 9 = 1 THEN 0.003 ELSE 0.0 END END AS la,
  CASE WHEN n % 8 = 1 THEN 47.0::DOUBLE ELSE longitude END AS lo FROM rec_cell WHERE n % 4 <> 0"""
# directions kept: from each one to the next that is over 15 degrees on, the last one not meeting the first
A.CTES["rec_dir"] = """
SELECT site_id, a FROM (SELECT *, min(a) OVER s AS f, max(a) OVER s AS l, count(*) OVER s AS k FROM (
  WITH RECURSIVE step AS (SELECT site_id, min(a) AS a FROM rec_arrow GROUP BY 1
    UNION ALL SELECT x.site_id, min(x.a) FROM step JOIN rec_arrow x ON x.site_id = step.site_id AND x.a - step.a > 15
      AND x.a - step.a < 345 GROUP BY x.site_id) SELECT * FROM step) WINDOW s AS (PARTITION BY site_id))
WHERE NOT (k > 1 AND a = l AND (f - l + 360) % 360 <= 15)"""
A.CTES["rec_sector"] = """
SELECT site_id, sector_num, bool_or(status = 'Active') AS active, coalesce(
  CASE WHEN any_value(n) % 13 = 0 THEN (row_number() OVER (PARTITION BY site_id ORDER BY sector_num) - 1) * 360
    // count(*) OVER (PARTITION BY site_id) END,
  min(CASE WHEN azimuth_deg <> 0 AND NOT (band = 'L800' AND n % 3 = 0) THEN azimuth_deg END), 0)::INTEGER AS a
FROM rec_cell WHERE n % 5 <> 0 GROUP BY site_id, sector_num"""
A.CTES["rec_pair"] = """
SELECT t.site_id, t.sector_num AS num, d.a, least((d.a - t.a + 360) % 360, (t.a - d.a + 360) % 360) AS off
FROM rec_sector t JOIN rec_dir d USING (site_id)"""
A.CTES["rec_match"] = """
SELECT site_id, num, a, off FROM (WITH RECURSIVE step AS (
  SELECT DISTINCT site_id, NULL::INTEGER AS num, NULL::INTEGER AS a, NULL::INTEGER AS off, []::INTEGER[] AS nums,
    []::INTEGER[] AS used FROM rec_pair
  UNION ALL SELECT site_id, num, a, off, list_append(nums, num), list_append(used, a) FROM (
    SELECT p.*, step.nums, step.used, row_number() OVER (PARTITION BY p.site_id ORDER BY p.off, p.num, p.a) AS rn
    FROM step JOIN rec_pair p ON p.site_id = step.site_id AND NOT list_contains(step.nums, p.num)
      AND NOT list_contains(step.used, p.a)) WHERE rn = 1) SELECT * FROM step) WHERE num IS NOT NULL"""
# a site's tracked position: the middle one of those in the region, in order
A.CTES["rec_spot"] = """
SELECT site_id, la, lo FROM (SELECT site_id, latitude AS la, longitude AS lo, row_number() OVER s - 1 AS rn,
    count(*) OVER (PARTITION BY site_id) AS k
  FROM rec_cell WHERE n % 5 <> 0 AND n % 15 <> 1 AND cell_id NOT LIKE '%2'
  WINDOW s AS (PARTITION BY site_id ORDER BY latitude, longitude)) WHERE rn = k // 2"""
A.CTES["rec_site"] = f"""
SELECT *, CASE WHEN drawn_site AND n % 17 = 0 THEN 'border-road site' WHEN tracked_site AND NOT active THEN
    'every cell is deactivated in the tracker' WHEN drawn_site AND n % 9 = 2 THEN 'drawn as planned' WHEN drawn_site THEN
    'drawn as on air' WHEN tracked_site THEN 'active in the tracker, not drawn' ELSE 'neither drawn nor tracked' END
    AS reason, CASE WHEN d_la IS NOT NULL AND t_la IS NOT NULL THEN
    round({q_hav('d_la', 'd_lo', 't_la', 't_lo')})::INTEGER END AS moved, coalesce(d_la, t_la) AS la,
  coalesce(d_lo, t_lo) AS lo
FROM (SELECT site_id, any_value(n) AS n FROM rec_cell GROUP BY 1)
LEFT JOIN (SELECT site_id, true AS drawn_site, any_value(CASE WHEN round(la, 3) <> 30 OR round(lo, 3) <> 47 THEN la END)
    AS d_la, any_value(CASE WHEN round(la, 3) <> 30 OR round(lo, 3) <> 47 THEN lo END) AS d_lo
  FROM rec_drawn GROUP BY 1) USING (site_id)
LEFT JOIN (SELECT site_id, true AS tracked_site, bool_or(active) AS active FROM rec_sector GROUP BY 1) USING (site_id)
LEFT JOIN (SELECT site_id, la AS t_la, lo AS t_lo FROM rec_spot) USING (site_id)
WHERE drawn_site OR tracked_site OR n % 3 <> 0"""
REC_STATUS = """CASE reason WHEN 'drawn as planned' THEN 'Planned' WHEN 'drawn as on air' THEN 'On Air'
  WHEN 'active in the tracker, not drawn' THEN 'On Air' ELSE 'Off Air' END"""


def reconciled(spark, d):
    return R.reconcile(*site_lists(spark, d))


@query("j18_f15_site_status", with_ctes(f"""
SELECT site_id, CASE WHEN NOT coalesce(drawn_site, false) THEN CASE WHEN tracked_site THEN 'Town_' || site_id
    ELSE site_id END WHEN n % 17 = 0 THEN '20m_ARBRoad_' || site_id ELSE '20m_Marbad_' || site_id END AS name,
  {REC_STATUS} AS status, reason, round(la, 6) AS latitude, round(lo, 6) AS longitude, CASE WHEN d_la IS NOT NULL
    THEN 'drawing' WHEN t_la IS NOT NULL THEN 'tracker' END AS position_of, la IS NULL AS omitted FROM rec_site"""))
def _(spark, d):
    return r6(reconciled(spark, d).drop("sectors", "review"), "latitude", "longitude")


@query("j18_map_sectors", with_ctes(f"""
SELECT site_id, {REC_STATUS} AS status, sector_num, azimuth_deg, source, drawn_azimuth_deg, off_deg FROM (
  SELECT t.site_id, t.sector_num, t.a AS azimuth_deg, 'tracker' AS source, m.a AS drawn_azimuth_deg, m.off AS off_deg
  FROM rec_sector t LEFT JOIN rec_match m ON m.site_id = t.site_id AND m.num = t.sector_num
  UNION ALL SELECT site_id, (row_number() OVER (PARTITION BY site_id ORDER BY a))::INTEGER, a, 'drawing', a, 0
  FROM rec_dir WHERE site_id NOT IN (SELECT site_id FROM rec_sector))
JOIN rec_site USING (site_id) WHERE la IS NOT NULL"""))
def _(spark, d):
    return R.map_sectors(reconciled(spark, d))


@query("j18_review_rows", with_ctes(f"""
SELECT list_position({list(R.REVIEW_ORDER)}, category)::INTEGER AS rank, category, site_id, {REC_STATUS} AS status, detail
FROM (
  SELECT site_id, 'no-coords' AS category, NULL::INTEGER AS detail FROM rec_site
    WHERE la IS NULL OR (drawn_site AND d_la IS NULL)
  UNION ALL SELECT site_id, 'moved', moved FROM rec_site WHERE moved > 150
  UNION ALL SELECT site_id, 'new-site', NULL FROM rec_site WHERE la IS NOT NULL AND n % 3 = 0
  UNION ALL SELECT site_id, 'missing-from-arrows', NULL FROM rec_site WHERE la IS NOT NULL
    AND reason = 'active in the tracker, not drawn'
  UNION ALL SELECT site_id, 'off-air', NULL FROM rec_site WHERE la IS NOT NULL AND {REC_STATUS} = 'Off Air'
  UNION ALL SELECT site_id, 'extra-arrow', a FROM rec_dir JOIN rec_site USING (site_id) WHERE la IS NOT NULL
    AND tracked_site AND (site_id, a) NOT IN (SELECT (site_id, a) FROM rec_match)
  UNION ALL SELECT site_id, 'missing-arrow', sector_num FROM rec_sector JOIN rec_site USING (site_id)
    WHERE la IS NOT NULL AND drawn_site AND (site_id, sector_num) NOT IN (SELECT (site_id, num) FROM rec_match))
JOIN rec_site USING (site_id)"""))
def _(spark, d):
    return R.review_rows(reconciled(spark, d)).drop("name")
