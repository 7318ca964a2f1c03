"""Registered queries: composed runs on kept results, row by row."""

from pyspark.sql import functions as F

from radiolake.functions import text as X
from radiolake.operators import runs as RN
from radiolake.plans import adapters as A
from radiolake.plans import ingest, series  # noqa: F401  (define the tables the oracles name)
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import judged_hours, r6
from radiolake.plans.ingest import shared_path, wide_cells
from radiolake.plans.registry import query

# the trend oracle speaks of sites: here every cell is one
CELL_SERIES = """
SELECT object AS site_id, kpi, datetime, value AS y FROM slong WHERE kpi IN ('cell_avail_pct', 'dl_prb_util',
  'ul_rssi_dbm')"""


def hourly_run(spark, d):
    return RN.full_analysis(RN.Run(shared_path(spark, "analysis")), wide_cells(spark, d), A.hourly_sites(spark, d))


@query("e01_run_breaches", with_ctes("""
SELECT cell_id, kpi, 'all' AS period, NULL::TIMESTAMP AS datetime, round(value, 6) AS value, 2 AS sev FROM (
  SELECT cell_id, 'dl_prb_util' AS kpi, prb AS value FROM pc4 WHERE prb > 80
  UNION ALL SELECT cell_id, 'cell_avail_pct', avail FROM pc4 WHERE avail < 99
  UNION ALL SELECT cell_id, 'ul_rssi_dbm', rssi FROM pc4 WHERE rssi > -105)
UNION ALL SELECT object, 'dl_prb_util', 'hour', datetime, round(dl_prb_util, 6), 2 FROM (
  SELECT *, row_number() OVER (PARTITION BY object ORDER BY total_traffic_gb DESC, datetime) AS rn
  FROM f3 WHERE dl_prb_util > 80 AND total_traffic_gb >= 0.05) WHERE rn = 1"""))
def _(spark, d):
    b = hourly_run(spark, d)["breaches"]
    return r6(b.select("cell_id", "kpi", "period", "datetime", "value", "sev"), "value")


@query("e01_run_trends", with_ctes("""
SELECT site_id AS cell_id, kpi, n, round(slope, 6) AS slope_per_day, round(pct, 6) AS pct_change,
  CASE WHEN abs(shift) >= 4 AND abs(rel) >= 0.08 THEN CASE WHEN move > 0 THEN 'step-up' ELSE 'step-down' END
    WHEN cv > 0.5 AND abs(rel) < 0.12 AND abs(ends) < 0.12 THEN 'volatile'
    WHEN ends <= -0.15 AND fit <= -0.10 THEN 'degrading'
    WHEN ends >= 0.15 AND fit >= 0.10 THEN 'improving' ELSE 'stable' END AS verdict
FROM sall WHERE n >= 5""", sbase=CELL_SERIES))
def _(spark, d):
    t = hourly_run(spark, d)["trends"].filter(F.col("kpi").isin("cell_avail_pct", "dl_prb_util", "ul_rssi_dbm"))
    return r6(t.select("cell_id", "kpi", "n", "slope_per_day", "pct_change", "verdict"), "slope_per_day", "pct_change")


@query("e01_n12_run_findings", with_ctes("""
SELECT cell_id, problem_class, sev, priority, round(gb, 6) AS traffic_gb, worst_hour FROM (
  SELECT cell_id, problem_class, 2 AS sev, gb, CASE WHEN gb >= (SELECT quantile_cont(gb, 0.5) FROM pc4) THEN 'P1'
    ELSE 'P2' END AS priority FROM (SELECT cell_id, problem_class, gb FROM pcf
    UNION SELECT cell_id, 'high_utilization', gb FROM pc4 WHERE p95 > 80 AND prb < p95 AND gb >= 0.05)
  UNION ALL SELECT cell_id, 'traffic_imbalance', CASE WHEN gap > 45 THEN 2 ELSE 1 END, gb, CASE WHEN gap > 45 THEN
    CASE WHEN gb >= (SELECT quantile_cont(gb, 0.5) FROM pc4) THEN 'P1' ELSE 'P2' END
    WHEN gb >= (SELECT quantile_cont(gb, 0.5) FROM pc4) THEN 'P3' ELSE 'P4' END FROM (
    SELECT first(cell_id ORDER BY prb DESC, cell_id) AS cell_id, first(gb ORDER BY prb DESC, cell_id) AS gb,
      max(prb) - min(prb) AS gap, max(prb) AS top, count(*) AS n
    FROM pc4 WHERE prb IS NOT NULL GROUP BY site_id, right(cell_id, 1)) WHERE n >= 2 AND gap >= 25 AND top >= 55)
LEFT JOIN (SELECT object AS cell_id, 'availability' AS problem_class, first(datetime ORDER BY cell_avail_pct, datetime)
    AS worst_hour FROM f3 WHERE cell_avail_pct IS NOT NULL GROUP BY object
  UNION ALL SELECT object, 'high_utilization', first(datetime ORDER BY dl_prb_util DESC, datetime) FROM f3
    WHERE dl_prb_util IS NOT NULL GROUP BY object
  UNION ALL SELECT object, 'interference', first(datetime ORDER BY ul_rssi_dbm DESC, datetime) FROM f3
    WHERE ul_rssi_dbm IS NOT NULL GROUP BY object
  UNION ALL SELECT object, 'traffic_imbalance', first(datetime ORDER BY total_traffic_gb DESC, datetime) FROM f3
    WHERE total_traffic_gb IS NOT NULL GROUP BY object) USING (cell_id, problem_class)"""))
def _(spark, d):
    f = hourly_run(spark, d)["findings"]
    return r6(f.select("cell_id", "problem_class", "sev", "priority", "traffic_gb", "worst_hour"), "traffic_gb")


@query("e02_dashboard_panels", with_ctes("""
SELECT 'distribution' AS panel, sev::VARCHAR AS item, count(*) AS n, NULL::BIGINT AS critical FROM sstat GROUP BY sev
UNION ALL SELECT 'ranking', label, count(DISTINCT site_id), count(DISTINCT CASE WHEN sev = 2 THEN site_id END) FROM objs
  WHERE sev > 0 GROUP BY label
UNION ALL SELECT 'areas', sup_district, count(*), count(CASE WHEN sev = 2 THEN 1 END) FROM sstat JOIN hsites USING (site_id)
  WHERE sev > 0 AND sup_district IS NOT NULL GROUP BY sup_district
UNION ALL SELECT 'days', strftime(day, '%Y-%m-%d'), count(CASE WHEN sev > 0 THEN 1 END), count(CASE WHEN sev = 2 THEN 1 END)
  FROM (SELECT datetime::DATE AS day, site_id, max(sev) AS sev FROM jhours GROUP BY 1, 2) GROUP BY day
UNION ALL SELECT 'tickets', CASE status WHEN 'Completed' THEN 'Closed' WHEN 'Sleep' THEN 'Sleep' WHEN 'Pending Customer'
    THEN 'Pending' ELSE 'In Progress' END, count(*), NULL FROM tickets
  GROUP BY 2"""))
def _(spark, d):
    t = A.tickets(spark, d).select(X.ticket_state(
        F.col("status"), F.substring_index("status", " ", 1)).alias("state"))
    run = RN.dashboard(RN.Run(shared_path(spark, "dashboard")), judged_hours(spark, d), A.hourly_sites(spark, d), t)
    return RN.panels(run)
