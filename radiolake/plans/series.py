"""Registered queries: trends, level shifts and spikes of hourly series."""

from pyspark.sql import functions as F

from radiolake.operators import health as H
from radiolake.operators import series as N
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import r6
from radiolake.plans.registry import query

KPIS = ["cell_avail_pct", "dl_prb_util", "ul_rssi_dbm", "total_traffic_gb"]


def long_of(spark, d):
    return H.to_long(A.hourly(spark, d), KPIS)


A.CTES["slong"] = """
SELECT datetime, object, site_id, prefix, tech, duplex, kpi, value FROM (SELECT * FROM f3)
UNPIVOT (value FOR kpi IN (cell_avail_pct, dl_prb_util, ul_rssi_dbm, total_traffic_gb))"""
A.CTES["sbase"] = """
SELECT site_id, kpi, datetime, CASE WHEN kpi = 'total_traffic_gb' THEN sum(value) ELSE avg(value) END
  AS y FROM slong GROUP BY site_id, kpi, datetime"""
# position, day offset and decimation of each series
A.CTES["snum"] = """
SELECT *, row_number() OVER (PARTITION BY site_id, kpi ORDER BY datetime) AS rn,
  count(*) OVER (PARTITION BY site_id, kpi) AS n,
  epoch(datetime - min(datetime) OVER (PARTITION BY site_id, kpi)) / 86400.0::DOUBLE AS t FROM sbase"""
A.CTES["sdec"] = """
SELECT * FROM snum WHERE (rn - 1) % CAST(ceil(n / 180.0) AS BIGINT) = 0"""
A.CTES["sline"] = """
SELECT site_id, kpi, slope, my - slope * mt AS intercept FROM (
  SELECT a.site_id, a.kpi, quantile_cont((b.y - a.y) / (b.t - a.t), 0.5) AS slope
  FROM snum a JOIN snum b ON a.site_id = b.site_id AND a.kpi = b.kpi AND b.t > a.t GROUP BY 1, 2)
JOIN (SELECT site_id, kpi, quantile_cont(y, 0.5) AS my, quantile_cont(t, 0.5) AS mt FROM snum
      GROUP BY 1, 2) USING (site_id, kpi)"""


def site_series(spark, d):
    return N.series_for(long_of(spark, d), "site")


@query("w08_decimate", with_ctes("""
SELECT site_id, kpi, datetime, round(y, 6) AS value FROM sdec"""))
def _(spark, d):
    s = N.decimate(site_series(spark, d), ["site_id", "kpi"])
    return r6(s, "value")


@query("n03_theil_sen", with_ctes("""
SELECT site_id, kpi, round(slope, 6) AS slope_per_day, round(intercept, 6) AS intercept FROM sline"""))
def _(spark, d):
    return r6(N.theil_sen(site_series(spark, d), ["site_id", "kpi"]), "slope_per_day", "intercept")


@query("w03_rolling_medians", with_ctes("""
SELECT site_id, kpi, datetime,
  round(CASE WHEN count(y) OVER w5 >= 2 THEN quantile_cont(y, 0.5) OVER w5 END, 6) AS m5,
  round(CASE WHEN count(y) OVER w24 >= 6 THEN quantile_cont(y, 0.5) OVER w24 END, 6) AS m24
FROM sbase WINDOW
  w5 AS (PARTITION BY site_id, kpi ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
  w24 AS (PARTITION BY site_id, kpi ORDER BY datetime ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"""))
def _(spark, d):
    s = site_series(spark, d)
    s = N.rolling_median(s, ["site_id", "kpi"], "value", 5, 2, "m5")
    s = N.rolling_median(s, ["site_id", "kpi"], "value", 24, 6, "m24")
    return r6(s.drop("value"), "m5", "m24")


A.CTES["sroll"] = """
SELECT *, y - m24 AS r24, y - m5 AS r5, CASE WHEN rn <= n - k THEN y END AS yb FROM (
  SELECT *, least(greatest(3, round_even(n * 0.25, 0)::BIGINT), n // 2) AS k,
    quantile_cont(y, 0.5) OVER (PARTITION BY site_id, kpi ORDER BY datetime
      ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS m24,
    quantile_cont(y, 0.5) OVER (PARTITION BY site_id, kpi ORDER BY datetime
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5 FROM snum)"""
A.CTES["smed"] = """
SELECT site_id, kpi, any_value(n) AS n, quantile_cont(y, 0.5) AS med, quantile_cont(yb, 0.5) AS b_mu,
  quantile_cont(CASE WHEN rn > n - k THEN y END, 0.5) AS r_mu,
  quantile_cont(CASE WHEN rn <= k THEN y END, 0.5) AS f_mu, quantile_cont(r24, 0.5) AS c24,
  quantile_cont(r5, 0.5) AS c5, max(t) AS days, avg(y) AS mean, stddev_pop(y) AS std
FROM sroll GROUP BY 1, 2"""
A.CTES["ssig"] = """
SELECT r.site_id, r.kpi, 1.4826 * quantile_cont(abs(yb - b_mu), 0.5) AS mb, stddev_pop(yb) AS sb,
  1.4826 * quantile_cont(abs(r24 - c24), 0.5) AS m24, stddev_pop(r24) AS s24,
  1.4826 * quantile_cont(abs(r5 - c5), 0.5) AS m5, stddev_pop(r5) AS s5
FROM sroll r JOIN smed USING (site_id, kpi) GROUP BY 1, 2"""
A.CTES["sanom"] = """
SELECT r.site_id, r.kpi, count(CASE WHEN abs(r5) > 4 * (CASE WHEN mm5 <> 0 THEN mm5 WHEN ss5 <> 0 THEN ss5
    ELSE 1e-9 END) THEN 1 END) AS n_anom, first(datetime ORDER BY abs(r5) DESC, datetime) AS worst_at
FROM sroll r JOIN (SELECT site_id, kpi, m5 AS mm5, s5 AS ss5 FROM ssig) USING (site_id, kpi) GROUP BY 1, 2"""
A.CTES["sall"] = """
SELECT site_id, kpi, n, f_mu, r_mu, b_mu, slope, n_anom, worst_at,
  (r_mu - f_mu) / denom * 100 AS pct,
  (r_mu - b_mu) / (CASE WHEN mb <> 0 THEN mb WHEN sb <> 0 THEN sb ELSE 1e-9 END) AS shift,
  CASE WHEN n >= 48 THEN (CASE WHEN m24 <> 0 THEN m24 ELSE s24 END) / abs(med)
    ELSE std / abs(mean) END AS cv,
  sgn * (r_mu - b_mu) AS move, sgn * (r_mu - b_mu) / abs(b_mu) AS rel,
  sgn * (r_mu - f_mu) / denom AS ends, sgn * slope * days / denom AS fit
FROM (SELECT *, CASE WHEN kpi = 'cell_avail_pct' THEN 1 ELSE -1 END AS sgn,
        CASE WHEN med = 0 THEN 1 ELSE abs(med) END AS denom FROM smed)
  JOIN ssig USING (site_id, kpi) JOIN sanom USING (site_id, kpi) JOIN sline USING (site_id, kpi)"""


@query("n04_trend_verdict", with_ctes("""
SELECT site_id, kpi, n, round(f_mu, 6) AS first, round(r_mu, 6) AS last, round(b_mu, 6) AS baseline,
  round(slope, 6) AS slope_per_day, round(pct, 6) AS pct_change, round(shift, 5) AS level_shift_sigma,
  round(cv, 6) AS volatility_cv, n_anom AS n_point_anomalies,
  CASE WHEN n_anom > 0 THEN worst_at END AS worst_point,
  CASE WHEN abs(shift) >= 4 AND abs(rel) >= 0.08 THEN CASE WHEN move > 0 THEN 'step-up' ELSE 'step-down' END
    WHEN cv > 0.5 AND abs(rel) < 0.12 AND abs(ends) < 0.12 THEN 'volatile'
    WHEN ends <= -0.15 AND fit <= -0.10 THEN 'degrading'
    WHEN ends >= 0.15 AND fit >= 0.10 THEN 'improving' ELSE 'stable' END AS verdict
FROM sall"""))
def _(spark, d):
    way = F.when(F.col("kpi") == "cell_avail_pct", "up").otherwise("down")
    t = N.detect_anomalies(site_series(spark, d), ["site_id", "kpi"], way)
    return r6(t.drop("direction", "recent"), "first", "last", "baseline", "slope_per_day",
              "pct_change", "volatility_cv").withColumn(
        "level_shift_sigma", F.round("level_shift_sigma", 5))


@query("w04_sudden_spikes", with_ctes("""
SELECT object, count(*) AS spike_hours, first(datetime ORDER BY away DESC, datetime) AS spike_time,
  round(first(value ORDER BY away DESC, datetime), 6) AS spike_value, round(any_value(normal), 6) AS normal
FROM (SELECT *, value - normal AS away, quantile_cont(abs(value - normal), 0.5)
        OVER (PARTITION BY object) AS mad FROM (
    SELECT object, datetime, value, quantile_cont(value, 0.5) OVER (PARTITION BY object) AS normal,
      count(*) OVER (PARTITION BY object) AS n FROM slong WHERE kpi = 'total_traffic_gb'))
WHERE n >= 6 AND away > 0 AND away > 6 * greatest(1.4826 * mad, 0.01 * abs(normal)) AND value >= 200
GROUP BY object"""))
def _(spark, d):
    s = long_of(spark, d).filter(F.col("kpi") == "total_traffic_gb")
    return r6(N.sudden_spikes(s, ["object"], False, 200.0), "spike_value", "normal")


TREND_SQL = """
SELECT {key} kpi, points, round(first, 6) AS first, round(last, 6) AS last, round(mn, 6) AS min,
  round(mx, 6) AS max, round(mean, 6) AS mean, round(pct, 5) AS pct_change,
  CASE WHEN abs(pct) < 3 THEN 'Stable' WHEN pct > 0 THEN 'Increasing' ELSE 'Decreasing' END AS verdict
FROM (SELECT *, slope * days / CASE WHEN abs(intercept) > 1e-9 THEN abs(intercept) ELSE abs(mean) END * 100
        AS pct FROM (SELECT {key} kpi, count(*) AS points, first(y ORDER BY datetime) AS first,
      last(y ORDER BY datetime) AS last, min(y) AS mn, max(y) AS mx, avg(y) AS mean, max(t) AS days
    FROM snum GROUP BY {key} kpi) JOIN sline USING ({key} kpi))"""


@query("n05_site_trends", with_ctes(TREND_SQL.format(key="site_id,")))
def _(spark, d):
    t = N.trend_of(site_series(spark, d), ["site_id", "kpi"])
    return r6(t.drop("slope_per_day"), "first", "last", "min", "max", "mean").withColumn(
        "pct_change", F.round("pct_change", 5))


NET = """SELECT 'all' AS site_id, kpi, datetime,
  CASE WHEN kpi = 'total_traffic_gb' THEN sum(value) ELSE avg(value) END AS y
  FROM slong {0} GROUP BY kpi, datetime"""


LINES = """SELECT {0} AS line, kpi, datetime,
  round(CASE WHEN kpi = 'total_traffic_gb' THEN sum(value) ELSE avg(value) END, 6) AS value
  FROM slong GROUP BY {0}, kpi, datetime"""
# the overall trend of lines is that of the longest one, the first by name among equals
LONGEST = """SELECT 'all' AS site_id, kpi, datetime, value AS y FROM (
  SELECT *, CASE WHEN kpi = 'total_traffic_gb' THEN s ELSE m END AS value,
    count(*) OVER (PARTITION BY kpi, line) AS k FROM (
    SELECT {0} AS line, kpi, datetime, sum(value) AS s, avg(value) AS m FROM slong GROUP BY {0}, kpi, datetime))
  QUALIFY rank() OVER (PARTITION BY kpi ORDER BY k DESC, line) = 1"""


def rounded_trend(trend):
    return r6(trend.drop("slope_per_day"), "first", "last", "min", "max", "mean").withColumn(
        "pct_change", F.round("pct_change", 5))


def cells_of(long):
    """Every cell of the hourly frame; the names stay in a table."""
    return long.select("object").distinct()


@query("n06_panels", with_ctes(TREND_SQL.format(key=""), sbase=NET.format("")))
def _(spark, d):
    long = long_of(spark, d)
    _lines, overall = N.panels(long, cells_of(long))
    return rounded_trend(overall)


@query("n06_panel_lines", with_ctes(LINES.format("object")))
def _(spark, d):
    long = long_of(spark, d)
    return r6(N.panels(long, cells_of(long))[0], "value")


@query("n06_panels_by_technology", with_ctes(TREND_SQL.format(key=""),
                                             sbase=LONGEST.format("tech")))
def _(spark, d):
    return rounded_trend(N.panels(long_of(spark, d), by_tech=True)[1])


@query("n06_technology_lines", with_ctes(LINES.format("tech")))
def _(spark, d):
    return r6(N.panels(long_of(spark, d), by_tech=True)[0], "value")


@query("n06_panels_single", with_ctes(TREND_SQL.format(key=""), sbase=NET.format("")))
def _(spark, d):
    return rounded_trend(N.panels(long_of(spark, d))[1])


@query("n07_trend_summary", with_ctes("""
SELECT kpi, verdict, round_even(pct_change, 1) AS pct_change, round_even(first, 3) AS first,
  round_even(last, 3) AS last, round_even(min, 3) AS min, round_even(max, 3) AS max,
  round_even(mean, 3) AS mean, points FROM ntrend""", sbase=NET.format(""),
    ntrend=TREND_SQL.format(key="")))
def _(spark, d):
    return N.trend_summary(N.trend_of(N.series_for(long_of(spark, d)), ["kpi"]))
