"""Registered queries: roll-ups, pivots, breaches and daily reports."""

from pyspark.sql import functions as F

from radiolake.operators import rollup as R
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import r6
from radiolake.plans.registry import query

A.CTES["cellall"] = """
SELECT technology, region, site_id, sector_id, cell_id, band,
  coalesce(sum(erab_drop_rate * erab_drop_denom) / nullif(sum(erab_drop_denom), 0),
    avg(erab_drop_rate)) AS erab_drop_rate,
  sum(erab_drop_denom) AS erab_drop_denom, avg(cell_avail_pct) AS cell_avail_pct,
  sum(total_traffic_gb) AS total_traffic_gb, max(rrc_conn_users_max) AS rrc_conn_users_max,
  avg(dl_prb_util) AS dl_prb_util, count(*) AS n_rows
FROM f4 GROUP BY ALL"""

AGG_SQL = """
SELECT {keys}{bucket}
  round(coalesce(sum(erab_drop_rate * erab_drop_denom) / nullif(sum(erab_drop_denom), 0),
    avg(erab_drop_rate)), 6) AS erab_drop_rate,
  round(sum(erab_drop_denom), 6) AS erab_drop_denom,
  round(avg(cell_avail_pct), 6) AS cell_avail_pct,
  round(sum(total_traffic_gb), 6) AS total_traffic_gb,
  max(rrc_conn_users_max) AS rrc_conn_users_max,
  round(avg(dl_prb_util), 6) AS dl_prb_util, count(*) AS n_rows
FROM f4 GROUP BY ALL"""


def shaped(df):
    return r6(df, "erab_drop_rate", "erab_drop_denom", "cell_avail_pct", "dl_prb_util").withColumn(
        "total_traffic_gb", F.round("total_traffic_gb", 6))


@query("a01_cell_day", with_ctes(AGG_SQL.format(
    keys="technology, region, site_id, sector_id, cell_id, band,",
    bucket=" date_trunc('day', datetime)::TIMESTAMP AS datetime,")))
def _(spark, d):
    return shaped(R.aggregate(A.cell_days(spark, d), "cell", "day"))


@query("a01_site_dow_hour", with_ctes(AGG_SQL.format(
    keys="technology, region, site_id,",
    bucket=" strftime(datetime, '%a %H:00') AS datetime,")))
def _(spark, d):
    return shaped(R.aggregate(A.cell_days(spark, d), "site", "dow_hour"))


@query("a02_sector_weighted_all", with_ctes(AGG_SQL.format(
    keys="technology, region, site_id, sector_id,", bucket="")))
def _(spark, d):
    return shaped(R.aggregate(A.cell_days(spark, d), "sector", "all"))


@query("a03_call_setup_fill", with_ctes("""
SELECT cell_id, round(coalesce(CASE WHEN n_rows % 2 = 0 THEN 99.0::DOUBLE END,
  (100 - erab_drop_rate) * cell_avail_pct / 100), 6) AS call_setup_sr FROM cellall"""))
def _(spark, d):
    c = R.aggregate(A.cell_days(spark, d), "cell", "all").select(
        "cell_id", (100 - F.col("erab_drop_rate")).alias("rrc_setup_sr"),
        F.col("cell_avail_pct").alias("erab_setup_sr"),
        F.when(F.col("n_rows") % 2 == 0, 99.0).alias("call_setup_sr"))
    return r6(R.fill_call_setup(c).select("cell_id", "call_setup_sr"), "call_setup_sr")


@query("a04_busy_hour", with_ctes("""
SELECT site_id, first(h ORDER BY m DESC, h) AS busy_hour, round(max(m), 6) AS bh_total_traffic_gb
FROM (SELECT site_id, hour(datetime)::INTEGER AS h, avg(total_traffic_gb) AS m FROM f3 GROUP BY 1, 2)
WHERE m IS NOT NULL GROUP BY site_id"""))
def _(spark, d):
    return r6(R.busy_hour(A.hourly(spark, d), "site"), "bh_total_traffic_gb")


@query("a05_p95_per_cell", with_ctes("""
SELECT object AS cell_id, round(quantile_cont(dl_prb_util, 0.95), 6) AS bh_dl_prb_util,
  round(quantile_cont(ul_rssi_dbm, 0.95), 6) AS bh_ul_rssi_dbm FROM f3 GROUP BY object"""))
def _(spark, d):
    h = A.hourly(spark, d).withColumnRenamed("object", "cell_id")
    return r6(R.p95_by(h, "cell_id", ["dl_prb_util", "ul_rssi_dbm"]), "bh_dl_prb_util",
              "bh_ul_rssi_dbm")


@query("a06_network_profile", with_ctes("""
SELECT datetime, count(*) AS cells, round(avg(dl_prb_util), 6) AS dl_prb_util,
  round(avg(cell_avail_pct), 6) AS cell_avail_pct,
  round(sum(total_traffic_gb), 6) AS total_traffic_gb FROM f3 GROUP BY datetime"""))
def _(spark, d):
    p = R.network_profile(A.hourly(spark, d), ["dl_prb_util", "cell_avail_pct",
                                               "total_traffic_gb"])
    return r6(p, "dl_prb_util", "cell_avail_pct", "total_traffic_gb")


@query("a07_headline", with_ctes("""
SELECT 'dl_prb_util' AS kpi, 'DL PRB Utilisation' AS label, '%' AS unit,
  round(avg(dl_prb_util), 6) AS network, round(max(dl_prb_util), 6) AS worst,
  80.0::DOUBLE AS warning, 80.0::DOUBLE AS critical,
  CASE WHEN avg(dl_prb_util) > 80 THEN 'Critical' ELSE 'OK' END AS status,
  count(CASE WHEN dl_prb_util > 80 THEN 1 END) AS cells_below_target FROM cellall
UNION ALL SELECT 'erab_drop_rate', 'E-RAB Drop Rate', '%', round(avg(erab_drop_rate), 6),
  round(max(erab_drop_rate), 6), 0.8, 2.0,
  CASE WHEN avg(erab_drop_rate) > 2.0 THEN 'Critical' WHEN avg(erab_drop_rate) > 0.8 THEN 'Warning'
    ELSE 'OK' END, count(CASE WHEN erab_drop_rate > 0.8 THEN 1 END) FROM cellall
UNION ALL SELECT 'total_traffic_gb', 'Total Data Volume', 'GB', round(sum(total_traffic_gb), 6),
  round(min(total_traffic_gb), 6), NULL, NULL, '-', 0 FROM cellall"""))
def _(spark, d):
    c = R.aggregate(A.cell_days(spark, d), "cell", "all")
    h = R.headline(c, ["dl_prb_util", "erab_drop_rate", "total_traffic_gb"])
    return r6(h, "network", "worst")


PIVOT_HOURS = [f"{h:02d}:00" for h in range(24)]


@query("a08_hourly_pivot", with_ctes(
    "SELECT object, strftime(datetime, '%Y-%m-%d') AS day, any_value(duplex) AS duplex, " + ", ".join(
        f"round_even(avg(CASE WHEN strftime(datetime, '%H:%M') = '{h}' THEN total_traffic_gb END)"
        f", 2) AS \"{h}\"" for h in PIVOT_HOURS)
    + " FROM f3 WHERE total_traffic_gb IS NOT NULL GROUP BY object, strftime(datetime, '%Y-%m-%d')"))
def _(spark, d):
    h = A.hourly(spark, d).withColumn("day", F.date_format(
        F.col("datetime").cast("timestamp"), "yyyy-MM-dd"))
    return R.hourly_pivot(h, "total_traffic_gb", PIVOT_HOURS, ["object", "day"], side="duplex",
                          label="HH:mm")


@query("a09_time_matrix", with_ctes("""
SELECT s.site_id, s.sector_id, v.datetime, round(coalesce(o.own, v.site_value), 6) AS value,
  o.own IS NULL AS from_site
FROM (SELECT DISTINCT site_id, sector_id FROM f3) s
JOIN (SELECT site_id, datetime, avg(dl_prb_util) AS site_value FROM f3
      WHERE dl_prb_util IS NOT NULL GROUP BY 1, 2) v USING (site_id)
LEFT JOIN (SELECT sector_id, datetime, avg(dl_prb_util) AS own FROM f3
      WHERE dl_prb_util IS NOT NULL GROUP BY 1, 2) o
  ON o.sector_id = s.sector_id AND o.datetime = v.datetime"""))
def _(spark, d):
    return r6(R.time_matrix(A.hourly(spark, d), "dl_prb_util"), "value")


@query("j03_sector_or_site_value", with_ctes("""
SELECT s.site_id, s.sector_id, round(coalesce(o.own, v.site_value), 6) AS value,
  o.own IS NULL AS from_site
FROM (SELECT DISTINCT site_id, sector_id FROM f3) s
JOIN (SELECT site_id, avg(dl_prb_util) AS site_value FROM f3 GROUP BY 1) v USING (site_id)
LEFT JOIN (SELECT sector_id, avg(dl_prb_util) AS own FROM f3 WHERE duplex = 'CELL_TDD' GROUP BY 1) o
  ON o.sector_id = s.sector_id"""))
def _(spark, d):
    h = A.hourly(spark, d)
    own = h.filter(F.col("duplex") == "CELL_TDD").groupBy("site_id", "sector_id").agg(
        F.avg("dl_prb_util").alias("own"))
    site = h.groupBy("site_id").agg(F.avg("dl_prb_util").alias("site_value"))
    return r6(R.value_or_site(own, site, h.select("site_id", "sector_id").distinct()), "value")


A.CTES["cellbreach"] = """
SELECT cell_id, site_id, kpi, v AS value, traffic_gb, n_rows, direction,
  CASE WHEN (direction = 'up' AND v < critical) OR (direction = 'down' AND v > critical) THEN 2
    ELSE 1 END AS sev, warning, critical
FROM (SELECT cell_id, site_id, total_traffic_gb AS traffic_gb, n_rows, kpi, v FROM cellall
      UNPIVOT (v FOR kpi IN (erab_drop_rate, cell_avail_pct, dl_prb_util))
      ) JOIN (VALUES ('erab_drop_rate', 'down', 0.8::DOUBLE, 2.0::DOUBLE, 0.1::DOUBLE),
        ('cell_avail_pct', 'up', 99.0, 99.0, 0.05), ('dl_prb_util', 'down', 80.0, 80.0, 0.05))
        r(kpi, direction, warning, critical, guard) USING (kpi)
WHERE traffic_gb >= guard AND ((direction = 'up' AND v < warning) OR (direction = 'down' AND v > warning))"""


@query("n01_breaches", with_ctes("""
SELECT cell_id, site_id, kpi, round(value, 6) AS value, sev, direction,
  CASE WHEN sev = 2 THEN critical ELSE warning END AS threshold,
  round(traffic_gb, 6) AS traffic_gb, n_rows FROM cellbreach"""))
def _(spark, d):
    b = R.breaches(R.aggregate(A.cell_days(spark, d), "cell", "all"))
    return r6(b, "value").withColumn("traffic_gb", F.round("traffic_gb", 6))


@query("n02_capacity_breaches", with_ctes("""
SELECT object AS cell_id, site_id, kpi, round(value, 6) AS value, datetime FROM (
  SELECT *, row_number() OVER (PARTITION BY object ORDER BY total_traffic_gb DESC, datetime) AS rn
  FROM (SELECT object, site_id, 'dl_prb_util' AS kpi, dl_prb_util AS value, datetime,
          total_traffic_gb FROM f3 WHERE dl_prb_util > 80 AND total_traffic_gb >= 0.05))
WHERE rn = 1"""))
def _(spark, d):
    h = A.hourly(spark, d).withColumnRenamed("object", "cell_id")
    b = R.capacity_breaches(h)
    return r6(b.select("cell_id", "site_id", "kpi", "value", "datetime"), "value")


@query("n08_busy_hour_findings", with_ctes("""
SELECT cell_id, 'dl_prb_util' AS kpi, round(p95, 6) AS value, round(m, 6) AS mean_value,
  CASE WHEN traffic >= (SELECT quantile_cont(traffic, 0.5) FROM
     (SELECT sum(total_traffic_gb) AS traffic FROM f3 GROUP BY object)) THEN 'P1' ELSE 'P2' END
  AS priority
FROM (SELECT object AS cell_id, quantile_cont(dl_prb_util, 0.95) AS p95, avg(dl_prb_util) AS m,
        sum(total_traffic_gb) AS traffic FROM f3 GROUP BY object)
WHERE p95 > 80 AND traffic >= 0.05 AND m < p95"""))
def _(spark, d):
    h = A.hourly(spark, d).withColumnRenamed("object", "cell_id")
    per_cell = h.groupBy("site_id", "cell_id").agg(
        F.avg("dl_prb_util").alias("dl_prb_util"),
        F.sum("total_traffic_gb").alias("total_traffic_gb"))
    f = R.busy_hour_findings(per_cell, R.p95_by(h, "cell_id", ["dl_prb_util"]), ["dl_prb_util"])
    return r6(f.select("cell_id", "kpi", "value", "mean_value", "priority"), "value", "mean_value")


@query("n09_worst_hours", with_ctes("""
SELECT object AS cell_id, 'availability' AS problem_class,
  first(datetime ORDER BY cell_avail_pct, datetime) AS worst_hour,
  round(min(cell_avail_pct), 6) AS worst_value FROM f3 WHERE cell_avail_pct IS NOT NULL GROUP BY object
UNION ALL SELECT object, 'high_utilization', first(datetime ORDER BY dl_prb_util DESC, datetime),
  round(max(dl_prb_util), 6) FROM f3 WHERE dl_prb_util IS NOT NULL GROUP BY object
UNION ALL SELECT object, 'interference', first(datetime ORDER BY ul_rssi_dbm DESC, datetime),
  round(max(ul_rssi_dbm), 6) FROM f3 WHERE ul_rssi_dbm IS NOT NULL GROUP BY object
UNION ALL SELECT object, 'traffic_imbalance', first(datetime ORDER BY total_traffic_gb DESC, datetime),
  round(max(total_traffic_gb), 6) FROM f3 WHERE total_traffic_gb IS NOT NULL GROUP BY object"""))
def _(spark, d):
    h = A.hourly(spark, d).withColumnRenamed("object", "cell_id")
    return r6(R.worst_hours(h), "worst_value")


@query("t04_order_findings", with_ctes("""
SELECT cell_id, problem_class, priority, round(traffic_gb, 6) AS traffic_gb FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id, problem_class ORDER BY priority) AS rn FROM (
    SELECT cell_id, traffic_gb, CASE kpi WHEN 'erab_drop_rate' THEN 'retainability' ELSE 'other' END
        AS problem_class,
      CASE WHEN sev = 2 THEN CASE WHEN traffic_gb >= med THEN 'P1' ELSE 'P2' END
        WHEN traffic_gb >= med THEN 'P3' ELSE 'P4' END AS priority
    FROM cellbreach, (SELECT quantile_cont(total_traffic_gb, 0.5) AS med FROM cellall)))
WHERE rn = 1 ORDER BY priority, traffic_gb DESC"""))
def _(spark, d):
    from radiolake.operators.common import with_scalars
    c = R.aggregate(A.cell_days(spark, d), "cell", "all")
    b = with_scalars(R.breaches(c), R.median_traffic(c)).select(
        "cell_id", "traffic_gb", F.when(F.col("kpi") == "erab_drop_rate", "retainability")
        .otherwise("other").alias("problem_class"),
        R.priority("sev", "traffic_gb", "busy_gb").alias("priority"))
    return R.order_findings(b).withColumn("traffic_gb", F.round("traffic_gb", 6))


@query("n11_site_day_report", with_ctes("""
SELECT b.site_id, b.day, 'dl_flowctrl_drops' AS kpi, round(b.value, 6) AS value, 2 AS sev,
  100000.0::DOUBLE AS threshold, 'P1' AS priority,
  array_to_string(list_slice(hrs, 1, 4), ', ')
    || CASE WHEN len(hrs) > 4 THEN ' (+' || (len(hrs) - 4)::VARCHAR || ' more)' ELSE '' END AS bad_hours
FROM (SELECT site_id, date_trunc('day', datetime)::TIMESTAMP AS day, sum(dl_flowctrl_drops) AS value
      FROM f3 GROUP BY 1, 2 HAVING sum(dl_flowctrl_drops) > 100000) b
JOIN (SELECT site_id, date_trunc('day', datetime)::TIMESTAMP AS day,
        coalesce(list(DISTINCT strftime(datetime, '%H:00') ORDER BY strftime(datetime, '%H:00'))
          FILTER (dl_flowctrl_drops > 100000), []) AS hrs FROM f3 GROUP BY 1, 2) h
  USING (site_id, day)"""))
def _(spark, d):
    h = A.hourly(spark, d).select("site_id", "datetime", "dl_flowctrl_drops")
    return r6(R.site_day_findings(h), "value")


@query("t02_top_sites", with_ctes("""
SELECT site_id, object, round(value, 6) AS value FROM (
  SELECT site_id, first(object ORDER BY v DESC, object) AS object, max(v) AS value
  FROM (SELECT site_id, object, max(dl_prb_util) AS v FROM f3 GROUP BY 1, 2) WHERE v IS NOT NULL
  GROUP BY 1) ORDER BY value DESC, site_id LIMIT 5"""))
def _(spark, d):
    c = A.hourly(spark, d).groupBy("site_id", "object").agg(F.max("dl_prb_util").alias("value"))
    return r6(R.top_sites(c.filter(F.col("value").isNotNull()), 5), "value")


@query("a23_kpi_context", with_ctes("""
SELECT site_id, sector_id, round(max(dl_prb_util), 6) AS prb_max,
  round(avg(dl_prb_util), 6) AS prb_mean, round(min(cell_avail_pct), 6) AS avail_min,
  round(max(ul_rssi_dbm), 6) AS rssi_max, round(sum(total_traffic_gb), 6) AS traffic_gb,
  round((SELECT quantile_cont(dl_prb_util, 0.95) FROM f3), 6) AS prb_net_p95
FROM f3 GROUP BY 1, 2"""))
def _(spark, d):
    return r6(R.kpi_context(A.hourly(spark, d)), "prb_max", "prb_mean", "avail_min", "rssi_max",
              "traffic_gb", "prb_net_p95")


@query("w12_sibling_load", with_ctes("""
SELECT site_id, sector_id, count(*) AS cells, round(max(m), 6) AS top, round(min(m), 6) AS low,
  string_agg(cell_id || '=' || round(m, 3)::VARCHAR, ', ' ORDER BY cell_id) AS siblings
FROM (SELECT site_id, sector_id, cell_id, avg(dl_prb_util) AS m FROM f4 GROUP BY 1, 2, 3)
GROUP BY 1, 2"""))
def _(spark, d):
    s = R.sibling_load(A.cell_days(spark, d))
    text = F.array_join(F.transform("siblings", lambda x: F.concat(
        x["cell_id"], F.lit("="), F.round(x["load"], 3).cast("string"))), ", ")
    return r6(s.withColumn("siblings", text), "top", "low")
