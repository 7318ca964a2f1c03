"""Registered queries: hourly judgement of objects, sites, areas and days."""

from pyspark.sql import functions as F

from radiolake.kpis import hourly_rules
from radiolake.operators import health as H
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.registry import query


def judged_hours(spark, d):
    long = H.to_long(A.hourly(spark, d), A.HOURLY_KPIS)
    return H.judge_hours(long, hourly_rules(spark))


def judged_objects(spark, d):
    return H.judge_objects(judged_hours(spark, d))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


STATE_SQL = ("CASE {0} WHEN 2 THEN 'Critical' WHEN 1 THEN 'Warning' WHEN 0 THEN 'Normal' "
             "ELSE 'No data' END AS state")


@query("j02_rule_per_row", with_ctes("""
SELECT kpi, r.is_tdd, count(*)::BIGINT AS rows, any_value(r.line) AS warning
FROM f3long l JOIN hrules r USING (kpi) WHERE r.is_tdd = (l.duplex = 'CELL_TDD')
GROUP BY kpi, r.is_tdd"""))
def _(spark, d):
    long = H.to_long(A.hourly(spark, d), A.HOURLY_KPIS)
    return H.with_rules(long, hourly_rules(spark)).groupBy("kpi", "is_tdd").agg(
        F.count(F.lit(1)).alias("rows"), F.max("warning").alias("warning"))


@query("a10_object_judgement", with_ctes(f"""
SELECT site_id, object_id, kpi, label, sev, {STATE_SQL.format('sev')}, hours, issue_hours,
  round(value, 6) AS value, round(peak, 6) AS peak, peak_time FROM objs"""))
def _(spark, d):
    o = judged_objects(spark, d)
    return r6(o.drop("direction", "is_main"), "value", "peak")


@query("a11_tdd_interference", with_ctes("""
SELECT site_id, object_id, sev, hours, issue_hours, round(peak, 6) AS peak, peak_time
FROM objs WHERE kpi = 'ul_rssi_dbm' AND object_id IN
  (SELECT object FROM f3 WHERE duplex = 'CELL_TDD')"""))
def _(spark, d):
    o = H.tdd_objects(judged_hours(spark, d))
    return r6(o.select("site_id", "object_id", "sev", "hours", "issue_hours", "peak",
                       "peak_time"), "peak")


@query("a12_site_status", with_ctes(f"""
SELECT s.*, {STATE_SQL.format('sev')} FROM sstat s"""))
def _(spark, d):
    return H.site_status(judged_objects(spark, d), A.hourly_sites(spark, d))


@query("a13_health_summary", with_ctes("""
SELECT count(*) AS sites, count(CASE WHEN sev > 0 THEN 1 END) AS issues,
  count(CASE WHEN sev = 2 THEN 1 END) AS n_critical, count(CASE WHEN sev = 1 THEN 1 END) AS n_warning,
  count(CASE WHEN sev = 0 THEN 1 END) AS n_normal, count(CASE WHEN sev = -1 THEN 1 END) AS n_no_data
FROM sstat"""))
def _(spark, d):
    return H.health_summary(H.site_status(judged_objects(spark, d), A.hourly_sites(spark, d)))


@query("a13_breaching_sites", with_ctes("""
SELECT kpi, count(DISTINCT site_id) AS measured,
  count(DISTINCT CASE WHEN sev > 0 THEN site_id END) AS breaching FROM objs GROUP BY kpi"""))
def _(spark, d):
    return H.breaching_sites(judged_objects(spark, d))


@query("a14_problem_ranking", with_ctes("""
SELECT label, count(DISTINCT site_id) AS sites,
  count(DISTINCT CASE WHEN sev = 2 THEN site_id END) AS critical
FROM objs WHERE sev > 0 GROUP BY label"""))
def _(spark, d):
    return H.problem_ranking(judged_objects(spark, d))


@query("a31_issues_by_day", with_ctes("""
SELECT day, count(*) AS sites, count(CASE WHEN sev > 0 THEN 1 END) AS issues,
  count(CASE WHEN sev = 2 THEN 1 END) AS critical
FROM (SELECT date_trunc('day', datetime)::TIMESTAMP AS day, site_id, max(sev) AS sev
      FROM jhours GROUP BY ALL) GROUP BY day"""))
def _(spark, d):
    return H.issues_by_day(judged_hours(spark, d))


AREA_SQL = """
SELECT p.name, c.city, p.sites, coalesce(affected, 0)::BIGINT AS affected,
  round(100.0 * coalesce(affected, 0) / p.sites, 6)::DOUBLE AS rate,
  coalesce(issues, 0)::BIGINT AS issues, coalesce(critical, 0)::BIGINT AS critical,
  0::BIGINT AS warning, coalesce(worst, 0)::BIGINT AS worst, coalesce(t.label, '') AS top_issue,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM (SELECT coalesce({0}, 'Unknown area') AS name, count(*) AS sites,
        quantile_cont(latitude, 0.5) AS latitude, quantile_cont(longitude, 0.5) AS longitude
      FROM hsites GROUP BY 1) p
JOIN (SELECT name, first(city ORDER BY n DESC, city DESC) AS city FROM
        (SELECT coalesce({0}, 'Unknown area') AS name, city, count(*) AS n FROM hsites GROUP BY 1, 2)
      GROUP BY 1) c USING (name)
LEFT JOIN (SELECT coalesce({0}, 'Unknown area') AS name, count(DISTINCT site_id) AS affected,
        count(*) AS issues, count(CASE WHEN sev = 2 THEN 1 END) AS critical, max(sev) AS worst
      FROM objs JOIN hsites USING (site_id) WHERE sev > 0 GROUP BY 1) a USING (name)
LEFT JOIN (SELECT name, first(label ORDER BY n DESC, label) AS label FROM
        (SELECT coalesce({0}, 'Unknown area') AS name, label, count(DISTINCT site_id) AS n
         FROM objs JOIN hsites USING (site_id) WHERE sev > 0 GROUP BY 1, 2) GROUP BY 1) t
  USING (name)"""


@query("a15_area_table", with_ctes(AREA_SQL.format("sup_district")))
def _(spark, d):
    t = H.region_table(judged_objects(spark, d), A.hourly_sites(spark, d), "sup_district")
    return r6(t, "rate", "latitude", "longitude")


@query("a15_area_table_governorate", with_ctes(AREA_SQL.format("governorate")))
def _(spark, d):
    t = H.region_table(judged_objects(spark, d), A.hourly_sites(spark, d), "governorate")
    return r6(t, "rate", "latitude", "longitude")


@query("a32_half_trend", with_ctes("""
SELECT name, count(DISTINCT CASE WHEN NOT late THEN j.site_id END) AS prev,
  count(DISTINCT CASE WHEN late THEN j.site_id END) AS last,
  (count(DISTINCT CASE WHEN late THEN j.site_id END)
   - count(DISTINCT CASE WHEN NOT late THEN j.site_id END))::DOUBLE AS trend
FROM (SELECT site_id, coalesce(sup_district, 'Unknown area') AS name FROM hsites) r
LEFT JOIN (SELECT site_id, datetime >= t0 + (t1 - t0) / 2 AS late FROM jhours,
             (SELECT min(datetime) AS t0, max(datetime) AS t1 FROM jhours) WHERE sev > 0) j
  USING (site_id) GROUP BY name"""))
def _(spark, d):
    return H.half_trend(judged_hours(spark, d), A.hourly_sites(spark, d), "sup_district")


SITE_HOURS_SQL = """
SELECT site_id, kpi, datetime, any_value(label) AS label, count(*) AS objects,
  count(CASE WHEN sev > 0 THEN 1 END) AS bad_objects,
  first(v ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, object_id) AS v,
  first(object_id ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, object_id)
    AS object_id, max(sev) AS sev, any_value(direction) AS direction
FROM jhours GROUP BY site_id, kpi, datetime"""
A.CTES["shours"] = SITE_HOURS_SQL


@query("w05_site_hours", with_ctes("""
SELECT * EXCLUDE (v, direction), round(v, 6) AS v FROM shours"""))
def _(spark, d):
    return r6(H.site_hours(judged_hours(spark, d)).drop("direction", "is_main"), "v")


@query("w02_worst_hour", with_ctes("""
SELECT site_id, kpi, max(sev) AS sev,
  round(first(v ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime,
    object_id), 6) AS v,
  first(datetime ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime,
    object_id) AS datetime,
  first(object_id ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime,
    object_id) AS object_id
FROM jhours GROUP BY site_id, kpi"""))
def _(spark, d):
    return r6(H.worst_hour(judged_hours(spark, d), ["site_id", "kpi"]), "v")


@query("t01_issue_order", with_ctes("""
SELECT site_id, object_id, kpi, sev, label, round(peak, 6) AS peak FROM objs
ORDER BY sev DESC, label, CASE WHEN direction = 'up' THEN peak ELSE -peak END, object_id"""))
def _(spark, d):
    o = H.issue_order(judged_objects(spark, d))
    return o.select("site_id", "object_id", "kpi", "sev", "label", F.round("peak", 6).alias("peak"))


@query("t03_worst_sectors", with_ctes("""
SELECT sector_id, sev, round(v, 6) AS v FROM (
  SELECT sector_id, avg(value) AS v, CASE WHEN avg(value) > 80 THEN 2 ELSE 0 END AS sev
  FROM f3long WHERE kpi = 'dl_prb_util' GROUP BY 1)
ORDER BY sev DESC, v DESC, sector_id LIMIT 10"""))
def _(spark, d):
    s = A.hourly(spark, d).groupBy("sector_id").agg(F.avg("dl_prb_util").alias("v"))
    s = s.filter(F.col("v").isNotNull()).withColumn("direction", F.lit("down")).withColumn(
        "sev", F.when(F.col("v") > 80, 2).otherwise(0))
    return r6(H.worst_sectors(s, 10).select("sector_id", "sev", "v"), "v")


@query("t06_worst_sites", with_ctes("""
SELECT site_id, sev, issues, label, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM (SELECT site_id, max(sev) AS sev, count(*) AS issues,
        first(label ORDER BY sev DESC, label) AS label FROM objs WHERE sev > 0 GROUP BY 1)
JOIN hsites USING (site_id)"""))
def _(spark, d):
    return r6(H.worst_sites(judged_objects(spark, d), A.hourly_sites(spark, d)), "latitude",
              "longitude")


CELLS_SQL = """
SELECT '4G' AS tech, object AS object_id, object AS cell_name, '' AS cell_id FROM f3 GROUP BY object"""


@query("a39_object_cells", with_ctes("""
SELECT '4G' AS tech, site_id AS object_id, string_agg(DISTINCT object, ', ' ORDER BY object)
  AS cell_name, '' AS cell_id FROM f3 GROUP BY site_id"""))
def _(spark, d):
    return H.object_cells(A.hourly(spark, d).withColumn("level", F.lit("site")))


ENRICHED = """
SELECT o.site_id, object_id, kpi, label, sev,
  CASE WHEN sev > 0 THEN (CASE WHEN direction = 'up' THEN 'Low ' ELSE 'High ' END) || label
    ELSE '' END AS issue,
  coalesce(governorate, 'Unknown area') AS governorate,
  coalesce(sup_district, 'Unknown area') AS sup_district, city,
  CASE sev WHEN 2 THEN 'Critical' WHEN 0 THEN 'Normal' END AS state
FROM objs o LEFT JOIN hsites USING (site_id)"""
A.CTES["enriched"] = ENRICHED


@query("p23_enriched_rows", with_ctes("""
SELECT site_id, object_id, kpi, issue,
  lower(concat_ws(' ', site_id, '', object_id, governorate, sup_district, city, label, state,
    issue)) AS search FROM enriched"""))
def _(spark, d):
    e = H.enrich_rows(judged_objects(spark, d), A.hourly_sites(spark, d))
    return e.select("site_id", "object_id", "kpi", "issue", "search")


@query("p19_facet_filter", with_ctes("""
SELECT site_id, object_id, kpi, issue FROM enriched
WHERE governorate = 'North' AND contains(lower(object_id), 'l21') AND sev = 2
  AND contains(lower(concat_ws(' ', site_id, object_id, label, issue)), 'high')"""))
def _(spark, d):
    sites = A.hourly_sites(spark, d)
    rows = H.enrich_rows(judged_objects(spark, d), sites)
    kept, _sites = H.facet_filter(rows, sites, governorate="North", cell=["L21"],
                                  words=["high"], states=["Critical"])
    return kept.select("site_id", "object_id", "kpi", "issue")


@query("p22_scope_sites", with_ctes("""
SELECT DISTINCT site_id FROM f3 WHERE site_id IN
  (SELECT site_id FROM hsites WHERE governorate = 'South')"""))
def _(spark, d):
    return H.scope_sites(A.hourly(spark, d), "governorate", "South", A.hourly_sites(spark, d))


@query("f13_severity", with_ctes("""
SELECT kpi, sev, count(*) AS hours FROM jhours GROUP BY kpi, sev"""))
def _(spark, d):
    return judged_hours(spark, d).groupBy("kpi", "sev").agg(F.count(F.lit(1)).alias("hours"))
