"""Registered queries: tickets against the KPI hours around them, and ticket history."""

from pyspark.sql import functions as F

from radiolake.functions import text as X
from radiolake.functions.times import in_period, local_time
from radiolake.kpis import hourly_rules
from radiolake.operators import health as H
from radiolake.operators import tickets as T
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import judged_hours, r6
from radiolake.plans.registry import query

WINDOW_H = 2.0

A.CTES["wtickets"] = """
SELECT *, date_trunc('hour', problem_time - INTERVAL 2 HOUR) AS lo,
  date_trunc('hour', problem_time + INTERVAL 2 HOUR) AS hi FROM tickets"""


@query("j04_ticket_window", with_ctes("""
SELECT ticket_id, w.site_id, object, kpi, datetime, round(value, 6) AS value
FROM wtickets w JOIN f3long f ON f.site_id = w.site_id AND f.datetime BETWEEN w.lo AND w.hi"""))
def _(spark, d):
    k = H.to_long(A.hourly(spark, d), A.HOURLY_KPIS).select("site_id", "object", "kpi", "datetime",
                                                           "value")
    return r6(T.ticket_window(A.tickets(spark, d), k, WINDOW_H), "value").select(
        "ticket_id", "site_id", "object", "kpi", "datetime", "value")


@query("j05_ticket_hour_value", with_ctes("""
SELECT ticket_id, t.site_id, date_trunc('hour', problem_time) AS datetime, round(v, 6) AS v
FROM tickets t LEFT JOIN (SELECT site_id, datetime, avg(dl_prb_util) AS v FROM f3 GROUP BY 1, 2) s
  ON s.site_id = t.site_id AND s.datetime = date_trunc('hour', problem_time)"""))
def _(spark, d):
    s = A.hourly(spark, d).groupBy("site_id", "datetime").agg(F.avg("dl_prb_util").alias("v"))
    return r6(T.ticket_hour_value(A.tickets(spark, d), s), "v")


A.CTES["tinwin"] = """
SELECT ticket_id, j.*, datetime >= lo AS inside, lo, hi FROM wtickets w JOIN jhours j
  ON j.site_id = w.site_id AND j.datetime BETWEEN w.lo - INTERVAL 6 HOUR AND w.hi"""
A.CTES["tcheck0"] = """
SELECT ticket_id, kpi, count(DISTINCT datetime) FILTER (inside) AS hours,
  count(DISTINCT datetime) FILTER (inside AND sev > 0) AS breach_hours,
  max(sev) FILTER (inside) AS sev,
  first(v ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime, object_id)
    FILTER (inside) AS worst,
  first(datetime ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime, object_id)
    FILTER (inside) AS worst_at,
  first(object_id ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime, object_id)
    FILTER (inside) AS worst_obj,
  count(DISTINCT object_id) FILTER (inside) AS n_cells,
  count(DISTINCT object_id) FILTER (inside AND sev > 0) AS n_bad,
  max(sev) FILTER (NOT inside) AS before_sev
FROM tinwin GROUP BY 1, 2"""
A.CTES["tafter0"] = """
SELECT w.ticket_id, s.kpi, count(*) AS n, count(CASE WHEN s.sev > 0 THEN 1 END) AS after_bad,
  last(s.sev ORDER BY s.datetime) AS last_sev, min(s.datetime) AS first_at,
  max(CASE WHEN s.sev > 0 THEN s.datetime END) AS last_bad
FROM wtickets w JOIN shours s ON s.site_id = w.site_id AND s.datetime > w.hi GROUP BY 1, 2"""
A.CTES["tcheck"] = """
SELECT w.ticket_id, w.site_id, k.kpi, k.label, k.direction, coalesce(c.sev, -1) AS sev, coalesce(hours, 0) AS hours,
  coalesce(breach_hours, 0) AS breach_hours, worst, worst_at, worst_obj,
  coalesce(n_cells, 0) AS n_cells, coalesce(n_bad, 0) AS n_bad,
  CASE WHEN c.sev IS NOT NULL THEN CASE WHEN before_sev > 0 THEN 'breaching' WHEN before_sev = 0
    THEN 'normal' ELSE 'no data' END END AS before,
  CASE WHEN c.sev IS NOT NULL THEN CASE WHEN a.n IS NULL THEN 'no data' WHEN a.last_sev > 0 THEN
    'breaching' ELSE 'normal' END END AS after, after_bad,
  CASE WHEN a.last_sev = 0 THEN coalesce((SELECT min(s.datetime) FROM shours s WHERE
    s.site_id = w.site_id AND s.kpi = k.kpi AND s.datetime > a.last_bad), first_at) END AS after_since,
  CASE WHEN c.sev > 0 THEN CASE WHEN a.n IS NULL THEN 'Unknown' WHEN a.last_sev > 0 THEN 'Not Resolved'
    ELSE 'Resolved' END END AS resolution
FROM wtickets w JOIN (SELECT DISTINCT site_id, kpi, label, direction FROM jhours) k USING (site_id)
LEFT JOIN tcheck0 c ON c.ticket_id = w.ticket_id AND c.kpi = k.kpi
LEFT JOIN tafter0 a ON a.ticket_id = w.ticket_id AND a.kpi = k.kpi"""


def checks(spark, d):
    return T.ticket_checks(A.tickets(spark, d), T.site_kpi_hours(judged_hours(spark, d)), WINDOW_H)


@query("c05_ticket_checks", with_ctes("""
SELECT ticket_id, kpi, sev, hours, breach_hours, round(worst, 6) AS worst, worst_at, worst_obj,
  n_cells, n_bad, before, after FROM tcheck"""))
def _(spark, d):
    c = checks(spark, d)
    return c.select("ticket_id", "kpi", "sev", "hours", "breach_hours",
                    F.round("worst", 6).alias("worst"), "worst_at", "worst_obj",
                    F.coalesce(F.size("cells"), F.lit(0)).cast("bigint").alias("n_cells"),
                    F.coalesce(F.size("bad_cells"), F.lit(0)).cast("bigint").alias("n_bad"),
                    "before", "after")


@query("w11_recovered_since", with_ctes("""
SELECT ticket_id, kpi, after_bad, after_since, resolution FROM tcheck WHERE sev > 0"""))
def _(spark, d):
    return checks(spark, d).filter(F.col("sev") > 0).select(
        "ticket_id", "kpi", "after_bad", "after_since", "resolution")


A.CTES["tverdict"] = """
SELECT ticket_id, site_id, CASE WHEN judged = 0 THEN 'Insufficient Data' WHEN crit > 0 THEN
    'Technical Issue' WHEN warn > 0 THEN 'Possible Technical Issue' ELSE 'No Network Issue Detected'
    END AS classification,
  CASE WHEN judged = 0 THEN 'Unknown' WHEN crit > 0 THEN 'Yes' WHEN warn > 0 THEN 'Possible' ELSE 'No' END
    AS detected,
  CASE WHEN judged > 0 AND crit + warn > 0 THEN CASE WHEN top_kpi = 'cell_avail_pct' AND top_worst < 50
    THEN 'Outage' ELSE CASE top_kpi WHEN 'cell_avail_pct' THEN 'Availability' WHEN 'ul_rssi_dbm' THEN
    'Interference' WHEN 'dl_prb_util' THEN 'Congestion' ELSE 'Flow control' END END ELSE '' END
    AS problem_type,
  CASE WHEN judged = 0 THEN '' WHEN crit > 0 THEN CASE WHEN top_hours >= 2 OR crit >= 2 THEN 'High' ELSE
    'Medium' END WHEN full_n >= 3 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN judged = 0 THEN '' WHEN crit + warn = 0 THEN 'No network issue' WHEN open_n > 0 THEN
    'Not Resolved' WHEN not_closed = 0 THEN 'Resolved' ELSE 'Unknown' END AS resolution,
  judged > 0 AND crit + warn = 0 AS manual_check
FROM (SELECT t.ticket_id, t.site_id, count(CASE WHEN sev >= 0 THEN 1 END) AS judged,
    count(CASE WHEN sev = 2 THEN 1 END) AS crit, count(CASE WHEN sev = 1 THEN 1 END) AS warn,
    count(CASE WHEN sev >= 0 AND hours >= 4 THEN 1 END) AS full_n,
    first(kpi ORDER BY sev DESC, breach_hours DESC, label) AS top_kpi,
    first(worst ORDER BY sev DESC, breach_hours DESC, label) AS top_worst,
    first(breach_hours ORDER BY sev DESC, breach_hours DESC, label) AS top_hours,
    count(CASE WHEN sev > 0 AND resolution = 'Not Resolved' THEN 1 END) AS open_n,
    count(CASE WHEN sev > 0 AND resolution <> 'Resolved' THEN 1 END) AS not_closed
  FROM tickets t LEFT JOIN tcheck c USING (ticket_id) GROUP BY 1, 2)"""


@query("c06_ticket_verdict", with_ctes("SELECT * FROM tverdict"))
def _(spark, d):
    return T.ticket_verdict(A.tickets(spark, d), checks(spark, d), WINDOW_H)


@query("c07_indicators", with_ctes("""
SELECT ticket_id, kpi, count(*) AS hours, max(sev) AS sev, count(CASE WHEN sev > 0 THEN 1 END) AS issue_hours,
  round(first(v ORDER BY CASE WHEN kpi = 'cell_avail_pct' THEN v ELSE -v END, datetime), 6) AS value,
  first(datetime ORDER BY CASE WHEN kpi = 'cell_avail_pct' THEN v ELSE -v END, datetime) AS at
FROM (SELECT *, CASE kpi WHEN 'cell_avail_pct' THEN CASE WHEN v < 99 THEN 2 ELSE 0 END
        WHEN 'dl_prb_util' THEN CASE WHEN v > 80 THEN 2 ELSE 0 END
        WHEN 'ul_rssi_dbm' THEN CASE WHEN v > -105 THEN 2 ELSE 0 END
        ELSE CASE WHEN v > 100000 THEN 2 ELSE 0 END END AS sev
  FROM (SELECT site_id, kpi, datetime, CASE kpi WHEN 'dl_flowctrl_drops' THEN sum(value)
          WHEN 'cell_avail_pct' THEN min(value) ELSE max(value) END AS v FROM f3long GROUP BY 1, 2, 3))
JOIN (SELECT ticket_id, site_id AS sid, lo, hi FROM wtickets) w ON sid = site_id AND datetime BETWEEN lo AND hi
GROUP BY 1, 2"""))
def _(spark, d):
    long = H.to_long(A.hourly(spark, d), A.HOURLY_KPIS)
    i = T.indicators(A.tickets(spark, d), long, hourly_rules(spark), WINDOW_H)
    return r6(i, "value")


A.CTES["ttiles"] = """
SELECT t.ticket_id, k.tile, coalesce(c.sev, -1) AS sev, c.kpi, c.worst AS value, c.worst_obj AS object_id
FROM tickets t, (VALUES ('AVA', 'cell_avail_pct'), ('PRB', 'dl_prb_util'), ('INTER', 'ul_rssi_dbm'),
  ('FLOW', 'dl_flowctrl_drops')) k(tile, kpi)
LEFT JOIN tcheck c ON c.ticket_id = t.ticket_id AND c.kpi = k.kpi"""


@query("c08_ticket_tiles", with_ctes("""
SELECT ticket_id, tile, sev, CASE WHEN sev < 0 THEN 'No Data' WHEN sev = 0 THEN 'Normal' WHEN sev = 2 THEN
  'Critical' ELSE 'High' END AS state, kpi, round(value, 6) AS value, object_id FROM ttiles"""))
def _(spark, d):
    return r6(T.ticket_tiles(A.tickets(spark, d), checks(spark, d)), "value")


@query("a33_tile_counts", with_ctes("""
SELECT tile, count(CASE WHEN sev = 2 THEN 1 END) AS critical, count(CASE WHEN sev = 1 THEN 1 END) AS warning,
  count(CASE WHEN sev = 0 THEN 1 END) AS normal, count(CASE WHEN sev < 0 THEN 1 END) AS nodata
FROM ttiles GROUP BY 1"""))
def _(spark, d):
    return T.tile_counts(T.ticket_tiles(A.tickets(spark, d), checks(spark, d)))


A.CTES["ttimeline"] = """
SELECT g.ticket_id, g.datetime, CASE WHEN g.datetime < lo THEN 'before' WHEN g.datetime <= hi THEN 'during'
  ELSE 'after' END AS phase, coalesce(max(sev), -1) AS sev,
  coalesce(string_agg(CASE WHEN sev > 0 THEN label END, ', ' ORDER BY label), '') AS drivers
FROM (SELECT ticket_id, site_id, lo, hi, unnest(generate_series(lo - INTERVAL 2 HOUR, hi + INTERVAL 3 HOUR,
        INTERVAL 1 HOUR)) AS datetime FROM wtickets) g
LEFT JOIN shours s ON s.site_id = g.site_id AND s.datetime = g.datetime GROUP BY 1, 2, 3"""


@query("c09_ticket_timeline", with_ctes("SELECT * FROM ttimeline"))
def _(spark, d):
    return T.ticket_timeline(A.tickets(spark, d), T.site_kpi_hours(judged_hours(spark, d)), WINDOW_H)


@query("c09_timeline_summary", with_ctes("""
SELECT ticket_id, max(CASE WHEN phase = 'before' THEN sev END) AS before,
  max(CASE WHEN phase = 'during' THEN sev END) AS during, max(CASE WHEN phase = 'after' THEN sev END) AS after,
  first(datetime ORDER BY sev DESC, datetime) FILTER (phase = 'during' AND sev > 0) AS peak_hour
FROM ttimeline GROUP BY 1"""))
def _(spark, d):
    return T.timeline_summary(T.ticket_timeline(
        A.tickets(spark, d), T.site_kpi_hours(judged_hours(spark, d)), WINDOW_H))


# ------------------------------------------------------------------ ticket table
def history(spark, d):
    t = A.tickets(spark, d)
    return t.select("ticket_id", "site_id", "sector_id", F.col("problem_time").alias("create_time"),
                    "group", "latitude", "longitude", "reopen",
                    X.city_name(F.lit(None).cast("string"), "site_id").alias("city"),
                    X.user_name("user").alias("user"), F.col("user").alias("login"),
                    X.ticket_state(F.when(F.col("status") == "Completed", "Completed").otherwise(""),
                                   F.regexp_replace("status", " .*", "")).alias("state"),
                    X.ticket_type("reopen", "user").alias("type"))


A.CTES["history"] = """
SELECT ticket_id, site_id, sector_id, problem_time AS create_time, "group", latitude, longitude,
  'Basrah' AS city, CASE WHEN "user" = '' THEN '' ELSE replace(substr("user", 4), '.', ' ') END AS "user",
  CASE status WHEN 'Completed' THEN 'Closed' WHEN 'Sleep' THEN 'Sleep' WHEN 'Pending Customer' THEN 'Pending'
    ELSE 'In Progress' END AS state,
  CASE WHEN reopen LIKE 'Reopen%' THEN 'REOPEN #' || substr(reopen, 8) WHEN "user" <> '' THEN 'UP OF SLEEP'
    ELSE 'NEW' END AS type FROM tickets"""


@query("p14_p15_p16_ticket_fields", with_ctes("""
SELECT ticket_id, city, "user", state, type FROM history"""))
def _(spark, d):
    return history(spark, d).select("ticket_id", "city", "user", "state", "type")


@query("c11_ticket_table", with_ctes("""
SELECT v.ticket_id, v.site_id, h.type, h.state, p.sup_district, v.classification, v.problem_type,
  v.resolution, n.n AS site_tickets, coalesce(i.kpi_issues, '') AS kpi_issues
FROM tverdict v JOIN history h USING (ticket_id) LEFT JOIN hsites p ON p.site_id = v.site_id
JOIN (SELECT site_id, count(*) AS n FROM tickets GROUP BY 1) n ON n.site_id = v.site_id
LEFT JOIN (SELECT ticket_id, string_agg(DISTINCT label, ', ' ORDER BY label) AS kpi_issues FROM tcheck
  WHERE sev > 0 GROUP BY 1) i ON i.ticket_id = v.ticket_id"""))
def _(spark, d):
    t = A.tickets(spark, d)
    c = checks(spark, d)
    return ticket_table(t, c, history(spark, d), A.hourly_sites(spark, d))


def ticket_table(t, c, hist, places):
    v = T.ticket_verdict(t, c, WINDOW_H)
    issues = c.filter(F.col("sev") > 0).groupBy("ticket_id").agg(
        F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("kpi_issues"))
    per_site = t.groupBy("site_id").agg(F.count(F.lit(1)).alias("site_tickets"))
    j = (v.join(hist.select("ticket_id", "type", "state"), "ticket_id")
         .join(places.select("site_id", "sup_district"), "site_id", "left")
         .join(per_site, "site_id").join(issues, "ticket_id", "left"))
    return j.select("ticket_id", "site_id", "type", "state", "sup_district", "classification",
                    "problem_type", "resolution", "site_tickets",
                    F.coalesce("kpi_issues", F.lit("")).alias("kpi_issues"))


@query("a30_top_ticket_sites", with_ctes("""
SELECT site_id, count(*) AS tickets, count(CASE WHEN ticket_id % 3 = 0 THEN 1 END) AS delay_tickets,
  count(CASE WHEN classification LIKE '%Technical Issue' THEN 1 END) AS technical,
  round_even(100.0 * count(*) / (SELECT count(*) FROM tickets), 1)::DOUBLE AS pct
FROM tverdict GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 5"""))
def _(spark, d):
    v = T.ticket_verdict(A.tickets(spark, d), checks(spark, d), WINDOW_H)
    return T.top_ticket_sites(v.withColumn("delayed", F.col("ticket_id") % 3 == 0), 5)


# --------------------------------------------------------------------- history
@query("a29_history_by_user", with_ctes("""
WITH u AS (SELECT CASE WHEN "user" = '' THEN 'No user' ELSE "user" END AS "user", count(*) AS tickets,
    row_number() OVER (ORDER BY count(*) DESC, CASE WHEN "user" = '' THEN 'No user' ELSE "user" END) AS r
  FROM history GROUP BY 1)
SELECT CASE WHEN r > 5 THEN 'Others' ELSE "user" END AS "user", sum(tickets)::BIGINT AS tickets
FROM u GROUP BY 1""").replace("\nWITH u AS", ",\nu AS", 1))
def _(spark, d):
    return T.history_by(history(spark, d), "user", n=5, empty="No user")


@query("a29_history_states", with_ctes("SELECT state, count(*) AS tickets FROM history GROUP BY 1"))
def _(spark, d):
    return T.history_states(history(spark, d))


@query("a29_history_per_month", with_ctes("""
SELECT strftime(create_time, '%Y-%m') AS month, count(DISTINCT ticket_id) AS tickets FROM history GROUP BY 1"""))
def _(spark, d):
    return T.history_per_month(history(spark, d))


@query("p18_in_period", with_ctes("""
SELECT ticket_id, create_time FROM history WHERE create_time >= DATE '2024-01-05'
  AND create_time < DATE '2024-01-11'"""))
def _(spark, d):
    h = history(spark, d)
    return h.filter(in_period("create_time", "2024-01-05", "2024-01-10")).select(
        "ticket_id", "create_time")


@query("p20_ticket_filter", with_ctes("""
SELECT ticket_id FROM history WHERE state IN ('Closed', 'Sleep') AND ("user" = '' OR "user" = 'User3 Name')
  AND create_time >= DATE '2024-01-02' AND create_time < DATE '2024-01-21'"""))
def _(spark, d):
    return T.ticket_filter(history(spark, d), {"state": ["Closed", "Sleep"],
                                               "user": ["No user", "User3 Name"]},
                           {"user": "No user"}, ("2024-01-02", "2024-01-20")).select("ticket_id")


@query("p21_ticket_search", with_ctes("""
SELECT ticket_id, site_id FROM history WHERE site_id LIKE '%S0003%' OR ticket_id::VARCHAR LIKE '%S0003%'"""))
def _(spark, d):
    return T.ticket_search(history(spark, d), "s0003", ["ticket_id", "site_id"]).select(
        "ticket_id", "site_id")


@query("p21_ticket_search_exact", with_ctes("""
SELECT ticket_id, site_id FROM history WHERE ticket_id = 12"""))
def _(spark, d):
    return T.ticket_search(history(spark, d), "12", ["ticket_id", "site_id"]).select(
        "ticket_id", "site_id")


@query("t05_newest_first", with_ctes("""
SELECT ticket_id, create_time FROM history ORDER BY create_time DESC NULLS LAST, ticket_id"""))
def _(spark, d):
    return T.newest_first(history(spark, d)).select("ticket_id", "create_time")


@query("p06_local_time", with_ctes("""
SELECT ticket_id, problem_time AS local FROM tickets"""))
def _(spark, d):
    t = A.tickets(spark, d)
    text = F.concat(F.date_format(F.col("problem_time").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
                    F.lit("Z"))
    return t.select("ticket_id", local_time(text).alias("local"))
