"""The library's input tables derived from the given tables, in Spark and as SQL text.

Every adapter exists twice: a DataFrame builder and the same derivation as a
common table expression, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.times import hour_floor

CTES: dict[str, str] = {}


def with_ctes(body: str, **extra: str) -> str:
    """`body` preceded by every common table expression it names, in order of need."""
    texts = {**CTES, **extra}
    order: list[str] = []
    open_names: set[str] = set()

    def need(text: str):
        for name, own in texts.items():
            if name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                need(own)
                order.append(name)
    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in order) + "\n" + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --------------------------------------------------------------------- hourly
def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly KPI frame of 40 cells on 7 sites, from the event stream."""
    e = (table(spark, d, "events").select("ts", "user_id", "event_type", "value")
         .withColumn("c", (F.col("user_id") % 40).cast("int"))
         .withColumn("datetime", hour_floor("ts")))
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    g = e.groupBy("c", "datetime").agg(
        F.avg(of("click")).alias("m"), F.count(of("error")).alias("n_err"),
        F.avg(of("view")).alias("mv"), F.sum(of("purchase")).alias("p"),
        F.sum("value").alias("total"))
    site = F.concat(F.lit("BAS"), F.lpad((F.col("c") % 7 + 1).cast("string"), 4, "0"))
    sector = (F.col("c") % 3 + 1).cast("string")
    return g.select(
        "datetime",
        F.concat(F.when(F.col("c") < 21, "L_").otherwise("L21_"), site, F.lit("-"),
                 sector).alias("object"),
        site.alias("site_id"), F.concat(site, F.lit("-S"), sector).alias("sector_id"),
        F.lit("BAS").alias("prefix"), F.lit("cell").alias("level"),
        F.when(F.col("c") % 4 == 0, "CELL_TDD").otherwise("CELL_FDD").alias("duplex"),
        F.concat(F.lit("enb_"), site).alias("parent"), F.lit("4G").alias("tech"),
        F.when(F.col("m") > 100, 100.0).otherwise(F.col("m")).alias("dl_prb_util"),
        F.when(F.col("n_err") > 0, 100 - F.lit(0.8).cast("double") * F.col("n_err"))
        .alias("cell_avail_pct"),
        (F.lit(-120.0) + F.lit(0.2) * F.col("mv")).alias("ul_rssi_dbm"),
        (F.lit(5000.0) * F.col("p")).alias("dl_flowctrl_drops"),
        F.col("total").alias("total_traffic_gb"))


CTES["f3"] = """
SELECT datetime, (CASE WHEN c < 21 THEN 'L_' ELSE 'L21_' END) || site_id || '-' || sec AS object,
  site_id, site_id || '-S' || sec AS sector_id, 'BAS' AS prefix, 'cell' AS level,
  CASE WHEN c % 4 = 0 THEN 'CELL_TDD' ELSE 'CELL_FDD' END AS duplex, 'enb_' || site_id AS parent,
  '4G' AS tech, CASE WHEN m > 100 THEN 100.0::DOUBLE ELSE m END AS dl_prb_util,
  CASE WHEN n_err > 0 THEN 100 - 0.8::DOUBLE * n_err END AS cell_avail_pct,
  -120.0::DOUBLE + 0.2::DOUBLE * mv AS ul_rssi_dbm, 5000.0::DOUBLE * p AS dl_flowctrl_drops,
  total AS total_traffic_gb
FROM (SELECT c, datetime, 'BAS' || lpad((c % 7 + 1)::VARCHAR, 4, '0') AS site_id,
        (c % 3 + 1)::VARCHAR AS sec,
        avg(CASE WHEN event_type = 'click' THEN value END) AS m,
        count(CASE WHEN event_type = 'error' THEN 1 END) AS n_err,
        avg(CASE WHEN event_type = 'view' THEN value END) AS mv,
        sum(CASE WHEN event_type = 'purchase' THEN value END) AS p, sum(value) AS total
      FROM (SELECT *, (user_id % 40)::INTEGER AS c, date_trunc('hour', ts) AS datetime FROM events)
      GROUP BY c, datetime)"""

HOURLY_KPIS = ["cell_avail_pct", "dl_prb_util", "ul_rssi_dbm", "dl_flowctrl_drops"]

CTES["f3long"] = """
SELECT datetime, object, site_id, sector_id, prefix, duplex, tech, kpi, value FROM (
  SELECT * FROM f3) UNPIVOT (value FOR kpi IN
  (cell_avail_pct, dl_prb_util, ul_rssi_dbm, dl_flowctrl_drops))"""

# the confirmed hourly lines, spelled out for the oracle
CTES["hrules"] = """
SELECT * FROM (VALUES
 ('dl_prb_util', false, 'down', 80.0::DOUBLE, 'DL PRB', true, false),
 ('dl_prb_util', true, 'down', 80.0, 'DL PRB', true, false),
 ('cell_avail_pct', false, 'up', 99.0, 'Availability', true, false),
 ('cell_avail_pct', true, 'up', 99.0, 'Availability', true, false),
 ('ul_rssi_dbm', false, 'down', -105.0, 'UL interference', true, false),
 ('ul_rssi_dbm', true, 'down', -100.0, 'UL interference', true, false),
 ('dl_flowctrl_drops', false, 'down', 100000.0, 'DL flow-control drops', true, true),
 ('dl_flowctrl_drops', true, 'down', 100000.0, 'DL flow-control drops', true, true)
) t(kpi, is_tdd, direction, line, label, is_main, per_site)"""

# every judged hour of every analysed object: a cell, or the site for flow control
CTES["jhours"] = """
SELECT h.*, CASE WHEN (r.direction = 'up' AND v < r.line) OR (r.direction = 'down' AND v > r.line)
  THEN 2 ELSE 0 END AS sev, r.direction, r.label
FROM (SELECT datetime, site_id, CASE WHEN kpi = 'dl_flowctrl_drops' THEN site_id ELSE object END
        AS object_id, kpi, min(duplex) AS duplex,
        CASE WHEN kpi = 'dl_flowctrl_drops' THEN sum(value) ELSE avg(value) END AS v
      FROM f3long GROUP BY datetime, site_id, 3, kpi) h
JOIN hrules r ON r.kpi = h.kpi AND r.is_tdd = (h.duplex = 'CELL_TDD')"""

CTES["objs"] = """
SELECT site_id, object_id, kpi, any_value(label) AS label, any_value(direction) AS direction,
  max(sev) AS sev, count(*) AS hours, count(CASE WHEN sev > 0 THEN 1 END) AS issue_hours,
  avg(v) AS value,
  first(v ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime) AS peak,
  first(datetime ORDER BY sev DESC, CASE WHEN direction = 'up' THEN v ELSE -v END, datetime)
    AS peak_time
FROM jhours GROUP BY site_id, object_id, kpi"""


# ------------------------------------------------------------------ cell days
def cell_days(spark: SparkSession, d: str) -> DataFrame:
    """Raw cell KPI rows from shipments: one row per line item."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice",
                                            "l_discount", "l_tax", "l_shipdate")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    j = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey)
         .join(r, F.col("n_regionkey") == r.r_regionkey))
    site = F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"))
    sector = (F.col("l_suppkey") % 3 + 1).cast("string")
    return j.select(
        F.col("l_shipdate").alias("datetime"), F.lit("LTE").alias("technology"),
        F.col("r_name").alias("region"), site.alias("site_id"),
        F.concat(site, F.lit("-S"), sector).alias("sector_id"),
        F.concat(F.lit("C"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("cell_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "L1800").otherwise("L800").alias("band"),
        (F.col("l_discount") * 20).alias("erab_drop_rate"),
        F.col("l_quantity").alias("erab_drop_denom"),
        (F.lit(100.0) - F.col("l_tax") * 30).alias("cell_avail_pct"),
        (F.col("l_extendedprice") / 1000).alias("total_traffic_gb"),
        F.col("l_quantity").alias("rrc_conn_users_max"),
        (F.col("l_quantity") * 2).alias("dl_prb_util"))


CTES["f4"] = """
SELECT l_shipdate AS datetime, 'LTE' AS technology, r_name AS region, site_id,
  site_id || '-S' || (l_suppkey % 3 + 1)::VARCHAR AS sector_id,
  'C' || lpad(l_suppkey::VARCHAR, 6, '0') AS cell_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'L1800' ELSE 'L800' END AS band,
  l_discount * 20 AS erab_drop_rate, l_quantity AS erab_drop_denom,
  100.0::DOUBLE - l_tax * 30 AS cell_avail_pct, l_extendedprice / 1000 AS total_traffic_gb,
  l_quantity AS rrc_conn_users_max, l_quantity * 2 AS dl_prb_util
FROM lineitem JOIN (SELECT *, 'N' || lpad(s_nationkey::VARCHAR, 3, '0') AS site_id FROM supplier)
  ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""


# ---------------------------------------------------------- sites and sectors
def sectors(spark: SparkSession, d: str) -> DataFrame:
    """Three-sector-per-site map: every supplier is a sector."""
    k = F.col("s_suppkey")
    site_no = F.floor(k / 3).cast("bigint")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.lpad(site_no.cast("string"), 5, "0")).alias("site_id"),
        F.concat(F.lit("S"), F.lpad(site_no.cast("string"), 5, "0"), F.lit("-S"),
                 (k % 3 + 1).cast("string")).alias("sector_id"),
        (k % 3 + 1).cast("int").alias("sector"),
        (F.lit(30.0) + (site_no * 37 % 100) * F.lit(0.0003)).alias("latitude"),
        (F.lit(47.0) + (site_no * 61 % 97) * F.lit(0.0003)).alias("longitude"),
        (k * 47 % 360).cast("double").alias("azimuth_deg"),
        (20 + site_no % 25).cast("double").alias("antenna_height_m"),
        (1 + k % 9).cast("double").alias("total_tilt_deg"),
        F.when(site_no % 10 == 0, "planned").otherwise("onair").alias("air"),
        F.when(k % 2 == 0, "L1800").otherwise("L800").alias("band"),
        (k * 31 % 504).cast("int").alias("pci"),
        (F.lit(15.0) + (k % 5) * F.lit(0.8)).alias("rs_power_dbm"),
        (5 + (k % 4) * 5).cast("double").alias("bandwidth_mhz"))


CTES["sectors"] = """
SELECT site_id, site_id || '-S' || (s_suppkey % 3 + 1)::VARCHAR AS sector_id,
  (s_suppkey % 3 + 1)::INTEGER AS sector,
  30.0::DOUBLE + (n * 37 % 100) * 0.0003::DOUBLE AS latitude,
  47.0::DOUBLE + (n * 61 % 97) * 0.0003::DOUBLE AS longitude,
  (s_suppkey * 47 % 360)::DOUBLE AS azimuth_deg, (20 + n % 25)::DOUBLE AS antenna_height_m,
  (1 + s_suppkey % 9)::DOUBLE AS total_tilt_deg,
  CASE WHEN n % 10 = 0 THEN 'planned' ELSE 'onair' END AS air,
  CASE WHEN s_suppkey % 2 = 0 THEN 'L1800' ELSE 'L800' END AS band,
  (s_suppkey * 31 % 504)::INTEGER AS pci,
  15.0::DOUBLE + (s_suppkey % 5) * 0.8::DOUBLE AS rs_power_dbm,
  (5 + (s_suppkey % 4) * 5)::DOUBLE AS bandwidth_mhz
FROM (SELECT *, s_suppkey // 3 AS n, 'S' || lpad((s_suppkey // 3)::VARCHAR, 5, '0') AS site_id
      FROM supplier)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    return sectors(spark, d).groupBy("site_id").agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"),
        F.min("air").alias("air"))


CTES["sites"] = """
SELECT site_id, min(latitude) AS latitude, min(longitude) AS longitude, min(air) AS air
FROM sectors GROUP BY site_id"""


# -------------------------------------------------------------- coverage grid
def coverage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.select(
        (F.lit(30.0) + (F.col("o_orderkey") * 13 % 60) * F.lit(0.00045)).alias("lat"),
        (F.lit(47.0) + (F.col("o_custkey") * 17 % 60) * F.lit(0.00045)).alias("lon"),
        (F.lit(-70.0) - F.col("o_totalprice") % 50).alias("rsrp"),
        (1 + F.col("o_orderkey") % 100).cast("double").alias("mr"))


CTES["grid"] = """
SELECT 30.0::DOUBLE + (o_orderkey * 13 % 60) * 0.00045::DOUBLE AS lat,
  47.0::DOUBLE + (o_custkey * 17 % 60) * 0.00045::DOUBLE AS lon,
  -70.0::DOUBLE - o_totalprice % 50 AS rsrp, (1 + o_orderkey % 100)::DOUBLE AS mr
FROM orders"""


# -------------------------------------------------------------------- tickets
def tickets(spark: SparkSession, d: str) -> DataFrame:
    """Customer tickets: who, which site, when and where."""
    k = F.col("c_custkey")
    site = F.concat(F.lit("BAS"), F.lpad((k % 7 + 1).cast("string"), 4, "0"))
    seg = F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        k.alias("ticket_id"), site.alias("site_id"),
        F.concat(site, F.lit("-S"), (k % 3 + 1).cast("string")).alias("sector_id"),
        (F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), (k * 29 % 720).cast("int"))).alias("problem_time"),
        seg.alias("group"), F.col("c_nationkey").cast("int").alias("city_no"),
        F.when(seg == "BUILDING", "Completed").when(seg == "MACHINERY", "Sleep")
        .when(seg == "FURNITURE", "Pending Customer").otherwise("Open").alias("status"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("Reopen "), (k % 3 + 1).cast("string")))
        .when(k % 4 == 0, "").otherwise("0").alias("reopen"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("hw.User"), (k % 11).cast("string"),
                                                  F.lit(".Name"))).alias("user"),
        (F.lit(30.0) + (k * 37 % 270) * F.lit(0.0001)).alias("latitude"),
        (F.lit(47.0) + (k * 61 % 271) * F.lit(0.0001)).alias("longitude"))


CTES["tickets"] = """
SELECT c_custkey AS ticket_id, site_id, site_id || '-S' || (c_custkey % 3 + 1)::VARCHAR AS sector_id,
  TIMESTAMP '2024-01-01 00:30:00' + to_hours((c_custkey * 29 % 720)::INTEGER) AS problem_time,
  c_mktsegment AS "group", c_nationkey::INTEGER AS city_no,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Completed' WHEN 'MACHINERY' THEN 'Sleep'
    WHEN 'FURNITURE' THEN 'Pending Customer' ELSE 'Open' END AS status,
  CASE WHEN c_acctbal < 0 THEN 'Reopen ' || (c_custkey % 3 + 1)::VARCHAR
    WHEN c_custkey % 4 = 0 THEN '' ELSE '0' END AS reopen,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'hw.User' || (c_custkey % 11)::VARCHAR || '.Name' END
    AS "user",
  30.0::DOUBLE + (c_custkey * 37 % 270) * 0.0001::DOUBLE AS latitude,
  47.0::DOUBLE + (c_custkey * 61 % 271) * 0.0001::DOUBLE AS longitude
FROM (SELECT *, 'BAS' || lpad((c_custkey % 7 + 1)::VARCHAR, 4, '0') AS site_id FROM customer)"""


# ------------------------------------------------------ places of hourly sites
def hourly_sites(spark: SparkSession, d: str) -> DataFrame:
    """The sites of the hourly frame with a position and place names."""
    n = F.substring("site_id", 4, 4).cast("int")
    users = table(spark, d, "events").select((F.col("user_id") % 40 % 7 + 1).cast("int").alias("n"))
    s = users.distinct().select(F.concat(F.lit("BAS"), F.lpad(F.col("n").cast("string"), 4, "0"))
                                .alias("site_id"))
    return s.select(
        "site_id", (F.lit(30.0) + n * F.lit(0.004)).alias("latitude"),
        (F.lit(47.0) + n * F.lit(0.0035)).alias("longitude"),
        F.when(n <= 3, "North").otherwise("South").alias("governorate"),
        F.when(n < 7, F.concat(F.lit("District "), (n % 3).cast("string"))).alias("sup_district"),
        F.concat(F.lit("City "), (n % 2).cast("string")).alias("city"))


CTES["hsites"] = """
SELECT site_id, 30.0::DOUBLE + n * 0.004::DOUBLE AS latitude,
  47.0::DOUBLE + n * 0.0035::DOUBLE AS longitude,
  CASE WHEN n <= 3 THEN 'North' ELSE 'South' END AS governorate,
  CASE WHEN n < 7 THEN 'District ' || (n % 3)::VARCHAR END AS sup_district,
  'City ' || (n % 2)::VARCHAR AS city
FROM (SELECT DISTINCT user_id % 40 % 7 + 1 AS n,
        'BAS' || lpad((user_id % 40 % 7 + 1)::VARCHAR, 4, '0') AS site_id FROM events)"""

CTES["sstat"] = """
SELECT site_id, max(sev) AS sev,
  first(label ORDER BY sev DESC, label, object_id) AS label,
  first(object_id ORDER BY sev DESC, label, object_id) AS object_id,
  count(CASE WHEN sev > 0 THEN 1 END) AS issues,
  coalesce(string_agg(DISTINCT CASE WHEN sev > 0 THEN label END, ', '
    ORDER BY CASE WHEN sev > 0 THEN label END), '') AS bad_kpis,
  count(DISTINCT object_id) AS cells,
  count(DISTINCT CASE WHEN sev > 0 THEN object_id END) AS cells_issue
FROM objs GROUP BY site_id"""
