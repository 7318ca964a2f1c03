"""Registered queries: sources, cleaning, file overlap, value bands, reports and composed runs."""

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from radiolake.functions import text as X
from radiolake.kpis import agg_how, load_catalogue, load_rules
from radiolake.operators import health as H
from radiolake.operators import report as RP
from radiolake.operators import rollup as R
from radiolake.plans import adapters as A
from radiolake.plans import rollups  # noqa: F401  (defines the cell roll-up the oracles name)
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import r6
from radiolake.plans.network import params
from radiolake.plans.registry import query
from radiolake.sources import archives as AR
from radiolake.sources import exports as E
from radiolake.sources import placemarks as PM
from radiolake.sources import registers as G
from radiolake.sources import sinks as K


def stamp(c, fmt="yyyy-MM-dd HH:mm"):
    return F.date_format(F.col(c).cast("timestamp"), fmt)


def raw_export(spark, d):
    """The hourly frame written back as an operator's text export."""
    h = A.hourly(spark, d)
    return h.select(
        stamp("datetime", "yyyy-MM-dd").alias("Date"), stamp("datetime", "HH:mm").alias("Time"),
        F.col("parent").alias("eNodeB Name"), F.col("duplex").alias("Cell FDD TDD Indication"),
        F.concat(F.lit(" "), "object").alias("Cell Name"), F.lit("3").alias("LocalCell Id"),
        F.concat(F.col("dl_prb_util").cast("string"), F.lit("%")).alias("HW_DL PRB Avg Utilization(%)"),
        F.format_number("dl_flowctrl_drops", 2).alias("Drops"),
        F.when(F.col("cell_avail_pct").isNull(), "#DIV/0!").otherwise(F.format_number("cell_avail_pct", 1))
        .alias("LTE_Availability(%)"), F.lit("noise").alias("Other"))


RAW_KPIS = ["HW_DL PRB Avg Utilization(%)", "Drops", "LTE_Availability(%)"]


@query("s01_p01_p03_p04_p06_hourly_export", with_ctes("""
SELECT datetime, object, site_id, sector_id, 'BAS' AS prefix, 'cell' AS level, duplex,
  round(dl_prb_util, 6) AS prb, round(dl_flowctrl_drops, 0) AS drops, round(cell_avail_pct, 1) AS avail FROM f3"""))
def _(spark, d):
    c = E.canonical_hourly(raw_export(spark, d), RAW_KPIS, "4G")
    return c.select("datetime", "object", "site_id", "sector_id", "prefix", "level", "duplex",
                    F.round(f"`{RAW_KPIS[0]}`", 6).alias("prb"), F.round("Drops", 0).alias("drops"),
                    F.round(f"`{RAW_KPIS[2]}`", 1).alias("avail"))


def export_lines(spark, d):
    """Text lines of one export per site: a banner, the header, then the data."""
    raw = raw_export(spark, d).withColumn("path", F.concat(
        F.lit("export_"), F.upper(F.regexp_extract("Cell Name", "(BAS[0-9]+)", 1)), F.lit(".csv")))
    names = [c for c in raw.columns if c != "path"]
    data = raw.select("path", F.concat_ws(",", F.concat_ws(" ", "Date", "Time"), *[
        F.regexp_replace(F.coalesce(f"`{c}`", F.lit("")), ",", "") for c in names[2:]]).alias("value"))
    files = raw.select("path").distinct()
    header = ",".join(["Time", *names[2:]])
    head = files.select("path", F.explode(F.array(F.lit("Report of the day"), F.lit(header)))
                        .alias("value"))
    return head.unionByName(data)


@query("s02_file_heads", with_ctes("""
SELECT 'export_' || site_id || '.csv' AS path, '4G' AS kind,
  'HW_DL PRB Avg Utilization(%)|Drops|LTE_Availability(%)|Other' AS kpis, min(datetime) AS first_time
FROM f3 GROUP BY site_id"""))
def _(spark, d):
    """Each export is a file of its own; only its first bytes are read."""
    folder = shared_path(spark, "exports")
    lines = export_lines(spark, d).withColumn(
        "at", F.when(F.col("value").startswith("Report"), 0).when(F.col("value").startswith("Time"), 1).otherwise(2))
    lines.repartition("path").sortWithinPartitions("path", "at", "value").select(
        F.col("path").alias("file"), "value").write.partitionBy("file").text(folder)
    p = E.profile_exports(spark, [folder]).where(F.col("path").contains("/file="))
    return p.select(F.regexp_extract("path", "file=([^/]*)", 1).alias("path"), "kind",
                    F.array_join("kpis", "|").alias("kpis"), "first_time")


@query("s02_export_profile", with_ctes("""
SELECT 'export_' || site_id || '.csv' AS path, '4G' AS kind,
  'HW_DL PRB Avg Utilization(%)|Drops|LTE_Availability(%)|Other' AS kpis, min(datetime) AS first_time
FROM f3 GROUP BY site_id"""))
def _(spark, d):
    p = E.profile_lines(export_lines(spark, d))
    return p.select("path", "kind", F.array_join("kpis", "|").alias("kpis"), "first_time")


@query("s01_p02_export_to_kpis", with_ctes("""
SELECT datetime, object, sector_id, round(dl_prb_util, 6) AS dl_prb_util,
  round(cell_avail_pct, 1) AS cell_avail_pct, NULL::DOUBLE AS ul_rssi_dbm FROM f3"""))
def _(spark, d):
    c = E.hourly_from_lines(export_lines(spark, d), ["dl_prb_util", "cell_avail_pct", "ul_rssi_dbm"])
    return c.select("datetime", "object", "sector_id", F.round("dl_prb_util", 6).alias("dl_prb_util"),
                    F.round("cell_avail_pct", 1).alias("cell_avail_pct"), "ul_rssi_dbm")


@query("p02_plausible_levels", with_ctes("""
SELECT datetime, object, CASE WHEN v BETWEEN -150 AND -60 THEN round(v, 4) END AS ul_rssi_dbm
FROM (SELECT *, CASE WHEN hour(datetime) % 6 = 0 THEN ul_rssi_dbm - 120 ELSE ul_rssi_dbm END AS v FROM f3)"""))
def _(spark, d):
    level = F.when(F.hour("datetime") % 6 == 0, F.col("ul_rssi_dbm") - 120).otherwise(
        F.col("ul_rssi_dbm"))
    raw = A.hourly(spark, d).select(
        stamp("datetime").alias("Time"), F.col("object").alias("Cell Name"),
        F.format_number(level, 6).alias("L.UL.Interference.Avg(dBm)"))
    c = E.canonical_hourly(raw, ["ul_rssi_dbm"], "4G")
    return c.select("datetime", "object", F.round("ul_rssi_dbm", 4).alias("ul_rssi_dbm"))


@query("s03_text_lines_to_rows", with_ctes("""
SELECT site_id, count(*) AS rows, round(sum(round(dl_flowctrl_drops, 2)), 2) AS drops FROM f3 GROUP BY 1"""))
def _(spark, d):
    header = ["Time", *[c for c in raw_export(spark, d).columns][2:]]
    rows = E.lines_to_rows(export_lines(spark, d), header)
    c = E.canonical_hourly(rows, ["Drops"], "4G")
    return c.groupBy("site_id").agg(F.count(F.lit(1)).alias("rows"),
                                    F.round(F.sum("Drops"), 2).alias("drops"))


HOURS = [f"{h:02d}:00" for h in range(24)]


@query("s04_wide_hours", with_ctes("""
SELECT object AS cell_id, duplex, datetime, round(max(total_traffic_gb), 6) AS traffic,
  round(max(dl_prb_util), 6) AS prb
FROM f3 WHERE total_traffic_gb IS NOT NULL OR dl_prb_util IS NOT NULL GROUP BY 1, 2, 3"""))
def _(spark, d):
    h = A.hourly(spark, d).withColumn("day", F.col("datetime").cast("date"))

    def sheet(kpi):
        g = h.withColumn("_h", F.hour("datetime")).groupBy(
            F.col("object").alias("cell_id"), "duplex", "day").agg(
            *[F.max(F.when(F.col("_h") == i, F.col(kpi))).alias(t) for i, t in enumerate(HOURS)])
        return g.select("cell_id", "duplex", "day", *[F.col(f"`{t}`").cast("string").alias(t) for t in HOURS])
    u = E.unpivot_hours({"traffic": sheet("total_traffic_gb"), "prb": sheet("dl_prb_util")})
    u = u.filter(F.col("traffic").isNotNull() | F.col("prb").isNotNull())
    return r6(u.select("cell_id", "duplex", "datetime", "traffic", "prb"), "traffic", "prb")


@query("s05_p08_p09_generic_kpi_file", with_ctes("""
SELECT cell_id, site_id, sector_id, region, date_trunc('day', l_shipdate)::TIMESTAMP AS datetime,
  round(l_quantity, 2) AS total_traffic_gb FROM (
  SELECT *, 'N' || lpad(s_nationkey::VARCHAR, 3, '0') AS site_id,
    'N' || lpad(s_nationkey::VARCHAR, 3, '0') || '-' || (l_suppkey % 9 + 1)::VARCHAR AS cell_id,
    'N' || lpad(s_nationkey::VARCHAR, 3, '0') || '-S' || (l_suppkey % 9 + 1)::VARCHAR AS sector_id,
    r_name AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE l_linenumber <> 4) WHERE region = 'ASIA'"""))
def _(spark, d):
    li = A.table(spark, d, "lineitem").join(A.table(spark, d, "supplier"),
                                            F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.join(A.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    site = F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"))
    day = F.date_format(F.col("l_shipdate").cast("timestamp"), "dd/MM/yyyy 00:00")
    raw = li.select(
        day.alias("Day"), site.alias("Site"), F.col("r_name").alias("Cluster"),
        F.when(F.col("l_linenumber") == 4, "Total of all").otherwise(
            F.concat(site, F.lit("-"), (F.col("l_suppkey") % 9 + 1).cast("string"))).alias("Cell Name"),
        F.format_number("l_quantity", 2).alias("Data Volume"))
    k = E.load_kpi(raw, {"day": "datetime", "site": "site_id", "cluster": "region",
                         "cell name": "cell_id", "data volume": "total_traffic_gb"}, region="asia")
    return k.select("cell_id", "site_id", "sector_id", "region", "datetime", "total_traffic_gb")


GRAIN_SQL = """
SELECT '{0}' AS rows_of, CASE WHEN (min(hour({1})) <> max(hour({1})) OR min(minute({1})) <> max(minute({1})))
  AND count(*) / greatest((epoch(max({1})) - epoch(min({1}))) / 86400.0, 1.0) > 1.5 THEN 'hour' ELSE 'day' END AS granularity
FROM {2}"""


@query("p10_granularity", with_ctes(GRAIN_SQL.format("hours", "datetime", "f3") + " UNION ALL "
                                    + GRAIN_SQL.format("days", "d", "(SELECT DISTINCT date_trunc('day', datetime)::TIMESTAMP AS d FROM f3)")))
def _(spark, d):
    h = A.hourly(spark, d)
    days = h.select(F.date_trunc("day", "datetime").alias("datetime")).distinct()
    return E.granularity(h).withColumn("rows_of", F.lit("hours")).unionByName(
        E.granularity(days).withColumn("rows_of", F.lit("days")))


@query("s06_p02_p07_site_database", with_ctes("""
SELECT site_id, sector, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, azimuth_deg,
  6.5::DOUBLE AS vbw_deg, 0.0::DOUBLE AS mech_tilt_deg, cell_id FROM (
  SELECT 'TA' || lpad((p_partkey // 3)::VARCHAR, 5, '0') AS site_id, (p_partkey % 3 + 1)::INTEGER AS sector,
    30.0::DOUBLE + (p_partkey // 3 % 300) * 0.01 AS latitude, 47.0::DOUBLE + (p_partkey // 3 % 200) * 0.01 AS longitude,
    (p_partkey % 3 * 120)::DOUBLE AS azimuth_deg,
    'TA' || lpad((p_partkey // 3)::VARCHAR, 5, '0') || '-S' || (p_partkey % 3 + 1)::VARCHAR AS cell_id FROM part)"""))
def _(spark, d):
    k = F.col("p_partkey")
    n = F.floor(k / 3)
    la, lo = F.lit(30.0) + (n % 300) * F.lit(0.01), F.lit(47.0) + (n % 200) * F.lit(0.01)
    swap = k % 4 == 0
    raw = A.table(spark, d, "part").select(
        F.concat(F.lit("Town_TA"), F.lpad(n.cast("string"), 5, "0")).alias("Site Name"),
        (k % 3 + 1).cast("string").alias("Sector"),
        F.when(swap, lo).otherwise(la).cast("string").alias("Lat"),
        F.when(swap, la).otherwise(lo).cast("string").alias("Long"),
        F.concat((k % 3 * 120).cast("string"), F.lit(" deg")).alias("Azimuth"),
        F.lit("on air").alias("Status"))
    s = G.load_site_db(raw)
    return r6(s.select("site_id", "sector", "latitude", "longitude", "azimuth_deg", "vbw_deg",
                       "mech_tilt_deg", "cell_id"), "latitude", "longitude")


A.CTES["bandcells"] = """
SELECT ['X_', 'L18_', 'U2100-', 'L26_', 'L1800 ', 'L40_', 'L23_', 'L8_', 'U09_', 'G_', 'LX_', 'L21_'][p_partkey % 12 + 1]
    || p_partkey::VARCHAR AS cell_name, ['2G', '3G', '4G'][p_partkey // 12 % 3 + 1] AS tech,
  [300, 1300, 2500, 2800, 3500, 3689, 3750, 6200, 38700, 39000, NULL, 700][p_partkey // 36 % 12 + 1]::INTEGER AS earfcn,
  ['GSM900', 'DCS', '', NULL][p_partkey // 5 % 4 + 1] AS raw, CASE WHEN p_partkey % 7 = 0 THEN 3088 END AS freq FROM part"""


def band_cells(spark, d):
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]),
                                          (i % len(values) + 1).cast("int"))
    name = pick(["X_", "L18_", "U2100-", "L26_", "L1800 ", "L40_", "L23_", "L8_", "U09_", "G_", "LX_",
                 "L21_"], k)
    ch = pick([300, 1300, 2500, 2800, 3500, 3689, 3750, 6200, 38700, 39000, None, 700], F.floor(k / 36))
    return A.table(spark, d, "part").select(
        F.concat(name, k.cast("string")).alias("cell_name"),
        pick(["2G", "3G", "4G"], F.floor(k / 12)).alias("tech"), ch.cast("int").alias("earfcn"),
        pick(["GSM900", "DCS", "", None], F.floor(k / 5)).alias("raw"),
        F.when(k % 7 == 0, 3088).alias("freq"))


@query("p05_channel_band", with_ctes("""
SELECT cell_name, earfcn, coalesce(upper(nullif(regexp_extract(cell_name, '(?i)\\b(L(?:08|8|18|19|21|23|26)00?|L[0-9]{3,4}|U(?:09|21)00)\\b', 1), '')),
  CASE WHEN earfcn BETWEEN 0 AND 599 THEN 'L2100' WHEN earfcn BETWEEN 1200 AND 1949 THEN 'L1800'
    WHEN earfcn BETWEEN 2750 AND 3449 THEN 'L2600' WHEN earfcn BETWEEN 6150 AND 6449 THEN 'L800'
    WHEN earfcn BETWEEN 2400 AND 2649 THEN 'L2300' WHEN earfcn BETWEEN 3450 AND 3799 THEN 'L2500' ELSE 'UNKNOWN' END) AS band
FROM bandcells"""))
def _(spark, d):
    return band_cells(spark, d).select("cell_name", "earfcn",
                                       X.channel_band("cell_name", "earfcn").alias("band"))


@query("p05_map_band", with_ctes("""
SELECT cell_name, tech, earfcn, raw, freq, CASE tech WHEN '2G' THEN CASE WHEN raw = 'GSM900' THEN 'G900' WHEN raw = 'DCS' THEN 'G1800'
    ELSE 'GSM' END WHEN '3G' THEN CASE WHEN cell_name LIKE 'U09%' OR freq = 3088 THEN 'U900' ELSE 'U2100' END
  ELSE CASE WHEN cell_name LIKE 'L21%' OR earfcn = 300 THEN 'L2100'
    WHEN cell_name LIKE 'L26%' OR cell_name LIKE 'L40%' OR earfcn >= 39000 THEN 'L2600(TDD)'
    WHEN cell_name LIKE 'L8%' OR earfcn IN (3689, 3750) THEN 'L900'
    WHEN cell_name LIKE 'L23%' OR earfcn BETWEEN 38650 AND 38999 THEN 'L2300(TDD)' ELSE 'L1800' END END AS band
FROM bandcells"""))
def _(spark, d):
    c = band_cells(spark, d)
    return c.withColumn("band", X.map_band("cell_name", "tech", "earfcn", "raw", "freq"))


@query("p04_sector_letters", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 2 END::INTEGER AS sector FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "s3").when(k % 4 == 1, " 12 ").when(k % 4 == 2, "Sector B").otherwise("Z9x")
    return A.table(spark, d, "part").select("p_partkey", X.sector_letter_no(text).alias("sector"))


@query("p03_p04_name_parts", """
SELECT doc_id, nullif(upper(regexp_extract(text, '([A-Za-z]{2,4}[0-9]{3,6})', 1)), '') AS first_code,
  trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def _(spark, d):
    t = A.table(spark, d, "documents")
    return t.select("doc_id", X.site_code("text").alias("first_code"), X.norm_name("source").alias("norm"))


@query("p17_agg_kind", """
SELECT k AS kpi, CASE WHEN k LIKE '%rate%' OR k LIKE '%avg%' OR k LIKE '%mean%' THEN 'mean' WHEN k LIKE '%traffic%' OR
  k LIKE '%num%' OR k LIKE '%drop%' THEN 'sum' ELSE 'mean' END AS how, count(*) AS n
FROM (SELECT lower(p_brand) || '_' || ['drop', 'rate_drop', 'traffic', 'level', 'num_mean'][p_partkey % 5 + 1] AS k FROM part)
GROUP BY 1, 2""")
def _(spark, d):
    k = F.element_at(F.array(*[F.lit(x) for x in ("drop", "rate_drop", "traffic", "level", "num_mean")]),
                     (F.col("p_partkey") % 5 + 1).cast("int"))
    p = A.table(spark, d, "part").select(F.concat(F.lower("p_brand"), F.lit("_"), k).alias("kpi"))
    return p.groupBy("kpi", agg_how("kpi").alias("how")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_f17_site_names", """
SELECT p_partkey, h AS mast_height, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE '' END AS unit
FROM (SELECT *, (20 + p_partkey % 30)::DOUBLE AS h FROM part)""")
def _(spark, d):
    k = F.col("p_partkey")
    raw = F.concat("p_name", F.lit("_ABC"), F.lpad((k % 1000).cast("string"), 4, "0"), F.lit("_"),
                   (20 + k % 30).cast("string"), F.lit("m"))
    p = A.table(spark, d, "part").select("p_partkey", raw.alias("site_name"),
                                         F.when(k % 2 == 0, "Height (m)").otherwise("Height").alias("head"))
    return p.select("p_partkey", X.mast_height("site_name").alias("mast_height"),
                    X.clean_site_name("site_name").alias("name"), X.unit_of("head").alias("unit"))


def map_lines(spark, d):
    """Every supplier's sector as a placemark of a map document: sections, values that go on in the
    next line, RET readings."""
    k = F.col("s_suppkey")
    num = lambda c: c.cast("string")
    text = F.concat(
        F.lit("Town"), num(k % 5), F.lit("<br/>Site Code: ta"), F.lpad(num(F.floor(k / 3)), 4, "0"),
        F.lit(" Sector: "), num(k % 3 + 1), F.lit(" Azimuth: "), num(k * 47 % 360),
        F.lit("&deg;<br/>Height: 30 m Status: "), F.when(k % 3 == 0, "under TEST").otherwise("activated"),
        F.lit("<br/>2G cells<br/>G09_"), num(k),
        F.lit(": Azimuth=10, Band=GSM900, Electrical Downtilt="), num((k % 5 + 3) * 10),
        F.lit("<br/>4G cells<br/>L18_"), num(k), F.lit(": PCI=7, EARFCN=1300<br/>RS Power=182, Max RET="),
        num(k % 9 * 10), F.when(k % 2 == 0, F.concat(
            F.lit("<br/>RET actual tilt<br/>Band U900: "), num(k % 7 * 10), F.lit("<br/>Band U900: 30<br/>Band L18: 50")))
        .otherwise(""))
    body = F.concat(
        F.lit("<Placemark id='p'><styleUrl>#"), F.when(k % 4 == 0, "tower").otherwise("onair"),
        F.lit("</styleUrl><description><![CDATA["), text, F.lit("]]></description><Point><coordinates>"),
        num(F.lit(47.0) + k * F.lit(0.001)), F.lit(","), num(F.lit(30.0) + k * F.lit(0.001)),
        F.lit(",0</coordinates></Point></Placemark>"))
    return A.table(spark, d, "supplier").select(
        F.concat(F.lit("region"), num(k % 3)).alias("archive"), k.alias("at"), body.alias("value"))


def map_archives(spark, d):
    """The placemarks of archives with two documents each, and a picture that nobody reads."""
    docs = map_lines(spark, d).withColumn("entry", F.when(F.col("at") % 2 == 0, "doc.kml").otherwise("more/b.KML"))
    other = docs.select("archive").distinct().select(
        "archive", F.lit("legend.png").alias("entry"), F.lit(0).cast("long").alias("at"), F.lit("PNG").alias("value"))
    folder = shared_path(spark, "maps")
    AR.write_archives(docs.unionByName(other), folder, ".kmz").count()
    return folder


MAP_SQL = """
WITH m AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 <> 0)
"""


@query("s08_map_sectors", MAP_SQL + """
SELECT 'TA' || lpad((k // 3)::VARCHAR, 4, '0') || '-S' || (k % 3 + 1)::VARCHAR AS sector_id, 'Town' || (k % 5)::VARCHAR AS site_name,
  round(30.0::DOUBLE + k * 0.001, 6) AS latitude, (k * 47 % 360)::DOUBLE AS azimuth_deg, 30.0::DOUBLE AS antenna_height_m,
  CASE WHEN k % 3 = 0 THEN 'Under Test' ELSE 'Activated' END AS status, 'onair' AS air,
  round((CASE WHEN (k % 5 + 3) * 10 > 20 THEN k % 5 + 3 ELSE (k % 5 + 3) * 10 END + k % 9)::DOUBLE / 2, 6) AS elec_tilt_deg,
  1 AS n_2g, 0 AS n_3g, 1 AS n_4g, 2 AS n_cells, CASE WHEN k % 2 = 0 THEN round((k % 7 * 10 + 30) / 20::DOUBLE, 6) END AS ret_u900_deg,
  CASE WHEN k % 2 = 0 THEN round(((k % 7 * 10 + 30) / 20::DOUBLE + 5) / 2, 6) END AS ret_actual_deg
FROM m""")
def _(spark, d):
    rows = PM.sector_rows(PM.map_placemarks(spark, [map_archives(spark, d)]))
    s = PM.sectors_of(rows)
    return r6(s.select("sector_id", "site_name", "latitude", "azimuth_deg", "antenna_height_m", "status", "air",
                       "elec_tilt_deg", "n_2g", "n_3g", "n_4g", "n_cells", "ret_u900_deg", "ret_actual_deg"),
              "latitude", "elec_tilt_deg", "ret_u900_deg", "ret_actual_deg")


@query("s08_placemark_cells", MAP_SQL + """
SELECT 'TA' || lpad((k // 3)::VARCHAR, 4, '0') || '-S' || (k % 3 + 1)::VARCHAR AS sector_id, t AS technology,
  CASE t WHEN '4G' THEN 'L18_' ELSE 'G09_' END || k::VARCHAR AS cell_name,
  CASE t WHEN '4G' THEN 'L1800' ELSE 'G900' END AS band_label,
  CASE t WHEN '4G' THEN (k % 9)::DOUBLE ELSE (k % 5)::DOUBLE + 3 END AS elec_tilt_deg,
  CASE t WHEN '4G' THEN 18.2 END AS rs_power_dbm, CASE t WHEN '4G' THEN 7.0 END AS pci,
  CASE t WHEN '4G' THEN (k * 47 % 360)::DOUBLE ELSE 10.0 END AS azimuth_deg,
  round(30.0::DOUBLE + k * 0.001, 6) AS latitude
FROM m, (VALUES ('2G'), ('4G')) v(t)""")
def _(spark, d):
    docs = map_lines(spark, d).groupBy(F.col("archive").alias("path")).agg(
        F.array_join(F.collect_list("value"), "\n").alias("kml"))
    cells, _sectors = PM.parse_placemarks(PM.placemark_bodies(docs))
    return r6(cells.select("sector_id", "technology", "cell_name", "band_label", "elec_tilt_deg", "rs_power_dbm",
                           "pci", "azimuth_deg", "latitude"), "latitude", "elec_tilt_deg")


@query("s08_archive_entries", """
SELECT 'region' || (s_suppkey % 3)::VARCHAR AS archive, CASE WHEN s_suppkey % 2 = 0 THEN 'doc.kml' ELSE 'more/b.KML' END AS entry,
  'kml' AS kind, NULL AS reason FROM supplier GROUP BY ALL
UNION ALL SELECT DISTINCT 'region' || (s_suppkey % 3)::VARCHAR, 'legend.png', NULL, 'no text, CSV or KML file' FROM supplier""")
def _(spark, d):
    e = AR.zip_entries(spark, [map_archives(spark, d)])
    return e.select(F.regexp_extract("path", "(region[0-9])", 1).alias("archive"), "entry", "kind", "reason")


@query("s03_zipped_exports", with_ctes("""
SELECT datetime, object, sector_id, round(dl_prb_util, 6) AS dl_prb_util, round(cell_avail_pct, 1) AS cell_avail_pct FROM f3"""))
def _(spark, d):
    lines = export_lines(spark, d).withColumn("archive", F.substring("path", 8, 5))
    # the banner, then the header, then the hours
    at = F.when(F.col("value").startswith("Report"), 0).when(F.col("value").startswith("Time"), 1).otherwise(2)
    folder = shared_path(spark, "zipped")
    paths = AR.write_archives(lines.select("archive", F.col("path").alias("entry"), at.alias("at"), "value"), folder)
    names = [r["path"] for r in paths.collect()]  # of archives, not of rows
    c = E.read_hourly(spark, names, ["dl_prb_util", "cell_avail_pct"])
    return c.select("datetime", "object", "sector_id", F.round("dl_prb_util", 6).alias("dl_prb_util"),
                    F.round("cell_avail_pct", 1).alias("cell_avail_pct"))


@query("s08_page_links", """
SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def _(spark, d):
    p = A.table(spark, d, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
                    .cast("bigint").alias("links"),
                    F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("s09_coverage_source", with_ctes("""
SELECT count(*) AS rows, round(sum(rsrp), 2) AS rsrp, sum(CASE WHEN n % 11 = 0 THEN 1 ELSE mr END) AS mr
FROM (SELECT -70.0::DOUBLE - o_totalprice % 50 AS rsrp, (1 + o_orderkey % 100)::DOUBLE AS mr, o_orderkey AS n FROM orders
  WHERE o_orderkey % 17 <> 0)"""))
def _(spark, d):
    k = F.col("o_orderkey")
    o = A.table(spark, d, "orders").select(
        F.when(k % 17 == 0, "n/a").otherwise((F.lit(30.0) + (k * 13 % 60) * F.lit(0.00045)).cast("string"))
        .alias("Latitude"),
        (F.lit(47.0) + (F.col("o_custkey") * 17 % 60) * F.lit(0.00045)).cast("string").alias("Longitude"),
        (F.lit(-70.0) - F.col("o_totalprice") % 50).cast("string").alias("RSRP(All MRs) (dBm)"),
        F.when(k % 11 == 0, "0").otherwise((1 + k % 100).cast("string")).alias("MR Count"))
    c = G.load_coverage(o)
    return c.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("rsrp"), 2).alias("rsrp"),
                 F.sum("mr").alias("mr"))


def text_tickets(spark, d):
    k = F.col("ticket_id")
    t = A.tickets(spark, d)
    return t.select(
        (k % 1200).cast("string").alias("Ticket ID"),
        F.concat(stamp("problem_time", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")).alias("Problem Time"),
        stamp("problem_time", "yyyy-MM-dd HH:mm:ss").alias("Created At"),
        F.concat("site_id", F.lit("-"), (k % 3 + 1).cast("string")).alias("Sector Serving"),
        F.when(k % 3 == 0, "0").when(k % 3 == 1, F.col("longitude")).otherwise(F.col("latitude"))
        .cast("string").alias("Latitude"),
        F.when(k % 3 == 1, F.col("latitude")).otherwise(F.col("longitude")).cast("string").alias("Longitude"),
        F.when(k % 5 == 0, "Closed").otherwise("Open").alias("Status"),
        F.when(k % 2 == 0, "RF").otherwise("Core").alias("Group"),
        F.col("user").alias("User"), F.lit("Maysan / Emarah").alias("City"),
        k.cast("string").alias("HPSM Incident ID"), F.col("site_id").alias("Site ID(SD Check_Site_ID)"),
        F.lit("data").alias("Affected Services"))


@query("s10_complaint_source", with_ctes("""
SELECT ticket_id, site_id, sector, round(latitude, 6) AS latitude, coord_source, create_time FROM (
  SELECT (ticket_id % 1200)::VARCHAR AS ticket_id, site_id, (ticket_id % 3 + 1)::INTEGER AS sector,
    CASE WHEN ticket_id % 3 <> 0 THEN latitude END AS latitude,
    CASE WHEN ticket_id % 3 <> 0 THEN 'ticket' ELSE '' END AS coord_source, problem_time AS create_time
  FROM tickets WHERE ticket_id % 2 = 0 AND ticket_id % 5 <> 0)
QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY create_time DESC, site_id) = 1"""))
def _(spark, d):
    c = G.load_complaints(text_tickets(spark, d), rf_only=True, open_only=True)
    return r6(c.select("ticket_id", "site_id", "sector", "latitude", "coord_source", "create_time"), "latitude")


@query("s11_history_source", with_ctes("""
SELECT ticket_id::VARCHAR AS hpsm_id, site_id, 'Amarah' AS city, CASE WHEN "user" = '' THEN '' ELSE
  replace(substr("user", 4), '.', ' ') END AS "user", CASE WHEN ticket_id % 5 = 0 THEN 'Closed' ELSE 'In Progress' END AS state,
  problem_time FROM tickets"""))
def _(spark, d):
    return G.load_history(text_tickets(spark, d)).select("hpsm_id", "site_id", "city", "user", "state",
                                                         "problem_time")


@query("s12_target_source", with_ctes("""
SELECT count(*) AS tickets, 1.0::DOUBLE AS timed, true AS usable FROM tickets"""))
def _(spark, d):
    return G.check_target(G.load_target(text_tickets(spark, d)))


@query("s12_target_rows", with_ctes("""
SELECT (ticket_id % 1200)::VARCHAR AS ticket_id, ticket_id::VARCHAR AS hpsm_id, site_id, 'Maysan / Emarah' AS city,
  'data' AS affected_service, "user", problem_time, problem_time AS create_time FROM tickets"""))
def _(spark, d):
    t = G.load_target(text_tickets(spark, d))
    return t.select("ticket_id", "hpsm_id", "site_id", "city", "affected_service", "user", "problem_time",
                    "create_time")


@query("s13_dimensions", with_ctes("""
SELECT kpi, direction, warning, critical, judged, measured FROM (VALUES
  ('dl_prb_util', 'down', 75.0::DOUBLE, 90.0::DOUBLE, true), ('cell_avail_pct', 'up', 99.0, 99.0, true),
  ('ul_rssi_dbm', 'down', -105.0, -105.0, true)) r(kpi, direction, warning, critical, judged)
JOIN (SELECT kpi, count(*) AS measured FROM f3long GROUP BY 1) USING (kpi)"""))
def _(spark, d):
    rules = load_rules(spark, ["LTE"], {"dl_prb_util": {"warning": 75.0, "critical": 90.0}})
    cat = load_catalogue(spark).filter(F.col("technology") == "LTE").select("kpi", "label")
    long = H.to_long(A.hourly(spark, d), A.HOURLY_KPIS).groupBy("kpi").agg(F.count(F.lit(1)).alias("measured"))
    j = long.join(F.broadcast(rules), "kpi").join(F.broadcast(cat), "kpi")
    return j.select("kpi", "direction", "warning", "critical", "judged", "measured")


@query("s14_describe_input", with_ctes("""
SELECT count(*) AS rows, count(DISTINCT object) AS objects, count(DISTINCT site_id) AS sites,
  min(datetime) AS first_time, max(datetime) AS last_time, 0::BIGINT AS no_time, 0::BIGINT AS no_site FROM f3"""))
def _(spark, d):
    return E.describe_input(A.hourly(spark, d))


def shared_path(spark, name):
    """A new path in the folder that the cluster names for such files.

    Only a session of one machine may do without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="radiolake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s15_parsed_sink", with_ctes("""
SELECT object, datetime, datetime::DATE::VARCHAR AS date, round(dl_prb_util, 6) AS dl_prb_util FROM f3"""))
def _(spark, d):
    kept = K.keep_parsed(A.hourly(spark, d), shared_path(spark, "hourly"))
    return r6(kept.select("object", "datetime", F.col("date").cast("string"), "dl_prb_util"), "dl_prb_util")


@query("s16_geojson_lines", with_ctes("""
SELECT sector_id, 'Feature' AS kind, 15 AS points FROM sectors"""))
def _(spark, d):
    from radiolake.functions.geo import wedge_ring
    s = A.sectors(spark, d).select("sector_id", wedge_ring("latitude", "longitude", "azimuth_deg", 60.0,
                                                           500.0).alias("ring"))
    j = K.geojson_lines(s)
    pts = F.size(F.from_json(F.get_json_object("value", "$.geometry.coordinates[0]"), "array<array<double>>"))
    return j.select(F.get_json_object("value", "$.properties.sector_id").alias("sector_id"),
                    F.get_json_object("value", "$.type").alias("kind"), pts.alias("points"))


# ---------------------------------------------------------------- file overlap
def files(spark, d):
    """Every site's rows as three exports: an old one, its newer copy, and an unlike one."""
    h = A.hourly(spark, d).select("site_id", "object", "datetime", "tech")
    day = F.col("datetime").cast("date")
    old = h.filter(day <= F.lit("2024-01-20").cast("date")).withColumn("part", F.lit("old"))
    new = h.filter(day >= F.lit("2024-01-05").cast("date")).withColumn("part", F.lit("new"))
    other = h.filter(day >= F.lit("2024-01-19").cast("date")).withColumn("part", F.lit("tail"))
    u = old.unionByName(new).unionByName(other)
    return u.withColumn("file", F.concat_ws("_", "site_id", "part"))


@query("a34_newer_copies", with_ctes("""
SELECT o.site_id || o.part AS old, n.site_id || '_new' AS new, count(n.object) * 1.0::DOUBLE / any_value(o.n) AS cover
FROM (SELECT *, count(*) OVER (PARTITION BY site_id, part) AS n FROM fileobjects WHERE part <> '_new') o
LEFT JOIN fileobjects n ON n.site_id = o.site_id AND n.object = o.object AND n.part = '_new'
GROUP BY o.site_id, o.part, n.site_id HAVING cover >= 0.9""", fileobjects="""
SELECT DISTINCT site_id, object, part FROM f3, (VALUES ('_old', DATE '2024-01-01', DATE '2024-01-20'),
  ('_new', DATE '2024-01-05', DATE '2024-02-28'), ('_tail', DATE '2024-01-19', DATE '2024-02-28')) p(part, a, b)
WHERE datetime::DATE BETWEEN a AND b"""))
def _(spark, d):
    f = files(spark, d)
    kpis = f.select("file", F.explode(F.when(F.col("part") == "new", F.array(F.lit("a"), F.lit("b")))
                                      .otherwise(F.array(F.lit("a")))).alias("kpi")).distinct()
    return RP.newer_copies(f, kpis).select("old", "new", "cover")


# ------------------------------------------------------------------ value bands
@query("f19_value_bands", with_ctes("""
SELECT object, round(v, 6) AS v, CASE WHEN v > 50 THEN 'critical' ELSE CASE WHEN len(cuts) = 0 THEN 'ok' ELSE
  'ok' || len(list_filter(cuts, lambda c: c <= v))::VARCHAR END END AS band
FROM (SELECT object, avg(dl_prb_util) AS v FROM f3 GROUP BY 1), (SELECT list_filter(list_distinct([
    round_even(q1 / step, 0) * step, round_even(q2 / step, 0) * step]), lambda c: c > a AND c < 50) AS cuts FROM (
  SELECT *, pow(10.0, floor(log10((50 - a) / 10))) AS step FROM (SELECT min(v) AS a, quantile_cont(v, 1 / 3.0) AS q1,
    quantile_cont(v, 2 / 3.0) AS q2 FROM (SELECT avg(dl_prb_util) AS v FROM f3 GROUP BY object) WHERE v <= 50)))"""))
def _(spark, d):
    v = A.hourly(spark, d).groupBy("object").agg(F.avg("dl_prb_util").alias("v"))
    return r6(RP.value_bands(v, "v", "down", 50.0, 50.0), "v")


@query("f19_magnitude_counts", with_ctes("""
SELECT band, count(*) AS n, round(100.0 * count(*) / (SELECT count(DISTINCT object) FROM f3), 6)::DOUBLE AS pct FROM (
  SELECT 'b' || len(list_filter(cuts, lambda c: c <= v))::VARCHAR AS band
  FROM (SELECT sum(total_traffic_gb) AS v FROM f3 GROUP BY object), (SELECT list_slice(list_filter(ticks, lambda t, i:
      (i - 1) % greatest(1, round_even(len(ticks) / 5.0, 0)::INTEGER) = 0), 1, 5) AS cuts FROM (
    SELECT list_filter(flatten(list_transform(range(14), lambda e: list_transform([1.0, 2.0, 5.0], lambda s:
      s * pow(10.0, floor(log10(hi)) - 2 + e)))), lambda t: t > lo AND t < hi) AS ticks FROM (
      SELECT min(v) AS lo, max(v) AS hi FROM (SELECT sum(total_traffic_gb) AS v FROM f3 GROUP BY object))))) GROUP BY 1"""))
def _(spark, d):
    v = A.hourly(spark, d).groupBy("object").agg(F.sum("total_traffic_gb").alias("v"))
    return r6(RP.band_counts(RP.magnitude_bands(v, "v")), "pct")


# -------------------------------------------------------------------- reports
def report(spark, d):
    long = H.to_long(A.hourly(spark, d), ["total_traffic_gb"])
    return RP.kpi_report(long, "total_traffic_gb", False, 400.0, 200.0, A.hourly_sites(spark, d),
                         governorate="South")


A.CTES["rcells"] = """
SELECT f.site_id, object, sup_district, avg(total_traffic_gb) AS value, max(total_traffic_gb) AS worst,
  max(total_traffic_gb > 400) AS beyond, max(spike) AS spike FROM (
  SELECT *, n >= 6 AND total_traffic_gb - normal > 0 AND total_traffic_gb - normal > 6 * greatest(1.4826 * mad,
      0.01 * abs(normal)) AND total_traffic_gb >= 200 AS spike FROM (
    SELECT *, quantile_cont(abs(total_traffic_gb - normal), 0.5) OVER (PARTITION BY object) AS mad FROM (
      SELECT site_id, object, total_traffic_gb, count(*) OVER (PARTITION BY object) AS n,
        quantile_cont(total_traffic_gb, 0.5) OVER (PARTITION BY object) AS normal FROM f3))) f
JOIN hsites h ON h.site_id = f.site_id AND governorate = 'South' GROUP BY 1, 2, 3"""


@query("a35_report_cells", with_ctes("""
SELECT site_id, object, round(value, 6) AS value, round(worst, 6) AS worst, beyond, spike, beyond OR spike AS affected
FROM rcells"""))
def _(spark, d):
    return r6(report(spark, d)["cells"].select("site_id", "object", "value", "worst", "beyond", "spike",
                                               "affected"), "value", "worst")


@query("a35_report_totals", with_ctes("""
SELECT count(DISTINCT site_id) AS sites, count(DISTINCT CASE WHEN beyond OR spike THEN site_id END) AS affected_sites,
  count(*) AS cells, count(CASE WHEN beyond OR spike THEN 1 END) AS affected_cells, count(CASE WHEN spike THEN 1 END)
  AS spike_cells FROM rcells"""))
def _(spark, d):
    return report(spark, d)["totals"]


@query("a35_report_by_area", with_ctes("""
SELECT sup_district, count(*) AS affected FROM rcells WHERE (beyond OR spike) AND sup_district IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return report(spark, d)["by_area"]


@query("a35_report_top_sites", with_ctes("""
SELECT row_number() OVER (ORDER BY worst DESC, value DESC, site_id) AS rank, site_id, object, round(worst, 6) AS worst,
  round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY worst DESC, value DESC, object)
    AS rn FROM rcells WHERE beyond OR spike) WHERE rn = 1"""))
def _(spark, d):
    t = report(spark, d)["top_sites"]
    return r6(t.select(F.col("rank").cast("bigint").alias("rank"), "site_id", "object", "worst", "value"),
              "worst", "value")


@query("a35_report_trend", with_ctes("""
SELECT datetime, round(avg(total_traffic_gb), 6) AS value FROM f3 JOIN hsites h USING (site_id)
WHERE governorate = 'South' GROUP BY 1"""))
def _(spark, d):
    return r6(report(spark, d)["trend"], "value")


@query("a35_report_site_hours", with_ctes("""
SELECT site_id, datetime, round(sum(total_traffic_gb), 6) AS value FROM f3 JOIN hsites h USING (site_id)
WHERE governorate = 'South' GROUP BY 1, 2"""))
def _(spark, d):
    return r6(report(spark, d)["site_hour"], "value")


def wide_cells(spark, d):
    h = A.hourly(spark, d)
    return h.withColumnRenamed("object", "cell_id").withColumn("technology", F.lit("LTE"))


A.CTES["pc4"] = """
SELECT object AS cell_id, site_id, avg(dl_prb_util) AS prb, avg(cell_avail_pct) AS avail, avg(ul_rssi_dbm) AS rssi,
  sum(total_traffic_gb) AS gb, quantile_cont(dl_prb_util, 0.95) AS p95 FROM f3 GROUP BY 1, 2"""
A.CTES["pcf"] = """
SELECT cell_id, 'high_utilization' AS problem_class, CASE WHEN prb > 80 THEN 2 ELSE 0 END AS sev, gb FROM pc4 WHERE prb > 80
UNION ALL SELECT cell_id, 'availability', 2, gb FROM pc4 WHERE avail < 99
UNION ALL SELECT cell_id, 'interference', 2, gb FROM pc4 WHERE rssi > -105"""


@query("n10_findings_table", with_ctes("""
SELECT cell_id, problem_class, sev, CASE WHEN sev = 2 THEN CASE WHEN total_traffic_gb >= busy THEN 'P1' ELSE 'P2' END
    WHEN total_traffic_gb >= busy THEN 'P3' ELSE 'P4' END AS priority FROM (
  SELECT cell_id, total_traffic_gb, 'retainability' AS problem_class, CASE WHEN erab_drop_rate > 2 THEN 2 ELSE 1 END AS sev
    FROM e1 WHERE erab_drop_rate > 0.8
  UNION ALL SELECT cell_id, total_traffic_gb, 'availability', 2 FROM e1 WHERE cell_avail_pct < 99
  UNION ALL SELECT cell_id, total_traffic_gb, 'high_utilization', 2 FROM e1 WHERE dl_prb_util > 80),
  (SELECT quantile_cont(total_traffic_gb, 0.5) AS busy FROM e1)""", e1="""
SELECT cell_id, site_id, erab_drop_rate, cell_avail_pct, dl_prb_util, total_traffic_gb FROM cellall"""))
def _(spark, d):
    from radiolake.operators.diagnose import diagnose
    cells = R.aggregate(A.cell_days(spark, d), "cell", "all")
    t = RP.findings_table(diagnose(cells), cells)
    return t.select("cell_id", "problem_class", "sev", "priority")


@query("n12_daily_report", with_ctes("""
SELECT cell_id, problem_class, priority FROM (
  SELECT cell_id, problem_class, CASE WHEN gb >= (SELECT quantile_cont(gb, 0.5) FROM pc4) THEN 'P1' ELSE 'P2' END AS priority
  FROM pcf UNION SELECT cell_id, 'high_utilization', CASE WHEN gb >= (SELECT quantile_cont(gb, 0.5) FROM pc4) THEN 'P1'
    ELSE 'P2' END FROM pc4 WHERE p95 > 80 AND prb < p95 AND gb >= 0.05)"""))
def _(spark, d):
    return RP.analyse_cells(wide_cells(spark, d))["findings"].select("cell_id", "problem_class",
                                                                    "priority")


A.CTES["e1"] = """
SELECT cell_id, site_id, erab_drop_rate, cell_avail_pct, dl_prb_util, total_traffic_gb FROM cellall"""


@query("e01_full_analysis", with_ctes("""
SELECT 'per_cell' AS result, count(*) AS n FROM e1
UNION ALL SELECT 'breaches', count(*) FROM cellbreach
UNION ALL SELECT 'diagnoses', (count(CASE WHEN erab_drop_rate > 0.8 THEN 1 END) + count(CASE WHEN cell_avail_pct < 99 THEN 1 END)
  + count(CASE WHEN dl_prb_util > 80 THEN 1 END))::BIGINT FROM e1
UNION ALL SELECT 'actions', (count(CASE WHEN erab_drop_rate > 0.8 THEN 1 END) + count(CASE WHEN cell_avail_pct < 99 THEN 1 END)
  + count(CASE WHEN dl_prb_util > 80 THEN 1 END))::BIGINT FROM e1
UNION ALL SELECT 'imbalance', count(*) FROM (SELECT sector_id FROM cellall GROUP BY 1 HAVING count(*) >= 2 AND
  max(dl_prb_util) - min(dl_prb_util) >= 25 AND max(dl_prb_util) >= 55)"""))
def _(spark, d):
    cells = A.cell_days(spark, d)
    n = F.regexp_extract("site_id", r"(\d+)", 1).cast("int")
    sites = A.table(spark, d, "nation").select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("site_id")).select(
        "site_id", (F.lit(30.0) + n * F.lit(0.01)).alias("latitude"),
        (F.lit(47.0) + (n * 7 % 25) * F.lit(0.01)).alias("longitude"))
    return RP.full_analysis(cells, sites)["counts"]


@query("s07_params_summary", with_ctes("""
SELECT region, count(DISTINCT site_id) AS sites, count(*) AS cells FROM params GROUP BY 1"""))
def _(spark, d):
    p = params(spark, d).groupBy("region", "site_id").agg(F.count(F.lit(1)).alias("c"))
    return p.groupBy("region").agg(F.count(F.lit(1)).alias("sites"), F.sum("c").alias("cells"))


@query("a01_hourly_site", with_ctes("""
SELECT site_id, datetime, round(avg(dl_prb_util), 6) AS dl_prb_util, round(sum(total_traffic_gb), 6) AS total_traffic_gb,
  count(*) AS n_rows FROM f3 GROUP BY 1, 2"""))
def _(spark, d):
    a = R.aggregate(wide_cells(spark, d).select("site_id", "datetime", "dl_prb_util", "total_traffic_gb"),
                    "site", "hour")
    return r6(a, "dl_prb_util", "total_traffic_gb")
