"""Registered queries: headers resolved by an alias table, files of unlike headers read through it."""

from pyspark.sql import functions as F

from radiolake.plans import adapters as A
from radiolake.plans.health import r6
from radiolake.plans.registry import query
from radiolake.sources import headers as HD

KPIS = ["dl_prb_util", "total_traffic_gb", "erlang"]
OWN = [("LTE", "dl_prb_util", "DL PRB Utilization Rate", 1), ("LTE", "dl_prb_util", "PRB Utilization DL", 1),
       ("*", "total_traffic_gb", "Total Traffic", 1), ("GSM", "erlang", "TCH Traffic", 1),
       ("*", "dl_prb_util", "Load", 2), ("*", "total_traffic_gb", "Load", 2)]
STYLES = (("Time", "eNodeB Name", "Cell Name", "Cluster", "DL PRB Utilization Rate (%)", "Total Traffic",
           "Vendor Note"),
          ("Begin Time", "Sub Area", "EUtranCell FDD", "Site", "Data Vol DL+UL", "PRB Util DL", "Site Name"),
          ("Zone", "Result Time", "GsmCell", "BTS Name", "TCH Traffic", "Load"),
          ("cell_id", "site_id", "datetime", "region", "dl_prb_util", "Total Traffic Load"))


def kpi_lines(spark, d):
    """One file per supplier in one of four styles of header: banner, header, a line per item."""
    s = A.table(spark, d, "supplier").select(
        "s_suppkey", "s_nationkey", F.format_string("kpi_%06d.csv", "s_suppkey").alias("path"),
        (F.col("s_suppkey") % 4).cast("int").alias("style"))
    header = F.element_at(F.array(*[F.lit(",".join(h)) for h in STYLES]), F.col("style") + 1)
    head = s.select("path", F.explode(F.array(F.lit("Report,of,the day"), F.lit(""), header)).alias("value"))
    names = A.table(spark, d, "nation").join(A.table(spark, d, "region"),
                                             F.col("n_regionkey") == F.col("r_regionkey"))
    j = A.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(
        names, F.col("s_nationkey") == F.col("n_nationkey"))
    site = F.format_string("N%03d", "s_nationkey")
    cell = F.when(F.col("l_linenumber") == 4, "Total of all").otherwise(
        F.concat(site, F.lit("-"), (F.col("l_suppkey") % 9 + 1).cast("string")))
    day = F.col("l_shipdate").cast("timestamp")
    prb = F.concat(F.col("l_quantity").cast("string"), F.lit("%"))
    load, region = F.col("l_extendedprice").cast("string"), F.col("r_name")
    row = lambda *parts: F.concat_ws(",", *parts)
    line = (F.when(F.col("style") == 0, row(F.date_format(day, "yyyy-MM-dd HH:mm"), site, cell, region, prb, load,
                                            F.lit("-")))
            .when(F.col("style") == 1, row(F.date_format(day, "dd/MM/yyyy HH:mm"), region, cell, site, load, prb,
                                           F.lit("x")))
            .when(F.col("style") == 2, row(region, F.date_format(day, "yyyy/MM/dd HH:mm"), cell, site, prb, load))
            .otherwise(row(cell, site, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"), region, prb, load)))
    return head.unionByName(j.select("path", line.alias("value")))


def mapped(spark, d):
    lines = kpi_lines(spark, d)
    aliases = spark.createDataFrame(OWN, HD.ALIASES).unionByName(HD.own_names(spark))
    h = HD.file_headers(lines, aliases).withColumn("technology", F.when(
        F.array_contains("header", "GsmCell"), "GSM").otherwise("LTE"))
    manual = spark.createDataFrame([("Data Vol DL+UL", "total_traffic_gb")], "header string, canonical string")
    return lines, HD.resolve_headers(h, aliases, manual)


@query("s05_header_mapping", """
SELECT printf('kpi_%06d.csv', s_suppkey) AS path, CASE style WHEN 2 THEN 'GSM' ELSE 'LTE' END AS technology, position,
  header, canonical, method, outcome, candidates
FROM supplier JOIN (VALUES
  (0, 1, 'Time', 'datetime', 'exact', 'resolved', ''), (0, 2, 'eNodeB Name', 'site_id', 'exact', 'resolved', ''),
  (0, 3, 'Cell Name', 'cell_id', 'exact', 'resolved', ''), (0, 4, 'Cluster', 'region', 'exact', 'resolved', ''),
  (0, 5, 'DL PRB Utilization Rate (%)', 'dl_prb_util', 'exact', 'resolved', ''),
  (0, 6, 'Total Traffic', 'total_traffic_gb', 'exact', 'resolved', ''),
  (0, 7, 'Vendor Note', NULL, NULL, 'unmapped', ''),
  (1, 1, 'Begin Time', 'datetime', 'exact', 'resolved', ''), (1, 2, 'Sub Area', 'region', 'exact', 'resolved', ''),
  (1, 3, 'EUtranCell FDD', 'cell_id', 'exact', 'resolved', ''), (1, 4, 'Site', 'site_id', 'exact', 'resolved', ''),
  (1, 5, 'Data Vol DL+UL', 'total_traffic_gb', 'manual', 'resolved', ''),
  (1, 6, 'PRB Util DL', 'dl_prb_util', 'exact', 'resolved', ''),
  (1, 7, 'Site Name', 'site_id', 'exact', 'duplicate', ''),
  (2, 1, 'Zone', 'region', 'exact', 'resolved', ''), (2, 2, 'Result Time', 'datetime', 'exact', 'resolved', ''),
  (2, 3, 'GsmCell', 'cell_id', 'exact', 'resolved', ''), (2, 4, 'BTS Name', 'site_id', 'exact', 'resolved', ''),
  (2, 5, 'TCH Traffic', 'erlang', 'exact', 'resolved', ''),
  (2, 6, 'Load', NULL, NULL, 'ambiguous', 'dl_prb_util,total_traffic_gb'),
  (3, 1, 'cell_id', 'cell_id', 'exact', 'resolved', ''), (3, 2, 'site_id', 'site_id', 'exact', 'resolved', ''),
  (3, 3, 'datetime', 'datetime', 'exact', 'resolved', ''), (3, 4, 'region', 'region', 'exact', 'resolved', ''),
  (3, 5, 'dl_prb_util', 'dl_prb_util', 'exact', 'resolved', ''),
  (3, 6, 'Total Traffic Load', NULL, NULL, 'unmapped', 'total_traffic_gb')
) m(style, position, header, canonical, method, outcome, candidates) ON s_suppkey % 4 = style""")
def _(spark, d):
    return mapped(spark, d)[1].withColumn("candidates", F.array_join("candidates", ","))


@query("s05_mapped_files", """
SELECT printf('kpi_%06d.csv', l_suppkey) AS path, CASE l_suppkey % 4 WHEN 2 THEN 'GSM' ELSE 'LTE' END AS technology,
  l_shipdate::TIMESTAMP AS datetime, r_name AS region, site AS site_id,
  site || '-' || (l_suppkey % 9 + 1)::VARCHAR AS cell_id, site || '-S' || (l_suppkey % 9 + 1)::VARCHAR AS sector_id,
  CASE WHEN l_suppkey % 4 <> 2 THEN round(l_quantity::DOUBLE, 6) END AS dl_prb_util,
  CASE WHEN l_suppkey % 4 < 2 THEN round(l_extendedprice::DOUBLE, 6) END AS total_traffic_gb,
  CASE WHEN l_suppkey % 4 = 2 THEN round(l_quantity::DOUBLE, 6) END AS erlang
FROM lineitem JOIN (SELECT *, printf('N%03d', s_nationkey) AS site FROM supplier) ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_linenumber <> 4""")
def _(spark, d):
    lines, resolved = mapped(spark, d)
    k = HD.load_kpi_lines(lines, resolved, KPIS, width=max(len(h) for h in STYLES))
    return r6(k.select("path", "technology", "datetime", "region", "site_id", "cell_id", "sector_id", *KPIS), *KPIS)
