import datetime as dt

from pyspark.sql import functions as F

from radiolake.kpis import hourly_rules
from radiolake.operators import health as H
from radiolake.operators import params as P
from radiolake.operators import tickets as T

SCHEMA = ("datetime timestamp_ntz, object string, site_id string, sector_id string, level string, "
          "duplex string, kpi string, value double")


def hour(h, d=1):
    return dt.datetime(2024, 1, d, h)


def rows(*items):
    return [(hour(h), obj, obj[:7], obj[:7] + "-S1", "cell", dup, kpi, v)
            for h, obj, dup, kpi, v in items]


def judged(spark, data):
    return H.judge_hours(spark.createDataFrame(data, SCHEMA), hourly_rules(spark))


def test_every_hour_is_judged_on_its_own_line(spark):
    data = rows((0, "BAS0001-1", "CELL_FDD", "dl_prb_util", 80.0),
                (1, "BAS0001-1", "CELL_FDD", "dl_prb_util", 80.1),
                (2, "BAS0001-1", "CELL_FDD", "dl_prb_util", 95.0),
                (0, "BAS0001-1", "CELL_TDD", "ul_rssi_dbm", -101.0),
                (0, "BAS0001-2", "CELL_FDD", "ul_rssi_dbm", -101.0),
                (0, "BAS0002-1", "CELL_FDD", "cell_avail_pct", 99.0))
    o = {(r["object_id"], r["kpi"]): r for r in H.judge_objects(judged(spark, data)).collect()}
    prb = o[("BAS0001-1", "dl_prb_util")]
    assert (prb["sev"], prb["hours"], prb["issue_hours"], prb["peak"]) == (2, 3, 2, 95.0)
    assert prb["peak_time"] == hour(2)
    assert o[("BAS0001-1", "ul_rssi_dbm")]["sev"] == 0      # the TDD line is -100
    assert o[("BAS0001-2", "ul_rssi_dbm")]["sev"] == 2      # the FDD line is -105
    assert o[("BAS0002-1", "cell_avail_pct")]["sev"] == 0   # a value on the line is normal


def test_flow_control_is_the_site_sum_of_the_hour(spark):
    data = rows((0, "BAS0001-1", "CELL_FDD", "dl_flowctrl_drops", 60000.0),
                (0, "BAS0001-2", "CELL_FDD", "dl_flowctrl_drops", 60000.0),
                (1, "BAS0001-2", "CELL_FDD", "dl_flowctrl_drops", 99999.0))
    r = H.judge_objects(judged(spark, data)).collect()
    assert len(r) == 1 and r[0]["object_id"] == "BAS0001"
    assert (r[0]["issue_hours"], r[0]["peak"]) == (1, 120000.0)


def test_a_site_without_data_is_no_data_never_normal(spark):
    data = rows((0, "BAS0001-1", "CELL_FDD", "dl_prb_util", 10.0))
    sites = spark.createDataFrame([("BAS0001",), ("BAS0009",)], "site_id string")
    s = {r["site_id"]: r["state"] for r in H.site_status(
        H.judge_objects(judged(spark, data)), sites).collect()}
    assert s == {"BAS0001": "Normal", "BAS0009": "No data"}


def test_row_order_and_partitions_do_not_matter(spark):
    data = rows(*[(h % 24, f"BAS000{i}-1", "CELL_FDD", "dl_prb_util", float((h * 37 + i) % 100))
                  for h in range(24) for i in range(1, 6)])
    base = spark.createDataFrame(data, SCHEMA)

    def run(df):
        return sorted(map(tuple, H.judge_objects(H.judge_hours(df, hourly_rules(spark))).collect()))
    assert run(base.repartition(1)) == run(base.orderBy(F.rand(7)).repartition(50))


def test_merging_a_split_export_gives_the_whole(spark):
    whole = spark.createDataFrame(
        [("c1", hour(h), float(h), float(2 * h)) for h in range(12)],
        "object string, datetime timestamp_ntz, a double, b double")
    left = whole.select("object", "datetime", "a", F.lit(1).alias("recency"))
    right = whole.select("object", "datetime", "b", F.lit(2).alias("recency"))
    m = P.merge_hourly(P.union_exports([left, right]), ["a", "b"])
    assert sorted(map(tuple, m.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_ticket_window_edges_and_resolution(spark):
    data = rows(*[(h, "BAS0001-1", "CELL_FDD", "dl_prb_util", 90.0 if h in (9, 10, 13) else 20.0)
                  for h in range(0, 20)])
    hours = T.site_kpi_hours(judged(spark, data))
    tickets = spark.createDataFrame(
        [(1, "BAS0001", dt.datetime(2024, 1, 1, 10, 30)), (2, "BAS0001", None),
         (3, "BAS0001", dt.datetime(2024, 1, 1, 17, 30)), (4, "BAS0099", dt.datetime(2024, 1, 1, 10))],
        "ticket_id int, site_id string, problem_time timestamp_ntz")
    c = {r["ticket_id"]: r for r in T.ticket_checks(tickets, hours, 2.0).collect()}
    # from 08:00 (the floored lower bound) to 12:30: five hours, two of them over the line
    assert (c[1]["hours"], c[1]["breach_hours"], c[1]["sev"]) == (5, 2, 2)
    assert c[1]["before"] == "normal" and c[1]["after_bad"] == 1
    assert c[1]["resolution"] == "Resolved" and c[1]["after_since"] == hour(14)
    assert c[3]["sev"] == 0 and c[3]["resolution"] is None
    v = {r["ticket_id"]: r for r in T.ticket_verdict(
        tickets, T.ticket_checks(tickets, hours, 2.0), 2.0).collect()}
    assert v[1]["classification"] == T.TECHNICAL and v[1]["confidence"] == "High"
    assert v[2]["classification"] == v[4]["classification"] == T.INSUFFICIENT
    assert v[3]["classification"] == T.NO_ISSUE and v[3]["manual_check"]
