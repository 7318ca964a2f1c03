import datetime as dt
import json
import zipfile

import pytest

from radiolake.functions import text as X
from radiolake.functions.times import local_time
from radiolake.sources import exports as E
from radiolake.sources import registers as G
from radiolake.sources import sinks as K


def one(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


def test_numbers_and_codes(spark):
    assert one(spark, ["1,234.5", "98%", "#DIV/0!", "-", None, " 7 "], X.clean_number) == [
        1234.5, 98.0, None, None, None, 7.0]
    assert one(spark, ["L_Alpha_BAS0001-1", "x", "bas12 nas3456"], X.site_code) == [
        "BAS0001", None, "NAS3456"]
    assert one(spark, ["BAS0001 then NAS0002"], lambda c: X.site_code(c, "last")) == ["NAS0002"]
    assert one(spark, ["a-3", "BAS0001", "b_9 "], X.sector_no) == [3, 0, 9]
    assert one(spark, ["[40, 40, 43]", "4.5", "[]", "x"], X.mean_of_list) == [41.0, 4.5, None, None]


def test_ticket_fields(spark):
    df = spark.createDataFrame([("Reopen 2", "u"), ("", "hw.a.b"), ("0", ""), (None, "x"), ("3", "")],
                               "r string, u string")
    assert [r[0] for r in df.select(X.ticket_type("r", "u")).collect()] == [
        "REOPEN #2", "UP OF SLEEP", "NEW", "UP OF SLEEP", "REOPEN #3"]
    assert one(spark, ["hw.first.last", "", "plain"], X.user_name) == ["First Last", "", "Plain"]
    assert one(spark, ["Maysan / Emarah", "nowhere", None], X.city_name) == ["Amarah", "nowhere", ""]
    assert one(spark, ["Thiqar / x", "", "samawa city"], X.governorate_name) == ["Dhi Qar", "", "Muthanna"]
    assert one(spark, ["2024-01-02T03:04:05.000Z", "2024-01-02 03:04", "02/01/2024 03:04", "x"],
               local_time) == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4),
                               dt.datetime(2024, 1, 2, 3, 4), None]


CSV_4G = """Report,
User Name,someone
Time,eNodeB Name,Cell FDD TDD Indication,Cell Name,LocalCell Id,HW_DL PRB(%),Other
2024-01-01 00:00,E1,CELL_FDD,L_BAS0001-1,1,"81.5%",x
2024-01-01 01:00,E1,CELL_FDD,L_BAS0001-1,1,-,x
"""
CSV_3G = """Title
Time,RNC,NODEBNAME,NodeB ID,VS.IPPM.Rtt.Means(ms)
2024-01-01 00:00,R1,Town_BAS0038,7,0
2024-01-01 01:00,R1,Town_BAS0038,7,2.5
"""


def test_read_exports_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV_4G)
    (tmp_path / "b.csv").write_text(CSV_3G)
    (tmp_path / "c.csv").write_text("just,some,text\n1,2,3\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    prof = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["kpis"]) for r in E.profile_exports(spark, paths).collect()}
    assert prof["a.csv"] == ("4G", ["HW_DL PRB(%)", "Other"])
    assert prof["b.csv"][0] == "3G" and prof["c.csv"][0] == "unknown"
    rows = E.read_hourly(spark, paths, ["HW_DL PRB(%)", "VS.IPPM.Rtt.Means(ms)"]).collect()
    got = {(r["object"], r["datetime"].hour): (r["sector_id"], r["level"], r["HW_DL PRB(%)"],
                                              r["VS.IPPM.Rtt.Means(ms)"]) for r in rows}
    assert got == {("L_BAS0001-1", 0): ("BAS0001-S1", "cell", 81.5, None),
                   ("L_BAS0001-1", 1): ("BAS0001-S1", "cell", None, None),
                   ("Town_BAS0038", 0): ("BAS0038-S0", "site", None, None),
                   ("Town_BAS0038", 1): ("BAS0038-S0", "site", None, 2.5)}


def test_from_export_to_judgement(spark, tmp_path):
    """The example of the README, over a plain and a zipped export."""
    from radiolake.kpis import hourly_rules
    from radiolake.operators import health
    csv = ("Time,eNodeB Name,Cell Name,HW_DL PRB Avg Utilization(%),LTE_Availability(%)@AB,"
           "L.UL.Interference.Avg(dBm)\n2024-01-01 00:00,E1,L_BAS0001-1,99%,100,-155\n"
           "2024-01-01 01:00,E1,L_BAS0001-1,5%,10,-101.5\n")
    (tmp_path / "a.csv").write_text(csv)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", csv.replace("BAS0001", "BAS0002"))
    kpis = ["dl_prb_util", "cell_avail_pct", "ul_rssi_dbm", "ho_sr"]
    hourly = E.read_hourly(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.zip")], kpis)
    rows = {(r["site_id"], r["datetime"].hour): [r[k] for k in kpis] for r in hourly.collect()}
    assert rows["BAS0001", 0] == rows["BAS0002", 0] == [99.0, 100.0, None, None]
    assert rows["BAS0001", 1] == [5.0, 10.0, -101.5, None] and len(rows) == 4
    hours = health.judge_hours(health.to_long(hourly, kpis), hourly_rules(spark))
    sites = {r["site_id"] for r in health.site_status(health.judge_objects(hours)).collect()}
    assert sites == {"BAS0001", "BAS0002"}


def test_zipped_exports(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.csv", CSV_3G)
        z.writestr("two.csv", CSV_3G)
    lines = E.export_lines(spark, [str(tmp_path / "x.zip")])
    prof = E.profile_lines(lines).collect()
    assert len(prof) == 2 and {r["kind"] for r in prof} == {"3G"}
    rows = E.canonical_hourly(E.lines_to_rows(lines, prof[0]["header"]), ["VS.IPPM.Rtt.Means(ms)"], "3G")
    assert rows.count() == 4


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("4G", dt.datetime(2024, 1, d, 5), float(d)) for d in (1, 2)],
                               "tech string, datetime timestamp_ntz, v double")
    K.write_hourly(df, str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h")).filter("date = '2024-01-02'")
    assert [r["v"] for r in back.collect()] == [2.0]
    ring = spark.createDataFrame([("s1", [(47.0, 30.0), (47.1, 30.0), (47.0, 30.0)])],
                                 "sector_id string, ring array<struct<lon: double, lat: double>>")
    f = json.loads(K.geojson_lines(ring).collect()[0]["value"])
    assert f["geometry"]["coordinates"][0][1] == [47.1, 30.0] and f["properties"] == {"sector_id": "s1"}
    K.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2


def test_polygons_and_coverage_sources(spark, tmp_path):
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {
        "level": 3, "name": "A", "district": "D", "governorate": "G"}, "geometry": {
            "type": "Polygon", "coordinates": [[[47.0, 30.0], [47.1, 30.0], [47.1, 30.1]]]}}]}
    ring = [[47, 30.0], [47.1, 30.0], [47.1, 30.1], [47.0, 30.0]]
    geo["features"] += [{"type": "Feature", "properties": {"name": "M"}, "geometry": {
        "type": "MultiPolygon", "coordinates": [[ring, ring], [ring]]}},
        {"type": "Feature", "properties": {"name": "P"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "p.json").write_text(json.dumps(geo))
    r, many, point = G.load_polygons(spark, str(tmp_path / "p.json")).collect()
    assert r["name"] == "A" and r["parts"][0][0][2]["lat"] == 30.1
    assert [len(part) for part in many["parts"]] == [2, 1] and many["parts"][0][1][0]["lon"] == 47.0
    assert many["seq"] == 1 and point["parts"] is None
    raw = spark.createDataFrame([("30", "47", "-90", ""), ("95", "47", "-90", "3"), ("30", "x", "-90", "3")],
                                "`Latitude` string, `Longitude` string, `RSRP(All MRs) (dBm)` string, "
                                "`MR Count` string")
    assert [tuple(x) for x in G.load_coverage(raw).collect()] == [(30.0, 47.0, -90.0, 1.0)]
    with pytest.raises(ValueError):
        G.load_coverage(raw.select("Latitude"))


def test_registers_know_all_their_headers(spark):
    from radiolake.sources import registers as G
    raw = spark.createDataFrame([("BAS0001", "30.5", "47.1", "120", "31", "4", "65")],
                                ["NE Name", "Y", "X", "Antenna Azimuth", "HBA", "eTilt", "beamwidth"])
    row = G.load_site_db(raw).first()
    assert (row["site_id"], row["latitude"], row["longitude"], row["azimuth_deg"], row["antenna_height_m"],
            row["elec_tilt_deg"], row["hbw_deg"]) == ("BAS0001", 30.5, 47.1, 120.0, 31.0, 4.0, 65.0)
    target = spark.createDataFrame([("7", "BAS0002", "2024-01-02 03:00:00", "Yes")],
                                   ["CC Number", "Site ID(SD Check)", "SLA Target Time", "Is CMC"])
    got = G.load_target(target).first()
    assert (got["ticket_id"], got["site_id"], got["is_cmc"]) == ("7", "BAS0002", "Yes")
    assert got["sla_target"] == dt.datetime(2024, 1, 2, 3)
