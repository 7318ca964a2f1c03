"""Alias tables: keys, priorities, manual overrides, files of unlike headers in one table."""

import zipfile

from pyspark.sql import functions as F

from radiolake.sources import headers as HD


def table(spark, *rows):
    return spark.createDataFrame(list(rows), HD.ALIASES).unionByName(HD.own_names(spark))


def heads(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, technology string, header array<string>")


def result(df):
    return {(r["path"], r["position"]): (r["canonical"], r["method"], r["outcome"], r["candidates"])
            for r in df.collect()}


def test_keys_ignore_case_units_and_spelling(spark):
    given = ["E-RAB Setup Succ Rate (%)", " e rab  SETUP success RATE", "E_RAB setup succ ratio [pct]",
             "DL Thrp", "rate ratio", "", "CPU%", "(x)"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, h string").orderBy("i").select(
        HD.alias_key("h").alias("k")).collect()
    assert [r["k"] for r in got] == ["e rab setup success rate"] * 3 + [
        "downlink throughput", "rate", "", "cpu percent", ""]


def test_priority_technology_and_ties(spark):
    a = table(spark, ("LTE", "ho_sr", "HO Rate", 1), ("GSM", "call_drop_rate", "HO Rate", 1),
              ("*", "dl_prb_util", "Use", 2), ("*", "ul_prb_util", "use", 1),
              ("*", "ul_prb_util", "Both", 1), ("*", "dl_prb_util", "both (%)", 1))
    got = result(HD.resolve_headers(heads(
        spark, ("l", "lte", ["Handover Ratio", "Usage", "Use", "Both", None, " "]),
        ("g", "GSM", ["HO rate"]), ("u", "UMTS", ["HO rate"])), a))
    assert got[("l", 1)] == ("ho_sr", "exact", "resolved", [])
    assert got[("g", 1)] == ("call_drop_rate", "exact", "resolved", [])
    assert got[("u", 1)][:3] == (None, None, "unmapped")
    assert got[("l", 3)][:3] == ("ul_prb_util", "exact", "resolved")
    assert got[("l", 4)] == (None, None, "ambiguous", ["dl_prb_util", "ul_prb_util"])
    assert ("l", 5) not in got and ("l", 6) not in got


def test_manual_ones_win_and_later_columns_are_duplicates(spark):
    m = spark.createDataFrame([(None, "Odd", "site_id"), ("b", "Odd", "region"), (None, "None", None)],
                              "path string, header string, canonical string")
    h = ["Site", "Odd", "Site Name"]
    got = result(HD.resolve_headers(heads(spark, ("a", "LTE", h), ("b", "LTE", h)), table(spark), m))
    assert [got[("a", i)][:3] for i in (1, 2, 3)] == [
        ("site_id", "exact", "duplicate"), ("site_id", "manual", "resolved"), ("site_id", "exact", "duplicate")]
    assert [got[("b", i)][:3] for i in (1, 2, 3)] == [
        ("site_id", "exact", "resolved"), ("region", "manual", "resolved"), ("site_id", "exact", "duplicate")]


def test_unmapped_columns_name_the_nearest(spark):
    a = table(spark, ("*", "total_traffic_gb", "Total Traffic Volume", 1), ("*", "erlang", "Traffic Carried", 1))
    got = result(HD.resolve_headers(heads(spark, ("a", "LTE", ["Traffic Volume", "Lorem"])), a))
    assert got[("a", 1)] == (None, None, "unmapped", ["total_traffic_gb"])
    assert got[("a", 2)] == (None, None, "unmapped", [])


def test_files_of_unlike_headers_plain_and_packed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report,of,today\nTime,Cell Name,Site,Vol,Odd\n"
                                    "2024-01-01 01:00,L1-2,S1,\"1,000.5\",x\n,L1-2,S1,5,x\n"
                                    "2024-01-01 01:00,Total of all,S1,9,x\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", "cell,region,begin time,total load\nK9_3,North,01/02/2024 05:00,#DIV/0!\nK9_4,,"
                            "01/02/2024 06:00,7%\n")
    (tmp_path / "c.csv").write_text("nothing,to,see\n1,2,3\n")
    own = spark.createDataFrame([("*", "total_traffic_gb", "Volume", 1), ("*", "total_traffic_gb", "Total Load", 1)],
                                HD.ALIASES)
    own.repartition(1).write.csv(str(tmp_path / "aliases"), header=True)
    rows, what = HD.read_kpi_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.zip", "c.csv")],
                                   HD.read_aliases(spark, str(tmp_path / "aliases")), ["total_traffic_gb"])
    got = sorted((r["cell_id"], r["site_id"], r["region"], str(r["datetime"]), r["total_traffic_gb"])
                 for r in rows.collect())
    assert got == [("K9_3", "", "North", "2024-02-01 05:00:00", None), ("K9_4", "", "", "2024-02-01 06:00:00", 7.0),
                   ("L1-2", "S1", "", "2024-01-01 01:00:00", 1000.5)]
    assert [r["header"] for r in what.filter("outcome = 'unmapped'").collect()] == ["Odd"]


def test_no_files_with_a_header(spark):
    a = table(spark)
    lines = spark.createDataFrame([("x", "1,2,3"), ("x", None), ("y", "a,b")], "path string, value string")
    r = HD.resolve_headers(HD.file_headers(lines, a).withColumn("technology", F.lit("LTE")), a)
    assert r.count() == 0
    assert HD.load_kpi_lines(lines, r, ["erlang"]).count() == 0
