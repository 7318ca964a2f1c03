"""Heads and archive entries: what is read, what is not, damaged and very large files."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from radiolake.sources import archives as AR
from radiolake.sources import exports as E
from radiolake.sources import placemarks as PM

HEADER = "Time,eNodeB Name,Cell Name,HW_DL PRB(%),Drops"


def test_heads_read_no_more_than_they_give(spark, tmp_path):
    big = tmp_path / "a big+one%.csv"
    with open(big, "wb") as f:
        f.write(f"Report\r\n{HEADER}\r\n2024-01-01 05:00,e,L_BAS0001-1,5%,1\r\n".encode() * 6000)
        f.truncate(100_000_000)
    (tmp_path / "small.csv").write_text(f"﻿{HEADER}\n2024-01-01 07:00,e,L_BAS0001-1,5%,1")
    (tmp_path / "empty.csv").write_text("")
    heads = AR.file_heads(spark, [f"{tmp_path}/*.csv"])
    got = {os.path.basename(r["path"]): (r["size"], len(r["head"])) for r in heads.collect()}
    small = os.path.getsize(tmp_path / "small.csv")
    assert got == {big.name: (100_000_000, AR.HEAD), "small.csv": (small, small), "empty.csv": (0, 0)}
    assert heads.where(F.col("path").endswith("small.csv")).count() == 1
    prof = {os.path.basename(r["path"]): (r["kind"], r["kpis"], str(r["first_time"]))
            for r in E.profile_exports(spark, [str(tmp_path)]).collect()}
    want = ("4G", ["HW_DL PRB(%)", "Drops"])
    assert prof[big.name] == (*want, "2024-01-01 05:00:00")
    assert prof["small.csv"] == (*want, "2024-01-01 07:00:00")
    rows = E.read_hourly(spark, [f"{tmp_path}/small.csv"], ["Drops"]).collect()
    assert [r["Drops"] for r in rows] == [1.0]


def test_filters_on_the_path_reach_the_list(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.txt").write_text(str(k))
    heads = AR.file_heads(spark, [str(tmp_path)]).where(F.col("path") == f"{tmp_path}/f3.txt")
    assert [bytes(r["head"]) for r in heads.collect()] == [b"3"]
    reader = AR.FileHeads({"path": str(tmp_path)}).reader(None)
    left = list(reader.pushFilters([AR.EqualTo(("path",), f"{tmp_path}/f3.txt"),
                                    AR.EqualTo(("size",), 1)]))
    assert len(left) == 1
    assert [p.value for p in reader.partitions()] == [[(f"{tmp_path}/f3.txt", 1)]]


def test_entries_have_a_kind_or_a_reason(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/one.CSV", f"{HEADER}\r\na,b\r\n\r\n")
        z.writestr("stored.txt", "x\ny", zipfile.ZIP_STORED)
        z.writestr("empty.txt", "")
        z.writestr("picture.png", b"\x00")
        z.writestr("odd.csv", "x", zipfile.ZIP_BZIP2)
        z.mkdir("folder")
    (tmp_path / "no.zip").write_text("PK but no archive")
    entries = AR.zip_entries(spark, [str(tmp_path)])
    got = {r["entry"]: (r["kind"], r["reason"]) for r in entries.collect()}
    assert got == {"in/one.CSV": ("lines", None), "stored.txt": ("lines", None),
                   "empty.txt": ("lines", None), "picture.png": (None, "no text, CSV or KML file"),
                   "odd.csv": (None, "packed by method 12"), "folder/": (None, "a folder"),
                   None: (None, "no readable archive")}
    lines = [(r["path"].rpartition("!")[2], r["value"]) for r in AR.entry_lines(entries).collect()]
    assert sorted(lines) == [("in/one.CSV", ""), ("in/one.CSV", HEADER), ("in/one.CSV", "a,b"),
                             ("stored.txt", "x"), ("stored.txt", "y")]


def test_entries_beyond_two_gigabytes(spark, tmp_path):
    """A sparse archive: the entry that is read lies behind one of 2.5 GB that is not."""
    path, gap = tmp_path / "huge.zip", 2_600_000_000
    with open(path, "wb") as f:
        f.truncate(gap)
        f.seek(gap)
        with zipfile.ZipFile(f, "a", zipfile.ZIP_DEFLATED) as z:
            z.writestr("late.csv", "a\n" * 100_000)
    entries = AR.zip_entries(spark, [str(path)])
    assert entries.first()["offset"] >= gap
    assert AR.entry_lines(entries).where("value = 'a'").count() == 100_000


def test_large_and_damaged_entries(spark, tmp_path):
    text = "".join(f"{k},{k * k}\n" for k in range(900_000))
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("long.csv", text)
    entries = AR.zip_entries(spark, [f"{tmp_path}/x.zip"])
    lines = AR.entry_lines(entries).agg(F.count("*").alias("n"), F.sum(F.length("value") + 1).alias("m")).first()
    assert (lines["n"], lines["m"]) == (900_000, len(text))
    heads = AR.entry_heads(entries).agg(F.sum(F.length("value") + 1).alias("m")).first()["m"]
    assert AR.HEAD - 20 < heads <= AR.HEAD
    wrong = entries.withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="damaged"):
        AR.entry_lines(wrong).count()


BODY = """<Placemark id="1"><styleUrl>#onair</styleUrl><description><![CDATA[{}]]></description>
<Point><coordinates> 47.5 , 30.25,0</coordinates></Point></Placemark>"""


def test_placemarks_of_archives(spark, tmp_path):
    text = ("New &amp; Old Town<br/>Site Code: bas0007 Sector: 2 Azimuth: -10&deg;<br>Height: 31.5 m Status: ON air"
            "<br/>4G cells<br/>L18_a: PCI=7, EARFCN=1300, Max RET=60, RS Power=152<br/>Status=locked, PCI=9"
            "<br/>L21_b: Note=x (a, b=1), EARFCN=300<br/>3G cells<br/>Power=5<br/>U09_c: Tilt=45, DL PSC=12"
            "<br/>RET actual tilt<br/>Band U900: 20<br/>Band U900: 40<br/>Band L18: 50")
    name_only = "Basra BAS0009<br/>2G cells<br/>G09: Electrical Downtilt=5"
    doc = "<kml>" + BODY.format(text) + "<Placemark></Placemark>" + BODY.format(name_only) + BODY.format(
        "nobody").replace("onair", "tower") + BODY.format("no site here") + "</kml>"
    with zipfile.ZipFile(tmp_path / "m.kmz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", doc)
        z.writestr("files/icon.png", b"x")
    cells, sectors = PM.parse_placemarks(PM.map_placemarks(spark, [f"{tmp_path}/m.kmz"]))
    s = {r["sector_id"]: r for r in sectors.collect()}
    assert sorted(s) == ["BAS0007-S2", "BAS0009-S0"]
    r = s["BAS0007-S2"]
    assert (r["site_name"], r["azimuth_deg"], r["antenna_height_m"], r["status"]) == (
        "New & Old Town", -10.0, 31.5, "On Air")
    assert (r["latitude"], r["longitude"], r["n_2g"], r["n_3g"], r["n_4g"], r["n_cells"]) == (30.25, 47.5, 0, 1, 2, 3)
    # bands: U900 3 degrees, L18 5; tilts of the cells: 6 and 4.5
    assert (r["ret_u900_deg"], r["ret_u2100_deg"], r["ret_actual_deg"], r["elec_tilt_deg"], r["ret_deg"]) == (
        3.0, None, 4.0, 5.25, 4.0)
    assert s["BAS0009-S0"]["ret_deg"] == 5.0 and s["BAS0009-S0"]["site_name"] == "Basra BAS0009"
    c = {r["cell_name"]: r for r in cells.collect()}
    assert (c["L18_a"]["pci"], c["L18_a"]["status"], c["L18_a"]["rs_power_dbm"], c["L18_a"]["max_ret_deg"]) == (
        9.0, "Locked", 15.2, 6.0)
    assert (c["L21_b"]["band_label"], c["L21_b"]["elec_tilt_deg"], c["L21_b"]["ret_deg"]) == ("L2100", None, 4.0)
    assert (c["U09_c"]["psc"], c["U09_c"]["elec_tilt_deg"], c["U09_c"]["status"]) == ("12", 4.5, "On Air")
    assert len(c) == 4
    sites = {r["site_id"]: (r["n_sectors"], r["n_cells"]) for r in PM.sites_of(sectors).collect()}
    assert sites == {"BAS0007": (1, 3), "BAS0009": (1, 1)}


def test_archives_are_written_by_name(spark, tmp_path):
    rows = [(f"z{k % 2}", f"e{k % 4}.txt", k, f"line {k}") for k in range(40)]
    lines = spark.createDataFrame(rows, "archive string, entry string, at int, value string")
    paths = [r["path"] for r in AR.write_archives(lines.repartition(3), str(tmp_path / "out")).collect()]
    assert len(paths) == 2
    got = AR.entry_lines(AR.zip_entries(spark, paths)).collect()
    assert sorted(r["value"] for r in got) == sorted(r[3] for r in rows)
    for path in paths:
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                own = z.read(name).decode().split("\n")[:-1]
                assert own == [v for _, e, _, v in rows if e == name]
