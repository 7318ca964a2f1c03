"""Composed runs: kept tables, hourly and daily frames, empty frames, one read of the input."""

import datetime as dt
import os

import pytest

from radiolake.operators import runs as RN

CELL = ("cell_id string, site_id string, sector_id string, datetime timestamp_ntz, dl_prb_util double, "
        "cell_avail_pct double, total_traffic_gb double, rrc_conn_users_max double")
SITE = "site_id string, latitude double, longitude double"


def frame(spark, days, hours):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for c in range(4):
        for d in range(days):
            for h in hours:
                avail = 100.0 if c < 3 or d < days // 2 else 96.0
                prb = 95.0 if c == 0 and h == 20 else 30.0 + c
                rows.append((f"C{c}", f"S{c // 2}", f"S{c // 2}-S1", t0 + dt.timedelta(days=d, hours=h), prb,
                             avail, 10.0 + c, 5.0))
    return spark.createDataFrame(rows, CELL), spark.createDataFrame(
        [("S0", 30.5, 47.5), ("S1", 30.51, 47.5)], SITE)


def test_hourly_frame(spark, tmp_path):
    run = RN.full_analysis(RN.Run(f"file://{tmp_path}/run"), *frame(spark, 6, range(24)))
    counts = {r["result"]: r["n"] for r in run.counts().collect()}
    assert counts["input"] == 576 and counts["per_hour"] == 576 and counts["per_cell"] == 4
    assert counts["busy_hour"] == 2 and counts["summary"] == 1
    assert {(r["cell_id"], r["kpi"], r["period"]) for r in run["breaches"].collect()} == {
        ("C3", "cell_avail_pct", "all"), ("C0", "dl_prb_util", "hour")}
    peak = run["breaches"].filter("period = 'hour'").first()
    assert peak["datetime"].hour == 20
    s = run["summary"].first()
    assert (s["granularity"], s["rows"], s["sites"], s["cells"], s["kpi_breaches"]) == ("hour", 576, 2, 4, 2)
    falls = run["trends"].filter("cell_id = 'C3' and kpi = 'cell_avail_pct'").first()
    assert falls["verdict"] in ("degrading", "step-down", "stable")
    found = {(r["cell_id"], r["problem_class"]): r for r in run["findings"].collect()}
    assert found[("C3", "availability")]["worst_hour"] == dt.datetime(2024, 1, 4)
    # every table is on disk and the later ones do not read the given frame again
    assert set(os.listdir(f"{tmp_path}/run")) == set(run.tables)
    for name in ("trends", "findings", "actions"):
        assert "LogicalRDD" not in run[name]._jdf.queryExecution().optimizedPlan().toString()


def test_daily_frame_has_no_hours(spark, tmp_path):
    run = RN.full_analysis(RN.Run(f"file://{tmp_path}/run"), *frame(spark, 8, [0]))
    assert "per_day" in run.tables and "busy_hour" not in run.tables and "worst_hours" not in run.tables
    assert run["summary"].first()["granularity"] == "day"
    assert run["trends"].count() > 0
    few = RN.full_analysis(RN.Run(f"file://{tmp_path}/few"), *frame(spark, 3, [0]))
    assert few["trends"].count() == 0


def test_empty_frame(spark, tmp_path):
    cells, sites = frame(spark, 1, [0])
    run = RN.full_analysis(RN.Run(f"file://{tmp_path}/run"), cells.limit(0), sites.limit(0))
    s = run["summary"].first()
    assert (s["rows"], s["kpi_breaches"], s["diagnoses"], s["recommendations"]) == (0, 0, 0, 0)


def test_names_are_used_once(spark, tmp_path):
    run = RN.Run(f"file://{tmp_path}/run/")
    run.keep("a", spark.range(3))
    with pytest.raises(ValueError, match="table a"):
        run.keep("a", spark.range(2))
    assert run.counts().collect() == [("a", 3)]
