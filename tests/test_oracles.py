"""A sample of the registered queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

DIR = "/root/testdata/sf0.001"
SAMPLE = ["a12_site_status", "a02_sector_weighted_all", "a16_a17_weighted_grid", "n04_trend_verdict",
          "c06_ticket_verdict", "d_all_rules", "r02_coverage", "j09_best_server", "c17_sleep_verdict",
          "c14_worklist_decision", "c02_complaint_category", "s01_p01_p03_p04_p06_hourly_export",
          "n03_theil_sen", "n06_panel_lines", "j08_nearest_on_air", "j14_isolation", "j24_around_site",
          "j22_compare_sectors", "a34_newer_copies", "a18_grid_pyramid", "s15_parsed_sink",
          "a08_hourly_pivot", "s04_wide_hours", "p05_map_band", "p02_plausible_levels",
          "s01_p02_export_to_kpis", "f19_value_bands", "p10_granularity"]


def test_every_query_has_sql():
    from radiolake.plans.registry import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = entry.queries()[name](spark, DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(tuple(map(check.norm, r)) for r in got[cols].itertuples(index=False))
    b = sorted(tuple(map(check.norm, r)) for r in want[cols].itertuples(index=False))
    assert a == b


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
