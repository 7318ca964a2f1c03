"""Drawing, tracker and previous list: matching, directions, status, review, order of rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from radiolake.operators import reconcile as R

ARROW = ("site_id string, name string, seq int, latitude double, longitude double, azimuth_deg double, "
         "planned boolean")
CELL = ("site_id string, name string, sector_num int, tech string, azimuth_deg double, latitude double, "
        "longitude double, active boolean")


def arrow(site, seq, az, lat=30.5, lon=47.5, planned=False, name=None):
    return site, name or f"Town_{site}", seq, lat, lon, az, planned


def cell(site, num, az, tech="lte", lat=30.5, lon=47.5, active=True, name="T"):
    return site, name, num, tech, az, lat, lon, active


def run(spark, arrows, cells, previous=()):
    out = R.reconcile(spark.createDataFrame(arrows, ARROW), spark.createDataFrame(cells, CELL),
                      spark.createDataFrame([(p,) for p in previous], "site_id string"))
    return {r["site_id"]: r for r in out.collect()}


def greedy(drawn, tracked):
    """Brute force: the nearest pair that is still free, until one side is used up."""
    drawn, tracked, out = set(drawn), dict(tracked), set()
    while drawn and tracked:
        off, num, a = min((min((a - t) % 360, (t - a) % 360), n, a)
                          for a, (n, t) in itertools.product(drawn, tracked.items()))
        out.add((num, a, off))
        drawn.remove(a)
        del tracked[num]
    return out


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(4)
    cases = []
    for i in range(60):
        drawn = sorted(rng.sample(range(360), rng.randint(0, 8)))
        tracked = [(n, rng.randrange(360)) for n in rng.sample(range(1, 12), rng.randint(0, 7))]
        cases.append((i, drawn, tracked))
    df = spark.createDataFrame(cases, "i int, d array<int>, t array<struct<sector_num:int,azimuth_deg:int>>")
    got = df.select("i", R.match_directions(F.col("d"), F.col("t")).alias("m")).collect()
    want = {i: greedy(d, t) for i, d, t in cases}
    assert {r["i"]: {(m["num"], m["a"], m["off"]) for m in r["m"]} for r in got} == want


@pytest.mark.parametrize("given, kept", [
    ([], []), ([5], [5]), ([0, 10, 20], [0, 20]), ([5, 120, 350], [5, 120]), ([0, 350], [0]),
    ([10, 100, 110, 120, 354], [10, 100, 120, 354])])
def test_directions_within_15_degrees_are_one(spark, given, kept):
    df = spark.createDataFrame([(given,)], "a array<int>")
    assert df.select(R.merged_directions(F.col("a")).alias("k")).first()["k"] == kept


def test_status_rules_in_order(spark):
    got = run(spark, [arrow("S1", 1, 0.0), arrow("S2", 1, 0.0, planned=True), arrow("S3", 1, 0.0),
                      arrow("S4", 1, 0.0, name="X_ARBShebBRDR"), arrow("S5", 1, 0.0, name="Marbad"),
                      arrow("S8", 1, 0.0, planned=True), arrow("S8", 2, 90.0)],
              [cell("S3", 1, 10.0, active=False), cell("S6", 1, 10.0)], ["S7"])
    assert {k: r["status"] for k, r in got.items()} == {
        "S1": "On Air", "S2": "Planned", "S3": "Off Air", "S4": "Off Air", "S5": "On Air",
        "S6": "On Air", "S7": "Off Air", "S8": "On Air"}
    assert got["S6"]["reason"] == "active in the tracker, not drawn"
    assert got["S7"]["omitted"] and [tuple(x) for x in got["S7"]["review"]] == [("no-coords", None)]


def test_positions_and_review(spark):
    got = run(spark, [arrow("A", 1, 0.0, 30.0, 47.0), arrow("B", 1, 0.0), arrow("C", 1, 0.0, 30.0, 47.0),
                      arrow("C", 2, 90.0, 30.6, 47.6), arrow("D", 1, None), arrow("E", 1, 200.0, None, None)],
              [cell("A", 1, 0.0, lat=47.7, lon=30.7), cell("B", 1, 0.0, lat=30.53), cell("E", 1, 0.0, lat=0.0)],
              ["A", "B", "C"])
    assert (got["A"]["latitude"], got["A"]["longitude"], got["A"]["position_of"]) == (30.7, 47.7, "tracker")
    assert [x["category"] for x in got["A"]["review"]] == ["no-coords"]
    assert [tuple(x) for x in got["B"]["review"]] == [("moved", 3336)]
    assert got["C"]["latitude"] == 30.6 and got["C"]["review"] == []
    assert [(s["sector_num"], s["azimuth_deg"]) for s in got["D"]["sectors"]] == [(1, 0)]
    assert [x["category"] for x in got["D"]["review"]] == ["new-site"]
    assert got["E"]["omitted"]


def test_extra_and_missing_arrows(spark):
    got = run(spark, [arrow("A", i, a) for i, a in enumerate([0.0, 118.0, 180.0, 239.0])]
              + [arrow("B", 1, 5.0)],
              [cell("A", 1, 0.0), cell("A", 2, 120.0), cell("A", 3, 240.0), cell("B", 1, 0.0, "gsm"),
               cell("B", 1, 350.0, "gsm"), cell("B", 2, 170.0)])
    assert [tuple(x) for x in got["A"]["review"]] == [("extra-arrow", 180)]
    assert [tuple(x) for x in got["B"]["review"]] == [("missing-arrow", 2)]
    assert [(s["azimuth_deg"], s["drawn_azimuth_deg"], s["off_deg"]) for s in got["B"]["sectors"]] == [
        (350, 5, 15), (170, None, None)]


def test_sectors_without_a_direction_are_spread(spark):
    got = run(spark, [], [cell("A", n, None) for n in (1, 2, 5)] + [cell("B", 1, 0.0), cell("B", None, 9.0)])
    assert [s["azimuth_deg"] for s in got["A"]["sectors"]] == [0, 120, 240]
    assert [(s["sector_num"], s["azimuth_deg"]) for s in got["B"]["sectors"]] == [(1, 0)]


def test_order_of_rows_does_not_matter_and_empty_lists(spark):
    rng = random.Random(9)
    arrows = [arrow(f"S{i % 9}", i, float(rng.randrange(360)), 30 + rng.random(), 47 + rng.random(),
                    name=f"N{i}") for i in range(40)]
    cells = [cell(f"S{i % 7}", i % 4 + 1, float(rng.randrange(360)), R.TECHS[i % 3], 30 + rng.random(),
                  47 + rng.random(), i % 5 > 0, f"T{i}") for i in range(60)]
    arrows += [(None, None, None, None, None, None, None)]
    cells += [(None, None, None, None, None, None, None, None)]
    first = run(spark, arrows, cells, ["S1", "S1", "S20"])
    rng.shuffle(arrows)
    rng.shuffle(cells)
    assert run(spark, arrows * 2, cells, ["S20", "S1"]) == first
    assert run(spark, [], []) == {}
