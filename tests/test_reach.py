"""Searches by position: what a point looks at stays small however many places lie together."""

import math
import random

import pytest
from pyspark.sql import functions as F

from radiolake.functions.geo import az_gap, bearing_deg, box_m, flat_m, haversine_m, predict_rsrp
from radiolake.operators import coverage as C
from radiolake.operators import polygons as PG
from radiolake.operators import spatial as S


def flat(p, q):
    return math.hypot((q[1] - p[1]) * 111_320.0 * math.cos(math.radians(p[0])), (q[0] - p[0]) * 111_320.0)


@pytest.fixture(scope="module")
def town():
    """900 places on a square kilometre, some of them twice."""
    r = random.Random(4)
    rows = [(f"P{i:03d}", 30.0 + r.random() * 0.009, 47.0 + r.random() * 0.0104) for i in range(880)]
    return rows + [(f"Q{i:03d}", *rows[i][1:]) for i in range(20)]


def around(town, n=60):
    """Points in the town, beside it and far from it, each of one of the places."""
    r = random.Random(5)
    far = [(30.0 + 0.3 * r.random(), 47.0 + 0.3 * r.random()) for _ in range(n)]
    near = [(30.0 + 0.009 * r.random(), 47.0 + 0.0104 * r.random()) for _ in range(n)]
    return [(i, town[i][0], *p) for i, p in enumerate(far + near + [q[1:] for q in town[:10]])]


def test_far_points_look_at_the_edge_of_a_town_only(spark, town):
    places = spark.createDataFrame(town, "_place string, s_lat double, s_lon double")
    points = [(29.98 - i * 0.001, 47.005, flat((29.98 - i * 0.001, 47.005), min(
        (t[1:] for t in town), key=lambda t: flat((29.98 - i * 0.001, 47.005), t))) + 50.0) for i in range(20)]
    p = spark.createDataFrame(points, "p_lat double, p_lon double, reach double")
    pairs = S.within_own_reach(p, "reach", places)
    within = flat_m("p_lat", "p_lon", "s_lat", "s_lon") <= F.col("reach")
    held = sum(flat(q[:2], t[1:]) <= q[2] for q in points for t in town)
    assert pairs.filter(within).count() == held
    assert pairs.count() < 0.3 * len(points) * len(town)


@pytest.mark.parametrize("metric", ["flat", "haversine"])
def test_boxes_bound_the_distances_in_them(spark, metric):
    r = random.Random(6)
    rows = []
    for _ in range(300):
        south, west, tall, wide = r.uniform(-89, 80), r.uniform(-180, 170), r.random() ** 3 * 9, r.random() ** 3 * 10
        for _ in range(4):
            rows.append((r.uniform(-90, 90), r.uniform(-180, 180), south + r.random() * tall,
                         west + r.random() * wide, (south, south + tall, west, west + wide)))
    df = spark.createDataFrame(rows, "p_lat double, p_lon double, s_lat double, s_lon double, box struct<"
                                     "lo_lat: double, hi_lat: double, lo_lon: double, hi_lon: double>")
    fn = haversine_m if metric == "haversine" else flat_m
    got = df.select(box_m("p_lat", "p_lon", "box", metric).alias("lo"), fn("p_lat", "p_lon", "s_lat", "s_lon").alias("d"),
                    box_m("p_lat", "p_lon", "box", metric, far=True).alias("hi")).collect()
    assert all(x.lo <= x.d * (1 + 1e-7) + 1e-3 and x.d <= x.hi * (1 + 1e-7) + 1e-3 for x in got)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_without_the_own_place(spark, town, k):
    points = around(town)
    twice = town + [points[0][1:2] + (30.2, 47.2), points[0][1:2] + (30.21, 47.2)]  # a place at three positions
    got = S.k_nearest(spark.createDataFrame(points, "id int, own string, latitude double, longitude double"), "id",
                      spark.createDataFrame(twice, "name string, latitude double, longitude double"), "name", k,
                      exclude="own").collect()
    want = {(i, rank, round(d, 3), name) for i, own, *p in points for rank, (d, name) in enumerate(
        sorted((round(flat(p, t[1:]), 6), t[0]) for t in twice if t[0] != own)[:k], 1)}
    assert {(x.id, x["rank"], round(x.dist_m, 3), x.name) for x in got} == want and len(got) == k * len(points)


def test_exploded_points_are_not_sent_to_the_driver(spark, town):
    points = spark.createDataFrame(around(town), "id int, own string, latitude double, longitude double")
    grid = spark.createDataFrame(town, "rsrp string, latitude double, longitude double")
    near = S.nearest_within(points, "id", grid, 30.0, ["rsrp"])
    pairs = S.within_own_reach(points.selectExpr("latitude p_lat", "longitude p_lon", "30d reach"), "reach",
                               grid.withColumnsRenamed({"latitude": "s_lat", "longitude": "s_lon"}))
    for df in (near, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    want = {(i, n) for i, own, *p in around(town) for d, n in [min((round(flat(p, t[1:]), 6), t[0]) for t in town)] if d <= 30}
    assert {(x.id, x.rsrp) for x in near.collect()} == want and len(want) > 20


def joined_rows(df):
    """Rows that the joins of a collected frame made."""
    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        kids = node.children()
        made = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return made + sum(walk(kids.apply(i)) for i in range(kids.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def facing(p, srv, sites, within=3000.0):
    """The neighbours as the old code found them: all sites, then a fold nearest first."""
    def bearing(s):
        a, b, dl = math.radians(s[0]), math.radians(p[0]), math.radians(p[1] - s[1])
        return round((math.degrees(math.atan2(math.sin(dl) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a)
                                              * math.cos(b) * math.cos(dl))) + 360) % 360, 6)
    def gap(a, b):
        d = abs(a - b) % 360
        return 360 - d if d > 180 else d
    found = []
    for name, lat, lon, azimuths in sites:
        if name == srv[0] or round(flat(p, (lat, lon)), 6) > within:
            continue
        b = bearing((lat, lon))
        off, i = min((round(gap(a, b), 6), i) for i, a in enumerate(azimuths))
        if off <= 60:
            found.append((round(flat(p, (lat, lon)), 6), off, f"{name}-{i}", (b + 180) % 360))
    taken, out = [(srv[1] + 180) % 360], []
    for d, off, sector, toward in sorted(found):
        if d < 1 or all(gap(t, toward) >= 30 for t in taken):
            out.append(sector)
            taken += [toward] * (d >= 1)
    return out


def test_neighbours_of_a_dense_network_meet_few_sites(spark):
    r = random.Random(9)
    sites = [(f"S{i:04d}", 30.0 + r.random() * 0.027, 47.0 + r.random() * 0.03, [r.randrange(360) for _ in range(3)])
             for i in range(1500)]
    points = [(i, 30.0 + r.random() * 0.03, 46.999 + r.random() * 0.034) for i in range(60)]
    points.append((60, *sites[0][1:3]))  # at a site
    sectors = spark.createDataFrame([(n, f"{n}-{i}", float(a), la, lo) for n, la, lo, az in sites for i, a in enumerate(az)],
                                    "site_id string, sector_id string, azimuth_deg double, latitude double, longitude double")
    serving = [(i, sites[i][0], float(r.randrange(360)), 50.0) for i in range(61)]
    df = S.neighbour_sectors(
        spark.createDataFrame(points + points[:5], "id int, latitude double, longitude double"), "id", sectors,
        spark.createDataFrame(serving + serving[:5], "id int, site_id string, bearing_deg double, dist_m double"))
    got = {}
    for x in sorted(df.collect(), key=lambda x: (x.id, x["rank"])):
        got.setdefault(x.id, []).append(x.sector_id)
    assert got == {i: w for (i, *p), s in zip(points, serving) if (w := facing(p, s[1:], sites))}
    assert joined_rows(df) < 0.5 * len(points) * len(sites)


def test_predicted_best_server_is_that_of_all_within_reach(spark):
    r = random.Random(3)
    rows = [(None if i == 7 else f"C{i:04d}", 30.0 + r.random() * 0.027, 47.0 + r.random() * 0.03, float(r.randrange(360)),
             float(r.choice([12, 30, 45, 50])), None if i == 5 else float(r.randrange(1, 12))) for i in range(6000)]
    sectors = spark.createDataFrame(rows, "sector_id string, latitude double, longitude double, azimuth_deg double, "
                                          "antenna_height_m double, total_tilt_deg double")
    points = [(i // 2, 29.99 + r.random() * 0.05, 46.99 + r.random() * 0.05) for i in range(80)]
    points = spark.createDataFrame(points, "id int, latitude double, longitude double")
    df = S.predicted_best_server(points, "id", sectors)
    got = {tuple(x) for x in df.collect()}
    pairs = S.radius_join(points, sectors, 1500.0, ["id"], S.POWER_COLS)
    off = az_gap("azimuth_deg", F.round(bearing_deg("o_lat", "o_lon", "p_lat", "p_lon"), 6))
    pairs = pairs.withColumn("rsrp", predict_rsrp("dist_m", "antenna_height_m", "total_tilt_deg", off))
    want = pairs.groupBy("id").agg(F.min_by(F.struct("sector_id", "rsrp"), F.struct(-F.col("rsrp"), "sector_id"))
                                   .alias("w")).select("id", "w.*")
    assert got == {tuple(x) for x in want.collect()} and len({x[2] for x in got}) > 5
    assert joined_rows(df) < 0.7 * pairs.count()


def test_area_around_a_site_meets_bands_of_spots(spark):
    r = random.Random(8)
    spots = [(30.0 + i % 6 * 0.002, 47.0 + i // 6 * 0.002) for i in range(36)]
    rows = [(*r.choice(spots), -70.0 - r.random() * 20, float(r.randrange(5))) for _ in range(20000)]
    rows += [(*spots[0], None, 3.0), (None, 47.0, -80.0, 1.0)]
    sites = [(f"S{i}", *r.choice(spots)) for i in range(30)] + [("S0", 30.001, 47.001), ("far", 31.0, 47.0)]
    df = C.area_rsrp(spark.createDataFrame(sites, "site_id string, latitude double, longitude double"), spark.createDataFrame(
        rows, "lat double, lon double, rsrp double, mr double"), metres=300.0, weak=-85.0)
    got = {x.site_id: (x.median_rsrp, x.mrs, x.grids, round(x.weak_pct, 6)) for x in df.collect()}
    want, held = {}, 0
    for name in {s[0] for s in sites}:
        near = [(v, w) for s in sites if s[0] == name for la, lo, v, w in rows
                if la is not None and round(flat(s[1:], (la, lo)), 6) <= 300.0]
        if near:
            total, run, held = sum(w for _, w in near), 0.0, held + len(near)
            weak = 100 * sum(w for v, w in near if v is not None and v < -85) / total
            for v, w in sorted(near, key=lambda x: (x[0] is not None, x[0])):
                run += w
                if run >= total / 2 and w:
                    break
            want[name] = (v, total, len(near), round(weak, 6))
    assert got == want and len(want) == 30
    assert joined_rows(df) < 0.5 * held


def test_points_among_overlapping_areas_meet_few_of_their_edges(spark):
    r = random.Random(2)
    def square(x, y, half):
        return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
    boxes = [(47.0 + r.random() * 0.004, 30.0 + r.random() * 0.004, 0.0003 + r.random() * 0.0012) for _ in range(250)]
    areas = spark.createDataFrame([(i, f"A{i}", [square(*b)]) for i, b in enumerate(boxes)],
                                  "seq int, name string, rings array<array<struct<lon: double, lat: double>>>")
    points = [(i, 29.997 + r.random() * 0.01, 46.997 + r.random() * 0.01) for i in range(300)]
    df = PG.place_in_area(spark.createDataFrame(points, "id int, latitude double, longitude double"), "id", areas,
                          snap_m=200.0, cell_m=60.0)
    want = {}
    for i, la, lo in points:
        kx, found = 111_320.0 * math.cos(math.radians(la)), []
        for seq, (x, y, h) in enumerate(boxes):
            if abs(lo - x) < h and abs(la - y) < h:
                found.append((0.0, seq, seq))
            else:
                dx, dy = max(abs(lo - x) - h, 0) * kx, max(abs(la - y) - h, 0) * 110_540.0
                found.append((round(math.hypot(dx, dy), 6), 1000 - seq, seq))
        d, _, seq = min(found)
        if d <= 200:
            want[i] = (f"A{seq}", round(d, 3))
    assert {x.id: (x.area, round(x.snapped_m, 3)) for x in df.collect()} == want
    assert {d == 0 for _, d in want.values()} == {True, False} and len(want) < len(points)
