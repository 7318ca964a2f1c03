import numpy as np
import pandas as pd
import pytest

from radiolake.operators import coverage as C
from radiolake.operators import params as P
from radiolake.operators import polygons as PG
from radiolake.operators import spatial as S


def flat(lat1, lon1, lat2, lon2):
    dx = (lon2 - lon1) * 111320.0 * np.cos(np.radians(lat1))
    return np.round(np.hypot(dx, (lat2 - lat1) * 111320.0), 6)


@pytest.mark.parametrize("k", [1, 6])
def test_k_nearest_matches_brute_force_on_uneven_places(spark, k):
    rng = np.random.default_rng(11)
    # a dense town, a thin countryside, and one place far from everything
    town = rng.normal([30.5, 47.5], 0.004, (300, 2))
    country = rng.uniform([29.0, 46.0], [32.0, 49.0], (60, 2))
    places = np.vstack([town, country, [[36.0, 40.0]]])
    pts = np.vstack([rng.normal([30.5, 47.5], 0.01, (60, 2)), rng.uniform([28.0, 45.0], [33.0, 50.0], (60, 2)),
                     [[37.5, 38.0], [60.0, 10.0]]])
    pl = pd.DataFrame({"place": [f"p{i:04d}" for i in range(len(places))], "latitude": places[:, 0],
                       "longitude": places[:, 1]})
    po = pd.DataFrame({"pid": range(len(pts)), "latitude": pts[:, 0], "longitude": pts[:, 1]})
    got = S.k_nearest(spark.createDataFrame(po), "pid", spark.createDataFrame(pl), "place", k).toPandas()
    got = got.sort_values(["pid", "rank"])
    for i in range(len(pts)):
        d = flat(pts[i, 0], pts[i, 1], places[:, 0], places[:, 1])
        want = sorted(zip(d, pl["place"]))[:k]
        mine = got[got["pid"] == i]
        assert list(mine["place"]) == [w[1] for w in want]
        assert np.allclose(mine["dist_m"], [w[0] for w in want], atol=1e-3)


@pytest.mark.parametrize("metric", ["flat", "haversine"])
def test_k_nearest_with_crowded_positions_and_far_points(spark, metric):
    rng = np.random.default_rng(3)
    crowd = pd.DataFrame({"place": [f"c{i:05d}" for i in range(10_000)], "latitude": 30.5, "longitude": 47.5})
    thin = pd.DataFrame({"place": [f"t{i}" for i in range(40)], "latitude": rng.uniform(29, 32, 40),
                         "longitude": rng.uniform(46, 49, 40)})
    pl = pd.concat([crowd, thin], ignore_index=True)
    pts = np.vstack([np.tile([30.5, 47.5], (3000, 1)), [[30.5003, 47.5], [39.5, 47.5], [31.0, 36.0]],
                     rng.uniform([29, 46], [32, 49], (20, 2))])
    po = pd.DataFrame({"pid": range(len(pts)), "latitude": pts[:, 0], "longitude": pts[:, 1]})
    po["own"] = np.where(po.pid < 3000, "c00001", "")
    got = S.k_nearest(spark.createDataFrame(po), "pid", spark.createDataFrame(pl), "place", 3,
                      exclude="own", metric=metric).toPandas().sort_values(["pid", "rank"])
    assert len(got) == 3 * len(pts)
    assert set(got[got.pid < 3000].place) == {"c00000", "c00002", "c00003"}
    for i in range(3000, len(pts)):
        if metric == "flat":
            d = flat(pts[i, 0], pts[i, 1], pl.latitude.to_numpy(), pl.longitude.to_numpy())
        else:
            a, b = np.radians(pts[i]), np.radians(pl[["latitude", "longitude"]].to_numpy())
            h = np.sin((b[:, 0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - a[1]) / 2) ** 2
            d = 2 * 6371008.8 * np.arcsin(np.sqrt(h))
        want = sorted(zip(np.round(d, 3), pl.place))[:3]
        mine = got[got.pid == i]
        assert np.allclose(mine.dist_m, [w[0] for w in want], atol=2e-3)
        assert list(mine.place) == [w[1] for w in want]


def test_best_server_is_not_limited_to_the_nearest_sites(spark):
    rows = [(f"s{i}", f"n{i}", 30.0, 47.0 + (i + 1) * 1e-4, 90.0) for i in range(9)]  # all face away
    rows.append(("far", "f", 30.0, 47.0 + 12e-4, 270.0))
    sectors = spark.createDataFrame(rows, "sector_id string, site_id string, latitude double, "
                                          "longitude double, azimuth_deg double")
    point = spark.createDataFrame([(1, 30.0, 47.0 + 11e-4)], "pid int, latitude double, longitude double")
    best = S.best_server(point, "pid", sectors).first()
    assert best["sector_id"] == "s8" or best["score"] <= best["dist_m"] * 8.7
    west = spark.createDataFrame([(1, 30.0, 47.0)], "pid int, latitude double, longitude double")
    got = S.best_server(west, "pid", sectors).first()
    scores = {r[0]: flat(30.0, 47.0, r[2], r[3]) * (1 + ((180 if r[4] == 90 else 0) / 65) ** 2) for r in rows}
    assert got["sector_id"] == min(scores, key=scores.get)


def test_k_nearest_excludes_itself_and_returns_all_when_few(spark):
    pl = spark.createDataFrame([("a", 30.0, 47.0), ("b", 30.001, 47.0), ("c", 35.0, 47.0)],
                               "site_id string, latitude double, longitude double")
    isd = {r["site_id"]: r["isd_m"] for r in S.inter_site_distance(pl).collect()}
    assert isd["a"] == pytest.approx((111.195 + 555975.4) / 2, rel=1e-3)


def test_nearest_within_and_radius(spark):
    rng = np.random.default_rng(2)
    grid = pd.DataFrame({"latitude": 30 + rng.uniform(0, .02, 2000), "longitude": 47 + rng.uniform(0, .02, 2000),
                         "rsrp": rng.uniform(-120, -70, 2000)})
    pts = pd.DataFrame({"pid": range(100), "latitude": 30 + rng.uniform(-.002, .022, 100),
                        "longitude": 47 + rng.uniform(-.002, .022, 100)})
    got = S.nearest_within(spark.createDataFrame(pts), "pid", spark.createDataFrame(grid), 80.0,
                           ["rsrp"]).toPandas().set_index("pid")
    for p in pts.itertuples():
        d = flat(p.latitude, p.longitude, grid["latitude"].to_numpy(), grid["longitude"].to_numpy())
        if d.min() <= 80:
            assert got.loc[p.pid, "dist_m"] == pytest.approx(d.min(), abs=1e-3)
        else:
            assert p.pid not in got.index


def test_points_in_polygons_holes_and_snap(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    poly = spark.createDataFrame(
        [(0, "A", [box(47.0, 30.0, 47.1, 30.1), box(47.04, 30.04, 47.06, 30.06)]),
         (1, "B", [box(47.1, 30.0, 47.2, 30.1)])],
        "seq int, name string, rings array<array<struct<lon: double, lat: double>>>")
    pts = spark.createDataFrame([(1, 30.02, 47.02), (2, 30.05, 47.15), (3, 30.05, 47.21),
                                 (4, 30.05, 47.3), (5, None, 47.0)],
                                "pid int, latitude double, longitude double")
    got = {r["pid"]: (r["area"], r["snapped_m"]) for r in PG.place_in_area(pts, "pid", poly).collect()}
    assert got[1] == ("A", 0.0) and got[2] == ("B", 0.0)
    assert got[3][0] == "B" and got[3][1] == pytest.approx(0.01 * 111320 * np.cos(np.radians(30.05)), rel=1e-6)
    assert 4 not in got and 5 not in got


def test_grid_finds_its_own_lattice(spark):
    n = np.arange(40)
    lat, lon = np.meshgrid(30.0002 + n * 0.00045, 47.0001 + n * 0.00045)
    pdf = pd.DataFrame({"lat": lat.ravel(), "lon": lon.ravel(), "rsrp": -80.0, "mr": 2.0})
    df = spark.createDataFrame(pd.concat([pdf, pdf]))
    spec = C.grid_spec(df).collect()[0]
    assert spec["step_lat"] == pytest.approx(0.00045) and spec["step_lon"] == pytest.approx(0.00045)
    g = C.build_grid(df).toPandas()
    assert len(g) == 1600 and set(g["points"]) == {2} and set(g["mr"]) == {4.0}


def test_azimuth_gaps_and_merge(spark):
    s = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("a", 180.0), ("b", 90.0)],
                              "site_id string, azimuth_deg double")
    g = {r["site_id"]: r for r in S.azimuth_gaps(s).collect()}
    assert (g["a"]["largest_gap"], g["a"]["gap_centre"], g["a"]["smallest_step"]) == (170.0, 95.0, 20.0)
    assert (g["b"]["largest_gap"], g["b"]["gap_centre"]) == (360.0, 270.0)
    m = {r["site_id"]: r["azimuths"] for r in S.merge_azimuths(s, 25.0).collect()}
    assert m["a"] == [10.0, 180.0]


def test_missing_positions_are_not_far_away(spark):
    one = "site_id string, latitude double, longitude double"
    d = spark.createDataFrame([("a", None, None)], one)
    t = spark.createDataFrame([("a", 30.0, 47.0, True)], one + ", on boolean")
    p = spark.createDataFrame([("a", 30.0, 47.0, "On Air")], one + ", status string")
    r = P.reconcile_sites(d, t, p).collect()[0]
    assert r["status"] == "On Air" and r["review"] == []


def test_area_names_by_equal_text_then_by_tokens(spark):
    geo = spark.createDataFrame([("Al Zubair Center",), ("Al Faw",), ("Abu Khaseeb North Side",)],
                                "subdistrict string")
    names = spark.createDataFrame([("al-zubair CENTER",), ("Abu Khaseeb North",), ("Al Other",),
                                   ("Faw",), (None,)], "area string")
    got = {r["area"]: (r["subdistrict"], round(r["score"], 3))
           for r in S.geocode_area(names, "area", geo).collect()}
    assert got == {"al-zubair CENTER": ("Al Zubair Center", 1.0),
                   "Abu Khaseeb North": ("Abu Khaseeb North Side", 0.75)}


def brute_area(lat, lon, areas, snap):
    """(seq, distance) by the definition, over all edges of all areas."""
    def edges(ring):
        return zip(ring, ring[1:] + ring[:1], strict=True)

    def odd(ring):
        return sum((b[1] > lat) != (a[1] > lat) and lon < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1]) + a[0]
                   for a, b in edges(ring)) % 2 == 1

    def gap(a, b):
        kx, ky = 111320.0 * np.cos(np.radians(lat)), 110540.0
        x, y, dx, dy = (a[0] - lon) * kx, (a[1] - lat) * ky, (b[0] - a[0]) * kx, (b[1] - a[1]) * ky
        t = min(1.0, max(0.0, -(x * dx + y * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return np.hypot(x + t * dx, y + t * dy)

    held = [k for k, parts in areas.items() if any(odd(p[0]) and not any(map(odd, p[1:])) for p in parts)]
    if held:
        return min(held), 0.0
    near = [(round(min(gap(a, b) for p in parts for a, b in edges(p[0])), 6), -k) for k, parts in areas.items()]
    d, k = min(near)
    return (-k, d) if d <= snap else None


PARTS = "seq int, name string, parts array<array<array<struct<lon: double, lat: double>>>>"


@pytest.mark.parametrize("cell_m", [90.0, 700.0, 5000.0])
def test_areas_by_brute_force(spark, cell_m):
    """Ragged rings with holes and several parts, overlapping areas, points on corners and edges."""
    rng = np.random.default_rng(2)

    def ring(x, y, r, n):
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        far = r * rng.uniform(0.4, 1, n)
        return [(float(x + f * np.cos(t)), float(y + f * np.sin(t))) for t, f in zip(turn, far, strict=True)]

    areas = {k: [[ring(x, y, 0.006, 40), ring(x, y, 0.001, 7), ring(x + 0.0015, y, 0.0004, 5)],
                 [ring(x + 0.02, y - 0.01, 0.003, 3)]]
             for k, (x, y) in enumerate(rng.uniform(-0.02, 0.02, (9, 2)) + [[10.0, 60.0]])}
    areas[9] = [[[(10.0, 60.0), (10.01, 60.0), (10.01, 60.01), (10.0, 60.01)]]]
    areas[10] = [[[(9.99, 59.99)] * 3]]
    poly = spark.createDataFrame([(k, f"n{k}", parts) for k, parts in areas.items()], PARTS)
    spots = (rng.uniform(-0.03, 0.05, (400, 2)) + [10.0, 60.0]).tolist()
    spots += [(10.0, 60.0), (10.005, 60.0), (10.01, 60.005), (10.005, 60.005), *areas[3][0][0][:9]]
    pts = spark.createDataFrame([(k, y, x) for k, (x, y) in enumerate(spots)],
                                "pid int, latitude double, longitude double")
    got = {r["pid"]: (int(r["area"][1:]), r["snapped_m"]) for r in
           PG.place_in_area(pts, "pid", poly, snap_m=300.0, cell_m=cell_m).collect()}
    for k, (x, y) in enumerate(spots):
        want = brute_area(y, x, areas, 300.0)
        assert (k in got) == (want is not None), (k, x, y, want, got.get(k))
        if want:
            assert got[k][1] == pytest.approx(want[1], abs=1e-5)
            assert got[k][0] == want[0] or want[1] > 0 and abs(got[k][1] - want[1]) < 1e-5


def test_area_of_a_hundred_thousand_edges(spark):
    """A point meets the edges of its strip, not the ring: the pairs of the join are counted."""
    n = 100_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = 0.5 + 0.01 * np.sin(300 * turn)
    ring = [(float(x), float(y)) for x, y in zip(47 + far * np.cos(turn), 30 + far * np.sin(turn), strict=True)]
    poly = spark.createDataFrame([(0, "big", [[ring]])], PARTS)
    rng = np.random.default_rng(3)
    spots = rng.uniform(-0.6, 0.6, (3000, 2))
    pts = spark.createDataFrame([(k, float(30 + y), float(47 + x)) for k, (x, y) in enumerate(spots)],
                                "pid int, latitude double, longitude double")
    got = {r["pid"] for r in PG.place_in_area(pts, "pid", poly, snap_m=1.0).collect()}
    r, phi = np.hypot(*spots.T), np.arctan2(spots[:, 1], spots[:, 0])
    clear = np.abs(r - (0.5 + 0.01 * np.sin(300 * phi))) > 1e-4
    want = r < 0.5 + 0.01 * np.sin(300 * phi)
    assert all((k in got) == want[k] for k in np.flatnonzero(clear).tolist())
    edges = PG.edge_table(poly)
    sizes = PG.strips(edges)
    assert PG.edge_strips(edges, sizes).count() <= 3 * n
    cells = PG.area_cells(edges, sizes, PG.edge_strips(edges, sizes))
    assert cells.where("whole").count() > 200
