"""Registered queries: geometry, joins by position, coverage grids, polygons."""

from pyspark.sql import functions as F

from radiolake.functions import geo as G
from radiolake.operators import coverage as C
from radiolake.operators import polygons as PG
from radiolake.operators import spatial as S
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.health import r6
from radiolake.plans.registry import query


# the same formulas as SQL text
def q_flat(la1, lo1, la2, lo2, at=None):
    at = at or la1
    return (f"round(sqrt(pow(({lo2} - {lo1}) * 111320.0::DOUBLE * cos(radians({at})), 2) + "
            f"pow(({la2} - {la1}) * 111320.0::DOUBLE, 2)), 6)")


def q_hav(la1, lo1, la2, lo2):
    return (f"(2 * 6371008.8::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({la2} - {la1}) / 2), 2)"
            f" + cos(radians({la1})) * cos(radians({la2})) * "
            f"pow(sin(radians({lo2} - {lo1}) / 2), 2)))))")


def q_brg(la1, lo1, la2, lo2):
    return (f"round(fmod(degrees(atan2(sin(radians({lo2} - {lo1})) * cos(radians({la2})), "
            f"cos(radians({la1})) * sin(radians({la2})) - sin(radians({la1})) * "
            f"cos(radians({la2})) * cos(radians({lo2} - {lo1})))) + 360.0::DOUBLE, 360.0::DOUBLE), 6)")


def q_gap(a, b):
    return (f"round(CASE WHEN fmod(abs({a} - {b}), 360.0::DOUBLE) > 180 THEN 360.0 - "
            f"fmod(abs({a} - {b}), 360.0::DOUBLE) ELSE fmod(abs({a} - {b}), 360.0::DOUBLE) END, 6)")


A.CTES["nearsites"] = f"""
SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY d, site) AS rn FROM (
  SELECT t.ticket_id, t.latitude AS p_lat, t.longitude AS p_lon, s.site_id AS site, s.air,
    {q_flat('t.latitude', 't.longitude', 's.latitude', 's.longitude')} AS d
  FROM tickets t, sites s)"""

A.CTES["scored"] = f"""
SELECT *, round(dist_m * (1.0 + pow(off_deg / 65.0, 2)), 6) AS score FROM (
  SELECT *, {q_gap('azimuth_deg', 'bearing_deg')} AS off_deg FROM (
    SELECT n.ticket_id, n.rn, s.sector_id, s.site_id, s.azimuth_deg, s.air,
      {q_flat('n.p_lat', 'n.p_lon', 's.latitude', 's.longitude')} AS dist_m,
      {q_brg('s.latitude', 's.longitude', 'n.p_lat', 'n.p_lon')} AS bearing_deg
    FROM nearsites n JOIN sectors s ON s.site_id = n.site))"""

A.CTES["bserver"] = """
SELECT ticket_id, first(sector_id ORDER BY score, sector_id) AS sector_id,
  first(site_id ORDER BY score, sector_id) AS site_id,
  first(dist_m ORDER BY score, sector_id) AS dist_m,
  first(bearing_deg ORDER BY score, sector_id) AS bearing_deg,
  first(off_deg ORDER BY score, sector_id) AS off_deg, min(score) AS score
FROM scored GROUP BY ticket_id"""


@query("j08_k_nearest_sites", with_ctes("""
SELECT ticket_id, site AS site_id, d AS dist_m, rn AS rank FROM nearsites WHERE rn <= 8"""))
def _(spark, d):
    n = S.k_nearest(A.tickets(spark, d), "ticket_id", A.sites(spark, d), "site_id", 8)
    return n.withColumn("rank", F.col("rank").cast("bigint"))


@query("j08_nearest_on_air", with_ctes("""
SELECT ticket_id, first(site ORDER BY rn) AS site_id, first(d ORDER BY rn) AS dist_m
FROM nearsites WHERE air = 'onair' GROUP BY 1"""))
def _(spark, d):
    on_air = A.sites(spark, d).filter(F.col("air") == "onair")
    return S.k_nearest(A.tickets(spark, d), "ticket_id", on_air, "site_id", 1).drop("rank")


@query("j09_best_server", with_ctes("""
SELECT ticket_id, sector_id, site_id, dist_m, off_deg,
  score FROM bserver"""))
def _(spark, d):
    b = S.best_server(A.tickets(spark, d), "ticket_id", A.sectors(spark, d))
    return b.select("ticket_id", "sector_id", "site_id", "dist_m",
                    "off_deg", "score")


# tickets of the mapped network: the serving site is one of the mapped sites
A.CTES["mtickets"] = """
SELECT ticket_id, 'S' || lpad((ticket_id % (SELECT count(*) FROM sites))::VARCHAR, 5, '0') AS site_id,
  latitude, longitude FROM tickets"""


def mapped_tickets(spark, d):
    n = A.sites(spark, d).agg(F.count(F.lit(1)).alias("n_sites"))
    from radiolake.operators.common import with_scalars
    t = with_scalars(A.tickets(spark, d).select("ticket_id", "latitude", "longitude"), n)
    return t.select("ticket_id", F.concat(F.lit("S"), F.lpad(
        (F.col("ticket_id") % F.col("n_sites")).cast("string"), 5, "0")).alias("site_id"),
        "latitude", "longitude")


A.CTES["facing"] = f"""
SELECT ticket_id, first(sector_id ORDER BY off_deg, sector_id) AS sector_id,
  any_value(site_id) AS site_id, min(off_deg) AS off_deg,
  first(dist_m ORDER BY off_deg, sector_id) AS dist_m,
  first(bearing_deg ORDER BY off_deg, sector_id) AS bearing_deg
FROM (SELECT *, {q_gap('azimuth_deg', 'bearing_deg')} AS off_deg FROM (
  SELECT t.ticket_id, s.sector_id, s.site_id, s.azimuth_deg,
    {q_flat('s.latitude', 's.longitude', 't.latitude', 't.longitude',
            '(s.latitude + t.latitude) / 2')} AS dist_m,
    {q_brg('s.latitude', 's.longitude', 't.latitude', 't.longitude')} AS bearing_deg
  FROM mtickets t JOIN sectors s USING (site_id))) GROUP BY ticket_id"""


@query("j10_facing_sector", with_ctes("""
SELECT ticket_id, sector_id, site_id, off_deg, dist_m FROM facing"""))
def _(spark, d):
    f = S.facing_sector(mapped_tickets(spark, d), "ticket_id", A.sectors(spark, d))
    return f.select("ticket_id", "sector_id", "site_id", "off_deg",
                    "dist_m")


# the greedy fold over directions, spelled as a recursive walk of the sorted candidates
NEIGHBOURS_SQL = f"""
WITH RECURSIVE {{ctes}},
cand AS (SELECT ticket_id, site_id, first(sector_id ORDER BY off_deg, sector_id) AS sector_id,
    min(off_deg) AS off_deg, first(dist_m ORDER BY off_deg, sector_id) AS dist_m,
    fmod(first(bearing_deg ORDER BY off_deg, sector_id) + 180.0::DOUBLE, 360.0::DOUBLE) AS toward
  FROM scored s WHERE off_deg <= 60 AND dist_m <= 3000 AND site_id <>
    (SELECT b.site_id FROM bserver b WHERE b.ticket_id = s.ticket_id) GROUP BY 1, 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY ticket_id
    ORDER BY dist_m, off_deg, sector_id) AS n FROM cand),
walk AS (
  SELECT ticket_id, 0::BIGINT AS n, CASE WHEN dist_m >= 1
      THEN [fmod(bearing_deg + 180.0::DOUBLE, 360.0::DOUBLE)] ELSE []::DOUBLE[] END AS taken,
    NULL::VARCHAR AS sector_id, NULL::VARCHAR AS site_id, NULL::DOUBLE AS dist_m, false AS kept
  FROM bserver
  UNION ALL
  SELECT w.ticket_id, o.n,
    CASE WHEN o.dist_m >= 1 AND len(list_filter(w.taken, lambda t: {q_gap('t', 'o.toward')} < 30)) = 0
      THEN list_append(w.taken, o.toward) ELSE w.taken END,
    o.sector_id, o.site_id, o.dist_m,
    o.dist_m < 1 OR len(list_filter(w.taken, lambda t: {q_gap('t', 'o.toward')} < 30)) = 0
  FROM walk w JOIN ordered o ON o.ticket_id = w.ticket_id AND o.n = w.n + 1)
SELECT ticket_id, row_number() OVER (PARTITION BY ticket_id ORDER BY n) AS rank, sector_id, site_id,
  dist_m FROM walk WHERE kept"""


def _neighbours_oracle():
    text = with_ctes("SELECT * FROM scored, bserver")
    return NEIGHBOURS_SQL.replace("{ctes}", text[5:text.rindex("\nSELECT * FROM scored")])


@query("j11_neighbour_sectors", _neighbours_oracle())
def _(spark, d):
    t, sec = A.tickets(spark, d), A.sectors(spark, d)
    n = S.neighbour_sectors(t, "ticket_id", sec, S.best_server(t, "ticket_id", sec))
    return n.select("ticket_id", F.col("rank").cast("bigint").alias("rank"), "sector_id",
                    "site_id", "dist_m")


@query("j13_inter_site_distance", with_ctes(f"""
SELECT site_id, round(avg(dm), 4) AS isd_m FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY dm, other) AS rn FROM (
    SELECT a.site_id, b.site_id AS other,
      round({q_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 6) AS dm
    FROM sites a JOIN sites b ON a.site_id <> b.site_id)) WHERE rn <= 3 GROUP BY 1"""))
def _(spark, d):
    return S.inter_site_distance(A.sites(spark, d)).withColumn("isd_m", F.round("isd_m", 4))


@query("j14_isolation", with_ctes(f"""
SELECT site_id, nearest_site, nearest_m, nearest_m > 800 AS isolated,
  coalesce(planned_near, 0)::BIGINT AS planned_near FROM (SELECT site_id FROM sites)
LEFT JOIN (SELECT site_id, first(other ORDER BY d, other) AS nearest_site, min(d) AS nearest_m
   FROM pairs WHERE air = 'onair' GROUP BY 1) USING (site_id)
LEFT JOIN (SELECT site_id, count(CASE WHEN air = 'planned' AND d < 600 THEN 1 END) AS planned_near
   FROM pairs GROUP BY 1) USING (site_id)""", pairs=f"""
SELECT a.site_id, b.site_id AS other, b.air,
  {q_flat('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d
FROM sites a JOIN sites b ON a.site_id <> b.site_id"""))
def _(spark, d):
    return S.isolation(A.sites(spark, d), isolated_m=800.0, planned_m=600.0)


@query("j07_nearest_grid", with_ctes(f"""
SELECT ticket_id, round(first(rsrp ORDER BY d, rsrp, mr), 6) AS rsrp,
  first(mr ORDER BY d, rsrp, mr) AS mr, min(d) AS dist_m FROM (
  SELECT t.ticket_id, rsrp, mr, {q_flat('t.latitude', 't.longitude', 'g.lat', 'g.lon')} AS d
  FROM tickets t JOIN grid g ON abs(t.latitude - g.lat) < 0.002 AND abs(t.longitude - g.lon) < 0.002)
WHERE d <= 30 GROUP BY 1"""))
def _(spark, d):
    g = A.coverage(spark, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    n = S.nearest_within(A.tickets(spark, d), "ticket_id", g, 30.0, ["rsrp", "mr"])
    return r6(n, "rsrp")


# --------------------------------------------------------------------- coverage
A.CTES["gspec"] = """
SELECT step_lat, step_lon,
  (round_even(la_min / step_lat - la_off, 0) + la_off - 0.5) * step_lat AS lat0,
  (round_even(lo_min / step_lon - lo_off, 0) + lo_off - 0.5) * step_lon AS lon0
FROM (SELECT any_value(step_lat) AS step_lat, any_value(step_lon) AS step_lon,
    min(lat) AS la_min, min(lon) AS lo_min,
    fmod(atan2(avg(sin(2 * pi() * fmod(lat / step_lat, 1.0::DOUBLE))),
      avg(cos(2 * pi() * fmod(lat / step_lat, 1.0::DOUBLE)))) / (2 * pi()) + 1.0, 1.0::DOUBLE) AS la_off,
    fmod(atan2(avg(sin(2 * pi() * fmod(lon / step_lon, 1.0::DOUBLE))),
      avg(cos(2 * pi() * fmod(lon / step_lon, 1.0::DOUBLE)))) / (2 * pi()) + 1.0, 1.0::DOUBLE) AS lo_off
  FROM grid, (SELECT quantile_cont(round(g, 9), 0.5) AS step_lat FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g
      FROM (SELECT DISTINCT round(lat, 6) AS v FROM grid)) WHERE g > 1e-5 AND g < 0.01),
    (SELECT quantile_cont(round(g, 9), 0.5) AS step_lon FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g
      FROM (SELECT DISTINCT round(lon, 6) AS v FROM grid)) WHERE g > 1e-5 AND g < 0.01))"""
A.CTES["gcells"] = """
SELECT floor((lat - lat0) / step_lat)::BIGINT AS iy, floor((lon - lon0) / step_lon)::BIGINT AS ix,
  rsrp, mr FROM grid, gspec"""
A.CTES["gmed"] = """
SELECT iy, ix, min(rsrp) FILTER (cum >= tot / 2) AS rsrp, any_value(tot) AS mr, count(*) AS points
FROM (SELECT *, sum(mr) OVER (PARTITION BY iy, ix ORDER BY rsrp) AS cum,
        sum(mr) OVER (PARTITION BY iy, ix) AS tot FROM gcells) GROUP BY iy, ix"""


@query("a17_grid_spec", with_ctes("""
SELECT round(step_lat, 9) AS step_lat, round(step_lon, 9) AS step_lon, round(lat0, 8) AS lat0,
  round(lon0, 8) AS lon0 FROM gspec"""))
def _(spark, d):
    s = C.grid_spec(A.coverage(spark, d))
    return s.select(F.round("step_lat", 9).alias("step_lat"),
                    F.round("step_lon", 9).alias("step_lon"), F.round("lat0", 8).alias("lat0"),
                    F.round("lon0", 8).alias("lon0"))


@query("a16_a17_weighted_grid", with_ctes("""
SELECT iy, ix, round(rsrp, 6) AS rsrp, mr, points FROM gmed"""))
def _(spark, d):
    return r6(C.build_grid(A.coverage(spark, d)), "rsrp")


@query("a18_grid_pyramid", with_ctes("""
SELECT level, cy, cx, round(min(rsrp) FILTER (cum >= tot / 2), 6) AS rsrp, any_value(tot) AS mr
FROM (SELECT *, sum(mr) OVER (PARTITION BY level, cy, cx ORDER BY rsrp) AS cum,
        sum(mr) OVER (PARTITION BY level, cy, cx) AS tot FROM (
      SELECT level::INTEGER AS level, iy >> level AS cy, ix >> level AS cx, rsrp, mr
      FROM gcells, range(4) r(level))) GROUP BY 1, 2, 3"""))
def _(spark, d):
    return r6(C.grid_pyramid(A.coverage(spark, d), levels=4), "rsrp")


@query("a19_coverage_stats", with_ctes("""
SELECT CASE WHEN rsrp >= -85 THEN 'excellent' WHEN rsrp >= -95 THEN 'good' WHEN rsrp >= -105 THEN
    'fair' WHEN rsrp >= -112 THEN 'poor' ELSE 'very_poor' END AS rsrp_class, count(*) AS grids,
  round(100 * sum(mr) / (SELECT sum(mr) FROM gmed), 6) AS mr_pct,
  round((SELECT 100 * sum(mr) FILTER (rsrp >= -110) / sum(mr) FROM gmed), 6) AS covered_pct
FROM gmed GROUP BY 1"""))
def _(spark, d):
    return r6(C.coverage_stats(C.build_grid(A.coverage(spark, d))), "mr_pct", "covered_pct")


@query("f14_rsrp_class", with_ctes("""
SELECT ((rsrp < -85)::INTEGER + (rsrp < -95)::INTEGER + (rsrp < -105)::INTEGER
  + (rsrp < -112)::INTEGER) AS cls, count(*) AS n FROM grid GROUP BY 1"""))
def _(spark, d):
    return A.coverage(spark, d).groupBy(G.rsrp_class("rsrp").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"))


@query("j06_point_cell", with_ctes("""
SELECT ticket_id, round(rsrp, 6) AS rsrp, mr, points FROM (
  SELECT ticket_id, floor((latitude - lat0) / step_lat)::BIGINT AS iy,
    floor((longitude - lon0) / step_lon)::BIGINT AS ix FROM tickets, gspec)
LEFT JOIN gmed USING (iy, ix)"""))
def _(spark, d):
    t = A.tickets(spark, d).select("ticket_id", "latitude", "longitude")
    return r6(C.at_cell(t, A.coverage(spark, d)).select("ticket_id", "rsrp", "mr", "points"),
              "rsrp")


@query("j12_area_rsrp", with_ctes(f"""
SELECT site_id, round(min(rsrp) FILTER (cum >= tot / 2), 6) AS median_rsrp, any_value(tot) AS mrs,
  count(*) AS grids, round(100.0 * sum(CASE WHEN rsrp < -110 THEN mr ELSE 0 END) / any_value(tot), 6)
  AS weak_pct
FROM (SELECT *, sum(mr) OVER (PARTITION BY site_id ORDER BY rsrp) AS cum,
        sum(mr) OVER (PARTITION BY site_id) AS tot FROM (
    SELECT site_id, rsrp, mr, {q_flat('s.latitude', 's.longitude', 'g.lat', 'g.lon')} AS d
    FROM sites s JOIN grid g ON abs(s.latitude - g.lat) < 0.01) WHERE d <= 500) GROUP BY 1"""))
def _(spark, d):
    a = C.area_rsrp(A.sites(spark, d), A.coverage(spark, d))
    return r6(a.withColumn("grids", F.col("grids").cast("bigint")), "median_rsrp", "weak_pct")


# --------------------------------------------------------------------- polygons
def _box(lo_lon, lo_lat, hi_lon, hi_lat):
    return [(lo_lon, lo_lat), (hi_lon, lo_lat), (hi_lon, hi_lat), (lo_lon, hi_lat)]


# four squares, the first with a hole: seq, name, district, governorate, rings
AREAS = [
    (0, "Alpha", "Al-First", "North", [_box(47.0, 30.0, 47.01, 30.01),
                                       _box(47.004, 30.004, 47.006, 30.006)]),
    (1, "Beta", "Second", "North", [_box(47.01, 30.0, 47.02, 30.01)]),
    (2, "Gamma", "Al-Third", "South", [_box(47.0, 30.01, 47.01, 30.02)]),
    (3, "Delta", "Fourth", "South", [_box(47.012, 30.012, 47.02, 30.02)]),
]
AREA_SCHEMA = ("seq int, name string, district string, governorate string, "
               "rings array<array<struct<lon: double, lat: double>>>")


def areas(spark):
    return spark.createDataFrame(AREAS, AREA_SCHEMA)


def _edges_sql():
    rows = []
    for seq, name, _d, _g, rings in AREAS:
        for ring_no, ring in enumerate(rings):
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                rows.append(f"({seq}, '{name}', {ring_no}, {x0}::DOUBLE, {y0}::DOUBLE, "
                            f"{x1}::DOUBLE, {y1}::DOUBLE)")
    return "SELECT * FROM (VALUES " + ",\n".join(rows) + ") e(seq, name, ring, x0, y0, x1, y1)"


A.CTES["area_edges"] = _edges_sql()


def area_sql(points, pid):
    return f"""
SELECT {pid}, first(name ORDER BY inside DESC, dm, CASE WHEN inside THEN seq ELSE -seq END) AS area,
  first(dm ORDER BY inside DESC, dm, CASE WHEN inside THEN seq ELSE -seq END) AS snapped_m
FROM (SELECT {pid}, seq, name, inside, CASE WHEN inside THEN 0.0 ELSE round(dm, 6) END AS dm FROM (
  SELECT {pid}, seq, name,
    sum(cross0) % 2 = 1 AND sum(cross1) % 2 = 0 AS inside, min(dm) AS dm
  FROM (SELECT {pid}, seq, name,
      CASE WHEN ring = 0 AND hit THEN 1 ELSE 0 END AS cross0,
      CASE WHEN ring = 1 AND hit THEN 1 ELSE 0 END AS cross1,
      CASE WHEN ring = 0 THEN sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) END AS dm
    FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0,
          -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM (
      SELECT p.{pid}, e.seq, e.name, e.ring,
        y0 <> y1 AND ((y1 > p.latitude) <> (y0 > p.latitude)) AND p.longitude <
          (x1 - x0) * (p.latitude - y0) / (CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END) + x0 AS hit,
        (x0 - p.longitude) * 111320.0::DOUBLE * cos(radians(p.latitude)) AS ax,
        (y0 - p.latitude) * 110540.0::DOUBLE AS ay,
        (x1 - x0) * 111320.0::DOUBLE * cos(radians(p.latitude)) AS dx,
        (y1 - y0) * 110540.0::DOUBLE AS dy
      FROM {points} p, area_edges e))) GROUP BY 1, 2, 3))
WHERE inside OR dm <= 700 GROUP BY 1"""


@query("j15_point_in_polygon", with_ctes(area_sql("tickets", "ticket_id")))
def _(spark, d):
    return PG.place_in_area(A.tickets(spark, d), "ticket_id", areas(spark), snap_m=700.0)


A.CTES["placed"] = area_sql("hsites", "site_id").replace("dm <= 700", "dm <= 2000")


@query("j21_site_regions", with_ctes("""
SELECT site_id, coalesce(area, 'Outside the areas') AS sup_district,
  coalesce(CASE area WHEN 'Alpha' THEN 'First' WHEN 'Beta' THEN 'Second' WHEN 'Gamma' THEN 'Third'
    WHEN 'Delta' THEN 'Fourth' END, city) AS city,
  coalesce(CASE WHEN area IN ('Alpha', 'Beta') THEN 'North' WHEN area IS NOT NULL THEN 'South' END,
    governorate) AS governorate, round(snapped_m, 4) AS snapped_m
FROM hsites LEFT JOIN placed USING (site_id)"""))
def _(spark, d):
    s = A.hourly_sites(spark, d)
    r = PG.site_regions(s.select("site_id", "latitude", "longitude"), areas(spark), s)
    return r.select("site_id", "sup_district", "city", "governorate",
                    F.round("snapped_m", 4).alias("snapped_m"))


# every supplier has an area: a star of 12 corners with a hole, and a triangle apart from it
STAR_SQL = """
SELECT s_suppkey::INT AS seq, 'Area ' || s_suppkey::VARCHAR AS name, part, ring,
  47.0 + (s_suppkey % 9) * 0.004::DOUBLE + CASE part WHEN 0 THEN r * sin(radians(30.0 * j)) ELSE 0.0031 + r * sin(radians(120.0 * j)) END AS lon,
  30.0 + (s_suppkey // 9 % 9) * 0.004::DOUBLE + CASE part WHEN 0 THEN r * cos(radians(30.0 * j)) ELSE 0.0031 + r * cos(radians(120.0 * j)) END AS lat,
  j, CASE part WHEN 0 THEN 12 ELSE 3 END AS n
FROM (SELECT s_suppkey, part, ring, j, CASE WHEN part = 1 THEN 0.0007::DOUBLE WHEN ring = 1 THEN 0.0004::DOUBLE
    ELSE 0.0008::DOUBLE * (1 + (s_suppkey * 7 + j * 5) % 3) END AS r
  FROM supplier, (VALUES (0, 0), (0, 1), (1, 0)) v(part, ring), range(12) t(j)) WHERE part = 0 OR j < 3"""


def stars(spark, d):
    k = F.col("s_suppkey")
    west, south = 47.0 + k % 9 * 0.004, 30.0 + F.floor(k / 9) % 9 * 0.004

    def ring(n, radius, shift=0.0):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(
            (west + shift + radius(j) * F.sin(F.radians(j * (360.0 / n)))).alias("lon"),
            (south + shift + radius(j) * F.cos(F.radians(j * (360.0 / n)))).alias("lat")))

    outer = ring(12, lambda j: 0.0008 * (1 + (k * 7 + j * 5) % 3))
    parts = F.array(F.array(outer, ring(12, lambda j: F.lit(0.0004))),
                    F.array(ring(3, lambda j: F.lit(0.0007), 0.0031)))
    return A.table(spark, d, "supplier").select(
        k.cast("int").alias("seq"), F.concat(F.lit("Area "), k.cast("string")).alias("name"), parts.alias("parts"))


A.CTES["stars"] = STAR_SQL
A.CTES["star_edges"] = """
SELECT a.seq, a.name, a.part, a.ring, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1
FROM stars a JOIN stars b ON a.seq = b.seq AND a.part = b.part AND a.ring = b.ring AND b.j = (a.j + 1) % a.n"""


@query("j15_areas_of_many_parts", with_ctes("""
SELECT ticket_id, first(name ORDER BY inside DESC, d, CASE WHEN inside THEN seq ELSE -seq END) AS area,
  round(first(d ORDER BY inside DESC, d, CASE WHEN inside THEN seq ELSE -seq END), 3) AS snapped_m
FROM (SELECT ticket_id, seq, name, inside, CASE WHEN inside THEN 0.0 ELSE round(dm, 6) END AS d FROM (
  SELECT ticket_id, seq, name, bool_or(held) AS inside, min(dm) AS dm FROM (
    SELECT ticket_id, seq, name, part, sum(CASE WHEN ring = 0 AND hit THEN 1 ELSE 0 END) % 2 = 1
        AND sum(CASE WHEN ring = 1 AND hit THEN 1 ELSE 0 END) % 2 = 0 AS held, min(dm) AS dm
    FROM (SELECT *, CASE WHEN ring = 0 THEN sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) END AS dm
      FROM (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM (
        SELECT p.ticket_id, e.*, y0 <> y1 AND ((y1 > p.latitude) <> (y0 > p.latitude)) AND p.longitude <
            (x1 - x0) * (p.latitude - y0) / (CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END) + x0 AS hit,
          (x0 - p.longitude) * 111320.0::DOUBLE * cos(radians(p.latitude)) AS ax, (y0 - p.latitude) * 110540.0::DOUBLE AS ay,
          (x1 - x0) * 111320.0::DOUBLE * cos(radians(p.latitude)) AS dx, (y1 - y0) * 110540.0::DOUBLE AS dy
        FROM tickets p, star_edges e))) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3))
WHERE inside OR d <= 150 GROUP BY 1"""))
def _(spark, d):
    p = PG.place_in_area(A.tickets(spark, d), "ticket_id", stars(spark, d), snap_m=150.0, cell_m=60.0)
    return p.select("ticket_id", "area", F.round("snapped_m", 3).alias("snapped_m"))


@query("j24_around_site", with_ctes(f"""
SELECT centre, site_id, dist_m, rank, sector_id FROM (
  SELECT *, row_number() OVER (PARTITION BY centre ORDER BY dist_m, site_id) AS rank FROM (
    SELECT a.site_id AS centre, b.site_id,
      {q_flat('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS dist_m
    FROM sites a JOIN sites b ON a.site_id <> b.site_id) WHERE dist_m <= 1200)
JOIN (SELECT site_id, sector_id FROM sectors) USING (site_id)"""))
def _(spark, d):
    a = S.around_site(A.sites(spark, d), A.sectors(spark, d))
    return a.withColumn("rank", F.col("rank").cast("bigint"))


@query("w09_azimuth_gaps", with_ctes(f"""
SELECT site_id, count(*) AS directions,
  CASE WHEN count(*) < 2 THEN 360.0 ELSE first(gap ORDER BY gap DESC, az) END AS largest_gap,
  CASE WHEN count(*) < 2 THEN fmod(min(az) + 180.0, 360.0::DOUBLE) ELSE
    fmod(first(az + gap / 2 ORDER BY gap DESC, az), 360.0::DOUBLE) END AS gap_centre,
  min(CASE WHEN gap > 0 THEN least(gap, 360 - gap) END) AS smallest_step
FROM (SELECT *, fmod(coalesce(lead(az) OVER (PARTITION BY site_id ORDER BY az),
        min(az) OVER (PARTITION BY site_id)) - az + 360.0, 360.0::DOUBLE) AS gap
      FROM (SELECT DISTINCT site_id, azimuth_deg AS az FROM sectors)) GROUP BY 1"""))
def _(spark, d):
    return S.azimuth_gaps(A.sectors(spark, d))


@query("w10_merge_azimuths", with_ctes("""
SELECT site_id, array_to_string(list_transform(CASE WHEN len(k) > 1 AND
  (CASE WHEN k[len(k)] - k[1] > 180 THEN 360 - (k[len(k)] - k[1]) ELSE k[len(k)] - k[1] END) <= 50
  THEN k[1:len(k) - 1] ELSE k END, lambda x: x::INTEGER::VARCHAR), ',') AS azimuths
FROM (SELECT site_id, list_reduce(list(DISTINCT azimuth_deg ORDER BY azimuth_deg), lambda acc, x:
  CASE WHEN (CASE WHEN x - acc[len(acc)] > 180 THEN 360 - (x - acc[len(acc)]) ELSE
    x - acc[len(acc)] END) > 50 THEN list_append(acc, x) ELSE acc END, []) AS k
  FROM sectors GROUP BY 1)""").replace(
    "list_reduce(list(DISTINCT azimuth_deg ORDER BY azimuth_deg), lambda acc, x:",
    "list_reduce(list_transform(list(DISTINCT azimuth_deg ORDER BY azimuth_deg), lambda v: [v]), "
    "lambda acc, y:").replace("x - acc[len(acc)]", "y[1] - acc[len(acc)]").replace(
    "list_append(acc, x)", "list_append(acc, y[1])").replace(", []) AS k", ") AS k"))
def _(spark, d):
    m = S.merge_azimuths(A.sectors(spark, d), tolerance=50.0)
    return m.select("site_id", F.array_join(F.transform(
        "azimuths", lambda x: x.cast("int").cast("string")), ",").alias("azimuths"))


# ---------------------------------------------------------- geometry over tables
@query("f01_f04_distances", with_ctes(f"""
SELECT ticket_id, sector_id, round({q_hav('s.latitude', 's.longitude', 't.latitude', 't.longitude')}, 4)
  AS haversine_m, {q_flat('s.latitude', 's.longitude', 't.latitude', 't.longitude')} AS flat_m,
  {q_brg('s.latitude', 's.longitude', 't.latitude', 't.longitude')} AS bearing_deg,
  round(fmod(degrees(atan2((t.longitude - s.longitude) * cos(radians(s.latitude)),
    t.latitude - s.latitude)) + 360.0, 360.0::DOUBLE), 4) AS flat_bearing_deg,
  {q_gap('azimuth_deg', q_brg('s.latitude', 's.longitude', 't.latitude', 't.longitude'))} AS az_gap FROM mtickets t JOIN sectors s USING (site_id)"""))
def _(spark, d):
    t = mapped_tickets(spark, d).withColumnsRenamed({"latitude": "t_lat", "longitude": "t_lon"})
    j = t.join(A.sectors(spark, d), "site_id")
    args = ("latitude", "longitude", "t_lat", "t_lon")
    brg = F.round(G.bearing_deg(*args), 6)
    return j.select(
        "ticket_id", "sector_id", F.round(G.haversine_m(*args), 4).alias("haversine_m"),
        F.round(G.flat_m(*args), 6).alias("flat_m"), brg.alias("bearing_deg"),
        F.round(G.flat_bearing_deg(*args), 4).alias("flat_bearing_deg"),
        F.round(G.az_gap("azimuth_deg", brg), 6).alias("az_gap"))


@query("f05_f07_antenna", with_ctes("""
SELECT sector_id,
  round(greatest(antenna_height_m - 1.5, 1.0) / tan(radians(greatest(total_tilt_deg, 0.05))), 4)
    AS boresight_m,
  round(CASE WHEN total_tilt_deg - 3.25 <= 0.15 THEN 25000.0 ELSE least(greatest(
    antenna_height_m - 1.5, 1.0) / tan(radians(total_tilt_deg - 3.25)), 25000.0) END, 4) AS edge_m,
  round(degrees(atan2(greatest(antenna_height_m - 1.5, 0.5), 800.0)), 4) AS elevation_deg,
  round_even(greatest(0.0, least(16.0, degrees(atan2(greatest(antenna_height_m - 1.5, 0.5), 800.0))
    + 3.25)), 1) AS downtilt,
  round(-least(12 * pow(total_tilt_deg / 6.5, 2), 25.0), 4) AS pattern_db,
  round_even(-least(12 * pow((degrees(atan2(greatest(antenna_height_m - 1.5, 0.5), 800.0))
    - total_tilt_deg - 2) / 6.5, 2), 25.0) + least(12 * pow((degrees(atan2(greatest(
    antenna_height_m - 1.5, 0.5), 800.0)) - total_tilt_deg) / 6.5, 2), 25.0), 2) AS tilt_gain_db
FROM sectors"""))
def _(spark, d):
    h, t = "antenna_height_m", "total_tilt_deg"
    return A.sectors(spark, d).select(
        "sector_id", F.round(G.boresight_m(h, t), 4).alias("boresight_m"),
        F.round(G.edge_m(h, t), 4).alias("edge_m"),
        F.round(G.elevation_deg(h, 800.0), 4).alias("elevation_deg"),
        G.optimal_downtilt(h, 800.0).alias("downtilt"),
        F.round(G.pattern_db(t), 4).alias("pattern_db"),
        G.tilt_gain_db(h, 800.0, t, F.col(t) + 2).alias("tilt_gain_db"))


Q_HATA = """(46.3 + 33.9 * log10(1800.0) - 13.82 * log10(hb)
  - ((1.1 * log10(1800.0) - 0.7) * 1.5 - (1.56 * log10(1800.0) - 0.8))
  + (44.9 - 6.55 * log10(hb)) * log10(greatest({d}, 20.0) / 1000))"""


@query("f08_path_loss", with_ctes(f"""
SELECT sector_id, round(32.44 + 20 * log10(b / 1000) + 20 * log10(1800.0), 4) AS fspl_db,
  round({Q_HATA.format(d='b')} + 3, 4) AS hata_urban,
  round({Q_HATA.format(d='b')} - (2 * pow(log10(1800.0 / 28), 2) + 5.4), 4) AS hata_suburban,
  round({Q_HATA.format(d='b')} - (4.78 * pow(log10(1800.0), 2) - 18.33 * log10(1800.0) + 40.94), 4)
    AS hata_rural
FROM (SELECT sector_id, greatest(antenna_height_m, 20.0) AS hb,
  greatest(antenna_height_m - 1.5, 1.0) / tan(radians(total_tilt_deg)) AS b FROM sectors)"""))
def _(spark, d):
    b = G.boresight_m("antenna_height_m", "total_tilt_deg")
    hata = lambda k: F.round(G.hata_db(b, 1800.0, "antenna_height_m", k), 4)
    return A.sectors(spark, d).select(
        "sector_id", F.round(G.fspl_db(b, 1800.0), 4).alias("fspl_db"),
        hata("urban").alias("hata_urban"), hata("suburban").alias("hata_suburban"),
        hata("rural").alias("hata_rural"))


@query("f09_predicted_best_server", with_ctes(f"""
SELECT ticket_id, first(sector_id ORDER BY rsrp DESC, sector_id) AS sector_id, max(rsrp) AS rsrp
FROM (SELECT ticket_id, sector_id, round_even(27.7 - least(12 * pow((degrees(atan2(greatest(h - 1.5,
    0.5), greatest(dist_m, 1.0))) - tilt) / 6.5, 2), 25.0) - least(12 * pow(off_deg / 65, 2), 25.0)
    - ({Q_HATA.format(d='dist_m')} + 3), 1) AS rsrp
  FROM (SELECT c.*, s.antenna_height_m AS h, greatest(s.antenna_height_m, 20.0) AS hb,
          s.total_tilt_deg AS tilt FROM scored c JOIN sectors s USING (sector_id)
        WHERE dist_m <= 1500)) GROUP BY 1"""))
def _(spark, d):
    return S.predicted_best_server(A.tickets(spark, d), "ticket_id", A.sectors(spark, d))


@query("f10_power_delta", with_ctes("""
SELECT iy, ix, round_even(-105 - rsrp, 1) AS needed_db,
  round_even(CASE WHEN -105 - rsrp <= 0 THEN 0 ELSE least(-105 - rsrp, 3.0) END, 1) AS applied_db,
  round_even(CASE WHEN -105 - rsrp <= 0 THEN -105 - rsrp ELSE -105 - rsrp - least(-105 - rsrp, 3.0)
    END, 1) AS residual_db, -105 - rsrp > 3.0 AS limited FROM gmed"""))
def _(spark, d):
    g = C.build_grid(A.coverage(spark, d))
    return g.select("iy", "ix", G.power_delta("rsrp", -105.0).alias("p")).select("iy", "ix", "p.*")


@query("f11_sector_wedge", with_ctes("""
SELECT sector_id, i AS step,
  round(longitude + r * sin(radians(azimuth_deg - 30 + 60.0 * i / 12))
    / (111320.0 * cos(radians(latitude))), 7) AS lon,
  round(latitude + r * cos(radians(azimuth_deg - 30 + 60.0 * i / 12)) / 111320.0, 7) AS lat
FROM (SELECT *, greatest(150.0, least(1500.0, greatest(antenna_height_m - 1.5, 1.0)
  / tan(radians(total_tilt_deg)))) AS r FROM sectors), range(13) t(i)"""))
def _(spark, d):
    ring = G.wedge_ring("latitude", "longitude", "azimuth_deg", 60.0,
                        G.beam_length_m("antenna_height_m", "total_tilt_deg"))
    arc = A.sectors(spark, d).select("sector_id", F.posexplode(F.slice(ring, 2, 13)).alias("step", "p"))
    return arc.select("sector_id", F.col("step").cast("bigint").alias("step"),
                      F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


# ------------------------------------------------------------------ name geocode
TOKENS_SQL = ("list_sort(list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), "
              "' ')))")


@query("j16_geocode_area", f"""
WITH g AS (SELECT DISTINCT p_name AS subdistrict, {TOKENS_SQL.format('p_name')} AS tok FROM part),
n AS (SELECT DISTINCT p_name || ' / ' || p_type AS name, {TOKENS_SQL.format("p_name || ' / ' || p_type")} AS tok
  FROM part)
SELECT name, first(subdistrict ORDER BY s DESC, subdistrict) AS subdistrict, round(max(s), 6) AS score
FROM (SELECT name, subdistrict, len(list_intersect(n.tok, g.tok))::DOUBLE
        / len(list_distinct(list_concat(n.tok, g.tok))) AS s FROM n, g) WHERE s >= 0.6 GROUP BY 1""")
def _(spark, d):
    part = A.table(spark, d, "part").withColumn("name", F.concat_ws(" / ", "p_name", "p_type"))
    out = S.geocode_area(part, "name", part.select(F.col("p_name").alias("subdistrict")))
    return r6(out, "score")
