"""Joins by position: radius, nearest, k nearest, best server, neighbours.

Positions meet on lattice cells (an equi join), never as a cross product. The k-nearest
join picks for every place the smallest lattice that is certain to hold the answer, so it
is exact whatever the density.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.geo import (BUDGET_DBM, M_PER_DEG, at_least, at_most, az_gap, bearing_deg,
                                     box_m, cell_key, flat_m, hata_db, haversine_m, keys_within,
                                     predict_rsrp)
from radiolake.operators.common import first_by, ranked, top_n_by, unsent, with_scalars


def _pos(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        *[F.col(c) for c in keep], F.col("latitude").alias(f"{prefix}_lat"),
        F.col("longitude").alias(f"{prefix}_lon"))


def radius_join(points: DataFrame, others: DataFrame, metres: float, point_cols: Sequence[str],
                other_cols: Sequence[str], mean_latitude: bool = False) -> DataFrame:
    """Pairs of a point and another position within `metres`, with their distance.

    The points take every lattice cell their circle touches; the other side, usually the
    larger, keeps one key per row.
    """
    p = unsent(_pos(points, "p", point_cols).withColumn(
        "_cell", F.explode(keys_within("p_lat", "p_lon", metres, 1.02))))
    o = _pos(others, "o", other_cols).withColumn("_cell", cell_key("o_lat", "o_lon", metres))
    dist = F.round(flat_m("p_lat", "p_lon", "o_lat", "o_lon", mean_latitude), 6)
    return (p.join(o, "_cell").drop("_cell").withColumn("dist_m", dist)
            .filter(F.col("dist_m") <= metres))


def nearest_within(points: DataFrame, point_id: str, grid: DataFrame, metres: float,
                   values: Sequence[str]) -> DataFrame:
    """Per point: the nearest grid row within `metres` (the lowest values on a tie).

    Rows of the grid at one position collapse first, so a place measured very often does
    not grow the join.
    """
    spots = grid.groupBy("latitude", "longitude").agg(
        F.min(F.struct(*values)).alias("v"))
    pairs = radius_join(points, spots, metres, [point_id], ["v"])
    best = pairs.groupBy(point_id).agg(
        first_by(["v", "dist_m"], "dist_m", "v").alias("w"))
    return best.select(point_id, *[F.col(f"w.v.{c}").alias(c) for c in values],
                       F.col("w.dist_m").alias("dist_m"))


# ------------------------------------------------------------------ k nearest
BASE_M = 125.0
LEVELS = 19  # lattices of 125 m, 250 m ... to more than half of the Earth's circumference
FAR_M = BASE_M * 2 ** (LEVELS - 1)
ROUNDING = 1e-5  # metres that a rounded distance may differ from the measured one


def _level_m(lv: Column) -> Column:
    return F.lit(BASE_M) * F.pow(F.lit(2.0), lv)


def _key(level: Column, cell: Column) -> Column:
    return F.struct(level.cast("int").alias("lv"), cell["iy"].alias("iy"), cell["ix"].alias("ix"))


def _on_all_levels(df: DataFrame) -> DataFrame:
    """Every position (s_lat, s_lon) with the key of its cell in each lattice."""
    d = df.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    return d.withColumn("_key", _key(F.col("_lv"), cell_key(
        "s_lat", "s_lon", _level_m(F.col("_lv"))))).drop("_lv")


NODES = (["_key"], ["_key", "_node1"], ["_key", "_node1", "_node2"])  # of each depth
FAN = 8  # a node is so much narrower than the one above
COPIES = 8


def _tree(df: DataFrame) -> DataFrame:
    """Every position on all levels, with the nodes below its cell that it lies in."""
    step = _level_m(F.col("_key.lv")) / M_PER_DEG
    node = lambda n: F.struct(F.floor(F.col("s_lat") / step * n).alias("y"),
                              F.floor(F.col("s_lon") / step * n).alias("x"))
    return _on_all_levels(df).withColumns({"_node1": node(FAN), "_node2": node(FAN * FAN)})


def _nodes(tree: DataFrame, depth: int, counts: Column | None = None) -> DataFrame:
    """The nodes of a depth with the box around their positions and how many of them count."""
    box = F.struct(F.min("s_lat").alias("lo_lat"), F.max("s_lat").alias("hi_lat"),
                   F.min("s_lon").alias("lo_lon"), F.max("s_lon").alias("hi_lon"))
    return tree.groupBy(*NODES[depth]).agg(
        box.alias("_box"), (F.count("*") if counts is None else F.count_if(counts)).alias("_n"))


def _met(points: DataFrame, reach: str, tree: DataFrame, depth: int, metric: str,
         counts: Column | None = None) -> DataFrame:
    """Each point with the nodes of `depth` that its own `reach` in metres can hold.

    A point takes the cells its circle touches in the lattice as wide as its reach, and the
    others keep one key a lattice, so a point with a small reach meets few of them; then it goes
    down from node to node. Points are few bytes and much work, so they are dealt out anew: by
    their size alone they would be one task.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartition(n)  # by the keys they have, it would be taken out again
    level = F.ceil(F.log2(F.greatest(F.col(reach) * 1.1, F.lit(BASE_M)) / BASE_M)).cast("int")
    p = points.withColumn("_lv", F.least(level, F.lit(LEVELS - 1)))
    p = p.withColumn("_c", F.explode(keys_within("p_lat", "p_lon", _level_m(F.col("_lv")), 1.3)))
    p = p.withColumn("_key", _key(F.col("_lv"), F.col("_c"))).drop("_lv", "_c")
    # far points share a cell: its nodes come in copies, for as many tasks
    p = p.withColumn("_copy", F.pmod(F.xxhash64("p_lat", "p_lon"), F.lit(COPIES)).cast("int"))
    far = F.col(reach) + F.greatest(F.lit(1e-3), F.col(reach) * 1e-7)
    for d in range(1, depth + 1):
        nodes = _nodes(tree, d, counts).withColumn("_copy", F.explode(F.sequence(
            F.lit(0), F.lit(COPIES - 1))))
        p = unsent(p.drop("_box", "_n")).join(nodes, [*NODES[d - 1], "_copy"])
        p = p.filter(box_m("p_lat", "p_lon", "_box", metric) <= far)
    return p.drop("_copy")


def within_own_reach(points: DataFrame, reach: str, others: DataFrame,
                     metric: str = "flat") -> DataFrame:
    """Pairs of a point (p_lat, p_lon) and another position (s_lat, s_lon) that the point's own
    `reach` in metres can hold; the caller measures."""
    tree = _tree(others)
    p = _met(points, reach, tree, 2, metric).drop("_box", "_n")
    return unsent(p).join(tree, NODES[2]).drop(*NODES[2])


def _reach(points: DataFrame, places: DataFrame, need: int, metric: str) -> DataFrame:
    """Points with a distance, `_reach`, that surely holds `need` places.

    The places of the smallest cell around a point that has enough of them lie within its farthest
    corner (FAR_M without such a cell). Nodes in that reach make it smaller: one with enough places,
    or so many nodes, lie within their farthest corner, too. So a point far from all places does not
    look at all of them. A place that comes more than once counts once, as it may be excluded.
    """
    spot = points.columns
    w = W.partitionBy("_place").orderBy("s_lat", "s_lon")
    counts = F.col("_counts")
    tree = _tree(places.withColumn("_counts", F.col("_place").isNotNull()
                                   & (F.row_number().over(w) == 1)))
    within = box_m("p_lat", "p_lon", "_box", metric, far=True)
    within = within + F.greatest(F.lit(1e-3), within * 1e-7)
    own = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda lv: _key(
        lv, cell_key("p_lat", "p_lon", _level_m(lv))))
    cells = _nodes(tree, 0, counts).withColumn("_enough", F.col("_n") >= need)
    points = unsent(points.withColumn("_key", F.explode(own))).join(cells, "_key", "left").groupBy(
        *spot).agg(F.coalesce(F.min(F.when(F.col("_enough"), within)), F.lit(FAR_M)).alias("_reach"))
    met = _met(points, "_reach", tree, 2, metric, counts).select(
        *spot, "_reach", "_n", F.when(F.col("_n") > 0, within).alias("_far"))
    met = top_n_by(met, spot, [F.col("_far").asc_nulls_last()], need)
    one = F.min(F.when(F.col("_n") >= need, F.col("_far")))
    many = F.when(F.count("_far") >= need, F.max("_far"))
    return met.groupBy(*spot, "_reach").agg(one.alias("_one"), many.alias("_many")).select(
        *spot, F.least("_reach", "_one", "_many").alias("_reach"))


def k_nearest(points: DataFrame, point_id: str, places: DataFrame, place_id: str, k: int,
              exclude: str | None = None, metric: str = "flat") -> DataFrame:
    """The k nearest places of every point, exactly: (point, place, dist_m, rank).

    Points at one position are one, and of the places at one position only as many count as can
    be wanted. Counts of places in cells and nodes give every point a distance that its k nearest
    cannot exceed; a join looks at all places within it. `exclude` names a point column holding a
    place id that does not count.
    """
    need = k + (1 if exclude else 0)
    spot = ["p_lat", "p_lon"]
    every = _pos(points, "p", list(dict.fromkeys([point_id] + ([exclude] if exclude else []))))
    p = every.select(*spot).distinct()
    s = _pos(places, "s", [place_id]).withColumnRenamed(place_id, "_place")
    s = top_n_by(s, ["s_lat", "s_lon"], [F.col("_place")], need)
    fn = haversine_m if metric == "haversine" else flat_m
    dist = F.round(fn("p_lat", "p_lon", "s_lat", "s_lon"), 6)
    order = [F.col("dist_m"), F.col("_place")]

    reach = _reach(p, s, need, metric)
    pairs = within_own_reach(reach, "_reach", s, metric).filter(
        fn("p_lat", "p_lon", "s_lat", "s_lon") <= F.col("_reach") + ROUNDING)
    pairs = pairs.withColumn("dist_m", dist).filter(F.col("dist_m") <= F.col("_reach"))
    if exclude:
        # the nearest `need` different places of a position hold k that are not the excluded one
        once = F.row_number().over(W.partitionBy(*spot, "_place").orderBy("dist_m")) == 1
        pairs = pairs.filter(F.col("_place").isNotNull()).withColumn("_first", once.cast("int"))
        seen = F.sum("_first").over(W.partitionBy(*spot).orderBy(*order).rowsBetween(
            W.unboundedPreceding, 0))
        pairs = pairs.withColumn("_seen", seen).filter(F.col("_seen") <= need)
        pairs = every.select(*spot, exclude).distinct().join(pairs, spot).filter(
            F.col("_place") != F.col(exclude))
        spot = [*spot, exclude]
    best = top_n_by(pairs, spot, order, k, rank="rank")
    return every.join(best.select(*spot, F.col("_place").alias("_found"), "dist_m", "rank"), spot
                      ).select(point_id, F.col("_found").alias(place_id), "dist_m", "rank")


def inter_site_distance(sites: DataFrame, k: int = 3) -> DataFrame:
    """Mean distance to the k nearest other sites (to all of them when fewer)."""
    pts = sites.withColumn("_self", F.col("site_id"))
    near = k_nearest(pts.select(F.col("site_id").alias("point"), "_self", "latitude", "longitude"),
                     "point", sites, "site_id", k, exclude="_self", metric="haversine")
    return near.groupBy(F.col("point").alias("site_id")).agg(F.avg("dist_m").alias("isd_m"))


def isolation(sites: DataFrame, isolated_m: float = 2500.0,
              planned_m: float = 2500.0) -> DataFrame:
    """Per site: its nearest other on-air site, whether it stands alone, and the planned
    sites closer than `planned_m`."""
    pts = sites.select(F.col("site_id").alias("point"), F.col("site_id").alias("_self"),
                       "latitude", "longitude")
    on = k_nearest(pts, "point", sites.filter(F.col("air") == "onair"), "site_id", 1,
                   exclude="_self")
    planned = radius_join(pts, sites.filter(F.col("air") == "planned"), planned_m, ["point"],
                          ["site_id"])
    planned = planned.filter((F.col("point") != F.col("site_id")) & (F.col("dist_m") < planned_m))
    planned = planned.groupBy("point").agg(F.count(F.lit(1)).alias("planned_near"))
    return sites.select(F.col("site_id").alias("point")).join(
        on.select("point", F.col("site_id").alias("nearest_site"),
                  F.col("dist_m").alias("nearest_m")), "point", "left").join(
        planned, "point", "left").select(
        F.col("point").alias("site_id"), "nearest_site", "nearest_m",
        (F.col("nearest_m") > isolated_m).alias("isolated"),
        F.coalesce("planned_near", F.lit(0)).alias("planned_near"))


# ------------------------------------------------------------- serving sectors
SECTOR_COLS = ("sector_id", "site_id", "azimuth_deg", "antenna_height_m", "total_tilt_deg")


def _score(rows: DataFrame) -> DataFrame:
    """Pairs of a point (p_*) and a sector with bearing, off-boresight angle and score."""
    brg = bearing_deg("s_lat", "s_lon", "p_lat", "p_lon")
    rows = rows.withColumn("bearing_deg", F.round(brg, 6))
    rows = rows.withColumn("off_deg", F.round(az_gap("azimuth_deg", "bearing_deg"), 6))
    ratio = F.col("off_deg") / 65.0
    return rows.withColumn("score", F.round(F.col("dist_m") * (1.0 + ratio * ratio), 6))


def _sectors(sectors: DataFrame) -> DataFrame:
    keep = [c for c in SECTOR_COLS if c in sectors.columns]
    return sectors.filter(F.col("azimuth_deg").isNotNull()).select(
        *keep, F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"))


def _site_points(sectors: DataFrame) -> DataFrame:
    return sectors.filter(F.col("azimuth_deg").isNotNull()).groupBy("site_id").agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))


FIRST_SITES = 8  # whose sectors give the score that the others have to beat


def best_sector(points: DataFrame, point_id: str, sectors: DataFrame,
                metric: str = "flat") -> DataFrame:
    """Of all sectors, that with the least distance x (1 + (off / 65)^2), per point.

    A score is at least the distance, so the best one among the nearest few sites bounds how far
    a better sector can be; only what lies within is looked at. Among so many sites some sector
    faces the point nearly, and then the bound is little more than the distance itself.
    """
    fn = haversine_m if metric == "haversine" else flat_m
    exact = fn("p_lat", "p_lon", "s_lat", "s_lon")
    names = ["sector_id", "site_id", "dist_m", "bearing_deg", "azimuth_deg", "off_deg", "score"]

    def best(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
        scored = _score(pairs.withColumn("dist_m", F.round(exact, 6)))
        return scored.groupBy(*keys).agg(first_by(names, "score", "sector_id").alias("w"))

    pos = _pos(points, "p", [point_id])
    # points at one place have one answer
    spots = pos.select("p_lat", "p_lon").distinct().withColumn(
        "_spot", F.struct("p_lat", "p_lon"))
    near = k_nearest(spots.select("_spot", F.col("p_lat").alias("latitude"),
                                  F.col("p_lon").alias("longitude")), "_spot",
                     _site_points(sectors), "site_id", FIRST_SITES)
    near = near.select("site_id", F.col("_spot.p_lat").alias("p_lat"),
                       F.col("_spot.p_lon").alias("p_lon"))
    first = best(near.join(_sectors(sectors), "site_id"), ["p_lat", "p_lon"])
    reach = first.select("p_lat", "p_lon", F.col("w.score").alias("_reach"))
    # bearings and rounding are dear: only for what is in reach
    close = within_own_reach(reach, "_reach", _sectors(sectors), metric).filter(
        exact <= F.col("_reach") + ROUNDING)
    found = best(close, ["p_lat", "p_lon"])
    return pos.join(found, ["p_lat", "p_lon"]).select(point_id, "w.*")


def best_server(points: DataFrame, point_id: str, sectors: DataFrame) -> DataFrame:
    """The sector with the least distance x (1 + (off / 65)^2), whatever its site's rank."""
    return best_sector(points, point_id, sectors)


POWER_COLS = ("sector_id", "azimuth_deg", "antenna_height_m", "total_tilt_deg")


def predicted_best_server(points: DataFrame, point_id: str, sectors: DataFrame,
                          within_m: float = 1500.0) -> DataFrame:
    """The sector within reach that is predicted strongest at each point: point, sector_id, rsrp.

    No sector is stronger than its path loss alone lets it be, and that of the highest mast is the
    least, so the strongest of the nearest few bounds how far a stronger one can be; only what lies
    within is predicted. A sector whose prediction is missing comes first, as in the order of values.
    """
    spot = ["p_lat", "p_lon"]
    every = _pos(points, "p", [point_id])
    spots = every.select(*spot).distinct()
    known = F.lit(True)
    for c in POWER_COLS[1:]:
        known = known & F.col(c).isNotNull()
    s = _pos(sectors, "s", POWER_COLS)
    whole = s.filter(known)

    def predicted(pairs: DataFrame) -> DataFrame:
        d = F.round(flat_m("p_lat", "p_lon", "s_lat", "s_lon"), 6)
        off = az_gap("azimuth_deg", F.round(bearing_deg("s_lat", "s_lon", "p_lat", "p_lon"), 6))
        return pairs.withColumn("dist_m", d).filter(F.col("dist_m") <= within_m).withColumn(
            "rsrp", predict_rsrp("dist_m", "antenna_height_m", "total_tilt_deg", off))

    near = k_nearest(spots.select(F.struct(*spot).alias("_spot"), F.col("p_lat").alias("latitude"),
                                  F.col("p_lon").alias("longitude")), "_spot",
                     sectors.filter(known), "sector_id", FIRST_SITES)
    near = near.select("_spot.*", "sector_id").join(whole, "sector_id")
    first = predicted(near).groupBy(*spot).agg(F.max("rsrp").alias("_best"))
    mast = whole.agg(F.max("antenna_height_m").alias("_mast"))
    # the distance at which the path loss from the highest mast leaves the best so far
    slope = 44.9 - 6.55 * F.log10(at_most(at_least("_mast", 20.0), 200.0))
    left = BUDGET_DBM - F.col("_best") + 0.06 - hata_db(1000.0, 1800.0, "_mast")
    reach = F.greatest(F.pow(F.lit(10.0), left / slope) * 1000.0, F.lit(20.0)) * 1.0001
    reach = F.least(F.coalesce(reach, F.lit(within_m)), F.lit(within_m))
    reach = with_scalars(spots.join(first, spot, "left"), mast).select(
        *spot, reach.alias("_reach"))
    blind = radius_join(spots.withColumnsRenamed({"p_lat": "latitude", "p_lon": "longitude"}),
                        sectors.filter(~known), within_m, [], POWER_COLS)
    blind = blind.withColumnsRenamed({"o_lat": "s_lat", "o_lon": "s_lon"})
    pairs = within_own_reach(reach, "_reach", whole).filter(
        flat_m("p_lat", "p_lon", "s_lat", "s_lon") <= F.col("_reach") + 0.01)
    cols = [*spot, *POWER_COLS, "s_lat", "s_lon"]
    pairs = predicted(pairs.select(cols).unionByName(blind.select(cols)))
    best = lambda df, keys: df.groupBy(*keys).agg(
        first_by(["sector_id", "rsrp"], -F.col("rsrp"), "sector_id").alias("w")).select(*keys, "w.*")
    return best(every.join(best(pairs, spot), spot), [point_id])


def facing_sector(points: DataFrame, point_id: str, sectors: DataFrame) -> DataFrame:
    """Of the point's own site, the sector with the smallest azimuth gap to the point."""
    pos = _pos(points, "p", [point_id, "site_id"])
    pairs = pos.join(_sectors(sectors), "site_id")
    pairs = pairs.withColumn(
        "dist_m", F.round(flat_m("s_lat", "s_lon", "p_lat", "p_lon", mean_latitude=True), 6))
    best = _score(pairs).groupBy(point_id).agg(first_by(
        ["sector_id", "site_id", "dist_m", "bearing_deg", "azimuth_deg", "off_deg"],
        "off_deg", "sector_id").alias("w"))
    return best.select(point_id, "w.*")


RINGS = (1 / 27, 1 / 9, 1.0)  # of the distance in which neighbours are looked for
ROUND_DEG = 1.0  # that a direction on the flat may differ from a bearing, short of the poles


def neighbour_sectors(points: DataFrame, point_id: str, sectors: DataFrame, serving: DataFrame,
                      facing_deg: float = 60.0, within_m: float = 3000.0,
                      same_direction_deg: float = 30.0) -> DataFrame:
    """Sectors of other sites that face the point, one per direction, nearest first.

    `serving` holds (point, site_id, bearing_deg, dist_m) of the serving sector: its site is
    left out and its direction is taken. Each site offers the sector that faces the point best.
    Points with the same position and serving sector are one. They look from ring to ring, and
    beyond the first only into the directions that no nearer neighbour has taken, so in a dense
    network they meet a few dozen sites.
    """
    srv = serving.select(point_id, F.col("site_id").alias("srv_site"),
                         F.col("bearing_deg").alias("srv_brg"), F.col("dist_m").alias("srv_d"))
    at = F.struct("p_lat", "p_lon", "srv_site", "srv_brg", "srv_d")
    ids = _pos(points, "p", [point_id]).join(srv, point_id, "left").groupBy(point_id).agg(
        F.sort_array(F.collect_set(at)).alias("_at"))
    sec = _sectors(sectors).filter(F.col("site_id").isNotNull())
    sites = sec.groupBy("site_id").agg(
        F.struct(F.min("s_lat").alias("lat"), F.min("s_lon").alias("lon")).alias("_site"),
        F.collect_list(F.struct("sector_id", "azimuth_deg", "s_lat", "s_lon")).alias("_sectors"))
    spots = sec.filter("s_lat is not null and s_lon is not null").select(
        "site_id", "s_lat", "s_lon").distinct().join(sites, "site_id")
    kind = {f.name: f.dataType.simpleString() for f in sec.schema.fields}
    kind = (f"array<struct<dist_m:double,off_deg:double,sector_id:{kind['sector_id']},"
            f"site_id:{kind['site_id']},toward:double>>")
    first = F.element_at("_at", 1)
    start = F.when(first["srv_d"] >= 1.0, F.array(F.pmod(first["srv_brg"] + 180.0, F.lit(360.0))))
    found = ids.select("_at").distinct().select(
        "_at", F.coalesce(start, F.array().cast("array<double>")).alias("taken"),
        F.array().cast(kind).alias("out"))
    low = -1.0
    for part in RINGS:
        found = _ring(found, spots, low, within_m * part, facing_deg, within_m, same_direction_deg)
        low = within_m * part
    g = ids.join(found.filter(F.size("out") > 0).select("_at", "out"), "_at")
    return g.select(point_id, F.posexplode("out").alias("pos", "n")).select(
        point_id, (F.col("pos") + 1).alias("rank"), F.col("n.sector_id").alias("sector_id"),
        F.col("n.site_id").alias("site_id"), F.col("n.dist_m").alias("dist_m"),
        F.col("n.off_deg").alias("off_deg"))


def _free_arcs(taken, same_direction_deg: float) -> Column:
    """The directions that none of `taken` covers: middles and half widths."""
    s = F.sort_array(taken)
    nxt = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.try_element_at(s, F.lit(1)) + 360.0))
    arc = lambda mid, half: F.struct(mid.alias("mid"), half.alias("half"))
    arcs = F.zip_with(s, nxt, lambda a, b: arc((a + b) / 2, (b - a) / 2 - same_direction_deg))
    return F.when(F.size(s) == 0, F.array(arc(F.lit(0.0), F.lit(180.0)))).otherwise(
        F.filter(arcs, lambda x: x["half"] > -1e-6))


def _ring(state: DataFrame, spots: DataFrame, low: float, high: float, facing_deg: float,
          within_m: float, same_direction_deg: float) -> DataFrame:
    """`state` (_at, taken, out) after the neighbours farther than `low` and within `high`."""
    step = high / M_PER_DEG / FAN
    s = spots.withColumn("_cell", cell_key("s_lat", "s_lon", high)).withColumn("_node", F.struct(
        F.floor(F.col("s_lat") / step).alias("y"), F.floor(F.col("s_lon") / step).alias("x")))
    nodes = s.groupBy("_cell", "_node").agg(F.struct(
        F.min("s_lat").alias("lo_lat"), F.max("s_lat").alias("hi_lat"),
        F.min("s_lon").alias("lo_lon"), F.max("s_lon").alias("hi_lon")).alias("_box"))
    nodes = nodes.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = state.repartition(n).withColumn("_arcs", _free_arcs("taken", same_direction_deg))
    # one row without a cell keeps those that find nothing
    looks = F.flatten(F.transform("_at", lambda m: F.transform(
        keys_within(m["p_lat"], m["p_lon"], high, 1.02), lambda c: F.struct(
            c.alias("_cell"), m["p_lat"].alias("p_lat"), m["p_lon"].alias("p_lon")))))
    looks = F.when(F.size("_arcs") > 0, looks).otherwise(F.slice(looks, 1, 0))
    p = p.withColumn("_look", F.explode(F.concat(looks, F.array(F.lit(None))))).select(
        "*", "_look.*").drop("_look")
    p = p.withColumn("_copy", F.pmod(F.xxhash64("p_lat", "p_lon"), F.lit(COPIES)).cast("int"))
    p = unsent(p).join(nodes, ["_cell", "_copy"], "left").drop("_copy")

    def free(toward: Column, wide) -> Column:
        return F.exists("_arcs", lambda x: az_gap(x["mid"], toward) <= x["half"] + wide)

    def direction(lat: Column, lon: Column) -> Column:
        return F.degrees(F.atan2((lon - F.col("p_lon")) * F.cos(F.radians("p_lat")),
                                 lat - F.col("p_lat")))

    b = {c: F.col(f"_box.{c}") for c in ("lo_lat", "hi_lat", "lo_lon", "hi_lon")}
    middle = direction((b["lo_lat"] + b["hi_lat"]) / 2, (b["lo_lon"] + b["hi_lon"]) / 2)
    wide = F.greatest(*[az_gap(middle, direction(b[y], b[x])) for y in ("lo_lat", "hi_lat")
                        for x in ("lo_lon", "hi_lon")]) + ROUND_DEG
    near = box_m("p_lat", "p_lon", "_box")
    wide = F.when((near <= 1.0) | (F.abs("p_lat") > 85.0), 180.0).otherwise(wide)
    p = p.filter(F.col("_cell").isNull() | (
        (near <= high + 1e-3) & (box_m("p_lat", "p_lon", "_box", far=True) >= low - 1e-3)
        & free(middle, wide)))
    p = unsent(p.drop("_box")).join(s, ["_cell", "_node"], "left").drop("_node")

    def seen(lat, lon, s_lat, s_lon) -> tuple[Column, Column]:
        return (F.round(flat_m(lat, lon, s_lat, s_lon), 6),
                F.round(bearing_deg(s_lat, s_lon, lat, lon), 6))

    opposite = lambda brg: F.pmod(brg + 180.0, F.lit(360.0))
    dist, brg = seen(*map(F.col, ("p_lat", "p_lon", "s_lat", "s_lon")))
    p = p.withColumn("_d", dist).filter(F.col("_cell").isNull() | (
        (F.col("_d") > low) & (F.col("_d") <= high)))
    p = p.filter(F.col("_cell").isNull() | (F.col("_d") < 1.0) | free(opposite(brg), 1e-6))

    # of all that the site offers to the point, the sector that faces it best
    def offers(m: Column) -> Column:
        def offer(x: Column) -> Column:
            d, to = seen(m["p_lat"], m["p_lon"], x["s_lat"], x["s_lon"])
            return F.struct(F.round(az_gap(x["azimuth_deg"], to), 6).alias("off"),
                            x["sector_id"].alias("id"), d.alias("d"), opposite(to).alias("toward"),
                            x["s_lat"].alias("s_lat"), x["s_lon"].alias("s_lon"),
                            m["p_lat"].alias("p_lat"), m["p_lon"].alias("p_lon"))
        other = (m["srv_site"].isNull() | (m["srv_site"] != F.col("site_id"))) & (F.round(flat_m(
            m["p_lat"], m["p_lon"], F.col("_site.lat"), F.col("_site.lon")), 6) <= within_m)
        return F.transform(F.filter("_sectors", lambda x: other), offer)

    best = F.array_min(F.filter(F.flatten(F.transform("_at", offers)), lambda x: (
        x["off"] <= facing_deg) & (x["d"] <= within_m)))
    here = F.lit(True)
    for c in ("s_lat", "s_lon", "p_lat", "p_lon"):
        here = here & (F.col(f"_best.{c}") == F.col(c))
    cand = F.struct(F.col("_best.d").alias("dist_m"), F.col("_best.off").alias("off_deg"),
                    F.col("_best.id").alias("sector_id"), F.col("site_id").alias("site_id"),
                    F.col("_best.toward").alias("toward"))
    p = p.withColumn("_best", F.when(F.col("_cell").isNotNull(), best))
    g = p.groupBy("_at").agg(F.first("taken").alias("taken"), F.first("out").alias("out"),
                             F.sort_array(F.collect_set(F.when(here, cand))).alias("_c"))

    def step(acc, x):
        behind = F.exists(acc["taken"], lambda t: az_gap(t, x["toward"]) < same_direction_deg)
        skip = (x["dist_m"] >= 1.0) & behind
        return F.struct(
            F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"),
            F.when(skip | (x["dist_m"] < 1.0), acc["taken"]).otherwise(
                F.concat(acc["taken"], F.array(x["toward"]))).alias("taken"))

    after = F.aggregate("_c", F.struct(F.col("out"), F.col("taken")), step)
    return g.select("_at", after.alias("_after")).select("_at", "_after.taken", "_after.out")


def around_site(sites: DataFrame, sectors: DataFrame, metres: float = 1200.0,
                n_sites: int | None = None) -> DataFrame:
    """Per site: the other sites within reach (the nearest `n_sites` if given), ranked, and all
    their sectors."""
    pts = sites.select(F.col("site_id").alias("centre"), "latitude", "longitude")
    pairs = radius_join(pts, sites, metres, ["centre"], ["site_id"]).filter(
        F.col("centre") != F.col("site_id"))
    near = ranked(pairs, ["centre"], [F.col("dist_m"), F.col("site_id")], n_sites)
    return near.select("centre", "site_id", "dist_m", "rank").join(
        sectors.select("site_id", "sector_id"), "site_id")


# -------------------------------------------------------------- name geocoding
def name_tokens(col) -> Column:
    text = F.trim(F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col),
                                   "[^a-z0-9]+", " "))
    return F.sort_array(F.array_distinct(F.split(text, " ")))


def geocode_area(names: DataFrame, name: str, geocode: DataFrame,
                 floor: float = 0.6) -> DataFrame:
    """Distinct area names with the gazetteer entry of equal text, else the best token overlap.

    Names meet on equal tokens, and only on the rarest ones of each: two token sets as alike
    as the floor asks share one of their first n - ceil(floor x n) + 1 tokens in order of
    rarity. A word that half the names hold therefore joins nothing by itself.
    Returns (name, subdistrict, score).
    """
    n = names.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    n = n.withColumn("_tok", name_tokens("_name"))
    g = geocode.select("subdistrict").distinct().withColumn("_gtok", name_tokens("subdistrict"))
    each = lambda df, key, tok: df.withColumn("_t", F.explode(tok)).filter(
        F.col("_t") != "")
    gt, nt = each(g, "subdistrict", "_gtok"), each(n, "_name", "_tok")
    seen = gt.groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))

    def rare(df: DataFrame, key: str, tok: str) -> DataFrame:
        r = df.join(seen, "_t").withColumn("_r", F.row_number().over(
            W.partitionBy(key).orderBy("_df", "_t")))
        size = F.size(tok)
        # tokens the gazetteer lacks are the rarest of all: they come first in the order
        absent = size - F.count(F.lit(1)).over(W.partitionBy(key))
        r = r.withColumn("_absent", absent)
        return r.filter(F.col("_r") + F.col("_absent") <= size - F.ceil(size * floor) + 1).drop(
            "_df", "_r", "_absent")

    a, b = rare(nt, "_name", "_tok"), rare(gt, "subdistrict", "_gtok")
    pairs = a.join(b, "_t").groupBy("_name", "subdistrict").agg(
        F.first("_tok").alias("_tok"), F.first("_gtok").alias("_gtok"))
    score = F.size(F.array_intersect("_tok", "_gtok")) / F.size(F.array_union("_tok", "_gtok"))
    same = F.array_join("_tok", " ") == F.array_join("_gtok", " ")
    pairs = pairs.withColumn("score", F.when(same, 1.0).otherwise(score)).filter(
        F.col("score") >= floor)
    best = pairs.groupBy("_name").agg(
        first_by(["subdistrict", "score"], -F.col("score"), "subdistrict").alias("w"))
    return best.select(F.col("_name").alias(name), "w.*")


# ------------------------------------------------------------------- azimuths
def azimuth_gaps(sectors: DataFrame) -> DataFrame:
    """Per site: the largest gap between neighbouring directions, its centre, and the smallest
    step. A site has a handful of sectors."""
    a = sectors.filter(F.col("azimuth_deg").isNotNull()).select(
        "site_id", F.pmod(F.bround("azimuth_deg", 0), F.lit(360.0)).alias("az")).distinct()
    w = W.partitionBy("site_id").orderBy("az")
    every = W.partitionBy("site_id")
    nxt = F.coalesce(F.lead("az").over(w), F.min("az").over(every))
    g = a.withColumn("gap", F.pmod(nxt - F.col("az"), F.lit(360.0)))
    out = g.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("directions"), first_by(["gap", "az"], -F.col("gap"), "az")
        .alias("w"), F.min(F.when(F.col("gap") > 0, az_gap("az", F.col("az") + F.col("gap"))))
        .alias("smallest_step"))
    one = F.col("directions") < 2
    return out.select(
        "site_id", "directions", F.when(one, 360.0).otherwise(F.col("w.gap")).alias("largest_gap"),
        F.when(one, F.pmod(F.col("w.az") + 180.0, F.lit(360.0))).otherwise(
            F.pmod(F.col("w.az") + F.col("w.gap") / 2, F.lit(360.0))).alias("gap_centre"),
        "smallest_step")


def merge_azimuths(sectors: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Per site: its directions with those within the tolerance of the last kept one dropped,
    the wrap-around included."""
    g = sectors.filter(F.col("azimuth_deg").isNotNull()).groupBy("site_id").agg(
        F.sort_array(F.collect_set(F.pmod(F.col("azimuth_deg"), F.lit(360.0)))).alias("a"))
    kept = F.aggregate(
        "a", F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (az_gap(F.element_at(acc, -1), x) > tolerance),
                              F.concat(acc, F.array(x))).otherwise(acc))
    g = g.withColumn("k", kept)
    wraps = (F.size("k") > 1) & (az_gap(F.element_at("k", 1), F.element_at("k", -1)) <= tolerance)
    return g.select("site_id", F.when(wraps, F.slice("k", 1, F.size("k") - 1))
                    .otherwise(F.col("k")).alias("azimuths"))
