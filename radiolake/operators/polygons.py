"""Points in areas by an edge table: no ring travels with a point.

An area is a list of parts, each an outer ring and its holes. Its edges are rows. Three indexes are
built from them: the cells of a coarse lattice that an area covers, those that no edge touches being
wholly inside; per area, strips of latitude with the edges that pass them; and the cells that edges
run through, for the nearest edge. A point in a wholly inside cell is placed by one equi join; in a
cell that an edge touches, it meets the edges of its strip, and an odd number to its east decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.geo import M_PER_DEG, cell_key, keys_within, row_width_deg
from radiolake.operators.common import first_by, unsent

SNAP_M = 2000.0
CELL_M = 5000.0
NORTH_M = 110_540.0  # metres of a degree of latitude, as snapping measures it
EPS = 1e-9           # degrees by which cells are widened against rounding


def edge_table(polygons: DataFrame) -> DataFrame:
    """seq, part, ring (0 the outer one) and the two ends of every edge.

    polygons: seq and `parts` array<array<array<struct<lon, lat>>>>, or `rings` of a single part.
    """
    parts = F.col("parts") if "parts" in polygons.columns else F.array("rings")
    d = polygons.select("seq", F.posexplode(parts).alias("part", "rings"))
    d = d.select("seq", "part", F.posexplode("rings").alias("ring", "pts"))
    nxt = F.concat(F.slice("pts", F.lit(2), F.size("pts")), F.slice("pts", F.lit(1), F.lit(1)))
    d = d.select("seq", "part", "ring", F.explode(F.arrays_zip(
        F.col("pts").alias("a"), nxt.alias("b"))).alias("e"))
    return d.select("seq", "part", "ring", *[F.col(f"e.{p}.{c}").cast("double").alias(f"{p}_{c}")
                                            for p in "ab" for c in ("lat", "lon")])


def _between(a: Column, b: Column, step: Column) -> Column:
    """The numbers of all cells `step` wide from a to b."""
    return F.sequence(F.floor((a - EPS) / step).cast("bigint"),
                      F.floor((b + EPS) / step).cast("bigint"))


def _edge_cells(edges: DataFrame, metres: float, width) -> DataFrame:
    """Each edge with every lattice cell (iy, ix) it runs through; `width(row)` in degrees."""
    step = F.lit(metres / M_PER_DEG)
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    d = edges.withColumn("iy", F.explode(_between(low, high, step)))
    y = F.col("iy").cast("double") * step
    slope = (F.col("b_lon") - F.col("a_lon")) / F.nullif(F.col("b_lat") - F.col("a_lat"), F.lit(0.0))

    def at(lat: Column) -> Column:
        lat = F.greatest(low, F.least(high, lat))
        return F.col("a_lon") + (lat - F.col("a_lat")) * slope

    flat = slope.isNull()
    west = F.when(flat, F.least("a_lon", "b_lon")).otherwise(F.least(at(y), at(y + step)))
    east = F.when(flat, F.greatest("a_lon", "b_lon")).otherwise(F.greatest(at(y), at(y + step)))
    return d.withColumn("ix", F.explode(_between(west, east, width(F.col("iy")))))


def _cell(lat: str, lon: str, metres: float) -> list[Column]:
    step = metres / M_PER_DEG
    return [F.floor(F.col(lat) / step).cast("bigint").alias("iy"),
            F.floor(F.col(lon) / step).cast("bigint").alias("ix")]


def strips(edges: DataFrame) -> DataFrame:
    """Per area: south end and height of its strips of latitude.

    There are as many strips as leave about three times the edges in all of them together, so long
    edges make fewer strips and an area's strips never hold more than that.
    """
    span = F.max(F.greatest("a_lat", "b_lat")) - F.min(F.least("a_lat", "b_lat"))
    rise = F.sum(F.abs(F.col("a_lat") - F.col("b_lat")))
    n = F.greatest(F.floor(2 * F.count("*") * span / F.nullif(rise, F.lit(0.0))), F.lit(1))
    return edges.groupBy("seq").agg(F.min(F.least("a_lat", "b_lat")).alias("south"),
                                    (span / n).alias("height"))


def _strip(lat) -> Column:
    return F.coalesce(F.floor((lat - F.col("south")) / F.nullif("height", F.lit(0.0))),
                      F.lit(0)).cast("bigint")


def edge_strips(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The edges that a line of latitude can cross, once for each strip they pass."""
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    e = unsent(edges.where("a_lat <> b_lat")).join(sizes, "seq")
    return e.withColumn("strip", F.explode(F.sequence(_strip(low), _strip(high)))).drop(
        "south", "height")


def inside(candidates: DataFrame, sizes: DataFrame, striped: DataFrame) -> DataFrame:
    """The pairs (p_lat, p_lon, seq) of candidates whose point lies in the area: in the outer ring
    of a part and in none of its holes."""
    c = unsent(candidates).join(sizes, "seq").withColumn("strip", _strip(F.col("p_lat")))
    e = unsent(c.drop("south", "height")).join(striped, ["seq", "strip"])
    crossed = ((F.col("b_lat") > F.col("p_lat")) != (F.col("a_lat") > F.col("p_lat"))) & (
        F.col("p_lon") < (F.col("b_lon") - F.col("a_lon")) * (F.col("p_lat") - F.col("a_lat"))
        / (F.col("b_lat") - F.col("a_lat")) + F.col("a_lon"))
    point = ["p_lat", "p_lon", "seq"]
    rings = e.where(crossed).groupBy(*point, "part", "ring").agg(
        F.count("*").alias("n")).where(F.col("n") % 2 == 1)
    parts = rings.groupBy(*point, "part").agg(F.min("ring").alias("first"),
                                              F.max("ring").alias("last"))
    return parts.where((F.col("first") == 0) & (F.col("last") == 0)).select(*point).distinct()


def area_cells(edges: DataFrame, sizes: DataFrame, striped: DataFrame,
               cell_m: float = CELL_M) -> DataFrame:
    """(iy, ix, seq, whole): the lattice cells of every area; whole ones lie inside altogether.

    A cell that no edge touches is as its middle is.
    """
    step = cell_m / M_PER_DEG
    box = edges.groupBy("seq").agg(*[f(g(f"a_{c}", f"b_{c}")).alias(f"{n}_{c}")
                                     for c in ("lat", "lon")
                                     for f, g, n in ((F.min, F.least, "lo"), (F.max, F.greatest, "hi"))])
    touched = _edge_cells(edges, cell_m, lambda row: F.lit(step)).select(
        "seq", "iy", "ix").distinct()
    every = box.withColumn("iy", F.explode(_between(F.col("lo_lat"), F.col("hi_lat"), F.lit(step))))
    every = every.withColumn("ix", F.explode(_between(F.col("lo_lon"), F.col("hi_lon"), F.lit(step))))
    free = unsent(every.select("seq", "iy", "ix")).join(touched, ["seq", "iy", "ix"], "left_anti")
    middle = free.select("seq", ((F.col("iy") + 0.5) * step).alias("p_lat"),
                         ((F.col("ix") + 0.5) * step).alias("p_lon"))
    whole = inside(middle, sizes, striped).select("seq", *_cell("p_lat", "p_lon", cell_m),
                                                  F.lit(True).alias("whole"))
    return touched.withColumn("whole", F.lit(False)).unionByName(whole)


def first_areas(cells: DataFrame) -> DataFrame:
    """The cells of areas that can be the first to hold a point: none comes after the first one that
    the cell lies in altogether."""
    whole = F.min(F.when(F.col("whole"), F.col("seq"))).over(W.partitionBy("iy", "ix"))
    return cells.withColumn("_first", whole).where("_first is null or seq <= _first").drop("_first")


EARLY = 16  # areas of a cell that are looked at before the others
FINE = 16  # cells that hold edges are so much narrower than the reach
FINE_M = 10.0  # and no narrower than this, or long edges would fill too many


def nearest_edges(points: DataFrame, edges: DataFrame, snap_m: float) -> DataFrame:
    """(p_lat, p_lon, seq, d): the area with the nearest outer edge within snap_m of each point, the
    last in order on a tie.

    A point meets the fine cells that edges run through first. Some edge is no farther than the
    farthest corner of the nearest ones, and only edges of cells within that distance are measured.
    """
    wide = snap_m * 1.05  # a degree is shorter for the snap than for the lattice
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine_m = max(wide / FINE, FINE_M)
    fine = F.lit(fine_m / M_PER_DEG)
    e = _edge_cells(edges.where("ring = 0"), fine_m, lambda row: row_width_deg(row, fine))
    e = e.withColumn("fine", F.struct("iy", "ix")).drop("part", "ring", "iy", "ix")
    width = row_width_deg(F.col("fine.iy"), fine)
    south, west = F.col("fine.iy") * fine, F.col("fine.ix") * width
    cells = e.select("fine").distinct().select("fine", south.alias("south"), west.alias("west"), (
        south + fine).alias("north"), (west + width).alias("east"))
    # by its middle a cell lies in one wide cell; the margin of the points covers the rest of it
    cells = cells.withColumn("cell", cell_key((F.col("south") + F.col("north")) / 2,
                                              (F.col("west") + F.col("east")) / 2, wide + fine_m))
    p = points.repartition(n).withColumn("cell", F.explode(keys_within(
        "p_lat", "p_lon", wide + fine_m)))
    p = unsent(p).join(cells, "cell").drop("cell")
    kx, ky = F.lit(M_PER_DEG) * F.cos(F.radians("p_lat")), F.lit(NORTH_M)

    def apart(x: Column, y: Column) -> Column:
        return F.sqrt(x * x * kx * kx + y * y * ky * ky)

    def gap(of: str, lo: str, hi: str, far: bool) -> Column:
        lo, hi = (F.col(c) - F.col(of) for c in (lo, hi))
        return F.greatest(F.abs(lo), F.abs(hi)) if far else F.greatest(lo, -hi, F.lit(0.0))

    near, far = (apart(gap("p_lon", "west", "east", f), gap("p_lat", "south", "north", f))
                 for f in (False, True))
    p = p.select("p_lat", "p_lon", "fine", near.alias("near"), far.alias("far")).where(
        F.col("near") <= snap_m + 1e-3)
    least = F.min("far").over(W.partitionBy("p_lat", "p_lon"))
    p = p.withColumn("least", least).where(F.col("near") <= F.col("least") + 1e-3).select(
        "p_lat", "p_lon", "fine")
    x0, y0 = (F.col("a_lon") - F.col("p_lon")) * kx, (F.col("a_lat") - F.col("p_lat")) * ky
    dx = (F.col("b_lon") - F.col("a_lon")) * kx
    dy = (F.col("b_lat") - F.col("a_lat")) * ky
    seg = dx * dx + dy * dy
    t = F.when(seg > 0, F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), -(x0 * dx + y0 * dy) / seg))).otherwise(0.0)
    ex, ey = x0 + F.col("t") * dx, y0 + F.col("t") * dy
    d = F.round(F.sqrt(ex * ex + ey * ey), 6)
    pairs = unsent(p).join(e, "fine").withColumn("t", t).withColumn("d", d)
    best = pairs.groupBy("p_lat", "p_lon").agg(first_by(["seq", "d"], "d", -F.col("seq")).alias("w"))
    return best.select("p_lat", "p_lon", "w.*").where(F.col("d") <= snap_m)


def place_in_area(points: DataFrame, point_id: str, polygons: DataFrame,
                  snap_m: float = SNAP_M, cell_m: float = CELL_M) -> DataFrame:
    """The area that holds each point (the first in order), else the one with the nearest outer edge
    in reach (the last in order on a tie): point, area, snapped_m. Points without either fall out.

    polygons: seq (list order), name and `parts` or `rings`, see `edge_table`.
    """
    # areas and points are few bytes and much work: they are dealt out anew
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edge_table(polygons.repartition(n))
    sizes = strips(edges)
    striped = edge_strips(edges, sizes)
    every = points.where("latitude is not null and longitude is not null").select(
        point_id, F.col("latitude").cast("double").alias("p_lat"),
        F.col("longitude").cast("double").alias("p_lon"))
    spots = every.select("p_lat", "p_lon").distinct()  # points at one place have one answer
    cells = first_areas(area_cells(edges, sizes, striped, cell_m))
    order = F.row_number().over(W.partitionBy("iy", "ix").orderBy("seq"))
    cells = cells.withColumn("early", order <= EARLY)

    def hold(points: DataFrame, cells: DataFrame) -> DataFrame:
        met = unsent(points.repartition(n).select(
            "p_lat", "p_lon", *_cell("p_lat", "p_lon", cell_m))).join(cells, ["iy", "ix"])
        held = met.where("whole").select("p_lat", "p_lon", "seq").unionByName(
            inside(met.where("not whole").select("p_lat", "p_lon", "seq"), sizes, striped))
        return held.groupBy("p_lat", "p_lon").agg(F.min("seq").alias("seq"))

    # where areas overlap, one of the first in order mostly holds the point
    held = hold(spots, cells.where("early"))
    rest = spots.join(held, ["p_lat", "p_lon"], "left_anti")
    held = held.unionByName(hold(rest, cells.where("not early")))
    outside = spots.join(held, ["p_lat", "p_lon"], "left_anti")
    found = held.withColumn("d", F.lit(0.0)).unionByName(nearest_edges(outside, edges, snap_m))
    names = polygons.select("seq", F.col("name").alias("area"))
    return every.join(found.join(names, "seq"), ["p_lat", "p_lon"]).select(
        point_id, "area", F.col("d").alias("snapped_m"))


def site_regions(sites: DataFrame, polygons: DataFrame, names: DataFrame,
                 outside: str = "Outside the areas", unknown: str = "Unknown area") -> DataFrame:
    """Each site's area: the polygon that holds it, else outside when it has a position."""
    placed = place_in_area(sites, "site_id", polygons)
    meta = polygons.select(F.col("name").alias("area"), "district", "governorate")
    out = sites.join(placed, "site_id", "left").join(meta, "area", "left")
    own = names.select("site_id", F.col("city").alias("_city"),
                       F.col("governorate").alias("_gov"))
    out = out.join(own, "site_id", "left")
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return out.select(
        "site_id", "latitude", "longitude",
        F.coalesce("area", F.when(has, outside).otherwise(unknown)).alias("sup_district"),
        F.coalesce(F.regexp_replace("district", "^Al-", ""), "_city", F.lit(unknown)).alias("city"),
        F.coalesce("governorate", "_gov", F.lit(unknown)).alias("governorate"), "snapped_m")
