"""A drawing of arrows, a tracker of cells and last time's list of sites as one set of sites.

Inputs
    arrows    site_id, name, seq, latitude, longitude, azimuth_deg (may be null), planned
    cells     site_id, name, sector_num, tech (lte, gsm, umts), azimuth_deg, latitude, longitude,
              active
    previous  site_id

Rows without a site id take no part, cells without a sector number make no sector. All steps group by
site; what a site carries along is bounded by the circle (directions stand 16 degrees apart or more)
and by its sector numbers, never by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.geo import haversine_m
from radiolake.functions.text import is_border_site

# The box of the region, the marks a drawing sets for "no position yet", metres.
REGION = (29.0, 33.2, 43.8, 49.2)
MARKS = ((30.0, 47.0), (47.0, 30.0))
SWAPPED = (43.0, 50.0, 28.0, 34.0)
MOVED_M, MOVED_FAR_M = 150, 2000
SAME_DIRECTION_DEG = 15
TECHS = ("lte", "gsm", "umts")
REVIEW_ORDER = ("no-coords", "missing-from-arrows", "moved", "extra-arrow", "missing-arrow",
                "new-site", "off-air")


def in_region(lat, lon) -> Column:
    south, north, west, east = REGION
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def is_position(lat, lon) -> Column:
    """Inside the region and none of the marks for a missing position."""
    mark = F.lit(False)
    for a, b in MARKS:
        mark = mark | ((F.round(lat, 3) == a) & (F.round(lon, 3) == b))
    return in_region(lat, lon) & ~F.coalesce(mark, F.lit(False))


def whole_degrees(col) -> Column:
    return F.pmod(F.bround(col).cast("int"), F.lit(360))


def turn(a, b) -> Column:
    """The smaller angle between two directions, in degrees."""
    d = F.pmod(a - b, F.lit(360))
    return F.least(d, 360 - d)


def merged_directions(azimuths: Column) -> Column:
    """Sorted whole degrees with those within 15 degrees of the one kept before left out; the last
    one goes too if it meets the first across north."""
    empty = F.array().cast("array<int>")
    kept = F.aggregate(azimuths, empty, lambda acc, a: F.when(
        (F.size(acc) > 0) & (turn(a, F.try_element_at(acc, F.lit(-1))) <= SAME_DIRECTION_DEG),
        acc).otherwise(F.array_append(acc, a)))
    meets = F.pmod(F.try_element_at(kept, F.lit(1)) - F.try_element_at(kept, F.lit(-1)),
                   F.lit(360)) <= SAME_DIRECTION_DEG
    return F.when((F.size(kept) > 1) & meets, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)


def drawn_sites(arrows: DataFrame) -> DataFrame:
    """Per site: its first name and first real position by `seq`, its directions, all planned or not."""
    lat, lon = F.col("latitude"), F.col("longitude")
    order = F.struct("seq", "name", "latitude", "longitude", "azimuth_deg")
    first = lambda c, ok: F.min_by(c, F.when(ok, order))
    spot = F.struct("latitude", "longitude")
    a = arrows.filter(F.col("site_id").isNotNull())
    return a.groupBy("site_id").agg(
        first("name", F.col("name").isNotNull()).alias("name"),
        first(spot, is_position(lat, lon)).alias("spot"),
        F.bool_and(F.coalesce("planned", F.lit(False))).alias("planned"),
        F.sort_array(F.collect_set(whole_degrees("azimuth_deg"))).alias("directions")).withColumn(
        "directions", merged_directions(F.col("directions")))


def tracked_sectors(cells: DataFrame) -> DataFrame:
    """Per (site, sector number): direction and whether any cell is active.

    LTE's direction counts first, then GSM's, then UMTS's: the most frequent one that is not 0 (ties:
    the smallest). Without any it is 0 where a 0 is written, else sectors are spread evenly.
    """
    c = cells.filter(F.col("site_id").isNotNull() & F.col("sector_num").isNotNull())
    rank = F.lit(len(TECHS))
    for i, tech in enumerate(TECHS):
        rank = F.when(F.lower("tech") == tech, F.lit(i)).otherwise(rank)
    n = c.groupBy("site_id", "sector_num", rank.alias("r"), whole_degrees("azimuth_deg").alias("a")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("active", F.lit(False))).alias("active"))
    best = F.min(F.when(F.col("a") != 0, F.struct("r", (-F.col("n")).alias("n"), "a")))
    s = n.groupBy("site_id", "sector_num").agg(best.alias("b"), F.count("a").alias("told"),
                                               F.bool_or("active").alias("active"))
    site = W.partitionBy("site_id")
    spread = F.pmod(F.bround((F.row_number().over(site.orderBy("sector_num")) - 1) * 360
                             / F.count(F.lit(1)).over(site)).cast("int"), F.lit(360))
    return s.select("site_id", "sector_num", "active", F.coalesce(
        F.col("b.a"), F.when(F.col("told") > 0, 0), spread).alias("azimuth_deg"))


def tracked_positions(cells: DataFrame) -> DataFrame:
    """Per site the middle one of its positions in order, swapped pairs put right, typos left out."""
    lat, lon = F.col("latitude"), F.col("longitude")
    a0, a1, b0, b1 = SWAPPED
    swap = (lat > a0) & (lat < a1) & (lon > b0) & (lon < b1)
    p = cells.filter(F.col("site_id").isNotNull() & (lat != 0) & (lon != 0)).select(
        "site_id", F.when(swap, lon).otherwise(lat).alias("latitude"),
        F.when(swap, lat).otherwise(lon).alias("longitude"))
    p = p.filter(in_region(lat, lon)).groupBy("site_id", "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("n"))
    site = W.partitionBy("site_id")
    upto = F.sum("n").over(site.orderBy("latitude", "longitude").rowsBetween(W.unboundedPreceding, 0))
    p = p.select("site_id", "latitude", "longitude", "n", upto.alias("upto"),
                 F.sum("n").over(site).alias("all"))
    middle = F.floor(F.col("all") / 2)
    return p.filter((F.col("upto") > middle) & (F.col("upto") - F.col("n") <= middle)).select(
        "site_id", F.struct("latitude", "longitude").alias("spot"))


def match_directions(drawn: Column, tracked: Column) -> Column:
    """Drawn directions given to tracked (sector_num, azimuth_deg), the nearest pair first, each used
    once (ties: the smaller number, then the smaller direction): array of (num, a, off)."""
    pairs = F.sort_array(F.flatten(F.transform(drawn, lambda a: F.transform(
        tracked, lambda t: F.struct(turn(a, t["azimuth_deg"]).alias("off"),
                                    t["sector_num"].alias("num"), a.alias("a"))))))
    none = F.array().cast("array<struct<off:int,num:int,a:int>>")
    return F.aggregate(pairs, none, lambda acc, p: F.when(
        F.exists(acc, lambda m: (m["num"] == p["num"]) | (m["a"] == p["a"])), acc).otherwise(
        F.array_append(acc, p)))


def reconcile(arrows: DataFrame, cells: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per site of any list: name, status and reason, position and whence, sectors, review.

    The drawing decides the position and, unless the tracker says that every cell is off, the status;
    the tracker decides the sectors. A site without a position is left out of the map (`omitted`) and
    has that review only. `sectors` holds (sector_num, azimuth_deg, source, drawn_azimuth_deg, off_deg),
    `review` (category, detail): metres for moved, a direction for arrows, a sector number for sectors
    that are not drawn. No site is new where there was no list before.
    """
    d = drawn_sites(arrows).select("site_id", F.struct("name", "spot", "planned", "directions").alias("d"))
    sectors = tracked_sectors(cells).withColumn("sector_num", F.col("sector_num").cast("int"))
    t = sectors.groupBy("site_id").agg(
        F.bool_or("active").alias("active"),
        F.sort_array(F.collect_list(F.struct("sector_num", "azimuth_deg"))).alias("sectors"))
    names = cells.groupBy("site_id").agg(F.min(F.when(F.trim("name") != "", F.trim("name"))).alias("name"))
    t = t.join(names, "site_id", "left").join(tracked_positions(cells), "site_id", "left").select(
        "site_id", F.struct("name", "spot", "active", "sectors").alias("t"))
    p = previous.filter(F.col("site_id").isNotNull()).select("site_id").distinct()
    any_before = p.agg((F.count(F.lit(1)) > 0).alias("_before"))
    j = d.join(t, "site_id", "full").join(p.withColumn("p", F.lit(True)), "site_id", "full")
    j = j.join(F.broadcast(any_before))

    drawn, tracked = F.col("d").isNotNull(), F.col("t").isNotNull()
    j = j.withColumn("name", F.coalesce("d.name", "t.name", "site_id"))
    dead = tracked & ~F.col("t.active")
    steps = ((is_border_site("name"), "Off Air", "border-road site"),
             (dead, "Off Air", "every cell is deactivated in the tracker"),
             (drawn & F.col("d.planned"), "Planned", "drawn as planned"),
             (drawn, "On Air", "drawn as on air"),
             (tracked, "On Air", "active in the tracker, not drawn"),
             (F.lit(True), "Off Air", "neither drawn nor tracked"))
    verdict = F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(
        F.lit(s).alias("status"), F.lit(r).alias("reason"))) for cond, s, r in steps])
    j = j.select("*", verdict.alias("v")).select("*", "v.status", "v.reason")
    spot = F.coalesce("d.spot", "t.spot")
    j = j.withColumn("latitude", spot["latitude"]).withColumn("longitude", spot["longitude"])
    j = j.withColumn("position_of", F.when(F.col("d.spot").isNotNull(), "drawing").when(
        F.col("t.spot").isNotNull(), "tracker"))
    j = j.withColumn("omitted", F.col("latitude").isNull())

    none = F.array().cast("array<int>")
    directions = F.coalesce("d.directions", none)
    j = j.withColumn("_m", F.when(tracked, match_directions(directions, F.col("t.sectors"))))
    of = lambda num: F.try_element_at(F.filter("_m", lambda m: m["num"] == num), F.lit(1))
    row = lambda num, az, source, a, off: F.struct(
        num.cast("int").alias("sector_num"), az.cast("int").alias("azimuth_deg"),
        F.lit(source).alias("source"), a.cast("int").alias("drawn_azimuth_deg"),
        off.cast("int").alias("off_deg"))
    from_tracker = F.transform("t.sectors", lambda s: row(
        s["sector_num"], s["azimuth_deg"], "tracker", of(s["sector_num"])["a"],
        of(s["sector_num"])["off"]))
    shown = F.when(F.size(directions) > 0, directions).otherwise(F.array(F.lit(0)))
    from_drawing = F.transform(shown, lambda a, i: row(i + 1, a, "drawing", a, F.lit(0)))
    j = j.withColumn("sectors", F.when(tracked, from_tracker).when(drawn, from_drawing))

    moved = haversine_m("d.spot.latitude", "d.spot.longitude", "t.spot.latitude", "t.spot.longitude")
    item = lambda name, detail=F.lit(None): F.struct(
        F.lit(name).alias("category"), detail.cast("int").alias("detail"))
    whole = [(moved > MOVED_M, item("moved", F.round(moved))),
             (drawn & F.col("d.spot").isNull(), item("no-coords")),
             (F.col("_before") & F.col("p").isNull(), item("new-site")),
             (~drawn & (F.col("status") == "On Air"), item("missing-from-arrows")),
             (F.col("status") == "Off Air", item("off-air"))]
    flags = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), what) for cond, what in whole]),
                     lambda x: x.isNotNull())
    extra = F.transform(F.filter(directions, lambda a: ~F.exists("_m", lambda m: m["a"] == a)),
                        lambda a: item("extra-arrow", a))
    undrawn = F.transform(F.filter("sectors", lambda s: s["drawn_azimuth_deg"].isNull()),
                          lambda s: item("missing-arrow", s["sector_num"]))
    no_items = F.array().cast("array<struct<category:string,detail:int>>")
    review = F.when(F.col("omitted"), F.array(item("no-coords"))).otherwise(F.concat(
        flags, F.when(tracked, extra).otherwise(no_items),
        F.when(tracked & (F.size(directions) > 0), undrawn).otherwise(no_items)))
    return j.select("site_id", "name", "status", "reason", "latitude", "longitude", "position_of",
                    "omitted", "sectors", review.alias("review"))


def map_sectors(reconciled: DataFrame) -> DataFrame:
    """The sectors of all sites that have a position, one row each."""
    kept = reconciled.filter(~F.col("omitted"))
    return kept.select("site_id", "status", F.explode("sectors").alias("s")).select(
        "site_id", "status", "s.*")


def review_rows(reconciled: DataFrame) -> DataFrame:
    """What a person should look at, one row each, with the place of its category in the report."""
    order = F.array_position(F.array(*[F.lit(c) for c in REVIEW_ORDER]), F.col("r.category"))
    return reconciled.select("site_id", "name", "status", F.explode("review").alias("r")).select(
        order.cast("int").alias("rank"), "r.category", "site_id", "name", "status", "r.detail")
