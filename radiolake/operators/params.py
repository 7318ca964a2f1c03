"""Engineering parameters and site lists: cleaning, dedupe, sector databases, status, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.geo import elevation_deg, haversine_m
from radiolake.functions.text import clean_text, mean_of_list, rs_power_dbm, tilt_deg
from radiolake.operators.common import first_by, top_n_by
from radiolake.operators.spatial import k_nearest


def number_sectors(df: DataFrame) -> DataFrame:
    """Sector numbers 1.. per site by azimuth when the list has none."""
    if "sector" in df.columns:
        return df
    return df.withColumn("sector", F.row_number().over(
        W.partitionBy("site_id").orderBy("azimuth_deg", "cell_id")))


def derive_params(df: DataFrame) -> DataFrame:
    """Tilts and power put right, total tilt, prefix and a completeness score.

    Mechanical tilts outside -2..15 become 0, electrical ones outside -3..16 are unknown.
    """
    mech, elec = tilt_deg(mean_of_list("mech_tilt")), tilt_deg(mean_of_list("elec_tilt"))
    d = df.withColumn("mech_tilt_deg", F.when(mech.between(-2, 15), mech).otherwise(0.0))
    d = d.withColumn("elec_tilt_deg", F.when(elec.between(-3, 16), elec))
    d = d.withColumn("rs_power_dbm", rs_power_dbm(mean_of_list("rs_power")))
    d = d.withColumn("total_tilt_deg", F.col("mech_tilt_deg") + F.col("elec_tilt_deg"))
    d = d.withColumn("prefix", F.upper(F.regexp_extract("site_id", "^([A-Za-z]+)", 1)))
    score = F.lit(0)
    for c in ("latitude", "azimuth_deg", "elec_tilt_deg", "rs_power_dbm"):
        score = score + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return d.withColumn("completeness", score)


def dedupe_params(df: DataFrame, ties: Sequence[str] = ("cell_id",)) -> DataFrame:
    """The most complete row per cell name, then per (site, sector, band, pci)."""
    order = [F.desc("completeness"), *[F.col(t) for t in ties]]
    one = top_n_by(df, ["cell_name"], order, 1)
    return top_n_by(one, ["site_id", "sector_num", "band", "pci"], order, 1)


def params_to_sectors(params: DataFrame) -> DataFrame:
    """Cells to a sector database: medians, the widest carrier's cell, and the band list."""
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    return params.groupBy("site_id", "sector_num").agg(
        med("latitude"), med("longitude"), med("azimuth_deg"), med("antenna_height_m"),
        med("total_tilt_deg"),
        first_by("cell_name", -F.col("bandwidth_mhz"), "cell_name").alias("cell_name"),
        F.array_join(F.sort_array(F.collect_set("band")), ",").alias("bands"),
        F.count(F.lit(1)).alias("n_cells"))


def site_dim(params: DataFrame, names: Sequence[str] = ("city", "district")) -> DataFrame:
    """One row per site: first non-blank names, median position."""
    aggs = [F.min(F.when(clean_text(n) != "", clean_text(n))).alias(n) for n in names]
    return params.groupBy("site_id").agg(
        *aggs, F.percentile("latitude", F.lit(0.5)).alias("latitude"),
        F.percentile("longitude", F.lit(0.5)).alias("longitude"))


def site_rollup(sectors: DataFrame, status: str = "air") -> DataFrame:
    """Sites with their sectors counted and the status most of them have."""
    modal = sectors.groupBy("site_id", status).agg(F.count(F.lit(1)).alias("n")).groupBy(
        "site_id").agg(first_by(status, -F.col("n"), status).alias(status),
                       F.sum("n").alias("sectors"))
    return modal


def on_air_sites(params: DataFrame, region: str | None = None) -> DataFrame:
    """Sites the tracker lists as live: active rows with a position in the region."""
    d = params.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if region:
        d = d.filter(F.lower("region").contains(region.lower()))
    status = F.lower(F.coalesce("status", F.lit("")))
    return d.filter(~status.contains("deactiv") & ~status.contains("inactive")).select(
        F.upper("site_id").alias("site_id")).distinct()


def apply_on_air(frame: DataFrame, on_air: DataFrame) -> DataFrame:
    """The map's status, overruled by the tracker's live set."""
    live = on_air.select("site_id", F.lit(True).alias("_live"))
    return frame.join(live, "site_id", "left").withColumn(
        "air", F.when(F.col("_live"), "onair").otherwise(F.col("air"))).drop("_live")


def planned_status(tickets: DataFrame, on_air: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Status of each ticket's planned site: live set, then the site list, else not built."""
    t = tickets.join(on_air.select(F.col("site_id").alias("plan_site"), F.lit(True).alias("_on")),
                     "plan_site", "left")
    if sites is None:
        status = F.when(F.col("_on"), "On Air").otherwise("")
        return t.withColumn("plan_status", F.when(F.coalesce("plan_site", F.lit("")) == "", "")
                            .otherwise(status)).drop("_on")
    s = sites.select(F.col("site_id").alias("plan_site"), F.col("air").alias("_air"))
    t = t.join(s, "plan_site", "left")
    return t.withColumn("plan_status", F.when(F.coalesce("plan_site", F.lit("")) == "", "")
                        .when(F.col("_on") | (F.col("_air") == "onair"), "On Air")
                        .otherwise("Still Not On Air")).drop("_on", "_air")


def attach_params(objects: DataFrame, params: DataFrame) -> DataFrame:
    """KPI objects with their parameters; the tracker's sector first, else the export's own."""
    p = params.groupBy(F.upper(F.trim("cell_name")).alias("_k")).agg(
        F.min(F.struct("cell_id", "sector_num", "azimuth_deg")).alias("p"))
    j = objects.join(p, F.upper(F.trim("object")) == F.col("_k"), "left").drop("_k")
    return j.select(*objects.columns, F.col("p.cell_id").alias("cell_id"),
                    F.col("p.azimuth_deg").alias("azimuth_deg"),
                    F.coalesce(F.when(F.col("p.sector_num") > 0, F.col("p.sector_num")),
                               F.col("own_sector")).alias("sector_num"))


def topology_tags(params: DataFrame, tag: str = "band") -> DataFrame:
    """The tags of every sector, the site's for a sector that has none of its own."""
    clean = F.when(clean_text(tag) != "", clean_text(tag))
    own = params.groupBy("site_id", "sector_num").agg(F.sort_array(F.collect_set(clean)).alias("o"))
    site = params.groupBy("site_id").agg(F.sort_array(F.collect_set(clean)).alias("s"))
    return own.join(site, "site_id").select(
        "site_id", "sector_num", F.when(F.size("o") > 0, F.col("o")).otherwise(F.col("s"))
        .alias("tags"))


def has_tag(tags, value: str) -> Column:
    return F.array_contains(tags, value)


def union_exports(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column an export lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def site_points(params: DataFrame, sites: DataFrame) -> DataFrame:
    """Where every site stands: the tracker first, the site list for the rest."""
    a = params.filter(F.col("latitude").isNotNull()).groupBy("site_id").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    b = sites.filter(F.col("latitude").isNotNull()).groupBy("site_id").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    u = a.withColumn("source", F.lit("tracker")).unionByName(
        b.join(a.select("site_id"), "site_id", "left_anti").withColumn("source", F.lit("list")))
    return u


def all_sites(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("site_id")
    for f in frames[1:]:
        out = out.union(f.select("site_id"))
    return out.filter(F.col("site_id").isNotNull()).distinct()


def merge_hourly(frames: DataFrame, kpis: Sequence[str], recency: str = "recency") -> DataFrame:
    """Overlapping exports as one frame: per object, hour and KPI the newest non-null value."""
    keys = ["object", "datetime"]
    ids = [c for c in ("site_id", "sector_id", "duplex", "tech") if c in frames.columns]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(recency))).alias(c)
    return frames.groupBy(*keys).agg(*[last(c) for c in ids], *[last(k) for k in kpis])


def reconcile_sites(drawn: DataFrame, tracker: DataFrame, previous: DataFrame) -> DataFrame:
    """Three lists of sites as one: status and its reason, the position kept, and what to review.

    Each list: site_id, latitude, longitude, and `on` (active) for the tracker, `status` for
    the previous list.
    """
    a = drawn.select("site_id", F.struct("latitude", "longitude").alias("d"))
    b = tracker.select("site_id", F.struct("latitude", "longitude", "on").alias("t"))
    c = previous.select("site_id", F.struct("latitude", "longitude", "status").alias("p"))
    j = a.join(b, "site_id", "full").join(c, "site_id", "full")
    live = F.coalesce("t.on", F.lit(False))
    j = j.withColumn("status", F.when(live, "On Air").when(F.col("t").isNotNull(), "Off Air")
                     .when(F.col("d").isNotNull(), "Planned").otherwise("Removed"))
    j = j.withColumn("reason", F.when(live, "active in tracker")
                     .when(F.col("t").isNotNull(), "inactive in tracker")
                     .when(F.col("d").isNotNull(), "drawn only").otherwise("previous list only"))
    for x in ("latitude", "longitude"):
        j = j.withColumn(x, F.coalesce(F.col(f"t.{x}"), F.col(f"d.{x}"), F.col(f"p.{x}")))
    moved = haversine_m("d.latitude", "d.longitude", "t.latitude", "t.longitude")
    checks = [("moved_far", moved > 2000), ("moved", (moved > 150) & (moved <= 2000)),
              ("no_coordinates", F.col("latitude").isNull()),
              ("new", F.col("p").isNull()),
              ("went_off_air", (F.col("p.status") == "On Air") & (F.col("status") != "On Air")),
              ("missing_in_tracker", F.col("d").isNotNull() & F.col("t").isNull())]
    flags = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(n))
                               for n, cond in checks]), lambda x: x.isNotNull())
    return j.select("site_id", "status", "reason", "latitude", "longitude", flags.alias("review"))


def review_rows(reconciled: DataFrame) -> DataFrame:
    return reconciled.select("site_id", "status", F.explode("review").alias("review"))


def groups_for_list(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """Every (site, sector) of a list with its live cells, or why it has none."""
    cells = objects.groupBy("site_id", "sector_num").agg(
        F.sort_array(F.collect_set("object")).alias("cells"))
    known = objects.select("site_id", F.lit(True).alias("_site")).distinct()
    j = wanted.join(cells, ["site_id", "sector_num"], "left").join(known, "site_id", "left")
    return j.select("site_id", "sector_num", "cells",
                    F.when(F.col("cells").isNotNull(), "")
                    .when(F.col("_site"), "sector not in the export")
                    .otherwise("site not in the export").alias("missing"))


# Why a row of a list has nothing to show.
NO_SITE = "no cell of this site in the loaded export"
NO_SECTOR = "no cell in this sector"
NO_NUMBER = "no sector in the list for this row"
NO_DATA = "no KPI data for it in this window"
NOT_SPLIT = "a site-level KPI cannot be split by sector"


def plan_for_list(wanted: DataFrame, objects: DataFrame, long: DataFrame, kpi: str,
                  per_sector: bool) -> DataFrame:
    """What is shown for every row of a list once the KPI's own level is known, or why nothing is.

    `objects`: object, site_id, sector_num, site_level; `long`: object, kpi, value. A KPI measured on
    cells shows the row's cells; one that only the site's own object has shows the site (`site_only`),
    and is not repeated under every sector. A sector of a site whose objects have no sector at all is
    answered for by the site's object. Rows that repeat count once, rows without a site not at all.
    """
    present = long.filter((F.col("kpi") == kpi) & F.col("value").isNotNull()).select(
        "object", F.lit(True).alias("_live")).distinct()
    number = F.coalesce(F.col("sector_num").cast("int"), F.lit(0))
    o = objects.select("object", "site_id", number.alias("sector_num"),
                       F.coalesce("site_level", F.lit(False)).alias("whole")).distinct()
    o = o.join(present, "object", "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    names = lambda cond: F.sort_array(F.collect_set(F.when(F.col("_live") & cond, F.col("object"))))
    per = o.groupBy("site_id", "sector_num").agg(
        names(~F.col("whole")).alias("cells"), names(F.col("whole")).alias("own"),
        F.bool_or("whole").alias("any_own"))
    site = per.groupBy("site_id").agg(
        F.sort_array(F.flatten(F.collect_list("cells"))).alias("all_cells"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("all_own"),
        F.bool_or("any_own").alias("has_own"), F.max("sector_num").alias("last"))
    w = wanted.filter(F.col("site_id").isNotNull()).select("site_id", (
        F.col("sector_num").cast("int") if per_sector else F.lit(None).cast("int")).alias("sector_num")).distinct()
    j = w.join(site, "site_id", "left")
    none = F.array().cast("array<string>")
    if per_sector:
        j = j.join(per.drop("any_own").withColumn("_placed", F.lit(True)), ["site_id", "sector_num"], "left")
        by_site = F.col("_placed").isNull() & (F.col("last") <= 0) & F.col("has_own")
        cells = F.when(by_site, none).otherwise(F.coalesce("cells", none))
        own = F.when(by_site, F.col("all_own")).otherwise(F.coalesce("own", none))
        early = F.when(F.col("last").isNull(), NO_SITE).when(F.col("sector_num").isNull(), NO_NUMBER).when(
            F.col("_placed").isNull() & ~by_site, NO_SECTOR)
        late = F.when(F.size("_own") > 0, NOT_SPLIT).otherwise(NO_DATA)
    else:
        cells, own = F.coalesce("all_cells", none), F.coalesce("all_own", none)
        early = F.when(F.col("last").isNull(), NO_SITE)
        late = F.lit(NO_DATA)
    j = j.withColumn("_cells", cells).withColumn("_own", own).withColumn("_early", early)
    whole = (F.size("_cells") == 0) & (F.size("_own") > 0) & F.lit(not per_sector)
    shown = F.when(F.col("_early").isNotNull(), none).when(whole, F.col("_own")).otherwise(F.col("_cells"))
    j = j.withColumn("shown", shown)
    return j.select("site_id", "sector_num", F.col("shown").alias("cells"),
                    (F.col("_early").isNull() & whole).alias("site_only"),
                    F.coalesce("_early", F.when(F.size("shown") == 0, late), F.lit("")).alias("missing"))


# ------------------------------------------------------------------------ audit
# The likely cause each flag points to. `dup_pci_sector` has a cause but never rises:
# the PCIs of a sector are a set, so none can repeat in it.
POINTS_TO = {"missing_ret": "far_coverage", "tilt_imbalance": "far_coverage",
             "over_tilt": "far_coverage", "ret_at_max": "far_coverage",
             "few_sectors": "off_axis_azimuth", "azimuth_gap": "off_axis_azimuth",
             "azimuth_overlap": "off_axis_azimuth", "narrow_band_only": "congestion",
             "single_carrier": "congestion", "all_10mhz": "congestion",
             "pci_reuse_site": "interference", "dup_pci_sector": "interference",
             "rs_power_imbalance": "far_coverage", "isolated_site": "new_site_needed",
             "site_not_in_params": "insufficient_data"}
SEVERITY_RANK = {"info": 1, "warning": 2, "critical": 3}


def _flag(code: str, severity, cond: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(F.coalesce(cond, F.lit(False)),
                  F.struct(F.lit(code).alias("code"), sev.alias("severity")))


def _flags(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _circle_gaps(azimuths: Column) -> Column:
    """Steps between neighbouring directions of a short sorted array, the wrap included."""
    nxt = F.concat(F.slice(azimuths, 2, F.size(azimuths)), F.slice(azimuths, 1, 1))
    return F.zip_with(azimuths, nxt, lambda x, y: F.pmod(y - x, F.lit(360.0)))


def audit_sites(site_ids: DataFrame, params: DataFrame, max_ret: float = 10.0,
                wide_bands: Sequence[str] = ("L1800", "L2600", "N41")) -> DataFrame:
    """Parameter flags per listed site: (site_id, code, severity, points_to).

    Sector facts roll up into one row per site; a site's sectors and carriers are few, so its
    arrays are short. All flags are columns of that row.
    """
    wanted = site_ids.select("site_id").distinct()
    p = params.join(wanted, "site_id", "left_semi")
    med = lambda c, n: F.percentile(c, F.lit(0.5)).alias(n)
    site = p.groupBy("site_id").agg(
        F.bround(F.percentile("antenna_height_m", F.lit(0.5)), 1).alias("h"),
        F.collect_set("band").alias("bands"), F.max("bandwidth_mhz").alias("max_bw"))
    sect = p.groupBy("site_id", "sector_num").agg(
        med("azimuth_deg", "azimuth"), med("elec_tilt_deg", "elec"), med("total_tilt_deg", "tilt"),
        med("max_ret_deg", "max_ret"), med("rs_power_dbm", "power"))
    per = sect.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("elec").isNull()).alias("no_ret"),
        (F.max("tilt") - F.min("tilt")).alias("tilt_gap"), F.count("tilt").alias("n_tilt"),
        (F.max("power") - F.min("power")).alias("power_gap"), F.count("power").alias("n_power"),
        F.sort_array(F.collect_set(F.pmod(F.bround("azimuth", 0), F.lit(360.0)))).alias("az"),
        F.collect_list(F.struct("elec", "tilt", "max_ret")).alias("sectors"))
    reuse = p.filter(F.col("pci").isNotNull() & F.col("earfcn").isNotNull()).groupBy(
        "site_id", "band", "earfcn", "pci").agg(F.count(F.lit(1)).alias("k")).filter(
        F.col("k") > 1).groupBy("site_id").agg(
        F.size(F.collect_set(F.struct("band", "earfcn"))).alias("reused"))
    pos = params.filter(F.col("latitude").isNotNull()).groupBy("site_id").agg(
        F.percentile("latitude", F.lit(0.5)).alias("latitude"),
        F.percentile("longitude", F.lit(0.5)).alias("longitude"))
    near = nearest_other_site(pos)
    s = wanted.join(site, "site_id", "left").join(per, "site_id", "left").join(
        reuse, "site_id", "left").join(near, "site_id", "left")
    need = F.coalesce(elevation_deg(F.coalesce("h", F.lit(25.0)), 300.0), F.lit(0.0)) + 5.25
    one = F.size("az") < 2
    steps = _circle_gaps(F.col("az"))
    s = s.withColumn("need", F.greatest(need, F.lit(7.0))).withColumn(
        "largest", F.when(one, 360.0).otherwise(F.array_max(steps))).withColumn(
        "smallest", F.array_min(F.transform(F.filter(steps, lambda g: g > 0),
                                            lambda g: F.when(g > 180, 360 - g).otherwise(g))))
    n_bands = F.size("bands")
    wide = F.arrays_overlap("bands", F.array(*[F.lit(b) for b in wide_bands]))
    known = F.col("n").isNotNull()
    site_flags = _flags(
        _flag("site_not_in_params", "warning", ~known),
        _flag("missing_ret", F.when(F.col("no_ret") == F.col("n"), "critical")
              .otherwise("warning"), F.col("no_ret") > 0),
        _flag("tilt_imbalance", "info", (F.col("n_tilt") >= 2) & (F.col("tilt_gap") >= 3.0)),
        _flag("few_sectors", "info", F.col("n") <= 2),
        _flag("azimuth_gap", F.when(F.col("largest") >= 190, "warning").otherwise("info"),
              (F.col("n") >= 3) & (F.col("largest") >= 170)),
        _flag("azimuth_overlap", "info", (F.col("n") >= 3) & (F.col("smallest") <= 35)),
        _flag("narrow_band_only", "warning", known & (n_bands > 0) & ~wide),
        _flag("single_carrier", "info", known & wide & (n_bands == 1)),
        _flag("all_10mhz", "info", F.col("max_bw") <= 10),
        _flag("rs_power_imbalance", "warning",
              (F.col("n_power") >= 2) & (F.col("power_gap") >= 2.0)),
        _flag("isolated_site", "warning", F.col("nearest_m") > 3000.0))
    sector_flags = F.flatten(F.transform("sectors", lambda x: _flags(
        _flag("over_tilt", "warning", x["tilt"] >= F.col("need")),
        _flag("ret_at_max", "info",
              (x["elec"] >= F.coalesce(x["max_ret"], F.lit(max_ret)) - 0.1) & (x["elec"] >= 6)))))
    carrier_flags = F.array_repeat(F.struct(F.lit("pci_reuse_site").alias("code"),
                                            F.lit("warning").alias("severity")),
                                   F.coalesce("reused", F.lit(0)))
    s = s.withColumn("f", F.concat(site_flags, F.coalesce(sector_flags, F.array().cast(
        "array<struct<code:string,severity:string>>")), carrier_flags))
    m = F.create_map(*[F.lit(x) for kv in POINTS_TO.items() for x in kv])
    return s.select("site_id", F.explode("f").alias("f")).select(
        "site_id", "f.*").withColumn("points_to", F.element_at(m, F.col("code")))


def nearest_other_site(pos: DataFrame) -> DataFrame:
    pts = pos.select(F.col("site_id").alias("point"), F.col("site_id").alias("_self"),
                     "latitude", "longitude")
    near = k_nearest(pts, "point", pos, "site_id", 1, exclude="_self")
    return near.select(F.col("point").alias("site_id"), F.col("dist_m").alias("nearest_m"))


def severity_rank(col="severity") -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.element_at(m, F.col(col))


def audit_summary(site_ids: DataFrame, flags: DataFrame) -> DataFrame:
    """Per site: worst severity, flag count, likely causes worst first, and the leading flag."""
    item = F.struct((-severity_rank()).alias("r"), "code", "severity", "points_to")
    # a site has at most a few dozen flags: one per rule and sector
    g = flags.groupBy("site_id").agg(F.sort_array(F.collect_list(item)).alias("f"))
    j = site_ids.select("site_id").distinct().join(g, "site_id", "left")
    first = F.when(F.size("f") > 0, F.element_at("f", 1))
    return j.select(
        "site_id", F.coalesce(first["severity"], F.lit("ok")).alias("severity"),
        F.coalesce(F.size("f"), F.lit(0)).alias("n_flags"),
        F.coalesce(F.array_join(F.array_distinct(F.transform("f", lambda x: x["points_to"])), ", "),
                   F.lit("")).alias("likely_causes"),
        F.coalesce(first["code"], F.lit("")).alias("top_flag"))
