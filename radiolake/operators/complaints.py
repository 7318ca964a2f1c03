"""Complaint geometry, category, agreement with the engineer, and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.geo import az_gap, bearing_deg, haversine_m
from radiolake.operators.actions import recommend_for_location
from radiolake.operators.common import exact_quantile, top_n_by
from radiolake.operators.spatial import best_sector, k_nearest

# Words of the engineer's own fields, of the notes, and the label map.
NOT_RF_WORDS = ("device", "sim ", "no answer", "isp", "vpn", "handset", "charging",
                "wrong ticket", "switch off", "disconnected")
OUTAGE_WORDS = ("outage", "availability", "alarm", "site stopped", "site outage")
INTERFERENCE = r"(?i)\b(rtwp|interfe|jammer|jamming|noise rise)\b"
INDOOR = r"(?i)\b(indoor|in-?building|basement|inside the|mall)\b"
CONGESTION = r"(?i)\b(congest|utiliz|utilis|prb|flow control|overload|capacity|high traffic)\b"
NEW_SITE = (r"(?i)\b(new site|planned site|new tower|need a site|no coverage|null area|far from)\b")
ENGINEER_LABEL = {
    "new site required": "new_site_needed", "physical optimization": "far_coverage",
    "flow control": "congestion", "prb utilization": "congestion",
    "event traffic increase": "congestion", "interference": "interference",
    "high rtwp area (interference)": "interference", "government interference": "interference",
    "indoor issue - urban areas": "indoor", "device issue": "not_rf", "sim issue": "not_rf",
    "no answer": "not_rf", "alarms": "availability", "availability/outage": "availability",
    "data - high utilization cells": "congestion", "data - slow weak coverage": "far_coverage",
    "data - planned - this area needs a new site/tower": "new_site_needed",
    "planned - this area needs a new site/tower": "new_site_needed",
    "customer no answer/switch off/disconnected": "not_rf"}
# labels that name no category of their own
NO_LABEL = ("others", "resolved successfully", "no problem found")
NEAR_MISS = (("wrong_server", "far_coverage"), ("off_axis_azimuth", "far_coverage"),
             ("near_on_axis_other", "indoor"), ("near_on_axis_other", "congestion"),
             ("new_site_needed", "far_coverage"))


def complaint_geometry(complaints: DataFrame, sectors: DataFrame) -> DataFrame:
    """Serving sector (the site's first one as fallback), distance, bearing, off-axis angle,
    nearest other on-air site and best sector of every complaint.

    `complaints`: ticket_id, site_id, sector, latitude, longitude, coord_source
    (ticket, subdistrict or other).
    """
    sec = sectors.select("site_id", "sector", "sector_id", "azimuth_deg", "antenna_height_m",
                         F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"))
    first = sec.groupBy("site_id").agg(F.min_by(F.struct(*[c for c in sec.columns
                                                           if c != "site_id"]), "sector").alias("f"))
    own = sec.select("site_id", "sector", F.struct(*[c for c in sec.columns if c != "site_id"])
                     .alias("o"))
    c = complaints.join(own, ["site_id", "sector"], "left").join(first, "site_id", "left")
    c = c.withColumn("srv", F.coalesce("o", "f")).drop("o", "f")
    exact = (F.col("coord_source") == "ticket") & F.col("latitude").isNotNull() & F.col(
        "longitude").isNotNull()
    rough = (F.col("coord_source") == "subdistrict") & F.col("latitude").isNotNull() & F.col(
        "longitude").isNotNull()
    has = F.col("srv").isNotNull()
    c = c.withColumn("loc_source", F.when(exact, "ticket").when(rough, "subdistrict")
                     .when(has, "serving_site").otherwise("none"))
    dist = haversine_m("srv.s_lat", "srv.s_lon", "latitude", "longitude")
    c = c.withColumn("distance_m", F.when(has & (exact | rough), dist))
    brg = F.round(bearing_deg("srv.s_lat", "srv.s_lon", "latitude", "longitude"), 6)
    c = c.withColumn("bearing_deg", F.when(has & exact, brg))
    c = c.withColumn("az_offset_deg", az_gap("srv.azimuth_deg", "bearing_deg"))
    pts = c.filter(F.col("loc_source") == "ticket").filter(has).select(
        "ticket_id", F.col("site_id").alias("_srv"), "latitude", "longitude")
    on_air = sectors.filter(F.col("air") == "onair").groupBy("site_id").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    near = k_nearest(pts, "ticket_id", on_air, "site_id", 1, exclude="_srv").select(
        "ticket_id", F.col("site_id").alias("nearest_site"), F.col("dist_m").alias("nearest_m"))
    best = best_sector(pts, "ticket_id", sectors, metric="haversine").select(
        "ticket_id", F.col("sector_id").alias("best_sector_id"),
        F.col("off_deg").alias("best_offset_deg"), F.col("dist_m").alias("best_distance_m"))
    c = c.join(near, "ticket_id", "left").join(best, "ticket_id", "left")
    return c.withColumns({"serving_sector": F.col("srv.sector_id"),
                          "serving_height_m": F.col("srv.antenna_height_m")}).drop("srv")


def _says(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify_complaints(df: DataFrame, notes: str = "notes", engineer: str = "engineer") -> DataFrame:
    """Category and confidence: the engineer's non-radio word, else geometry, else hints."""
    txt, eng = F.lower(F.coalesce(notes, F.lit(""))), F.lower(F.coalesce(engineer, F.lit("")))
    d, off, near = F.col("distance_m"), F.col("az_offset_deg"), F.col("nearest_m")
    not_rf, outage = _says(eng, NOT_RF_WORDS), _says(eng, OUTAGE_WORDS)
    far, none_near = d > 2400, near.isNull() | (near > 1500)
    best = F.coalesce((F.col("best_distance_m") < 1400) & (F.col("best_offset_deg") < 35),
                      F.lit(False))
    closer = F.coalesce((near < 0.5 * d) & (near < 1200), F.lit(False))
    off_axis = F.coalesce(off > 32.5, F.lit(False))
    rough = F.col("loc_source") == "subdistrict"
    new_site = F.when(d > 3500, 0.6).otherwise(0.48)
    new_site = F.when(txt.rlike(NEW_SITE), F.least(F.lit(0.8), new_site + 0.15)).otherwise(new_site)
    cat = (F.when(not_rf, "not_rf").when(outage, "availability")
           .when(d.isNull(), "insufficient_data")
           .when(rough, F.when(d > 8000, "new_site_needed").otherwise("coverage_or_capacity"))
           .when(far & none_near, "new_site_needed").when(closer & best, "wrong_server")
           .when(off_axis & best, "off_axis_azimuth").when(off_axis | (d > 700), "far_coverage")
           .otherwise("near_on_axis_other"))
    conf = (F.when(not_rf | outage, 0.6).when(d.isNull(), 0.25)
            .when(rough, F.when(d > 8000, 0.3).otherwise(0.28)).when(far & none_near, new_site)
            .when(closer & best, 0.55).when(off_axis & best, 0.5).when(off_axis, 0.4)
            .when(d > 700, 0.5).otherwise(0.45))
    out = df.withColumn("_cat", cat).withColumn("_conf", conf.cast("double")).withColumn(
        "used_engineer_label", not_rf | outage)
    hint = ~F.col("used_engineer_label")
    soft = ("near_on_axis_other", "coverage_or_capacity", "insufficient_data")
    inter = hint & txt.rlike(INTERFERENCE)
    indoor = hint & txt.rlike(INDOOR) & F.col("_cat").isin("far_coverage", *soft)
    cong = hint & txt.rlike(CONGESTION) & F.col("_cat").isin(*soft)
    return out.withColumn("category", F.when(inter, "interference").when(indoor, "indoor")
                          .when(cong, "congestion").otherwise(F.col("_cat"))).withColumn(
        "confidence", F.when(inter | indoor, F.greatest(F.col("_conf"), F.lit(0.5)))
        .when(cong, F.greatest(F.col("_conf"), F.lit(0.45))).otherwise(F.col("_conf"))).drop(
        "_cat", "_conf")


def engineer_category(rf_analysis, closure_code) -> Column:
    """The engineer's own category: the RF analysis where it is a known label, else the code."""
    m = F.create_map(*[F.lit(x) for kv in ENGINEER_LABEL.items() for x in kv])
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    known = key(rf_analysis).isin(*ENGINEER_LABEL, *NO_LABEL)
    return F.when(known, F.try_element_at(m, key(rf_analysis))).otherwise(
        F.try_element_at(m, key(closure_code)))


def agreement(tool="category", engineer="engineer_category", used="used_engineer_label") -> Column:
    a, b = F.col(tool), F.col(engineer)
    close = [x + "|" + y for p in NEAR_MISS for x, y in (p, p[::-1])]
    return (F.when(F.col(used) | b.isNull(), "n/a").when(a == b, "agree")
            .when(F.concat_ws("|", a, b).isin(*close), "partial").otherwise("differ"))


def complaint_actions(df: DataFrame, elec_tilt: float = 3.0) -> DataFrame:
    """Sized action of exactly located far or off-axis complaints."""
    d = df.filter(F.col("category").isin("far_coverage", "off_axis_azimuth")
                  & (F.col("loc_source") == "ticket") & (F.col("serving_height_m") > 0))
    d = d.select("ticket_id", "category", F.col("distance_m").alias("dist_m"),
                 F.coalesce("az_offset_deg", F.lit(0.0)).alias("off_deg"),
                 F.col("serving_height_m").alias("antenna_height_m"),
                 F.lit(0.0).alias("mech_tilt_deg"), F.lit(elec_tilt).alias("elec_tilt_deg"))
    return recommend_for_location(d)


def _dominant(df: DataFrame, key: str, n: int) -> DataFrame:
    """The categories of each key by count (then name): the first, and the first n as text."""
    g = df.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct((-F.col("n")).alias("m"), "category", "n")
    # a key has at most the dozen categories
    s = g.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("c"))
    return s.select(key, F.element_at("c", 1)["category"].alias("dominant_category"),
                    F.array_join(F.transform(F.slice("c", 1, n), lambda x: F.concat(
                        x["category"], F.lit(":"), x["n"].cast("string"))), "; ")
                    .alias("top_categories"))


def hotspots_by_site(findings: DataFrame, site_facts: DataFrame | None = None) -> DataFrame:
    """Serving-site hotspots: tickets, sectors, categories, actions, exact places, median
    distance, with the site's isolation and planned neighbours."""
    f = findings.filter(F.coalesce("site_id", F.lit("")) != "")
    g = f.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.array_join(F.sort_array(F.collect_set(F.col("sector").cast("string"))), ",")
        .alias("sectors_complained"),
        F.count_if(F.col("category").isin("far_coverage", "off_axis_azimuth")
                   & (F.col("loc_source") == "ticket")).alias("n_actions"),
        F.count_if(F.col("loc_source") == "ticket").alias("with_exact_loc"))
    med = exact_quantile(f, ["site_id"], "distance_m", 0.5, "median_distance_m")
    out = g.join(_dominant(f, "site_id", 3), "site_id").join(med, "site_id", "left")
    return out.join(site_facts, "site_id", "left") if site_facts is not None else out


def hotspots_by_area(findings: DataFrame) -> DataFrame:
    """Sub-district hotspots: tickets, serving sites, dominant category, coverage-like ones."""
    f = findings.filter(~F.lower(F.trim(F.coalesce("sub_district", F.lit("")))).isin(
        "", "nan", "none", "0"))
    per_site = f.groupBy("sub_district", "site_id").agg(F.count(F.lit(1)).alias("n"))
    top = top_n_by(per_site, ["sub_district"], [F.desc("n"), F.col("site_id")], 3, rank="r")
    names = top.groupBy("sub_district").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("r", "site_id"))), lambda x: x["site_id"]), ",")
        .alias("top_serving_sites"))
    sites = per_site.groupBy("sub_district").agg(F.count(F.lit(1)).alias("serving_sites"))
    g = f.groupBy("sub_district").agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("category").isin(
            "new_site_needed", "far_coverage", "coverage_or_capacity", "wrong_server"))
        .alias("new_site_or_coverage"))
    return g.join(sites, "sub_district").join(names, "sub_district").join(
        _dominant(f, "sub_district", 1).drop("top_categories"), "sub_district")


CATEGORIES = ("new_site_needed", "wrong_server", "off_axis_azimuth", "far_coverage",
              "near_on_axis_other", "interference", "indoor", "congestion", "availability",
              "not_rf", "coverage_or_capacity", "insufficient_data")


def audit_matrix(findings: DataFrame) -> DataFrame:
    """Engineer category by tool category, for tickets with an engineer's label."""
    d = findings.filter((F.col("agreement") != "n/a") & F.col("engineer_category").isNotNull())
    return d.groupBy("engineer_category").pivot("category", list(CATEGORIES)).agg(
        F.count(F.lit(1))).na.fill(0)


def agreement_rates(findings: DataFrame) -> DataFrame:
    d = findings.filter(F.col("agreement") != "n/a")
    return d.agg(F.count(F.lit(1)).alias("audited"),
                 F.avg((F.col("agreement") == "agree").cast("double")).alias("agree"),
                 F.avg(F.col("agreement").isin("agree", "partial").cast("double"))
                 .alias("agree_or_partial"))
