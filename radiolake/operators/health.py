"""Hour-by-hour judgement of cells and sites, and its roll-ups by site, area and day.

Every shuffle here is an aggregation with a partial stage, so a key that holds a large
share of the rows is reduced on the map side before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.functions.times import day_floor, epoch_seconds
from radiolake.kpis import severity
from radiolake.operators.common import first_by, with_scalars

TDD = "CELL_TDD"
STATES = {2: "Critical", 1: "Warning", 0: "Normal", -1: "No data"}
UNKNOWN = "Unknown area"


def to_long(hourly: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """Wide hourly frame to one row per object, hour and measured KPI."""
    ids = [c for c in ("datetime", "object", "site_id", "sector_id", "prefix", "level", "duplex",
                       "tech") if c in hourly.columns]
    return (hourly.select(*ids, *[F.col(f"`{k}`").cast("double").alias(k) for k in kpis])
            .unpivot(ids, list(kpis), "kpi", "value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def state_of(sev):
    s = F.col(sev) if isinstance(sev, str) else sev
    out = F.lit(STATES[-1])
    for k, name in STATES.items():
        out = F.when(s == k, name).otherwise(out)
    return out


def with_rules(long: DataFrame, rules: DataFrame) -> DataFrame:
    """KPI rows with their confirmed line; a TDD cell's UL interference has its own.

    The rules are a fixed list of at most a few dozen rows.
    """
    is_tdd = F.coalesce(F.upper(F.trim("duplex")) == TDD, F.lit(False)) \
        if "duplex" in long.columns else F.lit(False)
    return long.withColumn("is_tdd", is_tdd).join(F.broadcast(rules), ["kpi", "is_tdd"])


def judge_hours(long: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per analysed object, KPI and hour with its value and severity.

    The object is the cell, or the site where the export measures sites; flow control is
    the sum over the site's cells of the hour.
    """
    r = with_rules(long, rules)
    at_site = F.col("per_site") | (F.col("level") == "site" if "level" in long.columns
                                   else F.lit(False))
    r = r.withColumn("object_id", F.when(at_site, F.col("site_id")).otherwise(F.col("object")))
    site_kpi = r.groupBy("site_id", "object_id", "kpi", "datetime").agg(
        F.min("is_tdd").alias("is_tdd"), F.sum("value").alias("s"), F.avg("value").alias("m"))
    h = site_kpi.join(F.broadcast(rules), ["kpi", "is_tdd"])
    v = F.when(F.col("per_site"), F.col("s")).otherwise(F.col("m"))
    return h.select("site_id", "object_id", "kpi", "datetime", "is_tdd", v.alias("v"),
                    severity(v, "direction", "warning", "critical").alias("sev"),
                    "direction", "label", "is_main", "per_site")


def badness():
    """Ascending: the most extreme value in the KPI's bad direction comes first."""
    return F.when(F.col("direction") == "up", F.col("v")).otherwise(-F.col("v"))


def worst_hour(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: the most severe hour, then the most extreme value, then the earliest."""
    return hours.groupBy(*keys).agg(
        first_by(["v", "datetime", "sev", "object_id"], -F.col("sev"), badness(), "datetime",
                 "object_id").alias("w")).select(*keys, "w.*")


def judge_objects(hours: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per object and KPI: state, judged and issue hours, window mean, worst hour and value."""
    keys = [*extra, "site_id", "object_id", "kpi"]
    g = hours.groupBy(*keys).agg(
        F.first("label").alias("label"), F.first("direction").alias("direction"),
        F.first("is_main").alias("is_main"), F.max("sev").alias("sev"),
        F.count(F.lit(1)).alias("hours"), F.count_if(F.col("sev") > 0).alias("issue_hours"),
        F.avg("v").alias("value"),
        first_by(["v", "datetime"], -F.col("sev"), badness(), "datetime").alias("w"))
    return g.select(*keys, "label", "direction", "is_main", "sev",
                    state_of("sev").alias("state"), "hours", "issue_hours", "value",
                    F.col("w.v").alias("peak"), F.col("w.datetime").alias("peak_time"))


def tdd_objects(hours: DataFrame) -> DataFrame:
    """The UL-interference judgement over the TDD cells alone."""
    return judge_objects(hours.filter(F.col("is_tdd") & (F.col("kpi") == "ul_rssi_dbm")))


def site_status(objects: DataFrame, sites: DataFrame | None = None,
                extra: Sequence[str] = ()) -> DataFrame:
    """Per site: worst state and the KPI behind it, checks in breach, cells measured and bad."""
    keys = [*extra, "site_id"]
    bad = F.col("sev") > 0
    # per object first, so that the distinct object counts are plain row counts
    order = [-F.col("sev"), ~F.col("is_main"), F.col("label"), F.col("object_id")]
    per_object = objects.groupBy(*keys, "object_id").agg(
        F.count_if(bad).alias("issues"), F.max(bad).alias("bad"),
        F.sort_array(F.collect_set(F.when(bad, F.col("label")))).alias("labels"),
        first_by(["sev", "is_main", "label", "object_id"], *order).alias("w"))
    # a site has few distinct sets of breached KPIs: their union is a short list
    names = F.sort_array(F.array_distinct(F.flatten(F.collect_set("labels"))))
    g = per_object.groupBy(*keys).agg(
        F.sum("issues").alias("issues"), F.count(F.lit(1)).alias("cells"),
        F.count_if("bad").alias("cells_issue"), F.array_join(names, ", ").alias("bad_kpis"),
        first_by("w", -F.col("w.sev"), ~F.col("w.is_main"), "w.label", "w.object_id").alias("w"))
    if sites is not None:
        g = sites.select("site_id").distinct().join(g, "site_id", "left")
    sev = F.coalesce(F.col("w.sev"), F.lit(-1))
    return g.select(*keys, sev.alias("sev"), state_of(sev).alias("state"),
                    F.coalesce("w.label", F.lit("")).alias("label"),
                    F.col("w.object_id").alias("object_id"),
                    F.coalesce("issues", F.lit(0)).alias("issues"),
                    F.coalesce("bad_kpis", F.lit("")).alias("bad_kpis"),
                    F.coalesce("cells", F.lit(0)).alias("cells"),
                    F.coalesce("cells_issue", F.lit(0)).alias("cells_issue"))


def health_summary(status: DataFrame) -> DataFrame:
    """One row: sites, sites with an issue, and the distribution of states."""
    return status.agg(F.count(F.lit(1)).alias("sites"),
                      F.count_if(F.col("sev") > 0).alias("issues"),
                      *[F.count_if(F.col("sev") == k).alias("n_" + name.lower().replace(" ", "_"))
                        for k, name in STATES.items()])


def breaching_sites(objects: DataFrame) -> DataFrame:
    """Per KPI: sites measured and sites in breach."""
    return (objects.groupBy("kpi", "site_id").agg(F.max("sev").alias("sev")).groupBy("kpi")
            .agg(F.count(F.lit(1)).alias("measured"),
                 F.count_if(F.col("sev") > 0).alias("breaching")))


def problem_ranking(objects: DataFrame) -> DataFrame:
    """KPIs by how many sites breach them, with the critical ones."""
    return (objects.filter(F.col("sev") > 0).groupBy("label", "site_id")
            .agg(F.max("sev").alias("sev")).groupBy("label")
            .agg(F.count(F.lit(1)).alias("sites"),
                 F.count_if(F.col("sev") == 2).alias("critical")))


def issue_order(objects: DataFrame) -> DataFrame:
    """Severity, then label, then the worst value in the rule's own direction."""
    value = F.when(F.col("direction") == "up", F.col("peak")).otherwise(-F.col("peak"))
    return objects.orderBy(F.desc("sev"), "label", value, "object_id")


def site_hours(hours: DataFrame) -> DataFrame:
    """Per site, KPI and hour: the most severe object, then the most extreme value."""
    return hours.groupBy("site_id", "kpi", "datetime").agg(
        F.first("label").alias("label"), F.first("direction").alias("direction"),
        F.first("is_main").alias("is_main"), F.count(F.lit(1)).alias("objects"),
        F.count_if(F.col("sev") > 0).alias("bad_objects"),
        first_by(["v", "object_id", "sev"], -F.col("sev"), badness(), "object_id").alias("w")
    ).select("site_id", "kpi", "datetime", "label", "direction", "is_main", "objects",
             "bad_objects", "w.*")


def issues_by_day(hours: DataFrame) -> DataFrame:
    """Every day judged alone: sites with an issue and sites critical."""
    d = hours.withColumn("day", day_floor("datetime"))
    per_site = d.groupBy("day", "site_id").agg(F.max("sev").alias("sev"))
    return per_site.groupBy("day").agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(F.col("sev") > 0).alias("issues"),
        F.count_if(F.col("sev") == 2).alias("critical"))


def region_table(objects: DataFrame, regions: DataFrame, level: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Per area: sites, affected and their share, issues by severity, worst state, the KPI
    most of its affected sites share, median position and dominant city."""
    area = F.coalesce(F.col(level), F.lit(UNKNOWN))
    r = regions.withColumn("name", area)
    cities = (r.groupBy("name", "city").agg(F.count(F.lit(1)).alias("n")).groupBy("name")
              .agg(F.max_by("city", F.struct("n", F.col("city"))).alias("city")))
    places = r.groupBy("name").agg(
        F.count(F.lit(1)).alias("sites"), F.percentile("latitude", F.lit(0.5)).alias("latitude"),
        F.percentile("longitude", F.lit(0.5)).alias("longitude"))
    bad = objects.filter(F.col("sev") > 0).join(r.select("site_id", "name"), "site_id")
    by_site = bad.groupBy("name", "site_id", "label").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("sev") == 2).alias("critical"),
        F.count_if(F.col("sev") == 1).alias("warning"), F.max("sev").alias("worst"))
    affected = by_site.groupBy("name", "site_id").agg(
        F.sum("issues").alias("issues"), F.sum("critical").alias("critical"),
        F.sum("warning").alias("warning"), F.max("worst").alias("worst")).groupBy("name").agg(
        F.count(F.lit(1)).alias("affected"), F.sum("issues").alias("issues"),
        F.sum("critical").alias("critical"), F.sum("warning").alias("warning"),
        F.max("worst").alias("worst"))
    shared = by_site.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top_issue"))
    t = places.join(cities, "name", "left")
    if keep:
        spark = objects.sparkSession
        kept = spark.createDataFrame([(k,) for k in keep], "name string")
        t = kept.join(t, "name", "full")
    t = t.join(affected, "name", "left").join(shared, "name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return t.select(
        "name", F.coalesce("city", F.lit("")).alias("city"), zero("sites"), zero("affected"),
        F.when(F.coalesce("sites", F.lit(0)) > 0,
               100.0 * F.coalesce("affected", F.lit(0)) / F.col("sites")).otherwise(0.0)
        .alias("rate"),
        zero("issues"), zero("critical"), zero("warning"), zero("worst"),
        F.coalesce("top_issue", F.lit("")).alias("top_issue"), "latitude", "longitude")


def region_order(table: DataFrame) -> DataFrame:
    """Unknown last, then the most affected areas first."""
    return table.orderBy(F.col("name") == UNKNOWN, F.desc("affected"), F.desc("issues"),
                         F.desc("rate"), "name")


def half_trend(hours: DataFrame, regions: DataFrame, level: str,
               min_hours: float = 4.0) -> DataFrame:
    """Per area: affected sites of the window's second half minus its first half;
    null when the window is under four hours."""
    t = epoch_seconds("datetime")
    bounds = hours.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    h = with_scalars(hours.filter(F.col("sev") > 0).select("site_id", t.alias("t"), "kpi",
                                                           "object_id"), bounds)
    late = F.col("t") >= (F.col("t0") + F.col("t1")) / 2
    per_site = h.groupBy("site_id").agg(F.max(late).alias("late"), F.max(~late).alias("early"))
    named = regions.select("site_id", F.coalesce(F.col(level), F.lit(UNKNOWN)).alias("name"))
    g = named.join(per_site, "site_id", "left").groupBy("name").agg(
        F.count_if(F.col("late")).alias("last"), F.count_if(F.col("early")).alias("prev"))
    g = with_scalars(g, bounds)
    return g.select("name", "prev", "last",
                    F.when(F.col("t1") - F.col("t0") >= min_hours * 3600,
                           (F.col("last") - F.col("prev")).cast("double")).alias("trend"))


def object_cells(hourly: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Per technology and analysed object: its cells and their ids, joined as text."""
    oid = F.when(F.col("level") == "site", F.col("site_id")).otherwise(F.col("object"))
    d = hourly.filter(F.col("site_id").isNotNull()).select(
        "tech", oid.alias("object_id"), "object").distinct()
    if params is not None:
        ids = params.select(F.upper(F.trim("cell_name")).alias("_n"), "cell_id").groupBy("_n").agg(
            F.min("cell_id").alias("cell_id"))
        d = d.join(ids, F.upper(F.trim("object")) == F.col("_n"), "left").drop("_n")
    else:
        d = d.withColumn("cell_id", F.lit(None).cast("string"))
    # the cells of one site are few: a site hosts tens of cells
    g = d.groupBy("tech", "object_id").agg(
        F.sort_array(F.collect_list(F.struct("object", "cell_id"))).alias("c"))
    return g.select("tech", "object_id",
                    F.array_join(F.transform("c", lambda x: x["object"]), ", ").alias("cell_name"),
                    F.array_join(F.filter(F.transform("c", lambda x: x["cell_id"]),
                                          lambda x: x.isNotNull()), ", ").alias("cell_id"))


def issue_text():
    name = F.col("label")
    word = F.when(F.col("direction") == "up", "Low ").otherwise("High ")
    return F.when(F.col("sev") > 0, F.concat(word, name)).otherwise("")


def enrich_rows(objects: DataFrame, regions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Object rows with place, issue, shown values and one lower-case search text."""
    out = objects.join(regions, "site_id", "left")
    if names is not None:
        out = out.join(names.select("site_id", "site_name"), "site_id", "left")
    else:
        out = out.withColumn("site_name", F.lit(""))
    for c in ("governorate", "city", "sup_district"):
        have = F.col(c) if c in regions.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(have, F.lit(UNKNOWN)))
    shown = lambda c: F.when(F.abs(c) < 1000, F.format_number(c, 1)).otherwise(
        F.format_number(c, 0))
    out = out.withColumn("issue", issue_text()).withColumn("value_text", shown("value"))
    out = out.withColumn("worst_text", shown("peak"))
    return out.withColumn("search", F.lower(F.concat_ws(
        " ", "site_id", "site_name", "object_id", "governorate", "sup_district", "city", "label",
        "state", "issue")))


def facet_filter(rows: DataFrame, sites: DataFrame, *, governorate: str | None = None,
                 sup_districts: Sequence[str] = (), site: str | None = None,
                 cell: Sequence[str] = (), words: Sequence[str] = (),
                 kpis: Sequence[str] = (), issues: Sequence[str] = (),
                 states: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows kept, sites kept). A place narrows both; a cell or search word narrows the rows
    and then the sites to those that still hold one; KPI, issue and state narrow rows only."""
    s = sites
    if governorate:
        s = s.filter(F.col("governorate") == governorate)
    if sup_districts:
        s = s.filter(F.col("sup_district").isin(*sup_districts))
    if site:
        s = s.filter(F.col("site_id") == site)
    r = rows.join(s.select("site_id"), "site_id", "left_semi")
    if cell:
        hit = F.lit(False)
        for w in cell:
            hit = hit | F.lower("object_id").contains(w.lower())
        r = r.filter(hit)
    for w in words:
        r = r.filter(F.col("search").contains(w.lower()))
    if cell or words:
        s = s.join(r.select("site_id").distinct(), "site_id", "left_semi")
    for name, picks in (("kpi", kpis), ("issue", issues), ("state", states)):
        if picks:
            r = r.filter(F.col(name).isin(*picks))
    return r, s


def scope_sites(index: DataFrame, level: str, obj: str | None = None,
                areas: DataFrame | None = None, cells: Sequence[str] = ()) -> DataFrame:
    """The sites an object selection covers: network, governorate, city, site or cells."""
    d = index.select("site_id", "object").filter(F.col("site_id").isNotNull())
    if cells:
        return d.filter(F.col("object").isin(*cells)).select("site_id").distinct()
    if level in ("governorate", "city") and obj and areas is not None:
        inside = areas.filter(F.col(level) == obj).select("site_id")
        return d.select("site_id").distinct().join(inside, "site_id", "left_semi")
    if level == "site" and obj:
        d = d.filter(F.col("site_id") == obj)
    return d.select("site_id").distinct()


def worst_sites(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """Affected sites, each with its worst check, issue count and position."""
    bad = objects.filter(F.col("sev") > 0).groupBy("site_id").agg(
        F.max("sev").alias("sev"), F.count(F.lit(1)).alias("issues"),
        first_by("label", -F.col("sev"), "label").alias("label"))
    return bad.join(regions.select("site_id", "latitude", "longitude"), "site_id").filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def worst_sectors(values: DataFrame, n: int) -> DataFrame:
    """The n worst sectors: severity, then the value in the bad direction."""
    return values.orderBy(F.desc("sev"), badness(), "sector_id").limit(n)
