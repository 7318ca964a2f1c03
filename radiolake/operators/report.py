"""File overlap, value bands, the scoped KPI report and the composed runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.times import epoch_seconds, hour_floor
from radiolake.kpis import agg_kind
from radiolake.operators import actions as ACT
from radiolake.operators import diagnose as DIA
from radiolake.operators import rollup as R
from radiolake.operators import series as N
from radiolake.operators.common import exact_quantiles, ranked, top_n_by, with_scalars
from radiolake.operators.spatial import inter_site_distance

COVER_CELLS, COVER_HOURS = 0.9, 0.5


def file_summary(df: DataFrame, kpis: DataFrame, file: str = "file") -> DataFrame:
    """Per file: technology, hours, number of objects and KPI set."""
    g = df.groupBy(file).agg(
        F.first("tech").alias("tech"), F.min("datetime").alias("start"),
        F.max("datetime").alias("end"))
    n = df.select(file, "object").distinct().groupBy(file).agg(F.count(F.lit(1)).alias("objects"))
    k = kpis.groupBy(file).agg(F.sort_array(F.collect_set("kpi")).alias("kpis"))
    return g.join(n, file).join(k, file)


def newer_copies(df: DataFrame, kpis: DataFrame, file: str = "file") -> DataFrame:
    """Pairs (old, new) where new is a newer copy: same technology, every KPI of old, nearly
    all its cells, at least half its hours, and nothing older. All counts are exact.

    A newer copy reaches past the old file's last hour and holds the second half of it, so the
    two meet on the old file's last day and their technology. There hours and KPIs are compared
    first; only the files of pairs that pass are then joined on their objects and counted.
    """
    summary = file_summary(df, kpis, file)
    cols = ("start", "end", "objects", "kpis")
    day = lambda c: F.col(c).cast("date")
    side = lambda p, days: summary.select(
        F.col(file).alias(p), "tech", *[F.col(c).alias(f"{p}_{c}") for c in cols],
        days.alias("_d"))
    old = side("old", day("end"))
    new = side("new", F.explode(F.sequence(day("start"), day("end"))))
    hours = lambda a, b: (epoch_seconds(b) - epoch_seconds(a)) / 3600.0 + 1
    span = hours("old_start", "old_end")
    shared = hours(F.greatest("old_start", "new_start"), F.least("old_end", "new_end"))
    superset = F.size(F.array_except("old_kpis", "new_kpis")) == 0
    # a copy that lacks more than a tenth of the cells cannot hold nine tenths of them
    enough = F.col("new_objects") >= COVER_CELLS * F.col("old_objects")
    pairs = old.join(new, ["tech", "_d"]).filter(
        (F.col("old") != F.col("new")) & (F.col("new_end") >= F.col("old_end"))
        & (shared >= COVER_HOURS * span) & superset & enough).select(
        "old", "new", "old_objects", "new_objects").distinct()
    names = df.select(F.col(file).alias("old"), "object").distinct()
    both = pairs.join(names, "old").join(names.withColumnRenamed("old", "new"), ["new", "object"])
    both = both.groupBy("old", "new", "old_objects", "new_objects").agg(
        F.count(F.lit(1)).alias("_both"))
    return both.withColumn("overlap", F.col("_both") / (
        F.col("old_objects") + F.col("new_objects") - F.col("_both"))).withColumn(
        "cover", F.col("_both") / F.col("old_objects")).filter(
        F.col("cover") >= COVER_CELLS).select("old", "new", "overlap", "cover")


# ------------------------------------------------------------------ value bands
def value_bands(df: DataFrame, value: str, direction: str, warning: float,
                critical: float) -> DataFrame:
    """Each value's band: critical, warning, or up to three shades of OK whose cuts are the
    tertiles of the healthy values, rounded to a readable step."""
    v = F.col(value)
    up = direction == "up"
    healthy = v >= warning if up else v <= warning
    ok = df.filter(healthy)
    ends = ok.agg((F.lit(float(warning)) if up else F.min(v)).alias("_a"),
                  (F.max(v) if up else F.lit(float(warning))).alias("_b"))
    one = with_scalars(ends, exact_quantiles(ok, [], value, {"_q1": 1 / 3, "_q2": 2 / 3}))
    span = F.col("_b") - F.col("_a")
    step = F.when(span > 0, F.pow(F.lit(10.0), F.floor(F.log10(span / 10)))).otherwise(1.0)
    cut = lambda q: F.bround(F.col(q) / step, 0) * step
    cuts = F.sort_array(F.array_distinct(F.filter(
        F.array(cut("_q1"), cut("_q2")), lambda c: (c > F.col("_a")) & (c < F.col("_b")))))
    d = with_scalars(df, one.select(cuts.alias("_cuts")))
    n = F.size("_cuts")
    i = F.size(F.filter("_cuts", lambda c: c <= v))
    rank = (n - i) if up else i
    shade = F.when(n == 0, "ok").otherwise(F.concat(F.lit("ok"), rank.cast("string")))
    past = (lambda line: v < line) if up else (lambda line: v > line)
    return d.withColumn("band", F.when(v.isNull(), "none").when(past(critical), "critical")
                        .when(past(warning), "warning").otherwise(shade)).drop("_cuts")


def magnitude_bands(df: DataFrame, value: str, want: int = 6) -> DataFrame:
    """Bands at 1-2-5 breaks across the data, for a KPI without a line."""
    v = F.col(value)
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    first = F.floor(F.log10(F.greatest(F.abs("_hi"), F.lit(1e-9)))) - 2
    ticks = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda e: F.transform(
        F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)),
        lambda s: s * F.pow(F.lit(10.0), first + e)))),
        lambda t: (t > F.col("_lo")) & (t < F.col("_hi")))
    step = F.greatest(F.lit(1), F.bround(F.size("_t") / (want - 1), 0).cast("int"))
    cuts = F.slice(F.filter("_t", lambda t, i: i % step == 0), 1, want - 1)
    one = ends.withColumn("_t", ticks).select(cuts.alias("_cuts"))
    d = with_scalars(df, one)
    i = F.size(F.filter("_cuts", lambda c: c <= v))
    return d.withColumn("band", F.when(v.isNull(), "none").otherwise(
        F.concat(F.lit("b"), i.cast("string")))).drop("_cuts")


def band_counts(bands: DataFrame) -> DataFrame:
    g = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    g = with_scalars(g, g.agg(F.sum("n").alias("_all")))
    return g.select("band", "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


# ------------------------------------------------------------------- KPI report
def kpi_report(long: DataFrame, kpi: str, low_is_bad: bool, threshold: float, warning: float,
               regions: DataFrame, *, governorate: str | None = None,
               sup_districts: Sequence[str] = (), site: str | None = None,
               top_sites: int = 10) -> dict[str, DataFrame]:
    """A scoped report of one KPI: cells with breach and spike flags, affected cells by area,
    the `top_sites` sites at their worst cell with their rank, the hourly network mean, and scope totals.

    A cell is affected when an hour passes the report's own threshold or it has a spike from
    the milder of that and the warning on.
    """
    rows = long.filter(F.col("kpi") == kpi)
    places = regions.select("site_id", "governorate", "sup_district")
    rows = rows.join(places, "site_id", "left")
    if governorate:
        rows = rows.filter(F.col("governorate") == governorate)
    if sup_districts:
        rows = rows.filter(F.col("sup_district").isin(*sup_districts))
    if site:
        rows = rows.filter(F.col("site_id") == site)
    v = F.col("value")
    past = v < threshold if low_is_bad else v > threshold
    cells = rows.groupBy("site_id", "object", "governorate", "sup_district").agg(
        F.avg(v).alias("value"), (F.min(v) if low_is_bad else F.max(v)).alias("worst"),
        F.max(past).alias("beyond"))
    level = max(warning, threshold) if low_is_bad else min(warning, threshold)
    spikes = N.sudden_spikes(rows, ["object"], low_is_bad, level)
    cells = cells.join(spikes.select("object", "spike_time", "spike_value"), "object", "left")
    cells = cells.withColumn("spike", F.col("spike_time").isNotNull()).withColumn(
        "affected", F.col("beyond") | F.col("spike"))
    hit = cells.filter("affected")
    sign = 1.0 if low_is_bad else -1.0
    top = top_n_by(hit, ["site_id"], [sign * F.col("worst"), sign * F.col("value"),
                                      F.col("object")], 1)
    totals = cells.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("affected").alias("bad"),
        F.count_if("spike").alias("spikes")).agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(F.col("bad") > 0).alias("affected_sites"),
        F.sum("cells").alias("cells"), F.sum("bad").alias("affected_cells"),
        F.sum("spikes").alias("spike_cells"))
    agg = F.sum if agg_kind(kpi) == "sum" else F.avg
    return {
        "cells": cells, "totals": totals,
        "by_area": hit.filter(F.col("sup_district").isNotNull()).groupBy("sup_district").agg(
            F.count(F.lit(1)).alias("affected")),
        "top_sites": ranked(top.withColumn("_all", F.lit(0)), ["_all"], [
            sign * F.col("worst"), sign * F.col("value"), F.col("site_id")], top_sites).drop("_all"),
        "trend": rows.groupBy("datetime").agg(F.avg(v).alias("value")),
        "site_hour": rows.groupBy("site_id", hour_floor("datetime").alias("datetime")).agg(
            agg(v).alias("value"))}


# ---------------------------------------------------------------- composed runs
def findings_table(diagnoses: DataFrame, per_cell: DataFrame) -> DataFrame:
    """Diagnoses with P1..P4: severity against the report's own median traffic."""
    d = with_scalars(diagnoses, R.median_traffic(per_cell)).withColumn(
        "traffic_gb", F.coalesce("total_traffic_gb", F.lit(0.0)))
    return d.withColumn("priority", R.priority("sev", "traffic_gb", "busy_gb")).drop("busy_gb")


def analyse_cells(hourly: DataFrame, capacity: Sequence[str] = ("dl_prb_util",),
                  technology: str = "LTE") -> dict[str, DataFrame]:
    """The daily 4G report: roll-ups, network profile, headline, findings with priorities."""
    per_cell = R.aggregate(hourly, "cell", "all", technology)
    diagnoses = DIA.diagnose(per_cell, technology)
    base = findings_table(diagnoses, per_cell).select("cell_id", "site_id", "problem_class", "sev",
                                                      "priority", "traffic_gb")
    peaks = R.busy_hour_findings(per_cell, R.p95_by(hourly, "cell_id", capacity), capacity,
                                 technology)
    merged = base.unionByName(peaks.select(*base.columns))
    kpis = [k for k in ("dl_prb_util", "cell_avail_pct", "ul_rssi_dbm", "total_traffic_gb")
            if k in per_cell.columns]
    return {"per_cell": per_cell, "per_day": R.aggregate(hourly, "cell", "day", technology),
            "per_site": R.aggregate(hourly, "site", "day", technology),
            "busy_hour": R.busy_hour(hourly, "cell"),
            "profile": R.network_profile(hourly, kpis), "headline": R.headline(per_cell, kpis),
            "diagnoses": diagnoses, "findings": R.order_findings(merged)}


def full_analysis(cells: DataFrame, sites: DataFrame, technology: str = "LTE"
                  ) -> dict[str, DataFrame]:
    """Roll-ups, breaches, diagnoses and actions of a cell frame, as lazy tables with counts."""
    per_cell = R.aggregate(cells, "cell", "all", technology)
    spaced = per_cell.join(inter_site_distance(sites), "site_id", "left")
    loaded = ACT.with_sibling_load(spaced) if "dl_prb_util" in spaced.columns else spaced
    diagnoses = DIA.diagnose(loaded, technology)
    out = {"per_cell": per_cell, "breaches": R.breaches(per_cell, technology),
           "diagnoses": diagnoses, "actions": ACT.recommend(diagnoses, loaded)}
    if "dl_prb_util" in spaced.columns:
        out["imbalance"] = DIA.traffic_imbalance(spaced)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("result"), "n")
    counts = None
    for name in list(out):
        part = one(out[name], name)
        counts = part if counts is None else counts.unionByName(part)
    out["counts"] = counts
    return out


