"""Composed runs on kept results: every stage is written once and what follows starts from there.

A run has a folder that all executors reach. The input is read once, a table that several stages need
is made once, and a lost executor costs the stage it was in and no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.kpis import rule_rows
from radiolake.operators import actions as ACT
from radiolake.operators import diagnose as DIA
from radiolake.operators import health as H
from radiolake.operators import rollup as R
from radiolake.operators import series as N
from radiolake.operators.report import findings_table
from radiolake.operators.spatial import inter_site_distance
from radiolake.sources.exports import granularity
from radiolake.sources.sinks import kept

# The KPIs that are looked at by the hour, not by the mean.
HOURLY_CAPACITY = ("dl_prb_util", "ul_prb_util", "pdcch_util", "ue_rejected_rrc", "rrc_conn_users_avg")
MIN_TREND_POINTS = 5


class Run:
    """Named tables under one folder. `keep` writes a table and gives it back as read from there."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.tables: dict[str, DataFrame] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise ValueError(f"the run has a table {name} already")
        self.tables[name] = kept(df, f"{self.folder}/{name}")
        return self.tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def counts(self) -> DataFrame:
        """(result, n) of every kept table; Parquet keeps row counts, so no table is read again."""
        one = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("result"), "n")
               for name, df in self.tables.items()]
        out = one[0]
        for df in one[1:]:
            out = out.unionByName(df)
        return out


def trend_series(frame: DataFrame, kpis: Sequence[str], key: str = "cell_id") -> DataFrame:
    """The judged KPIs of an aggregated frame as (key, datetime, kpi, value)."""
    wide = frame.select(key, "datetime", *[F.col(k).cast("double").alias(k) for k in kpis])
    return wide.unpivot([key, "datetime"], list(kpis), "kpi", "value").filter(F.col("value").isNotNull())


def full_analysis(run: Run, cells: DataFrame, sites: DataFrame, technology: str = "LTE") -> Run:
    """The whole analysis of a cell KPI frame, kept table by table.

    input; per_cell, per_sector, per_site; of an hourly frame per_hour, busy_hour (sites) and worst_hours;
    breaches of the whole period (`period` all) and the busy hour of critical capacity KPIs (`period`
    hour); trends, of an hourly frame by the hour, else by the day if there are five days or more;
    diagnoses reinforced by trends, with traffic imbalance; actions; findings with P1..P4 and worst hour;
    summary, one row. A frame without a time of day has neither hours nor busy-hour findings.
    """
    data = run.keep("input", cells)
    hourly = granularity(data).first()["granularity"] == "hour"
    per_cell = run.keep("per_cell", R.aggregate(data, "cell", "all", technology))
    for level in ("sector", "site"):
        run.keep(f"per_{level}", R.aggregate(data, level, "all", technology))
    breaches = R.breaches(per_cell, technology).withColumn("period", F.lit("all")).withColumn(
        "datetime", F.lit(None).cast(data.schema["datetime"].dataType))
    if hourly:
        by_time = run.keep("per_hour", R.aggregate(data, "cell", "hour", technology))
        run.keep("busy_hour", R.busy_hour(data, "site"))
        run.keep("worst_hours", R.worst_hours(data))
        peaks = R.capacity_breaches(by_time, technology, HOURLY_CAPACITY)
        breaches = breaches.unionByName(peaks.withColumn("period", F.lit("hour")), allowMissingColumns=True)
    else:
        by_time = run.keep("per_day", R.aggregate(data, "cell", "day", technology))
    run.keep("breaches", breaches)

    way = {r["kpi"]: r["direction"] for r in rule_rows(technology) if r["kpi"] in by_time.columns}
    points = by_time.select("datetime").distinct().limit(MIN_TREND_POINTS).count()
    directions = F.coalesce(*[F.when(F.col("kpi") == k, d) for k, d in way.items()], F.lit("down"))
    series = trend_series(by_time, list(way))
    if not hourly and points < MIN_TREND_POINTS:
        series = series.limit(0)
    trends = run.keep("trends", N.detect_anomalies(series, ["cell_id", "kpi"], directions))

    context = per_cell.join(inter_site_distance(sites), "site_id", "left")
    loaded = "dl_prb_util" in context.columns and "sector_id" in context.columns
    context = run.keep("context", ACT.with_sibling_load(context) if loaded else context)
    found = DIA.reinforce_by_trend(DIA.diagnose(context, technology), trends, technology)
    if loaded:
        found = found.unionByName(DIA.traffic_imbalance(per_cell), allowMissingColumns=True)
    diagnoses = run.keep("diagnoses", found)
    run.keep("actions", ACT.recommend(diagnoses, context))

    shown = ["cell_id", "site_id", "problem_class", "sev", "priority", "traffic_gb"]
    findings = findings_table(diagnoses, per_cell).select(*shown)
    capacity = [k for k in ("dl_prb_util", "ul_prb_util", "rrc_conn_users_avg") if k in data.columns]
    if hourly:
        if capacity:
            peaks = R.busy_hour_findings(per_cell, R.p95_by(data, "cell_id", capacity), capacity, technology)
            findings = findings.unionByName(peaks.select(*shown))
        findings = R.order_findings(findings).join(run["worst_hours"], ["cell_id", "problem_class"], "left")
    else:
        findings = R.order_findings(findings)
    run.keep("findings", findings)
    run.keep("summary", summary(run, technology, "hour" if hourly else "day"))
    return run


def summary(run: Run, technology: str, grain: str) -> DataFrame:
    """One row: what went in and how much was found."""
    data = run["input"].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("site_id").alias("sites"),
                            F.count_distinct("cell_id").alias("cells"))
    n = F.count(F.lit(1))
    falling = F.count_if(F.col("verdict").isin("degrading", "step-down")).alias("degrading_trends")
    out = data.select(F.lit(technology).alias("technology"), F.lit(grain).alias("granularity"), "*")
    for one in (run["breaches"].agg(n.alias("kpi_breaches")), run["trends"].agg(falling),
                run["diagnoses"].agg(n.alias("diagnoses"), F.count_if(F.col("sev") == 2).alias(
                    "critical_diagnoses")), run["actions"].agg(n.alias("recommendations"))):
        out = out.join(F.broadcast(one))  # one row each
    return out


def dashboard(run: Run, judged_hours: DataFrame, places: DataFrame, tickets: DataFrame) -> Run:
    """The numbers of the dashboard: state of sites, problem ranking, areas, days, tickets by state.

    `judged_hours`: hours with their severity; `places`: site_id, sup_district; `tickets`: state.
    Judged hours and objects are kept, all panels start from them.
    """
    hours = run.keep("hours", judged_hours)
    objects = run.keep("objects", H.judge_objects(hours))
    status = run.keep("status", H.site_status(objects, places.select("site_id").distinct()))
    run.keep("distribution", status.groupBy("sev").agg(F.count(F.lit(1)).alias("sites")))
    run.keep("ranking", H.problem_ranking(objects))
    bad = status.filter(F.col("sev") > 0).join(places.select("site_id", "sup_district"), "site_id")
    run.keep("areas", bad.filter(F.col("sup_district").isNotNull()).groupBy("sup_district").agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(F.col("sev") == 2).alias("critical")))
    run.keep("days", H.issues_by_day(hours))
    run.keep("tickets", tickets.groupBy("state").agg(F.count(F.lit(1)).alias("tickets")))
    return run


def panels(run: Run) -> DataFrame:
    """All panels as rows: panel, item, n, critical (null where a panel has none)."""
    none = F.lit(None).cast("bigint")
    row = lambda df, name, item, n, critical=none: df.select(
        F.lit(name).alias("panel"), item.cast("string").alias("item"), n.alias("n"),
        critical.alias("critical"))
    c = F.col
    parts = [row(run["distribution"], "distribution", c("sev"), c("sites")),
             row(run["ranking"], "ranking", c("label"), c("sites"), c("critical")),
             row(run["areas"], "areas", c("sup_district"), c("sites"), c("critical")),
             row(run["days"], "days", F.date_format("day", "yyyy-MM-dd"), c("issues"), c("critical")),
             row(run["tickets"], "tickets", c("state"), c("tickets"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
