"""Level and period roll-ups of KPI frames, busy hours, pivots, breaches and daily reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.times import day_floor, hour_floor
from radiolake.kpis import agg_kind, catalogue_rows, rule_rows
from radiolake.operators.common import (exact_quantile, first_by, top_n_by, with_scalars)

# The columns a level groups by, and the traffic columns a weighted mean
# falls back to, in order.
LEVEL_KEYS = {"cell": ["technology", "region", "site_id", "sector_id", "cell_id", "band"],
              "sector": ["technology", "region", "site_id", "sector_id"],
              "site": ["technology", "region", "site_id"]}
WEIGHT_FALLBACK = ("total_traffic_gb", "dl_traffic_gb", "rrc_setup_att", "erab_setup_att",
                   "ho_att")
LEVEL_ID = {"cell": "cell_id", "sector": "sector_id", "site": "site_id"}


def period_bucket(col: str, period: str) -> Column:
    if period == "hour":
        return hour_floor(col)
    if period == "dow_hour":
        names = F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
        return F.concat(F.element_at(names, F.weekday(F.col(col).cast("date")) + 1), F.lit(" "),
                        F.lpad(F.hour(col).cast("string"), 2, "0"), F.lit(":00"))
    return day_floor(col)


def _weights_of(columns: Sequence[str], wanted: str | None) -> list[str]:
    """The weight columns of a KPI in order: its own if the frame has it, then the traffic ones."""
    own = [wanted] if wanted and wanted in columns else []
    return own + [c for c in WEIGHT_FALLBACK if c in columns and c not in own]


def aggregate(df: DataFrame, level: str = "cell", period: str = "day",
              technology: str = "LTE") -> DataFrame:
    """One row per level and period with every catalogue KPI by its own kind, and n_rows."""
    keys = [k for k in LEVEL_KEYS[level] if k in df.columns]
    work = df
    if period != "all":
        work = work.withColumn("datetime", period_bucket("datetime", period))
        keys = [*keys, "datetime"]
    rows = [r for r in catalogue_rows(technology) if r["kpi"] in df.columns]
    weighted = {r["kpi"]: _weights_of(df.columns, r["weight_kpi"]) for r in rows
                if r["aggregate"] == "weighted"}
    weights = sorted({w for ws in weighted.values() for w in ws})
    clip = lambda w: F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))
    aggs = []
    for w in weights:
        aggs += [F.sum(w).alias(f"_total_{w}"), F.sum(clip(w)).alias(f"_den_{w}")]
    for r in rows:
        k, how = r["kpi"], r["aggregate"]
        fn = {"sum": F.sum, "max": F.max, "min": F.min}.get(how, F.avg)
        aggs += [F.sum(F.col(k) * clip(w)).alias(f"_num_{k}_{w}") for w in weighted.get(k, ())]
        aggs.append(fn(k).alias(k))
    out = work.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_rows"))
    if weights:
        # whether a weight carries anything is a property of the whole frame: it is read off
        # the rolled-up rows, whose shuffle both uses share
        out = with_scalars(out, out.agg(*[
            (F.coalesce(F.sum(f"_total_{w}"), F.lit(0.0)) > 0).alias(f"_has_{w}")
            for w in weights]))

    def value(k: str) -> Column:
        expr = F.col(k)
        for w in reversed(weighted.get(k, ())):
            den = F.col(f"_den_{w}")
            mean = F.coalesce(F.col(f"_num_{k}_{w}") / F.when(den != 0, den), F.col(k))
            expr = F.when(F.col(f"_has_{w}"), mean).otherwise(expr)
        return expr.alias(k)

    return fill_call_setup(out.select(*keys, *[value(r["kpi"]) for r in rows], "n_rows"))


def fill_call_setup(df: DataFrame) -> DataFrame:
    """Missing call setup success is the product of its two parts."""
    if not {"rrc_setup_sr", "erab_setup_sr", "call_setup_sr"} <= set(df.columns):
        return df
    return df.withColumn("call_setup_sr", F.coalesce(
        "call_setup_sr", F.col("rrc_setup_sr") * F.col("erab_setup_sr") / 100))


def busy_hour(df: DataFrame, by: str = "site") -> DataFrame:
    """Hour of day with the highest mean traffic (else PRB use); ties go to the earlier hour."""
    metric = next(m for m in ("total_traffic_gb", "dl_traffic_gb", "dl_prb_util")
                  if m in df.columns)
    key = LEVEL_ID[by]
    prof = df.groupBy(key, F.hour("datetime").alias("hour")).agg(F.avg(metric).alias("m"))
    return prof.filter(F.col("m").isNotNull()).groupBy(key).agg(
        first_by(["hour", "m"], -F.col("m"), "hour").alias("w")).select(
        key, F.col("w.hour").alias("busy_hour"), F.col("w.m").alias(f"bh_{metric}"))


def p95_by(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Exact 95th percentile per key: the busy-hour value of a capacity KPI.

    The frame has one row per object and hour, so a key's values are bounded by the hours of
    the window and one aggregation holds them.
    """
    return df.groupBy(key).agg(*[F.percentile(c, F.lit(0.95)).alias(f"bh_{c}") for c in cols])


def network_profile(df: DataFrame, kpis: Sequence[str], key: str = "datetime",
                    technology: str = "LTE") -> DataFrame:
    """Network-wide hourly shape: the sum of counters and the mean of levels, with cells."""
    kind = {r["kpi"]: r["aggregate"] for r in catalogue_rows(technology)}
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"),
        *[(F.sum(k) if kind.get(k) == "sum" else F.avg(k)).alias(k) for k in kpis])


def headline(per_cell: DataFrame, kpis: Sequence[str], technology: str = "LTE") -> DataFrame:
    """Per KPI: network value, worst cell, lines, status and cells past the warning."""
    spark = per_cell.sparkSession
    kind = {r["kpi"]: r for r in catalogue_rows(technology)}
    lines = {r["kpi"]: r for r in rule_rows(technology)}
    dim = spark.createDataFrame(
        [(k, kind.get(k, {}).get("label", k), kind.get(k, {}).get("unit", ""),
          kind.get(k, {}).get("aggregate") == "sum", lines.get(k, {}).get("direction"),
          lines.get(k, {}).get("warning"), lines.get(k, {}).get("critical")) for k in kpis],
        "kpi string, label string, unit string, is_sum boolean, direction string, "
        "warning double, critical double")
    long = per_cell.select(*[F.col(k).cast("double").alias(k) for k in kpis]).unpivot(
        [], list(kpis), "kpi", "v").filter(F.col("v").isNotNull())
    j = long.join(F.broadcast(dim), "kpi")
    past = F.when(F.col("direction") == "down", F.col("v") > F.col("warning")).otherwise(
        F.col("v") < F.col("warning"))
    g = j.groupBy("kpi", "label", "unit", "is_sum", "direction", "warning", "critical").agg(
        F.sum("v").alias("s"), F.avg("v").alias("m"), F.max("v").alias("hi"),
        F.min("v").alias("lo"), F.count_if(past).alias("cells_below_target"))
    value = F.when(F.col("is_sum"), F.col("s")).otherwise(F.col("m"))
    down = F.col("direction") == "down"
    over = lambda line: F.when(down, value > line).otherwise(value < line)
    status = (F.when(F.col("direction").isNull() | F.col("is_sum"), "-")
              .when(over(F.col("critical")), "Critical").when(over(F.col("warning")), "Warning")
              .otherwise("OK"))
    return g.select("kpi", "label", "unit", value.alias("network"),
                    F.when(F.coalesce(down, F.lit(False)), F.col("hi")).otherwise(F.col("lo"))
                    .alias("worst"), "warning", "critical", status.alias("status"),
                    "cells_below_target")


def hourly_pivot(df: DataFrame, kpi: str, hours: Sequence, id_col: str | Sequence[str] = "object",
                 side: str | None = None, label: str = "MM/dd HH:mm") -> DataFrame:
    """One row per id and one column per listed hour, mean, two decimals half to even.

    With a date among the id columns and the label `HH:mm` a period of any length keeps 24 columns.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = df.filter(F.col(kpi).isNotNull()).withColumn(
        "_h", F.date_format(F.col("datetime").cast("timestamp"), label))
    shape = label.replace("MM", "%m").replace("dd", "%d").replace("HH", "%H").replace("mm", "%M")
    names = [h if isinstance(h, str) else h.strftime(shape) for h in hours]
    aggs = [F.bround(F.avg(F.when(F.col("_h") == n, F.col(kpi))), 2).alias(n) for n in names]
    if side:
        aggs = [F.min(side).alias(side), *aggs]
    return rows.groupBy(*ids).agg(*aggs)


def time_matrix(df: DataFrame, kpi: str) -> DataFrame:
    """Per sector and hour the KPI by its own kind, the site's value where the sector has none."""
    agg = F.sum if agg_kind(kpi) == "sum" else F.avg
    rows = df.filter(F.col(kpi).isNotNull())
    own = rows.filter(~F.col("sector_id").endswith("-S0")).groupBy(
        "site_id", "sector_id", "datetime").agg(agg(kpi).alias("own"))
    site = rows.groupBy("site_id", "datetime").agg(agg(kpi).alias("site_value"))
    return value_or_site(own, site, df.select("site_id", "sector_id").distinct())


def value_or_site(own: DataFrame, site: DataFrame, sectors: DataFrame) -> DataFrame:
    """The sector's value, else its site's, per hour where both carry one."""
    at = [c for c in ("datetime",) if c in own.columns]
    base = sectors.join(site, "site_id").join(own, ["site_id", "sector_id", *at], "left")
    return base.select("site_id", "sector_id", *at, F.coalesce("own", "site_value").alias("value"),
                       F.col("own").isNull().alias("from_site"))


# --------------------------------------------------------------------- breaches
def breaches(agg: DataFrame, technology: str = "LTE", level: str = "cell",
             only: Sequence[str] = (), overrides: dict | None = None) -> DataFrame:
    """Every warning and critical breach of an aggregated frame, behind its traffic guard."""
    spark = agg.sparkSession
    rules = [r for r in rule_rows(technology, overrides)
             if r["kpi"] in agg.columns and (not only or r["kpi"] in only)]
    kpis = [r["kpi"] for r in rules]
    dim = spark.createDataFrame(
        [(r["kpi"], r["direction"], r["warning"], r["critical"], r["min_traffic_gb"],
          r["min_samples"]) for r in rules],
        "kpi string, direction string, warning double, critical double, min_traffic double, "
        "min_rows int")
    has_traffic = "total_traffic_gb" in agg.columns
    ids = [c for c in dict.fromkeys((LEVEL_ID[level], "site_id", "datetime")) if c in agg.columns]
    base = agg.select(*ids, *[F.col(k).cast("double").alias(k) for k in kpis],
                      (F.coalesce("total_traffic_gb", F.lit(0.0)) if has_traffic else F.lit(0.0))
                      .alias("traffic_gb"),
                      (F.coalesce("n_rows", F.lit(0)) if "n_rows" in agg.columns else F.lit(0))
                      .cast("bigint").alias("n_rows"))
    long = base.unpivot([*ids, "traffic_gb", "n_rows"], kpis, "kpi", "value").filter(
        F.col("value").isNotNull())
    j = long.join(F.broadcast(dim), "kpi")
    guard = (F.col("traffic_gb") >= F.col("min_traffic")) if has_traffic else F.lit(True)
    rows_ok = (F.col("n_rows") == 0) | (F.col("n_rows") >= F.col("min_rows"))
    past = lambda c: F.when(F.col("direction") == "up", F.col("value") < F.col(c)).otherwise(
        F.col("value") > F.col(c))
    sev = F.when(past("critical"), 2).when(past("warning"), 1).otherwise(0)
    out = j.filter(guard & rows_ok).withColumn("sev", sev).filter(F.col("sev") > 0)
    return out.select(*ids, "kpi", "value", "sev", "direction", F.when(
        F.col("sev") == 2, F.col("critical")).otherwise(F.col("warning")).alias("threshold"),
        "traffic_gb", "n_rows")


CAPACITY_KPIS = ("dl_prb_util", "ul_prb_util", "pdcch_util", "rrc_conn_users_avg",
                 "active_users_dl_avg")


def capacity_breaches(hourly: DataFrame, technology: str = "LTE",
                      kpis: Sequence[str] = CAPACITY_KPIS) -> DataFrame:
    """Critical hours of the capacity KPIs, the first per cell and KPI: its busy hour."""
    b = breaches(hourly, technology, "cell", only=kpis).filter(F.col("sev") == 2)
    return top_n_by(b, ["cell_id", "kpi"], [F.desc("traffic_gb"), F.col("datetime")], 1)


def priority(sev, traffic, busy) -> Column:
    """P1..P4: how broken the cell is, and whether it carries at least the median traffic."""
    high = F.col(traffic) >= F.col(busy)
    return (F.when(F.col(sev) == 2, F.when(high, "P1").otherwise("P2"))
            .when(high, "P3").otherwise("P4"))


def median_traffic(per_cell: DataFrame) -> DataFrame:
    return exact_quantile(per_cell, [], "total_traffic_gb", 0.5, "busy_gb").select(
        F.coalesce("busy_gb", F.lit(0.0)).alias("busy_gb"))


def busy_hour_findings(per_cell: DataFrame, peaks: DataFrame, kpis: Sequence[str],
                       technology: str = "LTE") -> DataFrame:
    """Capacity KPIs judged on their busy-hour value, unless the mean already is as high."""
    means = per_cell.select("cell_id", *[F.col(k).alias(f"mean_{k}") for k in kpis])
    at_peak = per_cell.drop(*kpis).join(
        peaks.select("cell_id", *[F.col(f"bh_{k}").alias(k) for k in kpis]), "cell_id", "left")
    b = breaches(at_peak, technology, "cell", only=kpis).join(means, "cell_id")
    mean = F.coalesce(*[F.when(F.col("kpi") == k, F.col(f"mean_{k}")) for k in kpis])
    b = b.withColumn("mean_value", mean).filter(
        F.col("mean_value").isNull() | (F.col("mean_value") < F.col("value")))
    b = with_scalars(b, median_traffic(per_cell))
    return b.select("cell_id", "site_id", "kpi", "value", "mean_value", "threshold", "sev",
                    priority("sev", "traffic_gb", "busy_gb").alias("priority"), "traffic_gb",
                    F.lit("high_utilization").alias("problem_class"))


# The KPI a problem class is worst on, and its bad end.
WORST_BY_CLASS = {"availability": ("cell_avail_pct", "min"),
                  "high_utilization": ("dl_prb_util", "max"),
                  "interference": ("ul_rssi_dbm", "max"),
                  "retainability": ("erab_drop_rate", "max"),
                  "accessibility": ("call_setup_sr", "min"),
                  "handover": ("ho_sr", "min"),
                  "low_throughput": ("dl_user_thr_mbps", "min"),
                  "traffic_imbalance": ("total_traffic_gb", "max")}


def worst_hours(df: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """Per cell and problem class: the hour its KPI looked worst (the earliest on a tie)."""
    have = {c: v for c, v in WORST_BY_CLASS.items() if v[0] in df.columns}
    pairs = F.array(*[F.struct(F.lit(c).alias("problem_class"),
                               (F.col(k) if end == "min" else -F.col(k)).cast("double")
                               .alias("score"), F.col(k).cast("double").alias("value"))
                      for c, (k, end) in have.items()])
    long = df.select(id_col, "datetime", F.explode(pairs).alias("p")).filter(
        F.col("p.score").isNotNull())
    return long.groupBy(id_col, F.col("p.problem_class").alias("problem_class")).agg(
        first_by([F.col("datetime"), F.col("p.value").alias("value")], "p.score", "datetime")
        .alias("w")).select(id_col, "problem_class", F.col("w.datetime").alias("worst_hour"),
                            F.col("w.value").alias("worst_value"))


def order_findings(findings: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """One row per cell and class, the most urgent; P1 first, then the most traffic."""
    one = top_n_by(findings, [id_col, "problem_class"],
                   [F.col("priority"), F.desc("traffic_gb")], 1)
    return one.orderBy("priority", F.desc("traffic_gb"), id_col, "problem_class")


def site_day_findings(hourly: DataFrame, technology: str = "UMTS", shown: int = 4) -> DataFrame:
    """Site-day breaches with the hours that broke the line (the first few, then a count)."""
    per_day = aggregate(hourly, "site", "day", technology)
    b = breaches(per_day, technology, "site").withColumnRenamed("datetime", "day")
    kpis = [r["kpi"] for r in rule_rows(technology) if r["kpi"] in hourly.columns]
    long = hourly.select("site_id", "datetime", day_floor("datetime").alias("day"),
                         *[F.col(k).cast("double").alias(k) for k in kpis]).unpivot(
        ["site_id", "datetime", "day"], kpis, "kpi", "v").filter(F.col("v").isNotNull())
    # an hour of day occurs once per site and day after this step: at most 24 rows a group
    hours = long.groupBy("site_id", "day", "kpi", F.hour("datetime").alias("h")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = b.join(hours, ["site_id", "day", "kpi"], "left")
    bad = F.when(F.col("direction") == "down", F.col("hi") > F.col("threshold")).otherwise(
        F.col("lo") < F.col("threshold"))
    text = F.when(bad, F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00")))
    g = j.groupBy("site_id", "day", "kpi", "value", "sev", "threshold").agg(
        F.sort_array(F.collect_set(text)).alias("hrs"))
    more = F.size("hrs") - shown
    return g.select("site_id", "day", "kpi", "value", "sev", "threshold",
                    F.when(F.col("sev") == 2, "P1").otherwise("P3").alias("priority"),
                    F.concat(F.array_join(F.slice("hrs", 1, shown), ", "),
                             F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"),
                                                       F.lit(" more)"))).otherwise(""))
                    .alias("bad_hours"))


def top_sites(cells: DataFrame, n: int, low_is_bad: bool = False) -> DataFrame:
    """The n worst sites at their worst cell, each site once."""
    bad = F.col("value") if low_is_bad else -F.col("value")
    worst = cells.groupBy("site_id").agg(
        first_by(["object", "value"], bad, "object").alias("w")).select("site_id", "w.*")
    return worst.orderBy(F.col("value") if low_is_bad else F.desc("value"), "site_id").limit(n)


def kpi_context(df: DataFrame) -> DataFrame:
    """Per site and sector: worst, mean and total values, with the network's 95th percentile."""
    g = df.groupBy("site_id", "sector_id").agg(
        F.max("dl_prb_util").alias("prb_max"), F.avg("dl_prb_util").alias("prb_mean"),
        F.min("cell_avail_pct").alias("avail_min"), F.max("ul_rssi_dbm").alias("rssi_max"),
        F.sum("total_traffic_gb").alias("traffic_gb"))
    return with_scalars(g, exact_quantile(df, [], "dl_prb_util", 0.95, "prb_net_p95"))


def sibling_load(cells: DataFrame, kpi: str = "dl_prb_util") -> DataFrame:
    """Per sector: every co-sited cell's load. A site hosts tens of cells, so the list is short."""
    per_cell = cells.groupBy("site_id", "sector_id", "cell_id").agg(F.avg(kpi).alias("load"))
    return per_cell.groupBy("site_id", "sector_id").agg(
        F.count(F.lit(1)).alias("cells"), F.max("load").alias("top"), F.min("load").alias("low"),
        F.sort_array(F.collect_list(F.struct("cell_id", "load"))).alias("siblings"))
