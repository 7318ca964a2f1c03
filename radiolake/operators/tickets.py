"""Tickets against the KPI hours around them.

A ticket only ever meets its site's hours: the hours are first reduced to one row per site,
KPI and hour, the tickets to distinct (site, hour window) pairs, and the two join on equal
(site, hour). What follows a window is read from running totals of the site's series, so no
ticket is paired with the rest of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.text import window_bounds
from radiolake.functions.times import day_floor, hour_floor, plus_hours
from radiolake.kpis import MAIN_KPIS
from radiolake.operators.common import first_by, with_scalars
from radiolake.operators.health import badness

TECHNICAL, POSSIBLE = "Technical Issue", "Possible Technical Issue"
NO_ISSUE, INSUFFICIENT = "No Network Issue Detected", "Insufficient Data"
RESOLVED, NOT_RESOLVED, UNKNOWN = "Resolved", "Not Resolved", "Unknown"

# The problem a KPI stands for, and the tile it feeds.
PROBLEM = {"cell_avail_pct": "Availability", "ul_rssi_dbm": "Interference",
           "dl_prb_util": "Congestion", "ul_prb_util": "Congestion",
           "call_setup_sr": "Accessibility", "ipmm_rtt_ms": "Transport latency",
           "ul_rtwp_dbm": "Interference", "dl_flowctrl_drops": "Flow control"}
TILE = {"cell_avail_pct": "AVA", "dl_prb_util": "PRB", "ul_prb_util": "PRB",
        "ul_rssi_dbm": "INTER", "call_setup_sr": "CSSR", "ipmm_rtt_ms": "IPL",
        "ul_rtwp_dbm": "RTWP", "dl_flowctrl_drops": "FLOW"}
PRIMARY_TILES = ("AVA", "PRB", "INTER", "FLOW")


def mapped(col: str, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.col(col)), F.col(col))


def hours_between(lo: Column, hi: Column) -> Column:
    """Every whole hour from lo to hi."""
    return F.sequence(hour_floor(lo), hour_floor(hi), F.expr("INTERVAL 1 HOUR"))


def windows_of(tickets: DataFrame, hours: float) -> DataFrame:
    """Tickets with the hour bounds of their window."""
    lo, hi = window_bounds("problem_time", hours)
    return tickets.withColumn("lo", lo).withColumn("hi", hour_floor(hi))


def ticket_window(tickets: DataFrame, kpi: DataFrame, hours: float) -> DataFrame:
    """KPI rows of the ticket's site inside its window: an equi join on (site, hour)."""
    # the KPI row's own minute still counts against the unrounded upper bound
    w = windows_of(tickets, hours).select(
        "ticket_id", "site_id", window_bounds("problem_time", hours)[1].alias("_end"),
        F.explode(hours_between(F.col("lo"), F.col("hi"))).alias("_h"))
    k = kpi.withColumn("_h", hour_floor("datetime"))
    j = w.join(k, ["site_id", "_h"])
    return j.filter(F.col("datetime") <= F.col("_end")).drop("_h", "_end")


def ticket_hour_value(tickets: DataFrame, site_hours: DataFrame) -> DataFrame:
    """The ticket's site at the problem hour."""
    t = tickets.select("ticket_id", "site_id", hour_floor("problem_time").alias("datetime"))
    return t.join(site_hours, ["site_id", "datetime"], "left")


def site_kpi_hours(hours: DataFrame) -> DataFrame:
    """One row per site, KPI and hour: state, the worst object, and the objects seen and bad."""
    bad = F.col("sev") > 0
    return hours.groupBy("site_id", "kpi", "datetime").agg(
        F.first("label").alias("label"), F.first("direction").alias("direction"),
        F.max("sev").alias("sev"),
        first_by(["v", "object_id"], -F.col("sev"), badness(), "object_id").alias("w"),
        F.collect_set("object_id").alias("cells"),
        F.collect_set(F.when(bad, F.col("object_id"))).alias("bad_cells")).select(
        "site_id", "kpi", "datetime", "label", "direction", "sev", F.col("w.v").alias("v"),
        F.col("w.object_id").alias("object_id"), "cells", "bad_cells")


def ticket_checks(tickets: DataFrame, site_hours: DataFrame, window_h: float) -> DataFrame:
    """Per ticket and KPI of its site: hours, breach hours, worst cell-hour, cells, the state
    six hours before, and what became of it by the end of the data."""
    t = windows_of(tickets.filter(F.col("problem_time").isNotNull()), window_h)
    keys = ["site_id", "lo", "hi"]
    spans = t.select(*keys).distinct()
    grid = spans.select(*keys, F.explode(hours_between(
        plus_hours("lo", -6), F.col("hi"))).alias("datetime"))
    h = grid.join(site_hours, ["site_id", "datetime"])
    inside, before = F.col("datetime") >= F.col("lo"), F.col("datetime") < F.col("lo")
    bad = F.col("sev") > 0
    order = F.when(inside, F.struct(-F.col("sev"), badness().alias("b"), "datetime", "object_id"))
    stats = h.groupBy(*keys, "kpi").agg(
        F.count_if(inside).alias("hours"), F.count_if(inside & bad).alias("breach_hours"),
        F.max(F.when(inside, F.col("sev"))).alias("sev"),
        F.min_by(F.struct("v", "datetime", "object_id"), order).alias("w"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(inside, F.col("cells"))))))
        .alias("cells"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(
            F.when(inside, F.col("bad_cells")))))).alias("bad_cells"),
        F.min(F.when(inside & bad, F.col("datetime"))).alias("breach_from"),
        F.max(F.when(inside & bad, F.col("datetime"))).alias("breach_to"),
        F.count_if(before).alias("n_before"), F.count_if(before & bad).alias("bad_before"))
    after = after_window(spans, site_hours)
    known = site_hours.groupBy("site_id", "kpi").agg(
        F.first("label").alias("label"), F.first("direction").alias("direction"))
    c = spans.join(known, "site_id").join(stats, [*keys, "kpi"], "left").join(
        after, [*keys, "kpi"], "left")
    sev = F.coalesce("sev", F.lit(-1))
    c = c.withColumn("sev", sev)
    c = c.select(
        *keys, "kpi", "label", "direction", "sev",
        F.coalesce("hours", F.lit(0)).alias("hours"),
        F.coalesce("breach_hours", F.lit(0)).alias("breach_hours"),
        F.col("w.v").alias("worst"), F.col("w.datetime").alias("worst_at"),
        F.col("w.object_id").alias("worst_obj"), "cells", "bad_cells", "breach_from", "breach_to",
        F.when(F.col("sev") >= 0, F.when(F.col("bad_before") > 0, "breaching")
               .when(F.col("n_before") > 0, "normal").otherwise("no data")).alias("before"),
        F.when(F.col("sev") >= 0, F.when(F.col("after_n").isNull(), "no data")
               .when(F.col("after_last_sev") > 0, "breaching").otherwise("normal")).alias("after"),
        "after_bad", "after_since",
        F.when(F.col("sev") > 0, F.when(F.col("after_n").isNull(), UNKNOWN)
               .when(F.col("after_last_sev") > 0, NOT_RESOLVED).otherwise(RESOLVED))
        .alias("resolution"))
    return t.select("ticket_id", *keys).join(c, keys)


def after_window(spans: DataFrame, site_hours: DataFrame) -> DataFrame:
    """Per (site, window end, KPI): hours after it, issue hours among them, the last state,
    and the first hour of the recovery.

    Window ends and hours of a site run through one sorted pass (a site and KPI has one row
    per hour and at most one window end per hour), reading totals from the end backwards.
    """
    keys = ["site_id", "lo", "hi"]
    ends = spans.select("site_id", "hi").distinct()
    kpis = site_hours.select("site_id", "kpi").distinct()
    marks = ends.join(kpis, "site_id").select(
        "site_id", "kpi", F.col("hi").alias("datetime"), F.lit(None).cast("int").alias("sev"),
        F.lit(0).alias("kind"))
    rows = site_hours.select("site_id", "kpi", "datetime", F.col("sev").cast("int").alias("sev"),
                             F.lit(1).alias("kind"))
    # an hour equal to the window's end is inside: it sorts before the mark, so not after it
    later = W.partitionBy("site_id", "kpi").orderBy(F.desc("datetime"), "kind").rowsBetween(
        W.unboundedPreceding, -1)
    earlier = W.partitionBy("site_id", "kpi").orderBy("datetime", F.desc("kind")).rowsBetween(
        W.unboundedPreceding, -1)
    u = marks.unionByName(rows)
    # the last issue hour up to each row tells where the run of good hours began
    is_hour = F.col("kind") == 1
    bad = is_hour & (F.col("sev") > 0)
    u = u.withColumn("_prev_bad", F.last(F.when(is_hour, F.col("sev") > 0), True).over(earlier))
    start = F.when(is_hour & (F.col("sev") == 0), F.when(F.coalesce("_prev_bad", F.lit(True)),
                                                         F.col("datetime")))
    u = u.withColumn("_start", start)
    u = (u.withColumn("after_n", F.count(F.when(is_hour, 1)).over(later))
         .withColumn("after_bad", F.count(F.when(bad, 1)).over(later))
         .withColumn("_last", F.max(F.when(is_hour, F.struct("datetime", "sev"))).over(later))
         .withColumn("_first", F.min(F.when(is_hour, F.col("datetime"))).over(later))
         .withColumn("_last_start", F.max("_start").over(later)))
    out = u.filter((F.col("kind") == 0) & (F.col("after_n") > 0)).select(
        "site_id", F.col("datetime").alias("hi"), "kpi", "after_n", "after_bad",
        F.col("_last.sev").alias("after_last_sev"),
        F.when(F.col("_last.sev") == 0, F.when(F.col("after_bad") > 0, F.col("_last_start"))
               .otherwise(F.col("_first"))).alias("after_since"))
    return spans.select(*keys).distinct().join(out, ["site_id", "hi"])


def ticket_verdict(tickets: DataFrame, checks: DataFrame, window_h: float) -> DataFrame:
    """Technical, possible, none or insufficient; the problem, confidence and resolution."""
    main = F.col("kpi").isin(*MAIN_KPIS)
    rank = F.struct(-F.col("sev"), (~main).alias("m"), -F.col("breach_hours"), "label")
    full = max(1, round(2 * window_h))
    g = checks.groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sev") >= 0).alias("judged"),
        F.count_if(F.col("sev") == 2).alias("crit"), F.count_if(F.col("sev") == 1).alias("warn"),
        F.count_if((F.col("sev") >= 0) & (F.col("hours") >= full)).alias("full"),
        F.min_by(F.struct("kpi", "label", "worst", "breach_hours"), rank).alias("top"),
        F.count_if((F.col("sev") > 0) & (F.col("resolution") == NOT_RESOLVED)).alias("open"),
        F.count_if((F.col("sev") > 0) & (F.col("resolution") != RESOLVED)).alias("not_closed"))
    j = tickets.select("ticket_id", "site_id", "problem_time").join(g, "ticket_id", "left")
    crit, warn = F.coalesce("crit", F.lit(0)) > 0, F.coalesce("warn", F.lit(0)) > 0
    enough = F.coalesce("judged", F.lit(0)) > 0
    cls = (F.when(~enough, INSUFFICIENT).when(crit, TECHNICAL).when(warn, POSSIBLE)
           .otherwise(NO_ISSUE))
    j = j.withColumn("classification", cls)
    outage = crit & (F.col("top.kpi") == "cell_avail_pct") & (F.col("top.worst") < 50)
    two = F.col("top.breach_hours") >= 2
    return j.withColumn("top_kpi", F.col("top.kpi")).select(
        "ticket_id", "site_id", "classification",
        F.when(crit & enough, "Yes").when(warn & enough, "Possible").when(enough, "No")
        .otherwise("Unknown").alias("detected"),
        F.when(enough & (crit | warn), F.when(outage, "Outage").otherwise(
            mapped("top_kpi", PROBLEM))).otherwise("").alias("problem_type"),
        F.when(~enough, "").when(crit, F.when(two | (F.col("crit") >= 2), "High")
                                 .otherwise("Medium"))
        .when(warn, F.when(two, "Medium").otherwise("Low"))
        .otherwise(F.when(F.col("full") >= 3, "Medium").otherwise("Low")).alias("confidence"),
        F.when(~enough, "").when(~(crit | warn), "No network issue")
        .when(F.col("open") > 0, NOT_RESOLVED).when(F.col("not_closed") == 0, RESOLVED)
        .otherwise(UNKNOWN).alias("resolution"),
        (enough & ~(crit | warn)).alias("manual_check"))


def indicators(tickets: DataFrame, long: DataFrame, rules: DataFrame, window_h: float,
               counts: Sequence[str] = ()) -> DataFrame:
    """Context indicators per ticket: the worst site-hour of a level, the sum of a count."""
    site = long.groupBy("site_id", "kpi", "datetime").agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("value").alias("s"))
    line = rules.filter(~F.col("is_tdd")).select("kpi", "direction", "critical", "warning",
                                                 "per_site")
    counted = F.col("kpi").isin(*counts) if counts else F.lit(False)
    s = site.join(F.broadcast(line), "kpi", "left").filter(counted | F.col("direction").isNotNull())
    v = F.when(counted | F.col("per_site"), F.col("s")).when(
        F.col("direction") == "up", F.col("lo")).otherwise(F.col("hi"))
    s = s.withColumn("v", v)
    past = F.when(F.col("direction") == "up", F.col("v") < F.col("critical")).otherwise(
        F.col("v") > F.col("critical"))
    s = s.withColumn("sev", F.when(counted, F.when(F.col("v") > 0, 1).otherwise(0))
                     .otherwise(F.when(past, 2).otherwise(0)))
    w = windows_of(tickets.filter(F.col("problem_time").isNotNull()), window_h).select(
        "ticket_id", "site_id", F.explode(hours_between(F.col("lo"), F.col("hi")))
        .alias("datetime"))
    j = w.join(s, ["site_id", "datetime"])
    g = j.groupBy("ticket_id", "kpi").agg(
        F.count(F.lit(1)).alias("hours"), F.max("sev").alias("sev"), F.sum("v").alias("total"),
        first_by(["v", "datetime"], F.when(F.col("direction") == "up", F.col("v"))
                 .otherwise(-F.col("v")), "datetime").alias("w"),
        F.count_if(F.col("sev") > 0).alias("issue_hours"))
    return g.select("ticket_id", "kpi", "hours", "sev", "issue_hours",
                    F.when(counted, F.col("total")).otherwise(F.col("w.v")).alias("value"),
                    F.col("w.datetime").alias("at"))


def ticket_tiles(tickets: DataFrame, checks: DataFrame) -> DataFrame:
    """Per ticket and tile: the worst of the checks that feed it; primary tiles always."""
    c = checks.withColumn("tile", mapped("kpi", TILE))
    extreme = F.when(F.col("direction") == "up", -F.col("worst")).otherwise(F.col("worst"))
    g = c.groupBy("ticket_id", "tile").agg(
        F.max_by(F.struct("kpi", "label", "sev", "worst", "worst_at", "worst_obj"),
                 F.struct("sev", "breach_hours", F.coalesce(extreme, F.lit(float("-inf")))
                          .alias("e"), "kpi")).alias("w"),
        F.count_if(F.col("sev") >= 0).alias("measured"))
    # every ticket carries the four primary tiles: a fixed list, exploded per ticket
    base = tickets.select("ticket_id", F.explode(F.array(*[F.lit(t) for t in PRIMARY_TILES]))
                          .alias("tile"))
    t = base.join(g, ["ticket_id", "tile"], "full")
    sev = F.coalesce("w.sev", F.lit(-1))
    return t.select("ticket_id", "tile", sev.alias("sev"),
                    F.when(sev < 0, "No Data").when(sev == 0, "Normal").when(sev == 2, "Critical")
                    .otherwise("High").alias("state"), F.col("w.kpi").alias("kpi"),
                    F.col("w.worst").alias("value"), F.col("w.worst_obj").alias("object_id"))


def tile_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("tile").agg(
        F.count_if(F.col("sev") == 2).alias("critical"),
        F.count_if(F.col("sev") == 1).alias("warning"),
        F.count_if(F.col("sev") == 0).alias("normal"), F.count_if(F.col("sev") < 0).alias("nodata"))


def ticket_timeline(tickets: DataFrame, site_hours: DataFrame, window_h: float, before_h: int = 2,
                    after_h: int = 3) -> DataFrame:
    """Every hour from a little before the window to a little after it: worst state, the KPIs
    that made it, and the phase."""
    t = windows_of(tickets.filter(F.col("problem_time").isNotNull()), window_h)
    grid = t.select("ticket_id", "site_id", "lo", "hi", F.explode(hours_between(
        plus_hours("lo", -before_h), plus_hours("hi", after_h))).alias("datetime"))
    worst = site_hours.groupBy("site_id", "datetime").agg(
        F.max("sev").alias("sev"),
        F.sort_array(F.collect_set(F.when(F.col("sev") > 0, F.struct("sev", "label")))).alias("l"))
    drivers = F.array_join(F.transform(F.filter("l", lambda x: x["sev"] == F.col("sev")),
                                       lambda x: x["label"]), ", ")
    h = worst.select("site_id", "datetime", "sev", drivers.alias("drivers"))
    j = grid.join(h, ["site_id", "datetime"], "left")
    phase = (F.when(F.col("datetime") < F.col("lo"), "before")
             .when(F.col("datetime") <= F.col("hi"), "during").otherwise("after"))
    return j.select("ticket_id", "datetime", phase.alias("phase"),
                    F.coalesce("sev", F.lit(-1)).alias("sev"),
                    F.coalesce("drivers", F.lit("")).alias("drivers"))


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """Per ticket: worst state before, during and after, and its peak hour in the window."""
    during = F.col("phase") == "during"
    of = lambda p: F.coalesce(F.max(F.when(F.col("phase") == p, F.col("sev"))), F.lit(-1))
    return timeline.groupBy("ticket_id").agg(
        of("before").alias("before"), of("during").alias("during"), of("after").alias("after"),
        F.min_by("datetime", F.when(during & (F.col("sev") > 0),
                                    F.struct(-F.col("sev"), "datetime"))).alias("peak_hour"))


# --------------------------------------------------------------------- history
def history_by(df: DataFrame, field: str, n: int | None = None, empty: str | None = None,
               ticket: str = "ticket_id") -> DataFrame:
    """Distinct tickets per value, most first; with `n`, the rest added up as Others."""
    name = F.col(field)
    d = df.withColumn("_k", F.when(name.isNull() | (name == ""), F.lit(empty)).otherwise(name))
    if empty is None:
        d = d.filter(F.col("_k").isNotNull())
    g = d.select("_k", ticket).distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("tickets"))
    if n is None:
        return g.select(F.col("_k").alias(field), "tickets")
    totals = g.agg(F.sum("tickets").alias("_all"), F.count(F.lit(1)).alias("_values"))
    head = g.orderBy(F.desc("tickets"), "_k").limit(n + 1)
    head = head.withColumn("_r", F.row_number().over(W.orderBy(F.desc("tickets"), "_k")))
    kept = with_scalars(head, totals).filter((F.col("_r") <= n) | (F.col("_values") <= n + 1))
    rest = kept.agg(F.sum("tickets").alias("_shown"), F.max("_all").alias("_all")).filter(
        F.col("_all") > F.col("_shown")).select(
        F.lit("Others").alias(field), (F.col("_all") - F.col("_shown")).alias("tickets"))
    return kept.select(F.col("_k").alias(field), "tickets").unionByName(rest)


def history_states(df: DataFrame, ticket: str = "ticket_id") -> DataFrame:
    return history_by(df, "state", ticket=ticket)


def history_per_month(df: DataFrame, ticket: str = "ticket_id") -> DataFrame:
    m = F.date_format(day_floor("create_time").cast("date"), "yyyy-MM")
    return df.filter(F.col("create_time").isNotNull()).select(
        m.alias("month"), ticket).distinct().groupBy("month").agg(
        F.count(F.lit(1)).alias("tickets"))


def top_ticket_sites(df: DataFrame, n: int = 10) -> DataFrame:
    """Sites by tickets, with the delayed and technical ones and the share of all."""
    g = df.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if("delayed").alias("delay_tickets"),
        F.count_if(F.col("classification").isin(TECHNICAL, POSSIBLE)).alias("technical"))
    g = with_scalars(g, g.agg(F.sum("tickets").alias("_all")))
    return g.select("site_id", "tickets", "delay_tickets", "technical",
                    F.bround(100.0 * F.col("tickets") / F.col("_all"), 1).alias("pct")).orderBy(
        F.desc("tickets"), F.desc("delay_tickets"), F.desc("technical"), "site_id").limit(n)


def ticket_filter(df: DataFrame, picks: dict[str, Sequence[str]], empty: dict[str, str] | None = None,
                  period: tuple | None = None, any_of: dict[str, Sequence[str]] | None = None,
                  time: str = "create_time") -> DataFrame:
    """Any picked value per field (an empty one under its name), whole days, list overlap."""
    from radiolake.functions.times import in_period
    for field, values in picks.items():
        if values:
            name = (empty or {}).get(field, "")
            v = F.when(F.coalesce(field, F.lit("")) == "", name).otherwise(F.col(field))
            df = df.filter(v.isin(*values))
    for field, values in (any_of or {}).items():
        if values:
            df = df.filter(F.arrays_overlap(field, F.array(*[F.lit(x) for x in values])))
    return df.filter(in_period(time, *period)) if period else df


def ticket_search(df: DataFrame, q: str, fields: Sequence[str]) -> DataFrame:
    """Exact id matches when there are any, else the rows that contain the text."""
    want = q.strip().upper()
    exact, part = F.lit(False), F.lit(False)
    for f in fields:
        v = F.upper(F.coalesce(F.col(f).cast("string"), F.lit("")))
        exact, part = exact | (v == want), part | v.contains(want)
    d = df.withColumn("_exact", exact).withColumn("_part", part).filter(F.col("_part"))
    d = with_scalars(d, d.agg(F.coalesce(F.max("_exact"), F.lit(False)).alias("_any")))
    return d.filter(~F.col("_any") | F.col("_exact")).drop("_exact", "_part", "_any")


def newest_first(df: DataFrame, time: str = "create_time") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time), "ticket_id")
