"""A ticket again, at the user's position: its serving sector and the neighbours facing it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.operators.spatial import neighbour_sectors
from radiolake.operators.tickets import site_kpi_hours, ticket_checks

SITE_LEVEL = ("dl_flowctrl_drops", "ipmm_rtt_ms", "ul_rtwp_dbm")  # counters of a whole site


def sector_kpi_hours(hours: DataFrame, site_level: Sequence[str] = SITE_LEVEL) -> DataFrame:
    """Judged hours (with sector_id) by sector in place of the site; counters of a site and cells
    without a sector are left out."""
    own = hours.filter(~F.col("sector_id").endswith("-S0") & ~F.col("kpi").isin(*site_level))
    return site_kpi_hours(own.withColumn("site_id", F.col("sector_id")))


def sector_tracks(wanted: DataFrame, sector_hours: DataFrame, site_hours: DataFrame) -> DataFrame:
    """The hours that judge each wanted (sector_id, site_id): per KPI its own, where the sector has
    any, else those of its site. `track` says which; site_id holds the sector."""
    w = wanted.select("sector_id", "site_id").distinct()
    ids = w.select(F.col("sector_id").alias("site_id")).distinct()
    own = sector_hours.join(ids, "site_id", "left_semi")
    have = own.select(F.col("site_id").alias("sector_id"), "kpi").distinct()
    theirs = w.join(site_hours, "site_id").join(have, ["sector_id", "kpi"], "left_anti")
    theirs = theirs.drop("site_id").withColumnRenamed("sector_id", "site_id")
    return own.withColumn("track", F.lit("sector")).unionByName(
        theirs.withColumn("track", F.lit("site")))


def reanalyse(tickets: DataFrame, sectors: DataFrame, serving: DataFrame, sector_hours: DataFrame,
              site_hours: DataFrame, window_h: float,
              keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Per ticket, sector and KPI the check of the hours around the problem.

    tickets: ticket_id, problem_time, latitude, longitude; serving: ticket_id, sector_id, site_id,
    bearing_deg, dist_m. The serving sector has rank 0, the neighbours facing the position theirs,
    nearest first. A sector is judged once for each window, however many tickets ask for it. `keep`
    may write the two tables that are read again and again, and give back what it wrote.
    """
    near = neighbour_sectors(tickets, "ticket_id", sectors, serving)
    cols = ["ticket_id", "rank", "sector_id", "site_id"]
    asked = serving.withColumn("rank", F.lit(0)).select(cols).unionByName(near.select(cols))
    asked = keep(asked, "asked")
    tracks = keep(sector_tracks(asked, sector_hours, site_hours), "tracks")
    key = F.struct("ticket_id", "rank", "sector_id").alias("ticket_id")
    t = asked.join(tickets.select("ticket_id", "problem_time"), "ticket_id").select(
        key, F.col("sector_id").alias("site_id"), "problem_time")
    checks = ticket_checks(t, tracks, window_h)
    which = tracks.select("site_id", "kpi", "track").distinct()
    return checks.join(which, ["site_id", "kpi"]).select(
        "ticket_id.*", "kpi", "label", "track", "sev", "hours", "breach_hours", "worst",
        "worst_at", "worst_obj", "before", "after", "resolution")


def sector_verdicts(checks: DataFrame, main: Sequence[str]) -> DataFrame:
    """Per ticket and sector: KPIs judged, KPIs in breach and the leading one (the gravest, main
    KPIs first, then the longest)."""
    lead = F.when(F.col("sev") > 0, F.struct(
        -F.col("sev"), (~F.col("kpi").isin(*main)).alias("m"), -F.col("breach_hours"), "kpi"))
    g = checks.groupBy("ticket_id", "rank", "sector_id").agg(
        F.count_if(F.col("sev") >= 0).alias("judged"), F.count_if(F.col("sev") > 0).alias("issues"),
        F.min(lead).alias("lead"))
    return g.select("ticket_id", "rank", "sector_id", "judged", "issues",
                    F.col("lead.kpi").alias("lead_kpi"))
