"""Daily worklist: measured verdict of a site, the decision per ticket, its priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.text import COMMENT_SIGNALS, text_signals
from radiolake.operators.common import exact_quantile, first_by, with_scalars
from radiolake.operators.params import severity_rank

# How much an action on each cause is worth.
ACTIONABLE = {"far_coverage": 3, "off_axis_azimuth": 3, "new_site_needed": 2, "congestion": 3,
              "interference": 3, "indoor": 2, "coverage_or_capacity": 1, "availability": 2,
              "not_rf": 0, "insufficient_data": 0}

CONTEXT_AGG = {"dl_prb_util": "max", "ul_rssi_dbm": "max", "erab_drop_rate": "max",
               "call_setup_sr": "avg", "ho_sr": "avg", "dl_user_thr_mbps": "avg",
               "cell_avail_pct": "min", "total_traffic_gb": "sum"}


def sector_context(df: DataFrame) -> DataFrame:
    """Per site and sector the worst, mean, lowest or total of each KPI, and the network's
    95th percentile of UL noise."""
    have = {k: v for k, v in CONTEXT_AGG.items() if k in df.columns}
    fn = {"max": F.max, "avg": F.avg, "min": F.min, "sum": F.sum}
    g = df.groupBy("site_id", "sector_id").agg(*[fn[v](k).alias(k) for k, v in have.items()])
    if "ul_rssi_dbm" in have:
        return with_scalars(g, exact_quantile(df, [], "ul_rssi_dbm", 0.95, "rssi_p95"))
    return g.withColumn("rssi_p95", F.lit(-100.0))


def kpi_verdict(context: DataFrame) -> DataFrame:
    """Per site: the most common fault category over its sectors, and whether one is severe."""
    col = lambda k: F.col(k) if k in context.columns else F.lit(None).cast("double")
    busy = F.coalesce(col("total_traffic_gb"), F.lit(0.0)) >= 0.3
    prb = F.coalesce(col("dl_prb_util"), F.lit(0.0))
    rules = [
        ("availability", col("cell_avail_pct") < 99.5, col("cell_avail_pct") < 95),
        ("retainability", busy & (col("erab_drop_rate") >= 2), col("erab_drop_rate") >= 4),
        ("accessibility", busy & (col("call_setup_sr") < 97), col("call_setup_sr") < 93),
        ("congestion", busy & (prb >= 80), prb >= 92),
        ("handover", busy & (col("ho_sr") < 95), F.lit(False)),
        ("low_throughput", busy & (col("dl_user_thr_mbps") < 5) & (prb < 60), F.lit(False)),
        ("interference", (col("ul_rssi_dbm") > -100) & (col("ul_rssi_dbm") >= F.col("rssi_p95")),
         col("ul_rssi_dbm") > -90)]
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(
        F.lit(i).alias("seen"), F.lit(n).alias("category"),
        F.coalesce(s, F.lit(False)).alias("severe"))) for i, (n, c, s) in enumerate(rules)]),
        lambda x: x.isNotNull())
    e = context.select("site_id", "sector_id", F.explode(hits).alias("h")).select(
        "site_id", "sector_id", "h.*")
    # a tie goes to the category seen first: by sector, then in rule order
    per = e.groupBy("site_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("sector_id", "seen")).alias("first"),
        F.max("severe").alias("severe"))
    top = per.groupBy("site_id").agg(first_by("category", -F.col("n"), "first").alias("category"),
                                     F.max("severe").alias("severe"))
    sites = context.select("site_id").distinct().join(top, "site_id", "left")
    return sites.select("site_id", F.when(F.col("category").isNull(), "kpi clean")
                        .otherwise("kpi issue").alias("kpi_status"),
                        F.coalesce("category", F.lit("")).alias("kpi_verdict"),
                        F.coalesce("severe", F.lit(False)).alias("kpi_severe"))


def decide(worklist: DataFrame, verdicts: DataFrame, flags: DataFrame,
           comment: str = "comment", service: str = "affected_service") -> DataFrame:
    """Likely cause, confidence and the check it came from: measured KPI, then the comment,
    then the parameter flags, then a default by service."""
    real = F.col("severity") != "info"
    f = flags.groupBy("site_id").agg(
        F.min_by(F.struct("code", "points_to", "severity"),
                 F.when(real, F.struct(-severity_rank(), "code"))).alias("top"),
        F.max(F.col("points_to") == "congestion").alias("any_cong"),
        F.max(F.col("code") == "site_not_in_params").alias("absent"),
        F.max(severity_rank()).alias("worst"))
    w = worklist.join(verdicts, "site_id", "left").join(f, "site_id", "left")
    w = w.withColumn("signals", text_signals(comment, COMMENT_SIGNALS))
    says = lambda s: F.array_contains("signals", s)
    kpi = F.coalesce("kpi_verdict", F.lit(""))
    site = F.coalesce("site_id", F.lit(""))
    absent = F.coalesce("absent", F.lit(False))
    top = F.coalesce("top.points_to", F.lit(None).cast("string"))
    by_flag = F.when(says("indoor"), "indoor").when(
        says("congestion") & F.coalesce("any_cong", F.lit(False)), "congestion").otherwise(top)
    flag_conf = F.when(says("congestion") & F.coalesce("any_cong", F.lit(False)), 0.55).when(
        F.col("top.severity") == "critical", 0.55).otherwise(0.45)
    cov = F.lower(F.coalesce(service, F.lit(""))).contains("coverage")
    cases = [
        ((kpi != "") & says("non_rf") & (kpi != "availability"), F.lit("not_rf"), F.lit(0.5), "kpi"),
        (kpi != "", kpi, F.lit(0.65), "kpi"),
        (says("non_rf"), F.lit("not_rf"), F.lit(0.6), "comment"),
        (says("alarm_or_outage") | absent, F.lit("availability"), F.lit(0.5), "comment"),
        (says("ret") & says("escalated"), F.lit("far_coverage"), F.lit(0.55), "comment"),
        (site == "", F.lit("insufficient_data"), F.lit(0.25), "default"),
        (top.isNotNull(), by_flag, flag_conf, "parameters"),
        (cov, F.lit("far_coverage"), F.lit(0.3), "default")]
    cause = F.lit("coverage_or_capacity")
    conf, source = F.lit(0.3), F.lit("default")
    for cond, c, k, s in reversed(cases):
        cond = F.coalesce(cond, F.lit(False))
        cause = F.when(cond, c).otherwise(cause)
        conf = F.when(cond, k).otherwise(conf)
        source = F.when(cond, s).otherwise(source)
    return w.select(*worklist.columns, "kpi_verdict", "kpi_severe", "worst",
                    cause.alias("likely_cause"), conf.cast("double").alias("confidence"),
                    source.alias("decided_by"), F.coalesce("top.code", F.lit("")).alias("top_flag"))


def worklist_priority(decided: DataFrame, history: DataFrame) -> DataFrame:
    """P1..P4 from the cause's worth, parameter severity, complaint history and KPI severity."""
    d = decided.join(history.select("site_id", F.col("tickets").alias("hist")), "site_id", "left")
    m = F.create_map(*[F.lit(x) for kv in ACTIONABLE.items() for x in kv])
    act = F.coalesce(F.try_element_at(m, F.col("likely_cause")), F.lit(1))
    hist = F.coalesce("hist", F.lit(0))
    severe = F.coalesce("kpi_severe", F.lit(False))
    sev = F.when(F.col("worst") == 3, 2).when(F.col("worst") == 2, 1).otherwise(0)
    score = (act + sev + F.when(hist >= 20, 2).when(hist >= 8, 1).otherwise(0)
             + F.when(F.col("confidence") >= 0.6, 1).otherwise(0)
             + F.when(severe, 2).when(F.coalesce("kpi_verdict", F.lit("")) != "", 1).otherwise(0))
    first = severe | ((F.col("worst") == 3) & (hist >= 8))
    return d.select(*decided.columns, score.alias("score"),
                    _ladder(act, score, F.coalesce(first, F.lit(False))).alias("priority"))


def _ladder(act: Column, score: Column, first: Column) -> Column:
    return (F.when(act == 0, "P4").when((score >= 6) & first, "P1").when(score >= 5, "P2")
            .when(score >= 3, "P3").otherwise("P4"))
