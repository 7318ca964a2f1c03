"""Rule-based diagnosis of cells: every rule is a struct column, one row per (cell, class).

A cell is one wide row of KPIs (optionally `isd_m`, the inter-site distance, and `edge_m`,
the far beam edge). Rules look at nothing but their row, so the whole set is one projection;
only the sector and trend rules join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.kpis import catalogue_rows, rule_rows
from radiolake.operators.common import first_by

# Spacing assumed without a site map, by surroundings.
DEFAULT_ISD_M = {"urban": 500.0, "suburban": 1200.0, "rural": 3500.0}


class Row:
    """The columns of one cell row as the rules read them: value, severity, presence."""

    def __init__(self, columns: Sequence[str], technology: str, env: str = "urban"):
        self.columns = set(columns)
        self.lines = {r["kpi"]: r for r in rule_rows(technology)}
        self.real = F.col("isd_m").isNotNull() if "isd_m" in self.columns else F.lit(False)
        hint = F.lit(DEFAULT_ISD_M.get(env, 1000.0))
        self.isd = F.coalesce("isd_m", hint) if "isd_m" in self.columns else hint

    def v(self, kpi: str) -> Column:
        return F.col(kpi).cast("double") if kpi in self.columns else F.lit(None).cast("double")

    def sev(self, kpi: str) -> Column:
        return F.col(f"_sev_{kpi}") if kpi in self.columns and kpi in self.lines else F.lit(0)

    def bad(self, kpi: str) -> Column:
        return self.sev(kpi) > 0

    def severity_columns(self) -> dict[str, Column]:
        out = {}
        for kpi, r in self.lines.items():
            if kpi in self.columns:
                x = self.v(kpi)
                past = (lambda line: x < line) if r["direction"] == "up" else (lambda line: x > line)
                out[f"_sev_{kpi}"] = (F.when(x.isNull() | F.isnan(x), 0).when(past(r["critical"]), 2)
                                      .when(past(r["warning"]), 1).otherwise(0))
        return out


def yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def pts(cond: Column, weight) -> Column:
    return F.when(yes(cond), weight).otherwise(0.0)


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def evidence(row: Row, items: Sequence[tuple[str, Column]]) -> Column:
    """The KPIs (and their values) a diagnosis leans on."""
    made = [F.when(yes(cond), F.struct(F.lit(k).alias("kpi"), row.v(k).alias("value")))
            for k, cond in items]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def worst(row: Row, kpis: Sequence[str]) -> Column:
    return F.greatest(*[row.sev(k) for k in kpis], F.lit(1))


def finding(cls: str, fires: Column, sev: Column, confidence: Column, ev: Column,
            score: Column) -> Column:
    conf = F.greatest(F.lit(0.15), F.least(F.lit(0.97), confidence))
    return F.when(yes(fires), F.struct(
        F.lit(cls).alias("problem_class"), sev.cast("int").alias("sev"), conf.alias("confidence"),
        score.cast("double").alias("score"), ev.alias("evidence")))


def support(row: Row, weights: dict[str, float]) -> tuple[Column, list]:
    """Points and evidence of the supporting KPIs that are past their own lines."""
    return (total([pts(row.bad(k), w) for k, w in weights.items()]),
            [(k, row.bad(k)) for k in weights])


def overshooting(r: Row) -> Column:
    ta, rsrp, rsrq, isd = r.v("ta_p95_m"), r.v("avg_rsrp_dbm"), r.v("avg_rsrq_db"), r.isd
    far = yes((rsrp > -100) & (rsrq < -12))
    long_real = yes(r.real & (ta > 1.25 * isd))
    long_abs = yes(~r.real & (ta > 3500) & (far | (ta > 5500)))
    share = r.bad("pct_ta_gt_threshold")
    beam = yes(r.real & (r.v("edge_m") > 1.4 * isd))
    late = yes(r.v("inter_freq_ho_sr") < 92)
    score = total([F.when(long_real, 0.35 + F.least(F.lit(0.25), (F.try_divide(ta, isd) - 1.25) * 0.2))
                   .otherwise(0.0), pts(long_abs, 0.3), pts(share, 0.25), pts(beam, 0.3),
                   pts(far, 0.15), pts(late, 0.1)])
    hard = long_real | long_abs | share | beam
    sev = F.when(yes(r.real & (ta > 1.8 * isd)) | (score > 0.85), 2).otherwise(1)
    conf = 0.45 + score * 0.4 - F.when(r.real, 0.0).otherwise(0.12)
    ev = evidence(r, [("ta_p95_m", long_real | long_abs), ("pct_ta_gt_threshold", share),
                      ("edge_m", beam), ("avg_rsrp_dbm", far), ("avg_rsrq_db", far),
                      ("inter_freq_ho_sr", late)])
    return finding("overshooting", hard & (score >= 0.4), sev, conf, ev, score)


def coverage(r: Row) -> Column:
    s1, s2 = r.sev("avg_rsrp_dbm"), r.sev("pct_rsrp_poor")
    extra, items = support(r, {"dl_user_thr_mbps": 0.12, "avg_sinr_db": 0.1, "dl_qpsk_ratio": 0.1,
                               "erab_drop_rate": 0.12, "rrc_setup_sr": 0.1})
    short = yes(r.real & (r.v("edge_m") > 0) & (r.v("edge_m") < 0.75 * r.isd))
    have = r.v("avg_rsrp_dbm").isNotNull()
    score = total([pts(have, F.when(s1 == 2, 0.35).otherwise(0.22)),
                   pts(s2 > 0, F.when(s2 == 2, 0.3).otherwise(0.18)), extra, pts(short, 0.15)])
    ev = evidence(r, [("avg_rsrp_dbm", have), ("pct_rsrp_poor", s2 > 0), *items, ("edge_m", short)])
    return finding("coverage", (s1 > 0) | (s2 > 0), worst(r, ["avg_rsrp_dbm", "pct_rsrp_poor"]),
                   0.4 + score * 0.45, ev, score)


def poor_rsrq(r: Row) -> Column:
    s1, s2 = r.sev("avg_rsrq_db"), r.sev("avg_sinr_db")
    extra, items = support(r, {"dl_qpsk_ratio": 0.12, "avg_cqi": 0.12, "dl_user_thr_mbps": 0.1,
                               "pct_prb_high_intf": 0.15})
    score = total([pts(s1 > 0, F.when(s1 == 2, 0.3).otherwise(0.2)),
                   pts(s2 > 0, F.when(s2 == 2, 0.25).otherwise(0.15)), extra])
    weak = yes(r.v("avg_rsrp_dbm") < -108)
    ev = evidence(r, [("avg_rsrq_db", s1 > 0), ("avg_sinr_db", s2 > 0), *items])
    return finding("poor_rsrq", ((s1 > 0) | (s2 > 0)) & ~weak,
                   worst(r, ["avg_rsrq_db", "avg_sinr_db"]), 0.4 + score * 0.4, ev, score)


def interference(r: Row) -> Column:
    s = r.sev("ul_rssi_dbm")
    extra, items = support(r, {"ul_bler": 0.12, "ul_user_thr_mbps": 0.12, "rach_setup_sr": 0.15,
                               "erab_drop_rate": 0.12, "rrc_setup_sr": 0.1})
    score = F.when(s == 2, 0.35).otherwise(0.22) + extra
    return finding("interference", s > 0, s, 0.45 + score * 0.4,
                   evidence(r, [("ul_rssi_dbm", s > 0), *items]), score)


def high_utilization(r: Row) -> Column:
    s1, s2, s3 = r.sev("dl_prb_util"), r.sev("pdcch_util"), r.sev("ue_rejected_rrc")
    extra, items = support(r, {"dl_user_thr_mbps": 0.15, "erab_drop_rate": 0.1})
    score = total([pts(s1 > 0, F.when(s1 == 2, 0.35).otherwise(0.22)), pts(s2 > 0, 0.2),
                   pts(s3 > 0, 0.25), extra])
    ev = evidence(r, [("dl_prb_util", s1 > 0), ("pdcch_util", s2 > 0), ("ue_rejected_rrc", s3 > 0),
                      ("rrc_conn_users_avg", r.v("rrc_conn_users_avg").isNotNull()), *items])
    return finding("high_utilization", (s1 > 0) | (s2 > 0) | (s3 > 0),
                   worst(r, ["dl_prb_util", "pdcch_util", "ue_rejected_rrc"]),
                   0.45 + score * 0.4, ev, score)


def low_throughput(r: Row) -> Column:
    s, cqi = r.sev("dl_user_thr_mbps"), r.v("avg_cqi")
    score = F.when(s == 2, 0.3).otherwise(0.18) + pts(cqi < 7, 0.12)
    present = [(k, r.v(k).isNotNull()) for k in ("avg_cqi", "avg_sinr_db", "dl_prb_util",
                                                 "dl_256qam_ratio", "dl_spectral_eff")]
    return finding("low_throughput", s > 0, s, 0.4 + score,
                   evidence(r, [("dl_user_thr_mbps", s > 0), *present]), score)


def _count_bad(r: Row, kpis: Sequence[str]) -> Column:
    return total([pts(r.bad(k), 1.0) for k in kpis])


def accessibility(r: Row) -> Column:
    rates = ["rrc_setup_sr", "erab_setup_sr", "call_setup_sr", "rach_setup_sr"]
    n = _count_bad(r, rates)
    extra, items = support(r, {"pdcch_util": 0.15, "dl_prb_util": 0.1, "ue_rejected_rrc": 0.15,
                               "avg_rsrp_dbm": 0.12, "ul_rssi_dbm": 0.12})
    score = 0.25 + 0.12 * n + extra
    ev = evidence(r, [*[(k, r.bad(k)) for k in rates], *items])
    return finding("accessibility", n > 0, worst(r, rates), 0.4 + score * 0.4, ev, score)


def retainability(r: Row) -> Column:
    ta = r.v("ta_p95_m")
    far = yes((r.real & (ta > 1.3 * r.isd)) | (~r.real & (ta > 4000)))
    extra, items = support(r, {"avg_sinr_db": 0.12, "avg_rsrp_dbm": 0.12, "ul_rssi_dbm": 0.15,
                               "ho_sr": 0.15, "dl_prb_util": 0.1})
    score = 0.3 + extra + pts(far, 0.1)
    drops = ["erab_drop_rate", "ctxt_drop_rate"]
    ev = evidence(r, [*[(k, r.bad(k)) for k in drops], *items, ("ta_p95_m", far)])
    return finding("retainability", _count_bad(r, drops) > 0, worst(r, drops),
                   0.4 + score * 0.4, ev, score)


def handover(r: Row) -> Column:
    rates = ["ho_sr", "intra_freq_ho_sr", "inter_freq_ho_sr", "x2_ho_sr", "s1_ho_sr"]
    n, pp = _count_bad(r, rates), r.bad("ho_ping_pong_rate")
    score = 0.25 + 0.12 * n + pts(pp, 0.2)
    ev = evidence(r, [*[(k, r.bad(k)) for k in rates], ("ho_ping_pong_rate", pp)])
    return finding("handover", (n > 0) | pp, worst(r, [*rates, "ho_ping_pong_rate"]),
                   0.4 + score * 0.4, ev, score)


def availability(r: Row) -> Column:
    kpis = ["cell_avail_pct", "cell_unavail_min"]
    return finding("availability", _count_bad(r, kpis) > 0, worst(r, kpis), F.lit(0.6),
                   evidence(r, [(k, r.bad(k)) for k in kpis]), F.lit(0.0))


LTE_RULES = {"overshooting": overshooting, "coverage": coverage, "poor_rsrq": poor_rsrq,
             "interference": interference, "high_utilization": high_utilization,
             "low_throughput": low_throughput, "accessibility": accessibility,
             "retainability": retainability, "handover": handover, "availability": availability}

# The 3G and 2G classes and the KPIs each reads.
TABLE_RULES = {
    "UMTS": {"accessibility": ["rrc_setup_sr", "rab_setup_sr_cs", "rab_setup_sr_ps"],
             "retainability": ["cs_drop_rate", "ps_drop_rate"],
             "handover": ["soft_ho_sr", "irat_ho_sr"], "coverage": ["avg_rscp_dbm"],
             "poor_rsrq": ["avg_ecno_db"], "interference": ["ul_rtwp_dbm"],
             "high_utilization": ["dl_power_util"], "availability": ["cell_avail_pct"]},
    "GSM": {"accessibility": ["tch_assign_sr", "sdcch_block_rate"],
            "high_utilization": ["tch_block_rate"], "retainability": ["call_drop_rate"],
            "handover": ["ho_sr"], "interference": ["ul_interference_band"],
            "coverage": ["avg_rxlev_dl_dbm"], "availability": ["cell_avail_pct"]},
}


def table_rule(cls: str, kpis: Sequence[str]):
    def rule(r: Row) -> Column:
        return finding(cls, _count_bad(r, kpis) > 0, worst(r, kpis), F.lit(0.55),
                       evidence(r, [(k, r.bad(k)) for k in kpis]), F.lit(0.0))
    return rule


def rules_of(technology: str, classes: Sequence[str] = ()) -> dict:
    rules = LTE_RULES if technology == "LTE" else {
        c: table_rule(c, k) for c, k in TABLE_RULES[technology].items()}
    return {c: f for c, f in rules.items() if not classes or c in classes}


def diagnose(cells: DataFrame, technology: str = "LTE", classes: Sequence[str] = (),
             keep: Sequence[str] = ("cell_id", "site_id", "total_traffic_gb"),
             env: str = "urban") -> DataFrame:
    """One row per cell and problem class that fires."""
    row = Row(cells.columns, technology, env)
    wide = cells.withColumns(row.severity_columns())
    made = F.array(*[rule(row) for rule in rules_of(technology, classes).values()])
    keep = [k for k in keep if k in cells.columns]
    return wide.select(*keep, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("d")).select(
        *keep, "d.*")


def traffic_imbalance(cells: DataFrame) -> DataFrame:
    """Per sector of two or more cells: its busiest cell when the spread is wide."""
    x = F.struct(F.col("dl_prb_util").alias("v"), "cell_id", "site_id", "total_traffic_gb")
    g = cells.filter(F.col("dl_prb_util").isNotNull()).groupBy("sector_id").agg(
        F.count(F.lit(1)).alias("n"), first_by(x, -F.col("dl_prb_util"), "cell_id").alias("hi"),
        F.min("dl_prb_util").alias("lo"))
    gap = F.col("hi.v") - F.col("lo")
    return g.filter((F.col("n") >= 2) & (gap >= 25) & (F.col("hi.v") >= 55)).select(
        "sector_id", F.col("hi.cell_id").alias("cell_id"), F.col("hi.site_id").alias("site_id"),
        F.col("hi.total_traffic_gb").alias("total_traffic_gb"),
        F.lit("traffic_imbalance").alias("problem_class"),
        F.when(gap > 45, 2).otherwise(1).alias("sev"), F.lit(0.6).alias("confidence"),
        gap.alias("gap_pp"))


def label_tokens(label: str) -> list[str]:
    """The words of a KPI's label that tell it from others."""
    return [t for t in label.lower().replace("/", " ").split() if len(t) > 2]


def related_kpis(cited: Column, technology: str) -> Column:
    """The KPIs of the catalogue that a list of cited ones speaks of, in its order.

    Named is a KPI whose name stands in the names and labels of the cited ones, or all of whose
    label's words do but one. The catalogue is a constant, so this is one expression, no join.
    """
    rows = catalogue_rows(technology)
    labels = F.create_map(*[F.lit(x) for r in rows for x in (r["kpi"], r["label"])])
    text = F.lower(F.array_join(F.transform(cited, lambda k: F.concat_ws(
        " ", k, F.try_element_at(labels, k))), " "))

    def named(kpi: str, label: str) -> Column:
        words = label_tokens(label)
        seen = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in words], F.lit(0))
        return text.contains(kpi.lower()) | (F.lit(bool(words)) & (seen >= max(1, len(words) - 1)))

    return F.filter(F.array(*[F.when(named(r["kpi"], r["label"]), F.lit(r["kpi"])) for r in rows]),
                    lambda k: k.isNotNull())


def reinforce_by_trend(diagnoses: DataFrame, trends: DataFrame,
                       technology: str = "LTE") -> DataFrame:
    """The worst falling trend of a KPI that the diagnosis speaks of adds a note and confidence.

    `trends`: cell_id, kpi, verdict, pct_change, baseline, recent. The KPIs are the related ones, or
    those cited where there is none. A step down on a warning is evidence, too: `step` holds the
    level before and after it.
    """
    falling = trends.filter(F.col("verdict").isin("degrading", "step-down"))
    d = diagnoses.withColumn("related_kpis", related_kpis(F.col("evidence.kpi"), technology))
    keys = F.when(F.size("related_kpis") > 0, F.col("related_kpis")).otherwise(
        F.col("evidence.kpi"))
    asked = d.select("cell_id", "problem_class", F.explode(keys).alias("kpi")).distinct()
    found = asked.join(falling, ["cell_id", "kpi"]).groupBy("cell_id", "problem_class").agg(
        first_by(["kpi", "verdict", "pct_change", "baseline", "recent"],
                 F.col("verdict") != "step-down", -F.abs("pct_change"), "kpi").alias("trend"))
    j = d.join(found, ["cell_id", "problem_class"], "left")
    step = (F.col("trend.verdict") == "step-down") & (F.col("sev") == 1)
    return j.withColumn("confidence", F.when(
        F.col("trend").isNotNull(), F.least(F.lit(0.97), F.col("confidence") + 0.08))
        .otherwise(F.col("confidence"))).withColumn(
        "step", F.when(step, F.struct("trend.baseline", "trend.recent")))


def diagnosis_counts(diagnoses: DataFrame) -> DataFrame:
    """Per class: critical and warning counts, and the cells on the action list."""
    return diagnoses.groupBy("problem_class").agg(
        F.count_if(F.col("sev") == 2).alias("critical"),
        F.count_if(F.col("sev") == 1).alias("warning"), F.count(F.lit(1)).alias("total"))


def action_list(findings: DataFrame) -> DataFrame:
    """P1 and P2 are to act on, the rest to watch."""
    return findings.withColumn("list", F.when(F.col("priority").isin("P1", "P2"), "action")
                               .otherwise("watch"))
