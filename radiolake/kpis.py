"""KPI catalogue, threshold rules and how a KPI adds up: small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, label, direction, unit, category, aggregate, weight KPI.
LTE_CATALOGUE = """
rrc_setup_sr, RRC Setup Success Rate, up, %, accessibility, weighted, rrc_setup_att
erab_setup_sr, E-RAB Setup Success Rate, up, %, accessibility, weighted, erab_setup_att
call_setup_sr, Call Setup Success Rate, up, %, accessibility, weighted, rrc_setup_att
rrc_setup_att, RRC Setup Attempts, info, #, accessibility, sum,
rrc_setup_succ, RRC Setup Successes, info, #, accessibility, sum,
erab_setup_att, E-RAB Setup Attempts, info, #, accessibility, sum,
erab_setup_succ, E-RAB Setup Successes, info, #, accessibility, sum,
rach_setup_sr, RACH Setup Success Rate, up, %, accessibility, mean,
erab_drop_rate, E-RAB Drop Rate, down, %, retainability, weighted, erab_drop_denom
erab_drop_denom, E-RAB Release Denominator, info, #, retainability, sum,
erab_abnorm_rel, E-RAB Abnormal Releases, info, #, retainability, sum,
ctxt_drop_rate, UE Context Drop Rate, down, %, retainability, mean,
ho_sr, Handover Success Rate, up, %, mobility, weighted, ho_att
ho_att, Handover Attempts, info, #, mobility, sum,
ho_succ, Handover Successes, info, #, mobility, sum,
intra_freq_ho_sr, Intra-Freq HO Success Rate, up, %, mobility, mean,
inter_freq_ho_sr, Inter-Freq HO Success Rate, up, %, mobility, mean,
x2_ho_sr, X2 Handover Success Rate, up, %, mobility, mean,
s1_ho_sr, S1 Handover Success Rate, up, %, mobility, mean,
ho_ping_pong_rate, HO Ping-Pong Rate, down, %, mobility, mean,
redirect_to_umts, Redirections to UMTS, info, #, mobility, sum,
dl_user_thr_mbps, DL User Throughput, up, Mbps, integrity, weighted, dl_thr_time_ratio
ul_user_thr_mbps, UL User Throughput, up, Mbps, integrity, weighted, ul_thr_time_ratio
dl_cell_thr_mbps, DL Cell Throughput, info, Mbps, integrity, mean,
ul_cell_thr_mbps, UL Cell Throughput, info, Mbps, integrity, mean,
dl_thr_time_ratio, DL Throughput Sample Weight, info, #, integrity, sum,
ul_thr_time_ratio, UL Throughput Sample Weight, info, #, integrity, sum,
dl_latency_ms, DL Latency, down, ms, integrity, mean,
dl_spectral_eff, DL Spectral Efficiency, up, bit/s/Hz, integrity, mean,
avg_rsrp_dbm, Average RSRP, up, dBm, coverage, mean,
avg_rsrq_db, Average RSRQ, up, dB, quality, mean,
avg_sinr_db, Average SINR, up, dB, quality, mean,
avg_cqi, Average CQI, up, index, quality, mean,
pct_cqi_ge10, % CQI >= 10, up, %, quality, mean,
dl_bler, DL Residual BLER, down, %, quality, mean,
ul_bler, UL Residual BLER, down, %, quality, mean,
pct_rsrp_poor, % RSRP < -110 dBm, down, %, coverage, mean,
pct_rsrq_poor, % RSRQ < -15 dB, down, %, quality, mean,
dl_256qam_ratio, DL 256QAM Ratio, up, %, quality, mean,
dl_qpsk_ratio, DL QPSK Ratio, down, %, quality, mean,
ta_avg_m, Average Timing Advance Distance, info, m, coverage, mean,
ta_p95_m, P95 Timing Advance Distance, info, m, coverage, mean,
pct_ta_gt_threshold, % UEs beyond overshoot distance, down, %, coverage, mean,
dl_prb_util, DL PRB Utilisation, down, %, utilization, mean,
ul_prb_util, UL PRB Utilisation, down, %, utilization, mean,
pdcch_util, PDCCH CCE Utilisation, down, %, utilization, mean,
rrc_conn_users_avg, Avg RRC Connected Users, info, #, utilization, mean,
rrc_conn_users_max, Max RRC Connected Users, info, #, utilization, max,
active_users_dl_avg, Avg Active DL Users, info, #, utilization, mean,
ue_rejected_rrc, RRC Rejections (Congestion), down, #, utilization, sum,
dl_traffic_gb, DL Data Volume, info, GB, traffic, sum,
ul_traffic_gb, UL Data Volume, info, GB, traffic, sum,
total_traffic_gb, Total Data Volume, info, GB, traffic, sum,
cell_avail_pct, Cell Availability, up, %, availability, mean,
cell_unavail_min, Cell Unavailable Time, down, min, availability, sum,
ul_rssi_dbm, UL RSSI / Interference (PUSCH), down, dBm, interference, mean,
ul_rssi_pucch_dbm, UL RSSI (PUCCH), down, dBm, interference, mean,
pct_prb_high_intf, % PRBs with high interference, down, %, interference, mean,
"""

UMTS_CATALOGUE = """
rrc_setup_sr, RRC Setup Success Rate, up, %, accessibility, mean,
rab_setup_sr_cs, RAB Setup SR (CS), up, %, accessibility, mean,
rab_setup_sr_ps, RAB Setup SR (PS), up, %, accessibility, mean,
cs_drop_rate, CS Call Drop Rate, down, %, retainability, mean,
ps_drop_rate, PS Call Drop Rate, down, %, retainability, mean,
soft_ho_sr, Soft Handover Success Rate, up, %, mobility, mean,
irat_ho_sr, IRAT Handover Success Rate, up, %, mobility, mean,
avg_rscp_dbm, Average RSCP, up, dBm, coverage, mean,
avg_ecno_db, Average Ec/No, up, dB, quality, mean,
hsdpa_thr_mbps, HSDPA Throughput, up, Mbps, integrity, mean,
dl_power_util, DL Power Utilisation (Tx), down, %, utilization, mean,
ul_rtwp_dbm, UL RTWP, down, dBm, interference, mean,
cell_avail_pct, Cell Availability, up, %, availability, mean,
total_traffic_gb, Total Data Volume, info, GB, traffic, sum,
ipmm_rtt_ms, IP Path RTT, down, ms, integrity, mean,
dl_flowctrl_drops, DL Flow-Control Drops, down, #, utilization, sum,
"""

GSM_CATALOGUE = """
tch_assign_sr, TCH Assignment Success Rate, up, %, accessibility, mean,
sdcch_block_rate, SDCCH Blocking Rate, down, %, accessibility, mean,
tch_block_rate, TCH Blocking Rate, down, %, utilization, mean,
call_drop_rate, Call Drop Rate (TCH), down, %, retainability, mean,
ho_sr, Handover Success Rate, up, %, mobility, mean,
dl_quality_p_good, % Good DL RxQual (0-2), up, %, quality, mean,
avg_rxlev_dl_dbm, Average DL RxLev, up, dBm, coverage, mean,
ul_interference_band, UL Interference Band (avg), down, index, interference, mean,
cell_avail_pct, Cell Availability, up, %, availability, mean,
erlang, Traffic (Erlang), info, Erl, traffic, sum,
"""

# KPI, warning, critical, least traffic (GB), confirmed line.
# A line that is not confirmed is kept for reference and judges nothing hourly.
LTE_LINES = """
rrc_setup_sr, 98.5, 96.0, 0.1, no
erab_setup_sr, 99.0, 97.0, 0.1, no
call_setup_sr, 98.0, 95.0, 0.1, no
rach_setup_sr, 95.0, 90.0, 0, no
ue_rejected_rrc, 20, 100, 0, no
erab_drop_rate, 0.8, 2.0, 0.1, no
ctxt_drop_rate, 1.0, 2.5, 0, no
ho_sr, 97.0, 93.0, 0, no
intra_freq_ho_sr, 97.0, 93.0, 0, no
inter_freq_ho_sr, 95.0, 90.0, 0, no
x2_ho_sr, 97.0, 92.0, 0, no
s1_ho_sr, 95.0, 90.0, 0, no
ho_ping_pong_rate, 4.0, 8.0, 0, no
dl_user_thr_mbps, 8.0, 3.0, 0.2, no
ul_user_thr_mbps, 1.5, 0.5, 0.1, no
dl_latency_ms, 30, 60, 0, no
avg_rsrp_dbm, -105, -112, 0, no
avg_rsrq_db, -12, -15, 0, no
avg_sinr_db, 3.0, 0.0, 0, no
avg_cqi, 7.0, 5.0, 0, no
pct_cqi_ge10, 55, 40, 0, no
dl_bler, 10, 15, 0, no
ul_bler, 10, 18, 0, no
pct_rsrp_poor, 12, 25, 0, no
pct_rsrq_poor, 10, 20, 0, no
dl_qpsk_ratio, 25, 40, 0, no
ta_p95_m, 3500, 6000, 0, no
pct_ta_gt_threshold, 8, 15, 0, no
dl_prb_util, 80, 80, 0, yes
ul_prb_util, 80, 80, 0, yes
pdcch_util, 65, 80, 0, no
rrc_conn_users_avg, 300, 400, 0, no
active_users_dl_avg, 12, 20, 0, no
cell_avail_pct, 99.0, 99.0, 0, yes
cell_unavail_min, 5, 30, 0, no
ul_rssi_dbm, -105, -105, 0, yes
ul_rssi_tdd_dbm, -100, -100, 0, yes
ul_rssi_pucch_dbm, -110, -105, 0, no
pct_prb_high_intf, 15, 30, 0, no
"""

UMTS_LINES = """
rrc_setup_sr, 98.0, 95.0, 0, no
rab_setup_sr_cs, 99.0, 97.0, 0, no
rab_setup_sr_ps, 98.0, 95.0, 0, no
cs_drop_rate, 0.7, 1.5, 0, no
ps_drop_rate, 1.5, 3.0, 0, no
soft_ho_sr, 98.0, 95.0, 0, no
irat_ho_sr, 95.0, 90.0, 0, no
avg_rscp_dbm, -95, -105, 0, no
avg_ecno_db, -12, -15, 0, no
hsdpa_thr_mbps, 2.0, 0.8, 0.1, no
dl_power_util, 75, 90, 0, no
ul_rtwp_dbm, -90, -90, 0, yes
cell_avail_pct, 99.0, 99.0, 0, yes
ipmm_rtt_ms, 10, 20, 0, no
dl_flowctrl_drops, 100000, 100000, 0, yes
"""

GSM_LINES = """
tch_assign_sr, 98.5, 96.0, 0, no
sdcch_block_rate, 1.0, 2.0, 0, no
tch_block_rate, 2.0, 5.0, 0, no
call_drop_rate, 1.0, 2.0, 0, no
ho_sr, 96.0, 92.0, 0, no
dl_quality_p_good, 95.0, 90.0, 0, no
avg_rxlev_dl_dbm, -85, -95, 0, no
ul_interference_band, 2.5, 3.5, 0, no
cell_avail_pct, 99.9, 99.0, 0, no
"""

# A rule whose direction its catalogue entry leaves open or that
# has no entry of its own.
LINE_DIRECTION = {"ta_p95_m": "down", "rrc_conn_users_avg": "down",
                  "active_users_dl_avg": "down", "ul_rssi_tdd_dbm": "down"}

GUARD_TRAFFIC_GB = {"LTE": 0.05, "UMTS": 0.02, "GSM": 0.0}
MAIN_KPIS = ("cell_avail_pct", "dl_prb_util", "ul_prb_util", "ul_rssi_dbm",
             "dl_flowctrl_drops", "ul_rtwp_dbm")
SITE_HOUR_KPIS = ("dl_flowctrl_drops",)
LABELS = {"cell_avail_pct": "Availability", "dl_prb_util": "DL PRB", "ul_prb_util": "UL PRB",
          "ul_rssi_dbm": "UL interference", "call_setup_sr": "CSSR",
          "ipmm_rtt_ms": "IP path RTT", "ul_rtwp_dbm": "RTWP",
          "dl_flowctrl_drops": "DL flow-control drops"}

# Words in a KPI name that say it is a level, or a counter.
MEAN_WORDS = ("rate", "%", "ratio", "avg", "average", "mean", "dbm", "mbps", "throughput",
              "utilization", "utilisation", "availability", "integrity", "(ms)", "index",
              "power")
SUM_WORDS = ("volume", "traffic", "num", "count", "times", "att", "succ", "fail", "drop",
             "erab", "rrc", "attempt", "request")


def _rows(text: str) -> list[list[str]]:
    return [[p.strip() for p in line.split(",")] for line in text.strip().splitlines()]


def catalogue_rows(technology: str) -> list[dict]:
    text = {"LTE": LTE_CATALOGUE, "UMTS": UMTS_CATALOGUE, "GSM": GSM_CATALOGUE}[technology]
    names = ("kpi", "label", "direction", "unit", "category", "aggregate", "weight_kpi")
    return [dict(zip(names, r), weight_kpi=r[6] or None, technology=technology)
            for r in _rows(text)]


def rule_rows(technology: str, overrides: dict[str, dict] | None = None) -> list[dict]:
    """The technology's lines; `overrides` replaces warning, critical or the guards per KPI."""
    text = {"LTE": LTE_LINES, "UMTS": UMTS_LINES, "GSM": GSM_LINES}[technology]
    known = {r["kpi"]: r for r in catalogue_rows(technology)}
    out = []
    for kpi, warning, critical, traffic, confirmed in _rows(text):
        entry = known.get(kpi, {})
        direction = LINE_DIRECTION.get(kpi) or entry.get("direction", "up")
        row = {"technology": technology, "kpi": kpi,
               "direction": "up" if direction == "info" else direction,
               "warning": float(warning), "critical": float(critical),
               "min_traffic_gb": max(float(traffic), GUARD_TRAFFIC_GB[technology]),
               "min_samples": 1, "unit": entry.get("unit", ""), "judged": confirmed == "yes"}
        change = (overrides or {}).get(kpi, {})
        row.update({k: float(v) for k, v in change.items() if k in ("warning", "critical")})
        if "min_traffic_gb" in change:
            row["min_traffic_gb"] = max(float(change["min_traffic_gb"]),
                                        GUARD_TRAFFIC_GB[technology])
        if "min_samples" in change:
            row["min_samples"] = max(int(change["min_samples"]), 1)
        out.append(row)
    return out


CATALOGUE_SCHEMA = ("technology string, kpi string, label string, direction string, unit string, "
                    "category string, aggregate string, weight_kpi string")
RULE_SCHEMA = ("technology string, kpi string, direction string, warning double, critical double, "
               "min_traffic_gb double, min_samples int, unit string, judged boolean")


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def load_catalogue(spark: SparkSession) -> DataFrame:
    return _frame(spark, [r for t in ("LTE", "UMTS", "GSM") for r in catalogue_rows(t)],
                  CATALOGUE_SCHEMA)


def load_rules(spark: SparkSession, technologies=("LTE", "UMTS", "GSM"),
               overrides: dict[str, dict] | None = None) -> DataFrame:
    return _frame(spark, [r for t in technologies for r in rule_rows(t, overrides)], RULE_SCHEMA)


def hourly_rules(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """One confirmed line per KPI, as the hourly judgement reads them.

    UL interference of a TDD cell has its own line, so the pair (KPI, TDD) is the key.
    """
    rows, seen = [], set()
    for tech in ("LTE", "UMTS"):
        for r in rule_rows(tech, overrides):
            if r["judged"] and r["kpi"] not in seen:
                seen.add(r["kpi"])
                rows.append(r)
    by_kpi = {r["kpi"]: r for r in rows}
    out = []
    for r in rows:
        if r["kpi"] == "ul_rssi_tdd_dbm":
            continue
        tdd = by_kpi["ul_rssi_tdd_dbm"] if r["kpi"] == "ul_rssi_dbm" else r
        for is_tdd, line in ((False, r), (True, tdd)):
            out.append((r["kpi"], is_tdd, r["direction"], line["warning"], line["critical"],
                        LABELS.get(r["kpi"], r["kpi"]), r["kpi"] in MAIN_KPIS,
                        r["kpi"] in SITE_HOUR_KPIS))
    return spark.createDataFrame(
        out, "kpi string, is_tdd boolean, direction string, warning double, critical double, "
             "label string, is_main boolean, per_site boolean")


def agg_how(col) -> Column:
    """mean or sum, read from the KPI's name; a rate wins over a counter word."""
    name = F.lower(F.col(col) if isinstance(col, str) else col)
    mean = F.lit(False)
    for w in MEAN_WORDS:
        mean = mean | name.contains(w)
    total = F.lit(False)
    for w in SUM_WORDS:
        total = total | name.contains(w)
    return F.when(mean, "mean").when(total, "sum").otherwise("mean")


def agg_kind(name: str) -> str:
    low = name.lower()
    if any(w in low for w in MEAN_WORDS):
        return "mean"
    return "sum" if any(w in low for w in SUM_WORDS) else "mean"


def severity(value, direction, warning, critical) -> Column:
    """0 normal, 1 warning, 2 critical; strict lines, and a missing value never breaches."""
    v = F.col(value) if isinstance(value, str) else value
    d = F.col(direction) if isinstance(direction, str) else direction
    w = F.col(warning) if isinstance(warning, str) else warning
    c = F.col(critical) if isinstance(critical, str) else critical
    past = lambda line: F.when(d == "up", v < line).otherwise(v > line)
    return (F.when(v.isNull() | F.isnan(v), 0).when(past(c), 2).when(past(w), 1)
            .otherwise(0))
