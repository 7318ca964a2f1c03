"""Registered queries: diagnosis rules and sized actions on cells derived from parts."""

from pyspark.sql import functions as F

from radiolake.kpis import catalogue_rows, rule_rows
from radiolake.operators import actions as R
from radiolake.operators import diagnose as D
from radiolake.plans import adapters as A
from radiolake.plans.adapters import with_ctes
from radiolake.plans.registry import query

# name, base, multiplier, modulus, step: value = base + (q * multiplier % modulus) * step
LTE_SPEC = [
    ("rrc_setup_sr", 94.0, 7, 61, 0.1), ("erab_setup_sr", 96.0, 11, 41, 0.1),
    ("call_setup_sr", 93.0, 13, 71, 0.1), ("rach_setup_sr", 88.0, 17, 121, 0.1),
    ("ue_rejected_rrc", 0.0, 19, 130, 1.0), ("erab_drop_rate", 0.0, 23, 31, 0.1),
    ("ctxt_drop_rate", 0.0, 29, 33, 0.1), ("ho_sr", 92.0, 31, 81, 0.1),
    ("intra_freq_ho_sr", 92.0, 37, 81, 0.1), ("inter_freq_ho_sr", 88.0, 41, 121, 0.1),
    ("x2_ho_sr", 90.0, 43, 101, 0.1), ("s1_ho_sr", 88.0, 47, 121, 0.1),
    ("ho_ping_pong_rate", 0.0, 53, 101, 0.1), ("dl_user_thr_mbps", 1.0, 59, 151, 0.1),
    ("ul_user_thr_mbps", 0.2, 61, 51, 0.1), ("avg_rsrp_dbm", -118.0, 67, 37, 1.0),
    ("avg_rsrq_db", -18.0, 71, 11, 1.0), ("avg_sinr_db", -2.0, 73, 15, 1.0),
    ("avg_cqi", 4.0, 79, 81, 0.1), ("pct_rsrp_poor", 0.0, 83, 35, 1.0),
    ("dl_qpsk_ratio", 10.0, 89, 41, 1.0), ("ta_p95_m", 300.0, 97, 71, 100.0),
    ("pct_ta_gt_threshold", 0.0, 101, 21, 1.0), ("dl_prb_util", 20.0, 103, 79, 1.0),
    ("pdcch_util", 30.0, 107, 61, 1.0), ("rrc_conn_users_avg", 50.0, 109, 401, 1.0),
    ("cell_avail_pct", 97.0, 113, 31, 0.1), ("cell_unavail_min", 0.0, 127, 41, 1.0),
    ("ul_rssi_dbm", -118.0, 131, 22, 1.0), ("ul_bler", 2.0, 137, 19, 1.0),
    ("pct_prb_high_intf", 0.0, 139, 36, 1.0), ("total_traffic_gb", 0.0, 149, 80, 0.1),
    ("isd_m", 400.0, 151, 41, 50.0), ("edge_m", 200.0, 157, 61, 50.0),
    ("antenna_height_m", 18.0, 163, 30, 1.0), ("mech_tilt_deg", 0.0, 167, 4, 1.0),
    ("elec_tilt_deg", 0.0, 173, 11, 1.0), ("azimuth_deg", 0.0, 179, 360, 1.0),
    ("latitude", 30.0, 181, 100, 0.001),
]
# KPIs that some cells lack: null where (q + offset) % 9 = 0
GAPS = {"isd_m": 0, "avg_rsrp_dbm": 1, "ta_p95_m": 2, "avg_cqi": 3, "ul_rssi_dbm": 4,
        "dl_prb_util": 5}
UMTS_SPEC = [
    ("rrc_setup_sr", 93.0, 7, 71, 0.1), ("rab_setup_sr_cs", 96.0, 11, 41, 0.1),
    ("cs_drop_rate", 0.0, 13, 21, 0.1), ("ps_drop_rate", 0.0, 17, 41, 0.1),
    ("soft_ho_sr", 94.0, 19, 61, 0.1), ("avg_rscp_dbm", -110.0, 23, 31, 1.0),
    ("avg_ecno_db", -18.0, 29, 11, 1.0), ("ul_rtwp_dbm", -104.0, 31, 21, 1.0),
    ("dl_power_util", 50.0, 37, 49, 1.0), ("cell_avail_pct", 97.0, 41, 31, 0.1),
]
GSM_SPEC = [
    ("tch_assign_sr", 92.0, 7, 81, 0.1), ("sdcch_block_rate", 0.0, 11, 31, 0.1),
    ("tch_block_rate", 0.0, 13, 41, 0.1), ("call_drop_rate", 0.0, 17, 41, 0.1), ("ho_sr", 88.0, 19, 121, 0.1),
    ("ul_interference_band", 0.0, 23, 6, 1.0), ("avg_rxlev_dl_dbm", -105.0, 29, 41, 1.0),
    ("cell_avail_pct", 97.0, 31, 31, 0.1),
]


def part_cells(spark, d, spec=LTE_SPEC):
    """One wide KPI row per part, from integer arithmetic on its ordered quantity."""
    g = A.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q0"), F.count(F.lit(1)).alias("n_rows"))
    g = g.withColumn("q", F.col("q0") * 3 + F.col("l_partkey"))
    cols = []
    for name, base, mul, mod, step in spec:
        v = F.lit(base) + (F.col("q") * mul % mod).cast("double") * F.lit(step)
        if name in GAPS and spec is LTE_SPEC:
            v = F.when((F.col("q") + GAPS[name]) % 9 != 0, v)
        cols.append(v.alias(name))
    k = F.col("l_partkey").cast("string")
    return g.select(F.concat(F.lit("P"), F.lpad(k, 8, "0")).alias("cell_id"),
                    F.concat(F.lit("Q"), F.floor(F.col("l_partkey") / 6).cast("string"))
                    .alias("site_id"),
                    F.concat(F.lit("Q"), F.floor(F.col("l_partkey") / 3).cast("string"))
                    .alias("sector_id"), F.col("q"), "n_rows", *cols)


def _cells_sql(spec):
    cols = []
    for name, base, mul, mod, step in spec:
        v = f"{base}::DOUBLE + (q * {mul} % {mod})::DOUBLE * {step}::DOUBLE"
        if name in GAPS and spec is LTE_SPEC:
            v = f"CASE WHEN (q + {GAPS[name]}) % 9 <> 0 THEN {v} END"
        cols.append(f"{v} AS {name}")
    return f"""
SELECT 'P' || lpad(l_partkey::VARCHAR, 8, '0') AS cell_id, 'Q' || (l_partkey // 6)::VARCHAR AS site_id,
  'Q' || (l_partkey // 3)::VARCHAR AS sector_id, q, n_rows, {', '.join(cols)}
FROM (SELECT l_partkey, sum(l_quantity)::BIGINT * 3 + l_partkey AS q, count(*) AS n_rows
      FROM lineitem GROUP BY l_partkey)"""


A.CTES["pcells"] = _cells_sql(LTE_SPEC)
A.CTES["ucells"] = _cells_sql(UMTS_SPEC)
A.CTES["gsmcells"] = _cells_sql(GSM_SPEC)


def sev_sql(kpi, tech="LTE"):
    r = next(x for x in rule_rows(tech) if x["kpi"] == kpi)
    op = "<" if r["direction"] == "up" else ">"
    return (f"(CASE WHEN {kpi} {op} {r['critical']} THEN 2 WHEN {kpi} {op} {r['warning']} THEN 1 "
            "ELSE 0 END)")


def bad(kpi):
    return f"({sev_sql(kpi)} > 0)::INTEGER"


def sup(weights):
    return " + ".join(f"{w} * {bad(k)}" for k, w in weights.items())


REAL, ISD = "(isd_m IS NOT NULL)", "coalesce(isd_m, 500.0)"
CLASS_SQL = {
    "overshooting": dict(
        fires="hard AND score >= 0.4",
        sev=f"CASE WHEN coalesce({REAL} AND ta_p95_m > 1.8 * {ISD}, false) OR score > 0.85 THEN 2 ELSE 1 END",
        conf=f"0.45 + score * 0.4 - CASE WHEN {REAL} THEN 0 ELSE 0.12 END",
        score=f"""CASE WHEN {REAL} AND ta_p95_m > 1.25 * {ISD}
            THEN 0.35 + least(0.25, (ta_p95_m / {ISD} - 1.25) * 0.2) ELSE 0 END
          + CASE WHEN NOT {REAL} AND ta_p95_m > 3500 AND ((coalesce(avg_rsrp_dbm > -100, false)
              AND avg_rsrq_db < -12) OR ta_p95_m > 5500) THEN 0.3 ELSE 0 END
          + 0.25 * {bad('pct_ta_gt_threshold')}
          + CASE WHEN {REAL} AND edge_m > 1.4 * {ISD} THEN 0.3 ELSE 0 END
          + CASE WHEN avg_rsrp_dbm > -100 AND avg_rsrq_db < -12 THEN 0.15 ELSE 0 END
          + CASE WHEN inter_freq_ho_sr < 92 THEN 0.1 ELSE 0 END""",
        hard=f"""coalesce({REAL} AND ta_p95_m > 1.25 * {ISD}, false)
          OR coalesce(NOT {REAL} AND ta_p95_m > 3500 AND ((coalesce(avg_rsrp_dbm > -100, false)
              AND avg_rsrq_db < -12) OR ta_p95_m > 5500), false)
          OR {bad('pct_ta_gt_threshold')} = 1 OR coalesce({REAL} AND edge_m > 1.4 * {ISD}, false)"""),
    "coverage": dict(
        fires=f"{bad('avg_rsrp_dbm')} + {bad('pct_rsrp_poor')} > 0",
        sev=f"greatest({sev_sql('avg_rsrp_dbm')}, {sev_sql('pct_rsrp_poor')})",
        conf="0.4 + score * 0.45",
        score=f"""CASE WHEN avg_rsrp_dbm IS NULL THEN 0 WHEN {sev_sql('avg_rsrp_dbm')} = 2 THEN 0.35
            ELSE 0.22 END + CASE {sev_sql('pct_rsrp_poor')} WHEN 2 THEN 0.3 WHEN 1 THEN 0.18 ELSE 0 END
          + {sup({'dl_user_thr_mbps': 0.12, 'avg_sinr_db': 0.1, 'dl_qpsk_ratio': 0.1,
                  'erab_drop_rate': 0.12, 'rrc_setup_sr': 0.1})}
          + CASE WHEN {REAL} AND edge_m < 0.75 * {ISD} THEN 0.15 ELSE 0 END"""),
    "poor_rsrq": dict(
        fires=f"{bad('avg_rsrq_db')} + {bad('avg_sinr_db')} > 0 AND coalesce(avg_rsrp_dbm, 0) >= -108",
        sev=f"greatest({sev_sql('avg_rsrq_db')}, {sev_sql('avg_sinr_db')})",
        conf="0.4 + score * 0.4",
        score=f"""CASE {sev_sql('avg_rsrq_db')} WHEN 2 THEN 0.3 WHEN 1 THEN 0.2 ELSE 0 END
          + CASE {sev_sql('avg_sinr_db')} WHEN 2 THEN 0.25 WHEN 1 THEN 0.15 ELSE 0 END
          + {sup({'dl_qpsk_ratio': 0.12, 'avg_cqi': 0.12, 'dl_user_thr_mbps': 0.1,
                  'pct_prb_high_intf': 0.15})}"""),
    "interference": dict(
        fires=f"{bad('ul_rssi_dbm')} > 0", sev=sev_sql("ul_rssi_dbm"), conf="0.45 + score * 0.4",
        score=f"CASE {sev_sql('ul_rssi_dbm')} WHEN 2 THEN 0.35 ELSE 0.22 END + "
        + sup({"ul_bler": 0.12, "ul_user_thr_mbps": 0.12, "rach_setup_sr": 0.15,
               "erab_drop_rate": 0.12, "rrc_setup_sr": 0.1})),
    "high_utilization": dict(
        fires=f"{bad('dl_prb_util')} + {bad('pdcch_util')} + {bad('ue_rejected_rrc')} > 0",
        sev=f"greatest({sev_sql('dl_prb_util')}, {sev_sql('pdcch_util')}, {sev_sql('ue_rejected_rrc')})",
        conf="0.45 + score * 0.4",
        score=f"CASE {sev_sql('dl_prb_util')} WHEN 2 THEN 0.35 WHEN 1 THEN 0.22 ELSE 0 END + "
        + sup({"pdcch_util": 0.2, "ue_rejected_rrc": 0.25, "dl_user_thr_mbps": 0.15,
               "erab_drop_rate": 0.1})),
    "low_throughput": dict(
        fires=f"{bad('dl_user_thr_mbps')} > 0", sev=sev_sql("dl_user_thr_mbps"), conf="0.4 + score",
        score=f"CASE {sev_sql('dl_user_thr_mbps')} WHEN 2 THEN 0.3 ELSE 0.18 END "
              "+ CASE WHEN avg_cqi < 7 THEN 0.12 ELSE 0 END"),
    "accessibility": dict(
        fires=" + ".join(bad(k) for k in ("rrc_setup_sr", "erab_setup_sr", "call_setup_sr",
                                          "rach_setup_sr")) + " > 0",
        sev="greatest(" + ", ".join(sev_sql(k) for k in (
            "rrc_setup_sr", "erab_setup_sr", "call_setup_sr", "rach_setup_sr")) + ")",
        conf="0.4 + score * 0.4",
        score="0.25 + " + sup({"rrc_setup_sr": 0.12, "erab_setup_sr": 0.12, "call_setup_sr": 0.12,
                               "rach_setup_sr": 0.12, "pdcch_util": 0.15, "dl_prb_util": 0.1,
                               "ue_rejected_rrc": 0.15, "avg_rsrp_dbm": 0.12,
                               "ul_rssi_dbm": 0.12})),
    "retainability": dict(
        fires=f"{bad('erab_drop_rate')} + {bad('ctxt_drop_rate')} > 0",
        sev=f"greatest({sev_sql('erab_drop_rate')}, {sev_sql('ctxt_drop_rate')})",
        conf="0.4 + score * 0.4",
        score="0.3 + " + sup({"avg_sinr_db": 0.12, "avg_rsrp_dbm": 0.12, "ul_rssi_dbm": 0.15,
                              "ho_sr": 0.15, "dl_prb_util": 0.1})
        + f" + CASE WHEN ({REAL} AND ta_p95_m > 1.3 * {ISD}) OR (NOT {REAL} AND ta_p95_m > 4000) "
          "THEN 0.1 ELSE 0 END"),
    "handover": dict(
        fires=" + ".join(bad(k) for k in ("ho_sr", "intra_freq_ho_sr", "inter_freq_ho_sr", "x2_ho_sr",
                                          "s1_ho_sr", "ho_ping_pong_rate")) + " > 0",
        sev="greatest(" + ", ".join(sev_sql(k) for k in (
            "ho_sr", "intra_freq_ho_sr", "inter_freq_ho_sr", "x2_ho_sr", "s1_ho_sr",
            "ho_ping_pong_rate")) + ")",
        conf="0.4 + score * 0.4",
        score="0.25 + " + sup({"ho_sr": 0.12, "intra_freq_ho_sr": 0.12, "inter_freq_ho_sr": 0.12,
                               "x2_ho_sr": 0.12, "s1_ho_sr": 0.12, "ho_ping_pong_rate": 0.2})),
    "availability": dict(
        fires=f"{bad('cell_avail_pct')} + {bad('cell_unavail_min')} > 0",
        sev=f"greatest({sev_sql('cell_avail_pct')}, {sev_sql('cell_unavail_min')})",
        conf="0.6", score="0.0"),
}


def class_sql(cls):
    c = CLASS_SQL[cls]
    return f"""
SELECT cell_id, site_id, '{cls}' AS problem_class, ({c['sev']})::INTEGER AS sev,
  round(greatest(0.15, least(0.97, {c['conf']})), 6)::DOUBLE AS confidence
FROM (SELECT *, {c['score']} AS score, {c.get('hard', 'true')} AS hard FROM pcells)
WHERE {c['fires']}"""


A.CTES["diags"] = "\nUNION ALL ".join(f"SELECT * FROM ({class_sql(c)})" for c in CLASS_SQL)


def shaped(df):
    return df.select("cell_id", "site_id", "problem_class", "sev",
                     F.round("confidence", 6).alias("confidence"))


def _register(no, cls):
    @query(f"d{no:02d}_{cls}", with_ctes(class_sql(cls)))
    def _(spark, d):
        return shaped(D.diagnose(part_cells(spark, d), classes=[cls]))


for _no, _cls in enumerate(CLASS_SQL, 1):
    _register(_no, _cls)


@query("d_all_rules", with_ctes("SELECT * FROM diags"))
def _(spark, d):
    return shaped(D.diagnose(part_cells(spark, d)))


def _table_sql(tech, spec, cells):
    rules = {r["kpi"]: r for r in rule_rows(tech)}
    have = {s[0] for s in spec}
    parts = []
    for cls, kpis in D.TABLE_RULES[tech].items():
        sevs = []
        for k in kpis:
            if k in have:
                r = rules[k]
                op = "<" if r["direction"] == "up" else ">"
                sevs.append(f"CASE WHEN {k} {op} {r['critical']} THEN 2 WHEN {k} {op} {r['warning']} "
                            "THEN 1 ELSE 0 END")
        parts.append(f"SELECT cell_id, site_id, '{cls}' AS problem_class, s AS sev, "
                     f"0.55::DOUBLE AS confidence FROM (SELECT *, greatest(0, {', '.join(sevs)})"
                     f"::INTEGER AS s FROM {cells}) WHERE s > 0")
    return "\nUNION ALL ".join(parts)


@query("d11_table_rules_2g", with_ctes(_table_sql("GSM", GSM_SPEC, "gsmcells")))
def _(spark, d):
    return shaped(D.diagnose(part_cells(spark, d, GSM_SPEC), "GSM", keep=("cell_id", "site_id")))


@query("d11_table_rules", with_ctes(_table_sql("UMTS", UMTS_SPEC, "ucells")))
def _(spark, d):
    return shaped(D.diagnose(part_cells(spark, d, UMTS_SPEC), "UMTS", keep=("cell_id", "site_id")))


@query("d12_traffic_imbalance", with_ctes("""
SELECT sector_id, first(cell_id ORDER BY dl_prb_util DESC, cell_id) AS cell_id,
  CASE WHEN max(dl_prb_util) - min(dl_prb_util) > 45 THEN 2 ELSE 1 END AS sev,
  max(dl_prb_util) - min(dl_prb_util) AS gap_pp
FROM pcells WHERE dl_prb_util IS NOT NULL GROUP BY 1
HAVING count(*) >= 2 AND max(dl_prb_util) - min(dl_prb_util) >= 25 AND max(dl_prb_util) >= 55"""))
def _(spark, d):
    return D.traffic_imbalance(part_cells(spark, d)).select("sector_id", "cell_id", "sev", "gap_pp")


TREND_KPIS = ("erab_drop_rate", "avg_rsrp_dbm", "ho_sr", "ctxt_drop_rate", "ho_ping_pong_rate", "dl_prb_util")


def part_trends(spark, d):
    """Trends of KPIs that a lost connection cites, of related ones, and of one that is neither."""
    c = part_cells(spark, d).select("cell_id", "q")
    kpis = F.array(*[F.struct(F.lit(k).alias("kpi"), F.lit(i).alias("i")) for i, k in enumerate(TREND_KPIS)])
    t = c.select("cell_id", "q", F.explode(kpis).alias("k"))
    n = F.col("q") + F.col("k.i") * 7
    return t.select("cell_id", F.col("k.kpi").alias("kpi"),
                    F.when(n % 5 == 0, "step-down").when(n % 3 == 0, "degrading")
                    .otherwise("stable").alias("verdict"),
                    ((n % 41).cast("double") - 20.0).alias("pct_change"),
                    (n % 13).cast("double").alias("baseline"), (n % 17).cast("double").alias("recent"))


A.CTES["ptrends"] = f"""
SELECT cell_id, kpi, CASE WHEN n % 5 = 0 THEN 'step-down' WHEN n % 3 = 0 THEN 'degrading' ELSE 'stable'
  END AS verdict, (n % 41)::DOUBLE - 20.0 AS pct_change, (n % 13)::DOUBLE AS baseline, (n % 17)::DOUBLE AS recent
FROM (SELECT cell_id, kpi, q + i * 7 AS n FROM pcells,
  (VALUES {", ".join(f"('{k}', {i})" for i, k in enumerate(TREND_KPIS))}) k(kpi, i))"""
# the words of the catalogue's labels
A.CTES["kpiwords"] = """
SELECT kpi, lower(label) AS label, list_filter(string_split(replace(lower(label), '/', ' '), ' '), lambda x: length(x) > 2) AS words
FROM (VALUES """ + ", ".join(f"('{r['kpi']}', '{r['label']}')" for r in catalogue_rows("LTE")) + """) v(kpi, label)"""
CITED_DROPS = ("erab_drop_rate", "ctxt_drop_rate", "avg_sinr_db", "avg_rsrp_dbm", "ul_rssi_dbm", "ho_sr", "dl_prb_util")
CITED_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {bad(k)} = 1 THEN '{k}' END" for k in CITED_DROPS) + f"""
  , CASE WHEN ({REAL} AND ta_p95_m > 1.3 * {ISD}) OR (NOT {REAL} AND ta_p95_m > 4000) THEN 'ta_p95_m' END)"""


@query("d13_trend_reinforcement", with_ctes(f"""
SELECT * FROM (WITH lost AS (SELECT cell_id, sev, confidence, {CITED_SQL} AS kpis FROM diags JOIN pcells USING (cell_id)
  WHERE problem_class = 'retainability'),
text AS (SELECT cell_id, string_agg(w.kpi || ' ' || w.label, ' ') AS text FROM
  (SELECT cell_id, unnest(string_split(kpis, ',')) AS kpi FROM lost) JOIN kpiwords w USING (kpi) GROUP BY 1),
related AS (SELECT cell_id, kpi FROM text, kpiwords WHERE contains(text, kpi) OR (len(words) > 0 AND
  len(list_filter(words, lambda x: contains(text, x))) >= greatest(1, len(words) - 1))),
worst AS (SELECT cell_id, first(t ORDER BY t.verdict <> 'step-down', abs(t.pct_change) DESC, t.kpi) AS t
  FROM related JOIN ptrends t USING (cell_id, kpi) WHERE t.verdict IN ('degrading', 'step-down') GROUP BY 1)
SELECT cell_id, 'retainability' AS problem_class, t.kpi AS trend_kpi, t.verdict AS trend_verdict,
  round(CASE WHEN t.kpi IS NULL THEN confidence ELSE least(0.97, confidence + 0.08) END, 6)::DOUBLE AS confidence,
  CASE WHEN t.verdict = 'step-down' AND sev = 1 THEN t.baseline END AS step_from,
  CASE WHEN t.verdict = 'step-down' AND sev = 1 THEN t.recent END AS step_to,
  (SELECT string_agg(kpi, ',' ORDER BY kpi) FROM related r WHERE r.cell_id = lost.cell_id) AS related
FROM lost LEFT JOIN worst USING (cell_id))"""))
def _(spark, d):
    x = D.reinforce_by_trend(D.diagnose(part_cells(spark, d), classes=["retainability"]),
                             part_trends(spark, d))
    return x.select("cell_id", "problem_class", F.col("trend.kpi").alias("trend_kpi"),
                    F.col("trend.verdict").alias("trend_verdict"), F.round("confidence", 6).alias("confidence"),
                    F.col("step.baseline").alias("step_from"), F.col("step.recent").alias("step_to"),
                    F.array_join(F.array_sort("related_kpis"), ",").alias("related"))


@query("a37_diagnosis_counts", with_ctes("""
SELECT problem_class, count(CASE WHEN sev = 2 THEN 1 END) AS critical,
  count(CASE WHEN sev = 1 THEN 1 END) AS warning, count(*) AS total FROM diags GROUP BY 1"""))
def _(spark, d):
    return D.diagnosis_counts(D.diagnose(part_cells(spark, d)))


# --------------------------------------------------------------------- actions
def elev(dist):
    return f"degrees(atan2(greatest(antenna_height_m - 1.5, 0.5), greatest({dist}, 1.0)))"


def gain(dist, new):
    e = elev(dist)
    return (f"round_even(-least(12 * pow(({e} - {new}) / 6.5, 2), 25.0) + "
            f"least(12 * pow(({e} - tilt) / 6.5, 2), 25.0), 2)")


def tilt_ctes(src, factor):
    return f"""(SELECT *, round_even(least(10.0, greatest(0.0, new_total - mech_tilt_deg)), 1) AS elec FROM (
  SELECT *, round_even(tilt + step, 1) AS new_total FROM (
    SELECT *, greatest(-3.0, least(3.0, best - tilt)) AS step FROM (
      SELECT *, mech_tilt_deg + elec_tilt_deg AS tilt, round_even(greatest(0.0, least(16.0,
        {elev(f'{factor} * isd')} + 3.25)), 1) AS best FROM (
          SELECT *, coalesce(isd_m, 500.0) AS isd FROM {src})))))"""


def conf_sql(keys, base, geometry=False):
    parts = [str(base)] + [f"CASE WHEN {k} IS NOT NULL THEN 0.08 ELSE 0 END" for k in keys]
    if geometry:
        parts.append("0.1")
    parts += ["CASE WHEN total_traffic_gb >= 1 THEN 0.05 ELSE 0 END",
              "CASE WHEN n_rows >= 24 THEN 0.05 ELSE 0 END"]
    return f"round(greatest(0.15, least(0.95, {' + '.join(parts)})), 6)::DOUBLE"


PRIO = ("CASE WHEN sev = 2 AND total_traffic_gb >= 1 THEN 'P1' WHEN sev = 2 OR total_traffic_gb >= 5 "
        "THEN 'P2' ELSE 'P3' END")


def src(cls):
    return f"(SELECT c.*, g.sev FROM pcells c JOIN diags g USING (cell_id) WHERE problem_class = '{cls}')"


def acts(spark, d, cls, cols, cells=None):
    c = cells if cells is not None else part_cells(spark, d)
    r = R.recommend(D.diagnose(c, classes=[cls]), c, [cls])
    return r.select("cell_id", "action", *[F.round(x, 6).alias(x) if x != "cause" else F.col(x)
                                           for x in cols],
                    F.round("confidence", 6).alias("confidence"), "priority")


@query("r01_overshooting", with_ctes(f"""
SELECT cell_id, 'downtilt' AS action, new_total AS new_total_tilt, elec AS new_elec_tilt,
  round(step, 6) AS tilt_step, {gain('2 * isd', 'new_total')} AS gain_db,
  {conf_sql(['ta_p95_m', 'avg_rsrq_db', 'pct_ta_gt_threshold'], 0.55, True)} AS confidence, {PRIO} AS priority
FROM {tilt_ctes(src('overshooting'), 1.15)} WHERE step >= 0.5"""))
def _(spark, d):
    return acts(spark, d, "overshooting", ["new_total_tilt", "new_elec_tilt", "tilt_step", "gain_db"])


def half_even(x):
    """One decimal, half to even, of the number as it prints."""
    d = f"({x})::VARCHAR::DECIMAL(38,20) * 10"
    return (f"(CASE WHEN abs({d} - trunc({d})) = 0.5 THEN trunc({d}) + CASE WHEN trunc({d}) % 2 = 0 "
            f"THEN 0 ELSE sign({x}) END ELSE round({d}, 0) END / 10)::DOUBLE")


@query("r02_coverage", with_ctes(f"""
SELECT cell_id, CASE WHEN tilts AND applied > 0 THEN 'uptilt+power' WHEN tilts THEN 'uptilt' ELSE 'power'
    END AS action, CASE WHEN tilts THEN new_total END AS new_total_tilt,
  CASE WHEN tilts THEN elec END AS new_elec_tilt, round(g, 6) AS gain_db, applied AS power_db,
  {half_even('gap')} AS needed_db,
  {conf_sql(['avg_rsrp_dbm', 'pct_rsrp_poor', 'dl_user_thr_mbps'], 0.5, True)} AS confidence, {PRIO} AS priority
FROM (SELECT *, CASE WHEN gap <= 0 THEN 0.0::DOUBLE ELSE {half_even('least(gap, 3.0)')} END AS applied FROM (
  SELECT *, -105.0 - coalesce(avg_rsrp_dbm, -108.0) - g AS gap FROM (
    SELECT *, step < -0.3 AND abs(elec - (new_total - mech_tilt_deg)) <= 0.05 AS tilts,
      CASE WHEN step < -0.3 THEN {gain('0.95 * isd', 'new_total')} ELSE 0.0 END AS g
    FROM {tilt_ctes(src('coverage'), 0.95)}))) WHERE tilts OR applied > 0"""))
def _(spark, d):
    return acts(spark, d, "coverage", ["new_total_tilt", "new_elec_tilt", "gain_db", "power_db",
                                       "needed_db"])


@query("r03_interference", with_ctes(f"""
SELECT cell_id, CASE WHEN NOT hunt AND step >= 0.5 THEN 'downtilt+neighbour_audit' WHEN NOT hunt THEN
    'neighbour_audit' ELSE 'hunt_uplink_source' END AS action,
  CASE WHEN hunt THEN ul_rssi_dbm + 115.0 END AS needed_db,
  CASE WHEN NOT hunt AND step >= 0.5 THEN new_total END AS new_total_tilt,
  CASE WHEN hunt THEN {conf_sql(['ul_rssi_dbm', 'avg_sinr_db'], 0.6)}
    ELSE {conf_sql(['avg_rsrq_db', 'avg_sinr_db', 'avg_rsrp_dbm'], 0.5)} END AS confidence, {PRIO} AS priority
FROM (SELECT *, coalesce(ul_rssi_dbm > -108, false) AND NOT coalesce(avg_rsrp_dbm > -100
    AND avg_rsrq_db < -13, false) AS hunt FROM {tilt_ctes(src('interference'), 1.05)})"""))
def _(spark, d):
    return acts(spark, d, "interference", ["needed_db", "new_total_tilt"])


A.CTES["plow"] = """
SELECT cell_id, (SELECT min(b.dl_prb_util) FROM pcells b WHERE b.sector_id = a.sector_id) AS low_all,
  (SELECT min(b.dl_prb_util) FROM pcells b WHERE b.sector_id = a.sector_id AND b.cell_id <> a.cell_id)
    AS low_other FROM pcells a"""


@query("r04_congestion", with_ctes(f"""
SELECT cell_id, CASE WHEN low_all < 45 THEN 'load_balance' ELSE 'expand_capacity' END AS action,
  greatest(coalesce(dl_prb_util, 0) - 70, 0) AS move_pp,
  round(CASE WHEN total_traffic_gb > 0 AND dl_prb_util > 0 THEN
    total_traffic_gb * greatest(dl_prb_util - 70, 0) / dl_prb_util END, 6) AS offload_gb,
  CASE WHEN low_all < 45 THEN {conf_sql(['dl_prb_util', 'rrc_conn_users_avg'], 0.55)}
    ELSE {conf_sql(['dl_prb_util', 'rrc_conn_users_avg'], 0.6)} END AS confidence, {PRIO} AS priority
FROM {src('high_utilization')} JOIN plow USING (cell_id)"""))
def _(spark, d):
    c = R.with_sibling_load(part_cells(spark, d))
    return acts(spark, d, "high_utilization", ["move_pp", "offload_gb"], c)


def cause_query(name, cls, cause, conf, action, where="true"):
    sql = (f"SELECT cell_id, {action} AS action, {cause} AS cause, {conf} AS confidence, {PRIO} AS priority "
           f"FROM {src(cls)} WHERE {where}")

    @query(name, with_ctes(sql))
    def _(spark, d):
        return acts(spark, d, cls, ["cause"])


RF = "(coalesce(avg_cqi < 7, false) OR coalesce(avg_sinr_db < 3, false))"
cause_query("r05_low_throughput", "low_throughput", f"CASE WHEN {RF} THEN 'radio' ELSE 'configuration' END",
            f"CASE WHEN {RF} THEN {conf_sql(['dl_user_thr_mbps', 'avg_cqi'], 0.45)} ELSE "
            f"{conf_sql(['dl_user_thr_mbps', 'avg_cqi'], 0.4)} END",
            f"CASE WHEN {RF} THEN 'fix_radio_first' ELSE 'features_and_transport' END",
            f"NOT (coalesce(dl_prb_util >= 75, false) AND NOT {RF})")
BUSY = ("(coalesce(dl_prb_util >= 75, false) OR coalesce(pdcch_util >= 75, false) "
        "OR coalesce(ue_rejected_rrc > 20, false))")
ULX = "(coalesce(ul_rssi_dbm > -108, false) AND coalesce(rach_setup_sr < 92, true))"
WEAK = "coalesce(avg_rsrp_dbm < -108, false)"
ACC = ["rrc_setup_sr", "erab_setup_sr"]
cause_query("r06_accessibility", "accessibility",
            f"CASE WHEN {BUSY} THEN 'congestion' WHEN {ULX} THEN 'uplink' WHEN {WEAK} THEN 'coverage' "
            "ELSE 'signalling' END",
            f"CASE WHEN {BUSY} THEN {conf_sql(ACC, 0.55)} WHEN {ULX} OR {WEAK} THEN {conf_sql(ACC, 0.5)} "
            f"ELSE {conf_sql(ACC, 0.4)} END", "'accessibility'")
UL7 = "coalesce(ul_rssi_dbm > -107, false)"
EDGE = ("(coalesce(avg_rsrp_dbm < -108, false) OR coalesce(avg_sinr_db < 2, false) OR "
        "coalesce(ho_sr < 95, false) OR coalesce(ta_p95_m > 1.3 * coalesce(isd_m, 500.0), false))")
LOAD = "coalesce(dl_prb_util >= 80, false)"
RET = ["erab_drop_rate", "avg_sinr_db"]
cause_query("r07_retainability", "retainability",
            f"CASE WHEN {UL7} THEN 'uplink' WHEN {EDGE} THEN 'mobility_or_edge' WHEN {LOAD} THEN "
            "'congestion' ELSE 'unclear' END",
            f"CASE WHEN {UL7} OR {EDGE} OR {LOAD} THEN {conf_sql(RET, 0.5)} ELSE {conf_sql(RET, 0.35)} END",
            "'retainability'")
HO = ["ho_sr", "ho_ping_pong_rate"]
cause_query("r08_handover", "handover",
            "CASE WHEN ho_ping_pong_rate > 5 THEN 'ping_pong' WHEN x2_ho_sr < 95 OR s1_ho_sr < 95 THEN "
            "'preparation' ELSE 'execution' END",
            f"CASE WHEN ho_ping_pong_rate > 5 THEN {conf_sql(HO, 0.5)} ELSE {conf_sql(HO, 0.45)} END",
            "'mobility'")
cause_query("r09_availability", "availability", "'not_radio'",
            "CASE WHEN cell_avail_pct IS NULL THEN 0.4 ELSE 0.7 END::DOUBLE", "'escalate_fault'")


@query("r10_imbalance", with_ctes(f"""
SELECT cell_id, 'border_offset' AS action, (dl_prb_util - low_other) / 2 AS move_pp,
  -round_even(least(6.0, greatest(2.0, (dl_prb_util - low_other) / 10)), 0) AS offset_db,
  {conf_sql(['dl_prb_util'], 0.5)} AS confidence, {PRIO} AS priority
FROM (SELECT first(cell_id ORDER BY dl_prb_util DESC, cell_id) AS cell_id,
    CASE WHEN max(dl_prb_util) - min(dl_prb_util) > 45 THEN 2 ELSE 1 END AS sev
  FROM pcells WHERE dl_prb_util IS NOT NULL GROUP BY sector_id HAVING count(*) >= 2 AND
    max(dl_prb_util) - min(dl_prb_util) >= 25 AND max(dl_prb_util) >= 55)
JOIN pcells USING (cell_id) JOIN plow USING (cell_id) WHERE dl_prb_util - low_other >= 20"""))
def _(spark, d):
    c = R.with_sibling_load(part_cells(spark, d))
    r = R.recommend(D.traffic_imbalance(c), c, ["traffic_imbalance"])
    return r.select("cell_id", "action", "move_pp", "offset_db",
                    F.round("confidence", 6).alias("confidence"), "priority")
