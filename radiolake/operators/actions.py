"""Sized actions for diagnosed cells: tilt steps, power, load to move, offsets.

`recommend` takes the diagnoses joined with their cell's KPIs and geometry and adds one
struct of numbers per (cell, class); it is a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions import geo as G
from radiolake.operators.diagnose import total, yes

# Fixed values.
MAX_TILT_STEP = 3.0
RET_LO, RET_HI = 0.0, 10.0
TARGET_RSRP = -105.0
COMPLAINT_RSRP = -100.0

FIELDS = (("action", "string"), ("cause", "string"), ("new_total_tilt", "double"),
          ("new_elec_tilt", "double"), ("tilt_step", "double"), ("gain_db", "double"),
          ("power_db", "double"), ("needed_db", "double"), ("move_pp", "double"),
          ("offload_gb", "double"), ("offset_db", "double"), ("confidence", "double"))


def made(**values) -> Column:
    return F.struct(*[(values[n] if n in values else F.lit(None)).cast(t).alias(n)
                      for n, t in FIELDS])


def confidence(keys: Sequence[str], base, geometry: bool = False) -> Column:
    b = base if isinstance(base, Column) else F.lit(float(base))
    score = b + total([F.when(F.col(k).isNotNull(), 0.08).otherwise(0.0) for k in keys])
    if geometry:
        known = (F.col("latitude").isNotNull() & (F.col("antenna_height_m") > 0)
                 & F.col("azimuth_deg").isNotNull())
        score = score + F.when(yes(known), 0.1).otherwise(-0.15)
    score = score + F.when(yes(F.col("total_traffic_gb") >= 1), 0.05).otherwise(0.0)
    score = score + F.when(yes(F.col("n_rows") >= 24), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.15), F.least(F.lit(0.95), score))


def action_priority(sev="sev", traffic="total_traffic_gb") -> Column:
    t = F.coalesce(F.col(traffic), F.lit(0.0))
    return (F.when((F.col(sev) == 2) & (t >= 1), "P1").when((F.col(sev) == 2) | (t >= 5), "P2")
            .otherwise("P3"))


# The share of the site spacing a class wants its far edge at.
EDGE_SHARE = {"overshooting": 1.15, "coverage": 0.95, "interference": 1.05, "poor_rsrq": 1.05}


def with_tilt(rows: DataFrame) -> DataFrame:
    """A capped tilt step per row that puts the far edge at its class's distance.

    Every stage is a column of its own, so each formula is generated once.
    """
    share = F.lit(None).cast("double")
    for cls, x in EDGE_SHARE.items():
        share = F.when(F.col("problem_class") == cls, x).otherwise(share)
    d = rows.withColumn("_edge", share * F.col("isd_m")).withColumn(
        "_tilt", F.col("mech_tilt_deg") + F.col("elec_tilt_deg"))
    d = d.withColumn("_best", G.optimal_downtilt("antenna_height_m", F.col("_edge"),
                                                 F.col("vbw_deg")))
    d = d.withColumn("_step", G.at_least(G.at_most(
        F.col("_best") - F.col("_tilt"), MAX_TILT_STEP), -MAX_TILT_STEP))
    d = d.withColumn("_total", F.bround(F.col("_tilt") + F.col("_step"), 1))
    d = d.withColumn("_raw", F.col("_total") - F.col("mech_tilt_deg"))
    d = d.withColumn("_elec", F.bround(G.at_most(G.at_least(F.col("_raw"), RET_LO), RET_HI), 1))
    d = d.withColumn("_limited", F.abs(F.col("_elec") - F.col("_raw")) > 0.05)
    # an overshooting cell is judged by what it takes off far away, the rest at the edge
    d = d.withColumn("_at", F.when(F.col("problem_class") == "overshooting", 2 * F.col("isd_m"))
                     .otherwise(F.col("_edge")))
    d = d.withColumn("_gain", G.tilt_gain_db("antenna_height_m", "_at", "_tilt", "_total",
                                             F.col("vbw_deg")))
    up = F.when(F.col("_step") < -0.3, F.col("_gain")).otherwise(0.0)
    return d.withColumn("_power", G.power_delta(
        F.coalesce(F.col("avg_rsrp_dbm"), F.lit(-108.0)), TARGET_RSRP, up))


def _overshooting() -> Column:
    return F.when(F.col("_step") >= 0.5, made(
        action=F.lit("downtilt"),
        cause=F.when(F.col("_limited"), "ret_exhausted").otherwise("low_tilt"),
        new_total_tilt=F.col("_total"), new_elec_tilt=F.col("_elec"), tilt_step=F.col("_step"),
        gain_db=F.col("_gain"),
        confidence=confidence(["ta_p95_m", "avg_rsrq_db", "pct_ta_gt_threshold"], 0.55, True)))


def _coverage() -> Column:
    up = F.col("_step") < -0.3
    p = F.col("_power")
    tilts, power = up & ~F.col("_limited"), p["applied_db"] > 0
    action = (F.when(tilts & power, "uptilt+power").when(tilts, "uptilt").otherwise("power"))
    cause = (F.when(tilts, "too_much_tilt").when(power & p["limited"], "link_budget")
             .otherwise("low_power"))
    return F.when(tilts | power, made(
        action=action, cause=cause, new_total_tilt=F.when(tilts, F.col("_total")),
        new_elec_tilt=F.when(tilts, F.col("_elec")), tilt_step=F.when(tilts, F.col("_step")),
        gain_db=F.when(up, F.col("_gain")).otherwise(0.0),
        power_db=p["applied_db"], needed_db=p["needed_db"],
        confidence=confidence(["avg_rsrp_dbm", "pct_rsrp_poor", "dl_user_thr_mbps"], 0.5, True)))


def _interference() -> Column:
    ul = yes(F.col("ul_rssi_dbm") > -108)
    overlap = yes((F.col("avg_rsrp_dbm") > -100) & (F.col("avg_rsrq_db") < -13))
    down = F.col("_step") >= 0.5
    return F.when(ul & ~overlap, made(
        action=F.lit("hunt_uplink_source"), cause=F.lit("uplink_noise"),
        needed_db=F.col("ul_rssi_dbm") + 115.0,
        confidence=confidence(["ul_rssi_dbm", "avg_sinr_db"], 0.6))).otherwise(made(
            action=F.when(down, "downtilt+neighbour_audit").otherwise("neighbour_audit"),
            cause=F.lit("downlink_overlap"), new_total_tilt=F.when(down, F.col("_total")),
            new_elec_tilt=F.when(down, F.col("_elec")), tilt_step=F.when(down, F.col("_step")),
            confidence=confidence(["avg_rsrq_db", "avg_sinr_db", "avg_rsrp_dbm"], 0.5)))


def _congestion() -> Column:
    prb = F.col("dl_prb_util")
    over = F.greatest(F.coalesce(prb, F.lit(0.0)) - 70, F.lit(0.0))
    gb = F.when((F.col("total_traffic_gb") > 0) & (prb > 0), F.col("total_traffic_gb") * over / prb)
    spread = yes(F.col("capacity_layer")) | yes(F.col("sibling_low") < 45)
    return made(action=F.when(spread, "load_balance").otherwise("expand_capacity"),
                cause=F.lit("demand"), move_pp=over, offload_gb=gb,
                confidence=confidence(["dl_prb_util", "rrc_conn_users_avg"],
                                      F.when(spread, 0.55).otherwise(0.6)))


def _low_throughput() -> Column:
    rf = yes(F.col("avg_cqi") < 7) | yes(F.col("avg_sinr_db") < 3)
    full = yes(F.col("dl_prb_util") >= 75)
    return F.when(F.col("dl_user_thr_mbps").isNotNull() & ~(full & ~rf), made(
        action=F.when(rf, "fix_radio_first").otherwise("features_and_transport"),
        cause=F.when(rf, "radio").otherwise("configuration"),
        confidence=confidence(["dl_user_thr_mbps", "avg_cqi"], F.when(rf, 0.45).otherwise(0.4))))


def _accessibility() -> Column:
    busy = (yes(F.col("dl_prb_util") >= 75) | yes(F.col("pdcch_util") >= 75)
            | yes(F.col("ue_rejected_rrc") > 20))
    ul = yes(F.col("ul_rssi_dbm") > -108) & (F.col("rach_setup_sr").isNull()
                                            | (F.col("rach_setup_sr") < 92))
    weak = yes(F.col("avg_rsrp_dbm") < -108)
    cause = (F.when(busy, "congestion").when(ul, "uplink").when(weak, "coverage")
             .otherwise("signalling"))
    base = F.when(busy, 0.55).when(ul | weak, 0.5).otherwise(0.4)
    return made(action=F.lit("accessibility"), cause=cause,
                confidence=confidence(["rrc_setup_sr", "erab_setup_sr"], base))


def _retainability() -> Column:
    ul = yes(F.col("ul_rssi_dbm") > -107)
    edge = yes(F.col("avg_rsrp_dbm") < -108) | yes(F.col("avg_sinr_db") < 2)
    late = yes(F.col("ho_sr") < 95) | yes(F.col("ta_p95_m") > 1.3 * F.col("isd_m"))
    busy = yes(F.col("dl_prb_util") >= 80)
    cause = (F.when(ul, "uplink").when(late | edge, "mobility_or_edge").when(busy, "congestion")
             .otherwise("unclear"))
    base = F.when(ul | late | edge | busy, 0.5).otherwise(0.35)
    return made(action=F.lit("retainability"), cause=cause,
                confidence=confidence(["erab_drop_rate", "avg_sinr_db"], base))


def _handover() -> Column:
    pong = yes(F.col("ho_ping_pong_rate") > 5)
    prep = yes(F.col("x2_ho_sr") < 95) | yes(F.col("s1_ho_sr") < 95)
    return made(action=F.lit("mobility"),
                cause=F.when(pong, "ping_pong").when(prep, "preparation").otherwise("execution"),
                confidence=confidence(["ho_sr", "ho_ping_pong_rate"],
                                      F.when(pong, 0.5).otherwise(0.45)))


def _availability() -> Column:
    return made(action=F.lit("escalate_fault"), cause=F.lit("not_radio"),
                confidence=F.when(F.col("cell_avail_pct").isNotNull(), 0.7).otherwise(0.4))


def _imbalance() -> Column:
    gap = F.col("dl_prb_util") - F.col("sibling_low_other")
    return F.when(gap >= 20, made(
        action=F.lit("border_offset"), cause=F.lit("uneven_load"), move_pp=gap / 2,
        offset_db=-F.bround(G.at_most(G.at_least(gap / 10, 2.0), 6.0), 0),
        confidence=confidence(["dl_prb_util"], 0.5)))


BUILDERS = {"overshooting": _overshooting, "coverage": _coverage, "interference": _interference,
            "poor_rsrq": _interference, "high_utilization": _congestion,
            "low_throughput": _low_throughput, "accessibility": _accessibility,
            "retainability": _retainability, "handover": _handover,
            "availability": _availability, "traffic_imbalance": _imbalance}

# what a cell row needs for the builders, with the value taken when it has none
CONTEXT = {"latitude": None, "azimuth_deg": 0.0, "antenna_height_m": 30.0, "mech_tilt_deg": 0.0,
           "elec_tilt_deg": 3.0, "vbw_deg": G.DEFAULT_VBW, "isd_m": 500.0, "n_rows": 0.0,
           "sibling_low": None, "sibling_low_other": None}
KPIS_READ = ("total_traffic_gb", "ta_p95_m", "avg_rsrq_db", "pct_ta_gt_threshold", "avg_rsrp_dbm",
             "pct_rsrp_poor", "dl_user_thr_mbps", "ul_rssi_dbm", "avg_sinr_db", "dl_prb_util",
             "rrc_conn_users_avg", "avg_cqi", "pdcch_util", "ue_rejected_rrc", "rach_setup_sr",
             "rrc_setup_sr", "erab_setup_sr", "ho_sr", "erab_drop_rate", "ho_ping_pong_rate",
             "x2_ho_sr", "s1_ho_sr", "cell_avail_pct")


def _context(cells: DataFrame) -> DataFrame:
    fill = {}
    for name, default in CONTEXT.items():
        have = F.col(name).cast("double") if name in cells.columns else F.lit(None).cast("double")
        fill[name] = F.coalesce(have, F.lit(default)) if default is not None else have
    for name in KPIS_READ:
        fill[name] = (F.col(name).cast("double") if name in cells.columns
                      else F.lit(None).cast("double"))
    fill["capacity_layer"] = (F.col("capacity_layer") if "capacity_layer" in cells.columns
                              else F.lit(False))
    return cells.withColumns(fill)


def with_sibling_load(cells: DataFrame) -> DataFrame:
    """Each cell with the lowest load of its sector, and of its co-sited others."""
    low = cells.filter(F.col("dl_prb_util").isNotNull()).groupBy("sector_id").agg(
        F.min(F.struct("dl_prb_util", "cell_id")).alias("a"),
        F.count(F.lit(1)).alias("n"))
    rest = cells.join(low.select("sector_id", F.col("a.cell_id").alias("cell_id")),
                      ["sector_id", "cell_id"], "left_anti")
    second = rest.filter(F.col("dl_prb_util").isNotNull()).groupBy("sector_id").agg(
        F.min("dl_prb_util").alias("next_low"))
    j = cells.join(low, "sector_id", "left").join(second, "sector_id", "left")
    return j.withColumn("sibling_low", F.col("a.dl_prb_util")).withColumn(
        "sibling_low_other", F.when(F.col("a.cell_id") == F.col("cell_id"), F.col("next_low"))
        .otherwise(F.col("a.dl_prb_util"))).drop("a", "n", "next_low")


def recommend(diagnoses: DataFrame, cells: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """One sized action per (cell, class); classes without a lever drop out."""
    names = [c for c in BUILDERS if not classes or c in classes]
    d = diagnoses.filter(F.col("problem_class").isin(*names)).select(
        "cell_id", "problem_class", "sev")
    j = d.join(_context(cells), "cell_id")
    if set(names) & set(EDGE_SHARE):
        j = with_tilt(j)
    pick = None
    for c in names:
        cond = F.col("problem_class") == c
        pick = F.when(cond, BUILDERS[c]()) if pick is None else pick.when(cond, BUILDERS[c]())
    # exploding the one-element array keeps the formulas from being copied into a filter
    out = j.select("cell_id", "problem_class", action_priority().alias("priority"),
                   F.explode(F.filter(F.array(pick), lambda x: x.isNotNull())).alias("_a"))
    return out.select("cell_id", "problem_class", "_a.*", "priority")


def recommend_for_location(points: DataFrame, kind: str = "urban", mhz: float = 1800.0) -> DataFrame:
    """Tilt, azimuth or power for coverage at one place.

    Needs dist_m, off_deg, antenna_height_m, mech_tilt_deg, elec_tilt_deg, and optionally
    measured_rsrp. The best tilt points the main lobe at the place; it is worth a change when
    the pattern gains two dB or more.
    """
    vbw, h, dist = F.lit(G.DEFAULT_VBW), F.col("antenna_height_m"), F.col("dist_m")
    now = F.col("mech_tilt_deg") + F.col("elec_tilt_deg")
    theta = G.elevation_deg(h, dist)
    ideal = F.bround(G.at_most(G.at_least(theta, 0.0), 16.0), 1)
    ok = G.tilt_gain_db(h, dist, now, ideal, vbw) < 2.0
    step = F.when(ok, 0.0).otherwise(
        G.at_least(G.at_most(ideal - now, MAX_TILT_STEP), -MAX_TILT_STEP))
    new_total = F.bround(now + step, 1)
    elec = F.bround(G.at_most(G.at_least(new_total - F.col("mech_tilt_deg"), RET_LO), RET_HI), 1)
    d = points.withColumns({"_now": now, "ideal_tilt": ideal, "_ok": ok})
    d = d.withColumns({"tilt_step": step, "new_total_tilt": new_total, "new_elec_tilt": elec})
    d = d.withColumns({
        "gain_db": G.tilt_gain_db(h, dist, F.col("_now"), F.col("new_total_tilt"), vbw),
        "rsrp_now": G.predict_rsrp(dist, h, F.col("_now"), "off_deg", mhz, kind),
        "rsrp_new": G.predict_rsrp(dist, h, F.col("new_total_tilt"), "off_deg", mhz, kind)})
    measured = F.col("measured_rsrp") if "measured_rsrp" in points.columns else F.lit(None)
    d = d.withColumn("_p", G.power_delta(F.coalesce(measured.cast("double"), F.col("rsrp_now")),
                                         COMPLAINT_RSRP, G.at_least(F.col("gain_db"), 0.0)))
    wide = F.col("off_deg") > G.H_BEAMWIDTH / 3
    action = (F.when(F.col("_ok") & wide, "azimuth+power")
              .when(F.col("_ok") & F.col("_p.limited"), "power+layer").when(F.col("_ok"), "power")
              .when(wide, "tilt+azimuth").otherwise("tilt"))
    return d.withColumns({
        "action": action, "power_db": F.col("_p.applied_db"), "needed_db": F.col("_p.needed_db"),
        "rotate_deg": F.when(wide, F.least(F.bround(F.col("off_deg") - G.H_BEAMWIDTH / 4, 0),
                                           F.lit(30.0))).otherwise(0.0)}).drop("_now", "_ok", "_p")
