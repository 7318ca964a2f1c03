"""Time series per object and KPI: decimation, robust trends, level shifts, spikes.

A series holds one row per object and hour, so its length is bounded by the hours of the
window whatever the volume of the exports; the windows below partition by series and share
one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.times import epoch_seconds
from radiolake.kpis import agg_how
from radiolake.operators.common import first_by

MAX_POINTS = 180  # of a series that is shown, not of one that is judged
STABLE_PCT = 3.0
SPIKE_SCALES, SPIKE_MIN_HOURS, SPIKE_FLAT = 6.0, 6, 0.01
MAD = 1.4826


def median_of(col, over=None) -> Column:
    m = F.percentile(col, F.lit(0.5))
    return m.over(over) if over is not None else m


def decimate(df: DataFrame, keys: Sequence[str], t: str = "datetime",
             n: int = MAX_POINTS) -> DataFrame:
    """Every ceil(rows / n)-th row of a series, the first included."""
    by = W.partitionBy(*keys)
    d = df.withColumn("_rn", F.row_number().over(by.orderBy(t))).withColumn(
        "_n", F.count(F.lit(1)).over(by))
    step = F.greatest(F.ceil(F.col("_n") / n), F.lit(1))
    return d.filter((F.col("_rn") - 1) % step == 0).drop("_rn", "_n")


def rolling_median(df: DataFrame, keys: Sequence[str], value: str, rows: int, least: int,
                   out: str, t: str = "datetime") -> DataFrame:
    """Centred rolling median; an even window reaches one row further back than forward."""
    half = rows // 2
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(-half, half if rows % 2 else half - 1)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, median_of(value, w)))


def median_slope(t: np.ndarray, y: np.ndarray) -> float:
    """Exact median of the slopes of all pairs with different t; 0 if there is none.

    A sample of the slopes brackets the median, one pass counts the slopes below the bracket and
    keeps those inside; a bracket that misses is widened. Slopes exist for one point at a time, so
    memory follows the length of the series.
    """
    order = np.argsort(t, kind="stable")
    t, y = t[order], y[order]
    later = np.searchsorted(t, t, side="right")
    pairs = int((len(t) - later).sum())
    if not pairs:
        return 0.0
    rng = np.random.default_rng(len(t))
    i, j = rng.integers(len(t), size=(2, 8 * len(t)))
    i, j = i[t[i] != t[j]], j[t[i] != t[j]]
    sample = np.sort((y[j] - y[i]) / (t[j] - t[i]))
    wide = 4
    low, high = (pairs - 1) // 2, pairs // 2
    while True:
        reach = int(wide * np.sqrt(len(sample))) + 1
        a, b = len(sample) // 2 - reach, len(sample) // 2 + reach
        lo = sample[a] if a >= 0 else -np.inf
        hi = sample[b] if b < len(sample) else np.inf
        below, inside = 0, []
        for k in range(len(t)):
            slope = (y[later[k]:] - y[k]) / (t[later[k]:] - t[k])
            below += int((slope < lo).sum())
            inside.append(slope[(slope >= lo) & (slope <= hi)])
        inside = np.sort(np.concatenate(inside))
        if below <= low and high < below + len(inside):
            return float((inside[low - below] + inside[high - below]) / 2)
        wide *= 4


def _robust_line(t: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Median of the pairwise slopes, and the line through the medians, per row of two arrays."""
    out = []
    for ts, ys in zip(t, y):
        if len(ts) < 3:
            out.append((0.0, float(ys.mean()) if len(ys) else None))
            continue
        slope = median_slope(ts, ys)
        out.append((slope, float(np.median(ys) - slope * np.median(ts))))
    return pd.DataFrame(out, columns=["slope", "intercept"])


def theil_sen(df: DataFrame, keys: Sequence[str], t: str = "datetime",
              y: str = "value") -> DataFrame:
    """Robust line per series: median of the slopes of all pairs of points (per day) and its
    intercept at the first point.

    A series is one row of two arrays, as long as the hours of the period; its slopes exist
    only inside a vectorised step, one point's at a time.
    """
    d = df.filter(F.col(y).isNotNull())
    g = d.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct(epoch_seconds(t).alias("_s"), F.col(y).cast("double").alias("_y")))).alias("p"))
    days = F.transform("p._s", lambda s: (s - F.col("p")[0]["_s"]) / 86400.0)
    fit = F.pandas_udf(_robust_line, "slope double, intercept double")
    g = g.withColumn("w", fit(days, F.col("p._y")))
    return g.select(*keys, F.col("w.slope").alias("slope_per_day"),
                    F.col("w.intercept").alias("intercept"))


def _sigma(value: Column, centre: Column, over) -> Column:
    """1.4826 x the median absolute deviation, the population deviation where that is zero."""
    mad = median_of(F.abs(value - centre), over) * MAD
    flat = F.coalesce(F.stddev_pop(value).over(over), F.lit(0.0))
    many = F.count(value).over(over) >= 2
    return F.when(many, F.when(F.coalesce(mad, F.lit(0.0)) != 0, mad).otherwise(flat)).otherwise(0.0)


def or_(value: Column, other) -> Column:
    return F.when(value != 0, value).otherwise(other)


def detect_anomalies(series: DataFrame, keys: Sequence[str], direction: Column | str,
                     flagged_only: bool = False) -> DataFrame:
    """Trend verdict per series of (keys, datetime, value): first and last block, level shift
    in robust sigmas, volatility of the de-cycled residual, point anomalies, verdict."""
    keys = list(keys)
    part = W.partitionBy(*keys)
    dirn = F.col(direction) if isinstance(direction, str) else direction
    d = series.filter(F.col("value").isNotNull()).select(
        *keys, "datetime", F.col("value").cast("double").alias("y"), dirn.alias("_dir"))
    d = d.withColumn("rn", F.row_number().over(part.orderBy("datetime"))).withColumn(
        "n", F.count(F.lit(1)).over(part)).filter(F.col("n") >= 5)
    block = F.least(F.greatest(F.lit(3), F.bround(F.col("n") * 0.25, 0).cast("int")),
                    F.floor(F.col("n") / 2).cast("int"))
    d = d.withColumn("k", block)
    d = rolling_median(d, keys, "y", 24, 6, "m24")
    d = rolling_median(d, keys, "y", 5, 2, "m5")
    d = d.withColumn("r24", F.col("y") - F.col("m24")).withColumn("r5", F.col("y") - F.col("m5"))
    is_base = F.col("rn") <= F.col("n") - F.col("k")
    d = d.withColumn("yb", F.when(is_base, F.col("y")))
    d = (d.withColumn("med", median_of("y", part)).withColumn("b_mu", median_of("yb", part))
         .withColumn("r_mu", median_of(F.when(~is_base, F.col("y")), part))
         .withColumn("first", median_of(F.when(F.col("rn") <= F.col("k"), F.col("y")), part))
         .withColumn("c24", median_of("r24", part)).withColumn("c5", median_of("r5", part)))
    d = (d.withColumn("s_b", _sigma(F.col("yb"), F.col("b_mu"), part))
         .withColumn("s_y", _sigma(F.col("y"), F.col("med"), part))
         .withColumn("s24", _sigma(F.col("r24"), F.col("c24"), part))
         .withColumn("s5", _sigma(F.col("r5"), F.col("c5"), part)))
    far = F.abs("r5")
    g = d.groupBy(*keys).agg(
        F.first("_dir").alias("direction"), F.max("n").alias("n"), F.max("first").alias("first"),
        F.max("r_mu").alias("recent"), F.max("b_mu").alias("baseline"), F.max("med").alias("med"),
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.max("s_b").alias("s_b"),
        F.max("s_y").alias("s_y"), F.max("s24").alias("s24"),
        F.count_if(far > 4 * or_(F.col("s5"), F.lit(1e-9))).alias("n_point_anomalies"),
        first_by("datetime", -far, "datetime").alias("at"),
        F.min("datetime").alias("t0"), F.max("datetime").alias("t1"))
    line = theil_sen(series, keys)
    g = g.join(line.select(*keys, "slope_per_day"), keys)
    last = F.col("recent")
    denom = or_(F.abs("med"), F.lit(1.0))
    g = g.withColumn("pct_change", (last - F.col("first")) / denom * 100.0)
    sigma = F.coalesce(or_(F.col("s_b"), or_(F.col("s_y"), F.lit(1e-9))), F.lit(1e-9))
    g = g.withColumn("level_shift_sigma", (F.col("recent") - F.col("baseline")) / sigma)
    g = g.withColumn("volatility_cv", F.when(
        F.col("n") >= 48, F.col("s24") / or_(F.abs("med"), F.lit(1e-9))).otherwise(
        F.col("std") / or_(F.abs("mean"), F.lit(1e-9))))
    sign = F.when(F.col("direction") == "up", 1.0).otherwise(-1.0)
    move = sign * (F.col("recent") - F.col("baseline"))
    rel = move / or_(F.abs("baseline"), F.lit(1.0))
    ends = sign * (last - F.col("first")) / denom
    days = (epoch_seconds("t1") - epoch_seconds("t0")) / 86400.0
    fit = sign * F.col("slope_per_day") * or_(days, F.lit(1.0)) / denom
    verdict = (F.when((F.abs("level_shift_sigma") >= 4) & (F.abs(rel) >= 0.08),
                      F.when(move > 0, "step-up").otherwise("step-down"))
               .when((F.col("volatility_cv") > 0.5) & (F.abs(rel) < 0.12) & (F.abs(ends) < 0.12),
                     "volatile")
               .when((ends <= -0.15) & (fit <= -0.10), "degrading")
               .when((ends >= 0.15) & (fit >= 0.10), "improving").otherwise("stable"))
    out = g.select(*keys, "direction", "n", "first", last.alias("last"), "slope_per_day",
                   "pct_change", "level_shift_sigma", "baseline", "recent", "volatility_cv",
                   "n_point_anomalies", F.when(F.col("n_point_anomalies") > 0, F.col("at"))
                   .alias("worst_point"), verdict.alias("verdict"))
    if flagged_only:
        out = out.filter(~F.col("verdict").isin("stable", "improving", "step-up"))
    return out


def sudden_spikes(series: DataFrame, keys: Sequence[str], low_is_bad: bool,
                  level: float) -> DataFrame:
    """Hours far outside the object's own normal variation, in the bad direction and past the
    level: per series the count and the worst one (the earliest on a tie)."""
    part = W.partitionBy(*keys)
    d = series.filter(F.col("value").isNotNull()).select(*keys, "datetime", "value")
    d = d.withColumn("n", F.count(F.lit(1)).over(part)).withColumn(
        "normal", median_of("value", part))
    d = d.withColumn("mad", median_of(F.abs(F.col("value") - F.col("normal")), part))
    scale = F.greatest(F.lit(MAD) * F.col("mad"), SPIKE_FLAT * F.abs("normal"))
    away = F.col("normal") - F.col("value") if low_is_bad else F.col("value") - F.col("normal")
    reach = F.col("value") <= level if low_is_bad else F.col("value") >= level
    hit = d.withColumn("away", away).filter(
        (F.col("n") >= SPIKE_MIN_HOURS) & (F.col("away") > 0)
        & (F.col("away") > SPIKE_SCALES * scale) & reach)
    return hit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spike_hours"),
        first_by(["datetime", "value", "normal"], -F.col("away"), "datetime").alias("w")).select(
        *keys, "spike_hours", F.col("w.datetime").alias("spike_time"),
        F.col("w.value").alias("spike_value"), F.col("w.normal").alias("normal"))


LEVEL_COLUMN = {"prefix": "prefix", "site": "site_id", "cell": "object"}


def series_for(long: DataFrame, level: str = "network", extra: Sequence[str] = ()) -> DataFrame:
    """The hourly series of each KPI at a level, over the hours it was measured in."""
    keys = [*extra, "kpi"] + ([LEVEL_COLUMN[level]] if level in LEVEL_COLUMN else [])
    g = long.filter(F.col("value").isNotNull()).groupBy(*keys, "datetime").agg(
        F.sum("value").alias("_s"), F.avg("value").alias("_m"))
    return g.select(*keys, "datetime", F.when(agg_how("kpi") == "sum", F.col("_s"))
                    .otherwise(F.col("_m")).alias("value"))


def trend_of(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change along the robust line, and Increasing, Decreasing or Stable."""
    g = series.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.min("datetime").alias("t0"),
        F.max("datetime").alias("t1"), first_by("value", "datetime").alias("first"),
        F.max_by("value", "datetime").alias("last"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("value").alias("mean"))
    g = g.join(theil_sen(series, keys), list(keys))
    days = (epoch_seconds("t1") - epoch_seconds("t0")) / 86400.0
    start = F.col("intercept")
    base = F.when(F.abs(start) > 1e-9, F.abs(start)).otherwise(or_(F.abs("mean"), F.lit(1.0)))
    pct = F.when(F.col("points") >= 2, F.col("slope_per_day") * days / base * 100.0).otherwise(0.0)
    g = g.withColumn("pct_change", pct)
    return g.select(*keys, "points", "first", "last", "min", "max", "mean", "slope_per_day",
                    "pct_change",
                    F.when(F.abs("pct_change") < STABLE_PCT, "Stable")
                    .when(F.col("pct_change") > 0, "Increasing").otherwise("Decreasing")
                    .alias("verdict"))


def panels(long: DataFrame, cells: Sequence[str] | DataFrame = (),
           by_tech: bool = False) -> tuple:
    """(lines, overall trend) per KPI: a line per chosen cell, per technology, or one.

    With cells (names, or a table with a column `object`) the trend is that of the cells together;
    otherwise of the longest line.
    """
    if isinstance(cells, DataFrame) or cells:
        d = (long.join(cells.select("object"), "object", "left_semi")
             if isinstance(cells, DataFrame) else long.filter(F.col("object").isin(*cells)))
        lines = series_for(d.withColumn("line", F.col("object")), "network", ["line"])
        return lines, trend_of(series_for(d), ["kpi"])
    d = long.withColumn("line", F.col("tech") if by_tech else F.lit("all"))
    lines = series_for(d, "network", ["line"])
    longest = lines.groupBy("kpi", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("kpi").agg(
        first_by("line", -F.col("n"), "line").alias("line"))
    return lines, trend_of(lines.join(longest, ["kpi", "line"]), ["kpi"])


def trend_summary(trends: DataFrame) -> DataFrame:
    """Rounded trend table, the largest change first."""
    r = lambda c, n: F.bround(c, n).alias(c)
    return trends.select("kpi", "verdict", r("pct_change", 1), r("first", 3), r("last", 3),
                         r("min", 3), r("max", 3), r("mean", 3), "points").orderBy(
        F.desc(F.abs("pct_change")), "kpi")
