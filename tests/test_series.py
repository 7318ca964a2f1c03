import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiolake.operators import series as N


def frame(spark, values, obj="c1"):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(obj, "k", t0 + dt.timedelta(hours=i), float(v))
                                  for i, v in enumerate(values)],
                                 "object string, kpi string, datetime timestamp_ntz, value double")


@pytest.mark.parametrize("n", [3, 50, 400, 2000])
def test_theil_sen_is_the_median_of_pairwise_slopes(spark, n):
    rng = np.random.default_rng(n)
    y = 5 + 0.3 * np.arange(n) + rng.normal(0, 3, n)
    got = N.theil_sen(frame(spark, y), ["object"]).collect()[0]
    t = np.arange(n) / 24.0
    i, j = np.triu_indices(len(t), 1)
    slope = np.median((y[j] - y[i]) / (t[j] - t[i]))
    assert got["slope_per_day"] == pytest.approx(slope)
    assert got["intercept"] == pytest.approx(np.median(y) - slope * np.median(t))


def test_median_slope_with_ties_and_few_points():
    rng = np.random.default_rng(9)
    for n in (2, 3, 7, 60, 500):
        t = np.sort(rng.integers(0, max(2, n // 3), n)).astype(float)
        y = rng.choice([0.0, 1.0, 1e6, -3.0], n)
        i, j = np.nonzero(t[None, :] - t[:, None] > 0)
        want = np.median((y[j] - y[i]) / (t[j] - t[i])) if len(i) else 0.0
        assert N.median_slope(t, y) == pytest.approx(want)
    assert N.median_slope(np.zeros(5), np.arange(5.0)) == 0.0


def test_rolling_medians_match_pandas(spark):
    y = np.random.default_rng(1).normal(0, 1, 60)
    s = N.rolling_median(frame(spark, y), ["object"], "value", 24, 6, "m")
    got = s.toPandas().sort_values("datetime")["m"].to_numpy()
    want = pd.Series(y).rolling(24, center=True, min_periods=6).median().to_numpy()
    assert np.allclose(got, want)


def test_verdicts(spark):
    rng = np.random.default_rng(4)
    step = np.r_[np.full(40, 95.0), np.full(20, 60.0)] + rng.normal(0, .5, 60)
    ramp = np.linspace(100, 60, 60) + rng.normal(0, 2, 60)
    calm = np.full(60, 50.0) + rng.normal(0, .1, 60)
    df = frame(spark, step, "step").unionByName(frame(spark, ramp, "ramp")).unionByName(
        frame(spark, calm, "calm")).unionByName(frame(spark, [1, 2, 3, 4], "short"))
    from pyspark.sql import functions as F
    v = {r["object"]: r["verdict"] for r in N.detect_anomalies(df, ["object"], F.lit("up")).collect()}
    assert v["step"] == "step-down" and v["calm"] == "stable" and "short" not in v
    assert v["ramp"] in ("degrading", "step-down")


def test_spikes_need_a_normal_and_the_level(spark):
    calm = [30.0, 25, 28, 40, 20, 35, 30, 27]
    df = frame(spark, calm + [100000.0], "jump").unionByName(frame(spark, calm + [90.0], "below")).unionByName(
        frame(spark, [30.0, 25, 100000.0], "short"))
    r = N.sudden_spikes(df, ["object"], False, 100.0).collect()
    assert [(x["object"], x["spike_hours"], x["spike_value"]) for x in r] == [("jump", 1, 100000.0)]


def test_panels_take_cells_as_a_table(spark):
    long = frame(spark, [1, 2, 3]).unionAll(frame(spark, [4, 5, 6], "c2")).unionAll(
        frame(spark, [7, 8, 9], "c3")).withColumn("tech", F.lit("4G"))
    cells = spark.createDataFrame([("c1",), ("c2",)], "object string")
    lines, overall = N.panels(long, cells)
    want, trend = N.panels(long, ["c1", "c2"])
    assert {r["line"] for r in lines.collect()} == {"c1", "c2"}
    assert sorted(lines.collect()) == sorted(want.collect())
    assert overall.collect() == trend.collect()
