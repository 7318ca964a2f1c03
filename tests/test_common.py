import numpy as np
import pandas as pd
import pytest

from radiolake.operators.common import exact_quantile, exact_quantiles, top_n_by, weighted_median
from pyspark.sql import functions as F


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile_hot_and_small_groups(spark, q):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.lognormal(3, 2, 40_000), 2)})
    small = pd.DataFrame({"k": np.repeat([f"s{i}" for i in range(20)], 7), "v": rng.normal(0, 1, 140)})
    pdf = pd.concat([hot, small, pd.DataFrame({"k": ["n"], "v": [np.nan]})])
    got = exact_quantile(spark.createDataFrame(pdf), ["k"], "v", q).toPandas().set_index("k")["q"]
    want = pdf.dropna().groupby("k")["v"].quantile(q)
    assert np.allclose(got.reindex(want.index), want, rtol=0, atol=1e-9)


def test_exact_quantile_over_all_rows(spark):
    v = np.arange(25_001, dtype=float) ** 1.5
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = exact_quantile(df, [], "v", 1 / 3).collect()[0]["q"]
    assert got == pytest.approx(np.quantile(v, 1 / 3))


def test_quantiles_of_many_values_hot_keys_and_outliers(spark):
    n = 2_000_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.pmod(F.col("id") * 7919, F.lit(n)) / 3.0).alias("v"))
    df = df.unionAll(spark.createDataFrame([("hot", 1e300), ("hot", -1e300), (None, 5.0)], df.schema))
    got = exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).toPandas().set_index("k")
    want = df.toPandas().groupby("k", dropna=False)["v"].quantile([0.5, 0.95]).unstack()
    assert np.allclose(got.loc["hot", ["a", "b"]].astype(float), want.loc["hot"], rtol=1e-12)
    assert np.allclose(got.loc["5", ["a", "b"]].astype(float), want.loc["5"], rtol=1e-12)
    assert len(got) == 9
    every = exact_quantiles(df, [], "v", {"m": 0.5})
    assert every.first()["m"] == pytest.approx(df.toPandas()["v"].quantile(0.5), rel=1e-12)


@pytest.mark.parametrize("values", [
    lambda r: np.exp(r.uniform(-600, 600, 30_000)),
    lambda r: np.exp(r.uniform(-40, 40, 30_000)) * r.choice([-1, 1], 30_000),
    lambda r: np.concatenate([np.zeros(500), r.normal(0, 1e-9, 20_000), [1e12, -1e12]]),
    lambda r: np.full(300, -7.5)])
def test_quantiles_of_many_orders_of_magnitude(spark, values):
    v = values(np.random.default_rng(11))
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v",
                          {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.999, "e": 1.0}).first()
    assert np.allclose(list(got), np.quantile(v, [0.0, 0.37, 0.5, 0.999, 1.0]), rtol=1e-9, atol=0)


def test_the_range_that_is_ordered_is_small(spark):
    """Values of many orders of magnitude: two rounds leave few of a key, not nearly all."""
    from radiolake.operators import common as C
    v = np.exp(np.random.default_rng(2).uniform(-200, 200, 200_000))
    sizes, whole = [], C._inside

    def seen(counted, goals, keys):
        sizes.append(whole(counted, goals, keys).groupBy("_rank").count().agg({"count": "max"}).first()[0])
        return whole(counted, goals, keys)
    C._inside = seen
    try:
        C.exact_quantile(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v", 0.5)
    finally:
        C._inside = whole
    assert sizes[0] == 200_000 and sizes[-1] <= 20


def test_weighted_median_without_weight(spark):
    df = spark.createDataFrame([("a", 3.0, 0.0), ("a", 2.0, 0.0), ("b", 1.0, 1.0)],
                               "k string, v double, w double")
    got = {r["k"]: (r["median"], r["weight"], r["n_rows"])
           for r in weighted_median(df, ["k"], "v", "w").collect()}
    assert got == {"a": (2.0, 0.0, 2), "b": (1.0, 1.0, 1)}


def test_weighted_median_is_the_lower_one(spark):
    df = spark.createDataFrame([("a", -80.0, 1.0), ("a", -90.0, 1.0), ("b", -70.0, 3.0),
                                ("b", -100.0, 2.0), ("b", -70.5, 0.5)], "k string, v double, w double")
    got = {r["k"]: (r["median"], r["weight"], r["n_rows"])
           for r in weighted_median(df, ["k"], "v", "w").collect()}
    assert got == {"a": (-90.0, 2.0, 2), "b": (-70.0, 5.5, 3)}


def test_weighted_median_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y", "z"], 3000, p=[.9, .05, .05]),
                        "v": np.round(rng.uniform(-140, -60, 3000), 1),
                        "w": rng.integers(1, 9, 3000).astype(float)})
    got = weighted_median(spark.createDataFrame(pdf), ["k"], "v", "w").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        g = g.sort_values("v")
        cum = g["w"].cumsum()
        assert got.loc[k, "median"] == g["v"][cum >= g["w"].sum() / 2].iloc[0]


def test_top_n_by(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "k string, v int")
    rows = top_n_by(df, ["k"], [F.desc("v")], 2).collect()
    assert sorted((r["k"], r["v"]) for r in rows) == [("a", 8), ("a", 9), ("b", 1)]
