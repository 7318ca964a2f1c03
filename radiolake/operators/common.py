"""Shared DataFrame helpers: scalars, order-free firsts, exact quantiles of hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """`df` with the columns of a global aggregate, which always is exactly one row."""
    return df.join(F.broadcast(one_row))


def unsent(df: DataFrame) -> DataFrame:
    """`df`, for a join that broadcasts neither side.

    The planner takes exploded rows for as few as they came from, and would send millions of them
    through the driver; once it has chosen so, the measured size does not change it.
    """
    return df.hint("merge")


def first_by(value, *order) -> Column:
    """The value (a column name or a list of them, as a struct) of the row first in `order`."""
    v = F.struct(*[col(c) for c in value]) if isinstance(value, (list, tuple)) else col(value)
    return F.min_by(v, F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)]))


def top_n_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
             rank: str | None = None) -> DataFrame:
    """The first `n` rows of every key. Spark keeps at most n rows per key and map task
    before the shuffle, so a hot key does not travel whole."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
           n: int | None = None) -> DataFrame:
    """Rows with their `rank` within the key, all of them or the first `n`."""
    if n is not None:
        return top_n_by(df, keys, order, n, rank="rank")
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


BINS = 4096


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float,
                   out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantile per key (or over all rows), safe for a hot key."""
    return exact_quantiles(df, keys, value, {out: q})


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    out: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key (or over all rows): key, a column for each.

    Equal values collapse first, with partial counts. The distinct values of a key then fall into
    BINS bins between its least and largest value that grow with the distance from 0, so that values
    of many orders of magnitude spread, too; the bin that holds a wanted rank is cut again, into equal
    ones between the least and largest value in it, and only what is left of it is ordered. Every step
    is exact, so nothing depends on the number of rows, and no step orders a whole key.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    size = F.when(F.col("_v") != 0, F.ln(F.abs("_v")))
    whole = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"),
                                       F.max("_v").alias("_hi"),
                                       F.coalesce(F.exp(F.avg(size)), F.lit(1.0)).alias("_s"))
    # the two neighbouring ranks of each quantile (from 0), and the rows below the open range
    ranks = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(float(q)).alias("_q"))
                      for name, q in out.items()])
    goals = whole.withColumn("_g", F.explode(ranks)).select("*", "_g.*").drop("_g")
    position = (F.col("_total") - 1) * F.col("_q")
    goals = goals.withColumn("_rank", F.explode(F.array_distinct(F.array(
        F.floor(position), F.least(F.floor(position) + 1, F.col("_total") - 1))))).select(
        *keys, "_name", (position - F.floor(position)).alias("_f"), "_rank", "_lo", "_hi", "_s",
        F.lit(0).cast("bigint").alias("_below"))
    # the logarithm is never decreasing as computed either, so bins keep the order of the values
    spread = lambda v: F.signum(v) * F.log1p(F.abs(v) / F.col("_s"))
    for scale in (spread, lambda v: v):
        goals = _narrowed(goals, _inside(counted, goals, keys), keys, scale)
    left = _inside(counted, goals, keys)
    w = W.partitionBy(*keys, "_name", "_rank").orderBy("_v")
    left = left.withColumn("_cum", F.col("_below") + F.sum("_n").over(w))
    hit = left.filter((F.col("_cum") > F.col("_rank"))
                      & (F.col("_cum") - F.col("_n") <= F.col("_rank")))
    # the lower rank's value and the upper one's; one row where both are the same rank
    two = hit.groupBy(*keys, "_name").agg(
        F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"),
        F.first("_f").alias("_f"))
    v = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return two.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, v)).alias(name)
                                    for name in out])


def _inside(counted: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct values in the open range of each goal."""
    c = counted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_v", "_n")
    cond = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # without keys the goals are two rows a quantile
    return c.join(goals if keys else F.broadcast(goals), cond).drop(*[f"_k_{k}" for k in keys])


def _narrowed(goals: DataFrame, inside: DataFrame, keys: Sequence[str], scale) -> DataFrame:
    """Each goal with the range of the bin, of equal ones on `scale`, that holds its rank."""
    v, lo, hi = (scale(F.col(c)) for c in ("_v", "_lo", "_hi"))
    width = (hi - lo) / BINS
    place = F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(BINS - 1))).otherwise(0)
    goal = [*keys, "_name", "_f", "_rank", "_below", "_s"]
    bins = inside.groupBy(*goal, place.alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # at most BINS rows a goal
    w = W.partitionBy(*keys, "_name", "_rank").orderBy("_bin")
    bins = bins.withColumn("_cum", F.col("_below") + F.sum("_n").over(w))
    bins = bins.filter((F.col("_cum") > F.col("_rank"))
                       & (F.col("_cum") - F.col("_n") <= F.col("_rank")))
    return bins.select(*keys, "_name", "_f", "_rank", "_lo", "_hi", "_s",
                       (F.col("_cum") - F.col("_n")).alias("_below"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median per key with the total weight and the row count.

    Equal (key, value) pairs collapse in the first aggregation. A key's values are then
    narrowed to the one unit-wide band that holds the half weight (the bands of a key are
    few: the value range is bounded), and only that band is ordered value by value. A key
    without any weight has its least value and weight 0.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_band", F.floor("_v"))
    by_band = cells.groupBy(*keys, "_band").agg(F.sum("_w").alias("_bw"),
                                                F.sum("_n").alias("n_rows"))
    half = half_bands(by_band, keys, ["n_rows"])
    return median_in_band(cells.join(half, [*keys, "_band"]), keys, ["n_rows"])


def half_bands(by_band: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Of the weights _bw by key and _band, the band that holds half of the key's weight: the weight
    before it, the key's weight and the key's sums of the columns `totals`."""
    run = W.partitionBy(*keys).orderBy("_band")
    whole = W.partitionBy(*keys)
    by_band = by_band.withColumns({
        "_cum": F.sum("_bw").over(run), "weight": F.sum("_bw").over(whole),
        "_nth": F.row_number().over(run), **{c: F.sum(c).over(whole) for c in totals}})
    crossing = ((F.col("_cum") >= F.col("weight") / 2)
                & (F.col("_cum") - F.col("_bw") < F.col("weight") / 2))
    half = by_band.filter(crossing | ((F.col("weight") == 0) & (F.col("_nth") == 1)))
    return half.select(*keys, "_band", (F.col("_cum") - F.col("_bw")).alias("_before"),
                       "weight", *totals)


def median_in_band(inside: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """The lower weighted median per key from the values _v and weights _w of its half band."""
    inside = inside.withColumn("_cum", F.col("_before") + F.sum("_w").over(
        W.partitionBy(*keys).orderBy("_v")))
    return inside.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_cum") >= F.col("weight") / 2, F.col("_v"))),
                   F.max("_v")).alias("median"),
        F.max("weight").alias("weight"), *[F.max(c).alias(c) for c in totals])
