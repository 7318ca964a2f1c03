"""Measured-coverage grids: lattice, weighted medians, pyramid, statistics, look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.geo import COVERED_DBM, RSRP_NAMES, rsrp_class
from radiolake.operators.common import (half_bands, median_in_band, unsent, weighted_median,
                                         with_scalars)
from radiolake.operators.spatial import radius_join

DEFAULT_STEP = 0.00045


def _steps(df: DataFrame) -> DataFrame:
    """Median gap between neighbouring distinct coordinates of both axes, as one row.

    Gaps that count are under 0.01 degree, so a coordinate's neighbour below lies in its own
    hundredth-degree strip or in the one before: every coordinate enters both strips, and no
    strip holds more than twenty thousand.
    """
    axes = F.array(F.struct(F.lit("lat").alias("axis"), F.round("lat", 6).alias("v")),
                   F.struct(F.lit("lon").alias("axis"), F.round("lon", 6).alias("v")))
    v = df.select(F.explode(axes).alias("x")).select("x.*").distinct()
    own = F.floor(F.col("v") / 0.01).cast("bigint")
    v = v.withColumn("own", own).withColumn(
        "strip", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = W.partitionBy("axis", "strip").orderBy("v")
    gap = v.withColumn("gap", F.col("v") - F.lag("v").over(w)).filter(
        (F.col("strip") == F.col("own")) & (F.col("gap") > 1e-5) & (F.col("gap") < 0.01))
    # gaps are multiples of 1e-6 below 0.01: at most ten thousand distinct values are left
    sizes = gap.groupBy("axis", F.round("gap", 9).alias("gap")).agg(F.count(F.lit(1)).alias("n"))

    def step(axis: str) -> Column:
        m = F.percentile(F.when(F.col("axis") == axis, F.col("gap")), F.lit(0.5), F.col("n"))
        return F.when(m.between(0.0001, 0.01), m).otherwise(DEFAULT_STEP)

    return sizes.agg(step("lat").alias("step_lat"), step("lon").alias("step_lon"))


def _origin(v: str, step: str, out: str) -> tuple[list[Column], Column]:
    """Aggregates of the circular mean offset, and the origin built from them."""
    angle = F.lit(2 * math.pi) * F.pmod(F.col(v) / F.col(step), F.lit(1.0))
    aggs = [F.avg(F.sin(angle)).alias(f"{out}_s"), F.avg(F.cos(angle)).alias(f"{out}_c"),
            F.min(v).alias(f"{out}_min")]
    off = F.pmod(F.atan2(F.col(f"{out}_s"), F.col(f"{out}_c")) / (2 * math.pi), F.lit(1.0))
    m = F.col(f"{out}_min") / F.col(step)
    return aggs, (F.bround(m - off, 0) + off - 0.5) * F.col(step)


def grid_spec(df: DataFrame) -> DataFrame:
    """One row: step and lattice origin of a coverage export in both directions."""
    d = with_scalars(df.select("lat", "lon"), _steps(df))
    a_lat, o_lat = _origin("lat", "step_lat", "lat0")
    a_lon, o_lon = _origin("lon", "step_lon", "lon0")
    g = d.agg(*a_lat, *a_lon, F.max("step_lat").alias("step_lat"),
              F.max("step_lon").alias("step_lon"))
    return g.select("step_lat", "step_lon", o_lat.alias("lat0"), o_lon.alias("lon0"))


def with_cells(df: DataFrame, spec: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    d = with_scalars(df, spec)
    return d.withColumn("iy", F.floor((F.col(lat) - F.col("lat0")) / F.col("step_lat"))).withColumn(
        "ix", F.floor((F.col(lon) - F.col("lon0")) / F.col("step_lon"))).drop(
        "step_lat", "step_lon", "lat0", "lon0")


def build_grid(df: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """The native grid: MR-weighted median RSRP, MRs and measured points per cell."""
    cells = with_cells(df, spec if spec is not None else grid_spec(df))
    return weighted_median(cells, ["iy", "ix"], "rsrp", "mr").select(
        "iy", "ix", F.col("median").alias("rsrp"), F.col("weight").alias("mr"),
        F.col("n_rows").alias("points"))


def grid_pyramid(df: DataFrame, levels: int, spec: DataFrame | None = None) -> DataFrame:
    """Levels 0 to levels - 1 of 2^k native cells, each with its own weighted median of the
    measurements.

    A level is built from the (cell, value, weight) table of the level below, which shrinks
    four times or more on the way, so a measurement is not copied to every level.
    """
    cells = with_cells(df, spec if spec is not None else grid_spec(df)).select(
        F.col("iy").alias("cy"), F.col("ix").alias("cx"), "rsrp", "mr")
    out = None
    for level in range(levels):
        if level:
            half = lambda c: F.floor(F.col(c) / 2).cast("bigint").alias(c)
            cells = cells.select(half("cy"), half("cx"), "rsrp", "mr")
        cells = cells.groupBy("cy", "cx", "rsrp").agg(F.sum("mr").alias("mr"))
        own = weighted_median(cells, ["cy", "cx"], "rsrp", "mr").select(
            F.lit(level).alias("level"), "cy", "cx", F.col("median").alias("rsrp"),
            F.col("weight").alias("mr"))
        out = own if out is None else out.unionByName(own)
    return out


def pyramid_levels(grid: DataFrame) -> int:
    """Levels until one cell holds the whole grid (one small aggregate is run)."""
    m = grid.agg(F.greatest(F.max("iy"), F.max("ix")), F.least(F.min("iy"), F.min("ix"))).first()
    if m[0] is None:
        return 1
    level, lo, hi = 1, m[1], m[0]
    while lo != hi and (lo, hi) != (-1, 0):
        lo, hi, level = lo // 2, hi // 2, level + 1
    return level


def coverage_stats(grid: DataFrame) -> DataFrame:
    """Per RSRP class: grids and share of MRs; with the overall covered share."""
    g = grid.withColumn("cls", rsrp_class("rsrp")).groupBy("cls").agg(
        F.count(F.lit(1)).alias("grids"), F.sum("mr").alias("mrs"),
        F.sum(F.when(F.col("rsrp") >= COVERED_DBM, F.col("mr")).otherwise(0.0)).alias("cov"))
    tot = g.agg(F.sum("mrs").alias("all_mrs"), F.sum("cov").alias("all_cov"))
    names = F.array(*[F.lit(n) for n in RSRP_NAMES])
    g = with_scalars(g, tot)
    return g.select(F.element_at(names, F.col("cls") + 1).alias("rsrp_class"), "grids",
                    (100.0 * F.col("mrs") / F.col("all_mrs")).alias("mr_pct"),
                    (100.0 * F.col("all_cov") / F.col("all_mrs")).alias("covered_pct"))


def at_cell(points: DataFrame, df: DataFrame, lat: str = "latitude", lon: str = "longitude",
            spec: DataFrame | None = None) -> DataFrame:
    """Each point with the RSRP, MRs and points of the grid cell it falls in (null if none)."""
    spec = spec if spec is not None else grid_spec(df)
    grid = build_grid(df, spec)
    return with_cells(points, spec, lat, lon).join(grid, ["iy", "ix"], "left").drop("iy", "ix")


def area_rsrp(sites: DataFrame, df: DataFrame, metres: float = 500.0,
              weak: float = COVERED_DBM) -> DataFrame:
    """Around each site: MR-weighted median RSRP and the share of MRs below the weak line.

    Rows of the grid at one position are one spot with its weights by unit band, sites at one position
    are one place. Pairs of a place and a spot meet the bands first, and then the values of the one
    band that holds half of the place's weight, so no place meets all rows around it.
    """
    cells = df.groupBy(F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"),
                       F.col("rsrp").alias("_v")).agg(
        F.sum("mr").alias("_w"), F.count(F.lit(1)).alias("_n")).withColumn("_band", F.floor("_v"))
    spot = ["o_lat", "o_lon"]
    by_spot = cells.groupBy(*spot, "_band").agg(
        F.sum("_w").alias("_w"), F.sum("_n").alias("_n"),
        F.sum(F.when(F.col("_v") < weak, F.col("_w")).otherwise(0.0)).alias("_weak"))
    # a site that comes more than once has all its positions
    ids = sites.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).groupBy(
        "site_id").agg(F.sort_array(F.collect_list(F.struct("latitude", "longitude"))).alias("_at"))
    places = ids.select("_at").distinct().withColumn("_p", F.explode("_at")).select("_at", "_p.*")
    spots = cells.select(F.col("o_lat").alias("latitude"),
                         F.col("o_lon").alias("longitude")).distinct()
    pairs = radius_join(places, spots, metres, ["_at"], []).select("_at", *spot)
    bands = unsent(pairs).join(by_spot, spot).groupBy("_at", "_band").agg(
        F.sum("_w").alias("_bw"), F.sum("_n").alias("grids"), F.sum("_weak").alias("weak_mr"))
    totals = ["grids", "weak_mr"]
    inside = unsent(pairs.join(half_bands(bands, ["_at"], totals), "_at")).join(
        cells.drop("_n"), [*spot, "_band"])
    same = ["_at", "_v", "_before", "weight", *totals]
    med = median_in_band(inside.groupBy(*same).agg(F.sum("_w").alias("_w")), ["_at"], totals)
    return ids.filter(F.col("site_id").isNotNull()).join(med, "_at").select(
        "site_id", F.col("median").alias("median_rsrp"), F.col("weight").alias("mrs"), "grids",
        (100.0 * F.col("weak_mr") / F.col("weight")).alias("weak_pct"))
