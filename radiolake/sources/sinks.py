"""Writers: parsed frames for the next run, result tables, map geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_hourly(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by technology and date: later reads prune to the days and KPIs they need.

    Rows of one day gather in as many files as their volume asks for, so a big day is not
    one task's work.
    """
    out = df.withColumn("date", F.col("datetime").cast("date"))
    (out.hint("rebalance", "tech", "date").write.mode(mode).partitionBy("tech", "date")
     .parquet(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path)


def geojson_lines(df: DataFrame, ring: str = "ring") -> DataFrame:
    """One GeoJSON feature per row: the ring column is its polygon, the rest its properties."""
    props = F.struct(*[F.col(c) for c in df.columns if c != ring])
    coords = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"),
                                        geometry.alias("geometry"))).alias("value"))


def geojson_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    props = F.struct(*[F.col(c) for c in df.columns if c not in (lat, lon)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat))
                        .alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"),
                                        geometry.alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, path: str, ring: str | None = "ring",
                  mode: str = "overwrite") -> None:
    lines = geojson_lines(df, ring) if ring else geojson_points(df)
    lines.write.mode(mode).text(path)


def keep_parsed(df: DataFrame, path: str) -> DataFrame:
    """The parsed frame written once to a path that every executor reaches, and read back: later
    steps start from Parquet. The caller names the path and removes it when it is done with."""
    write_hourly(df, path)
    return df.sparkSession.read.parquet(path)


def kept(df: DataFrame, path: str) -> DataFrame:
    """Writes a table that a run reads more than once, and gives it back from there: the plan of
    what comes after starts anew."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
