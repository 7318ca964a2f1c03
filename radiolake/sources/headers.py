"""Headers of any number of files resolved by an alias table that is data, and the files read by it.

An alias table has (technology, canonical, alias, priority): technology `*` counts for every file, a
smaller priority is asked first. Headers and aliases meet on `alias_key`, so case, units and
punctuation do not matter. A file's columns are found by a map that travels with its lines, so the
plan does not grow with the number of unlike headers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radiolake.functions.text import clean_number, is_summary_row, sector_id, sector_no
from radiolake.functions.times import local_time
from radiolake.kpis import catalogue_rows
from radiolake.sources import archives
from radiolake.sources.exports import export_lines, region_filter, split_paths

ALIASES = "technology string, canonical string, alias string, priority int"
DIMS = ("datetime", "region", "site_id", "cell_id", "cell_local_id", "band", "earfcn")
# Words of headers that mean the same.
SYNONYMS = {
    "succ": "success", "successes": "success", "att": "attempt", "atts": "attempt",
    "attempts": "attempt", "req": "request", "requests": "request", "sr": "successrate",
    "ratio": "rate", "rat": "rate", "avg": "average", "ave": "average", "mean": "average",
    "thrp": "throughput", "thr": "throughput", "tput": "throughput", "util": "utilization",
    "utilisation": "utilization", "usage": "utilization", "dl": "downlink", "ul": "uplink",
    "conn": "connection", "estab": "establishment", "est": "establishment", "rel": "release",
    "abnorm": "abnormal", "ho": "handover", "hho": "handover", "vol": "volume", "num": "number",
    "cnt": "count", "pct": "percent", "perc": "percent", "nbr": "neighbor", "neighbour": "neighbor",
}
# Headers of the columns that name a row, for every technology.
IDENTITY = {
    "datetime": ("Time", "Date", "Start Time", "Period Start Time", "Begin Time", "Date Time",
                 "Result Time"),
    "region": ("Region", "Cluster", "Area", "Zone", "Sub Area", "TAC Name"),
    "site_id": ("eNodeB Name", "eNodeB", "NodeB Name", "NodeB", "BTS Name", "Site", "Site Name",
                "gNodeB Name", "ENodeb Function Name", "NE Name"),
    "cell_id": ("Cell Name", "Cell", "Cellname", "EUtranCell FDD", "EUtranCellFDD", "Cell FDD",
                "UtranCell", "GsmCell"),
    "cell_local_id": ("Cell ID", "Local Cell ID", "LocalCell Id", "CI", "Cell Identity", "PSC", "PCI"),
    "band": ("Band", "Frequency Band", "Band Indicator", "Carrier", "Sector Carrier"),
    "earfcn": ("EARFCN", "DL EARFCN", "Downlink EARFCN", "UARFCN", "ARFCN"),
}


def alias_key(col) -> Column:
    """A header as comparable words: lower case, no units, synonyms as one, no word twice in a row."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(F.lower(F.trim(c)), r"[\(\[\{].*?[\)\]\}]", " ")
    text = F.regexp_replace(F.regexp_replace(text, "%", " percent "), "[^a-z0-9]+", " ")
    pairs = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""),
                        lambda w: F.coalesce(F.try_element_at(pairs, w), w))
    once = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(
        F.try_element_at(acc, F.lit(-1)) == w, acc).otherwise(F.array_append(acc, w)))
    return F.array_join(once, " ")


def own_names(spark: SparkSession) -> DataFrame:
    """The canonical names themselves and the fixed headers of identity columns as an alias table."""
    rows = [("*", c, c, 0) for c in DIMS]
    rows += [(t, r["kpi"], r["kpi"], 0) for t in ("LTE", "UMTS", "GSM") for r in catalogue_rows(t)]
    rows += [("*", c, a, 1) for c, names in IDENTITY.items() for a in names]
    return spark.createDataFrame(rows, ALIASES)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """An alias table kept as CSV with a header line; rows without a name or an alias are left out."""
    t = spark.read.csv(path, schema=ALIASES, header=True)
    return t.filter(F.col("canonical").isNotNull() & F.col("alias").isNotNull()).fillna(
        {"technology": "*", "priority": 1})


def file_headers(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per file (path) its header: of the lines of three or more cells without a number the one with
    most identity columns, at least a time and an object (ties: the smallest text). Files without such
    a line have none."""
    cells = F.transform(F.split(F.regexp_replace("value", "^﻿", ""), ","),
                        lambda x: F.trim(F.regexp_replace(x, '"', "")))
    # most lines of data are known by a plain number, before they are taken apart
    number = F.coalesce(F.col("value").rlike(r'(^|,)\s*"?-?\d+(\.\d+)?%?"?\s*(,|$)'), F.lit(True))
    d = lines.filter(~number).select("path", cells.alias("header")).filter(
        (F.size(F.filter("header", lambda x: x != "")) >= 3)
        & ~F.exists("header", lambda x: clean_number(x).isNotNull())).distinct()
    known = aliases.filter(F.col("canonical").isin("datetime", "site_id", "cell_id")).select(
        alias_key("alias").alias("key"), "canonical").distinct()
    words = d.select("path", "header", F.explode("header").alias("cell")).filter(F.col("cell") != "")
    hits = words.withColumn("key", alias_key("cell")).join(known, "key").groupBy("path", "header").agg(
        F.collect_set("canonical").alias("of"))
    hits = hits.filter(F.array_contains("of", "datetime") & (F.size("of") >= 2))
    return hits.groupBy("path").agg(F.min(F.struct((-F.size("of")).alias("n"), "header")).alias("b")).select(
        "path", "b.header")


def resolve_headers(headers: DataFrame, aliases: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """What every column of every file is.

    `headers`: path, technology, header (array); `manual`: header, canonical and, if it has one, path
    (null: all files). Result: path, technology, position (from 1), header, canonical, method (manual,
    exact), outcome and candidates. Outcomes: `resolved`; `duplicate`, another column of the file has
    that name already (manual ones first, then the first column); `ambiguous`, aliases of one priority
    name several; `unmapped`, with the canonical names of most words in common as candidates.
    """
    h = headers.select("path", "technology", F.posexplode("header").alias("position", "header"))
    h = h.withColumn("position", F.col("position") + 1).filter(F.coalesce(F.trim("header"), F.lit("")) != "")
    h = h.withColumn("key", alias_key("header"))
    a = aliases.select(F.upper("technology").alias("t"), "canonical", alias_key("alias").alias("key"),
                       F.coalesce("priority", F.lit(1)).alias("p")).filter(F.col("key") != "")
    fits = lambda xs: F.filter(xs, lambda x: (x["t"] == "*") | (x["t"] == F.upper("technology")))
    by_key = a.groupBy("key").agg(F.collect_set(F.struct("t", "p", "canonical")).alias("of"))
    j = h.join(by_key, "key", "left").withColumn("of", fits("of"))
    first = F.array_min(F.transform("of", lambda x: x["p"]))
    j = j.withColumn("first", first).withColumn("exact", F.array_sort(F.array_distinct(F.transform(
        F.filter("of", lambda x: x["p"] == F.col("first")), lambda x: x["canonical"])))).drop("of", "first")

    # words in common, by the words: nothing meets an alias it shares no word with
    words = F.array_distinct(F.split("key", " "))
    by_word = a.select("t", "canonical", F.col("key").alias("alias"), F.size(words).alias("m"),
                       F.explode(words).alias("w")).groupBy("w").agg(
        F.collect_set(F.struct("t", "canonical", "alias", "m")).alias("near"))
    whole = ["path", "technology", "position", "header", "exact"]
    j = j.select(*whole, F.size(words).alias("n"), F.explode_outer(
        F.when(F.coalesce(F.size("exact"), F.lit(0)) < 1, words)).alias("w"))
    j = j.join(by_word, "w", "left").select(*whole, "n", F.explode_outer(fits("near")).alias("x"))
    j = j.groupBy(*whole, "n", "x").agg(F.count(F.lit(1)).alias("k"))
    j = j.withColumn("share", F.col("k") / (F.col("n") + F.col("x.m") - F.col("k")))
    j = j.groupBy(*whole, "share").agg(F.sort_array(F.collect_set("x.canonical")).alias("near"))
    j = j.groupBy(*whole).agg(F.max_by("near", "share").alias("near"))
    j = j.withColumn("by_hand", F.lit(None).cast("string"))
    if manual is not None:
        m = manual if "path" in manual.columns else manual.withColumn("path", F.lit(None).cast("string"))
        m = m.filter(F.col("canonical").isNotNull()).select(F.col("path").alias("_path"), "header",
                                                            F.col("canonical").alias("_c"))
        here = m.filter(F.col("_path").isNotNull()).groupBy(F.col("_path").alias("path"), "header").agg(
            F.min("_c").alias("_here"))
        all_files = m.filter(F.col("_path").isNull()).groupBy("header").agg(F.min("_c").alias("_all"))
        j = j.join(here, ["path", "header"], "left").join(all_files, "header", "left").withColumn(
            "by_hand", F.coalesce("_here", "_all"))
    one = F.when(F.size("exact") == 1, F.element_at("exact", 1))
    j = j.withColumn("canonical", F.coalesce("by_hand", one))
    j = j.withColumn("method", F.when(F.col("by_hand").isNotNull(), "manual").when(one.isNotNull(), "exact"))
    place = F.row_number().over(W.partitionBy("path", "canonical").orderBy(
        F.when(F.col("method") == "manual", 0).otherwise(1), "position"))
    j = j.withColumn("outcome", F.when(F.col("canonical").isNotNull(), F.when(
        place == 1, "resolved").otherwise("duplicate")).when(F.size("exact") > 1, "ambiguous")
        .otherwise("unmapped"))
    none = F.array().cast("array<string>")
    return j.select("path", "technology", "position", "header", "canonical", "method", "outcome",
                    F.when(F.col("outcome") == "ambiguous", F.col("exact")).when(
                        F.col("outcome") == "unmapped", F.coalesce("near", none)).otherwise(none)
                    .alias("candidates"))


def load_kpi_lines(lines: DataFrame, resolved: DataFrame, kpis: Sequence[str], region: str | None = None,
                   prefixes: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Text lines (path, value) of files of unlike headers as one KPI table.

    A column that a file lacks is null (identity columns: empty), numbers are cleaned, rows without a
    cell or a time and vendor totals fall out, as do lines of files that nothing was resolved of.
    `width` is the place of the last column that is read; it is looked up where it is not given.
    """
    slots = resolved.filter(F.col("outcome") == "resolved").groupBy("path", "technology").agg(
        F.map_from_entries(F.collect_list(F.struct("canonical", "position"))).alias("slots"),
        F.max("position").alias("width"))
    if width is None:
        width = slots.agg(F.max("width")).first()[0] or 1
    schema = ", ".join(f"_c{i} string" for i in range(width))
    # a generated column is made once a line, an expression would be parsed again for every field
    r = lines.join(slots, "path").select("path", "technology", "slots",
                                         F.explode(F.array(F.from_csv("value", schema))).alias("r"))
    r = r.withColumn("r", F.array(*[F.col(f"r._c{i}") for i in range(width)]))
    get = lambda c: F.try_element_at("r", F.try_element_at("slots", F.lit(c)))
    text = lambda c: F.coalesce(F.trim(get(c)), F.lit("")).alias(c)
    out = r.select("path", "technology", local_time(get("datetime")).alias("datetime"),
                   *[text(c) for c in DIMS if c != "datetime"], *[clean_number(get(k)).alias(k) for k in kpis])
    out = out.filter((F.col("cell_id") != "") & F.col("datetime").isNotNull() & ~is_summary_row("cell_id"))
    return region_filter(out.withColumn("sector_id", sector_id("site_id", sector_no("cell_id"))),
                         region, prefixes)


def read_kpi_files(spark: SparkSession, paths: Sequence[str], aliases: DataFrame, kpis: Sequence[str],
                   technology: str = "LTE", manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plain and packed files of any headers: the KPI table, and what became of every column.

    Headers come from the first 256 KiB of each file; the table needs one pass over the lines.
    """
    every = aliases.unionByName(own_names(spark))
    heads = file_headers(archives.head_rows(spark, *split_paths(paths)), every)
    resolved = resolve_headers(heads.withColumn("technology", F.lit(technology)), every, manual)
    return load_kpi_lines(export_lines(spark, paths), resolved, kpis), resolved
