"""Hourly KPI exports: profile, text and zipped CSV, wide sheets, generic KPI files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.text import (clean_number, is_summary_row, null_outside, sector_id,
                                      sector_no, site_code, zero_is_missing)
from radiolake.functions.times import epoch_seconds, local_time
from radiolake.kpis import catalogue_rows
from radiolake.sources import archives

# Header names as exports write them (lower case, single spaces).
TIME_HEADERS = ("time", "datetime", "start time", "period start time")
CELL_HEADERS = ("cell name", "cellname")
PARENT_HEADERS = ("enodeb name", "enodeb function name", "rnc", "bsc", "bsc name")
NODE_HEADERS = ("nodebname", "nodeb name", "bts name", "btsname", "bts")
OTHER_IDS = ("date", "cell fdd tdd indication", "localcell id", "local cell id", "nodeb id",
             "site name", "site id", "cellid", "cell id")
MARKS = (("3G", ("rnc", "nodebname", "nodeb name")),
         ("4G", ("enodeb name", "enodeb function name", "cell fdd tdd indication")),
         ("2G", ("bsc", "bsc name", "bts name", "btsname", "bts")))
ZERO_MISSING = ("vs ippm rtt means ms",)
ID_HEADERS = (*TIME_HEADERS, *CELL_HEADERS, *PARENT_HEADERS, *NODE_HEADERS, *OTHER_IDS)


def norm_header(name: str) -> str:
    """A header as lower-case words; a percent sign is a word."""
    text = "".join(ch if ch.isalnum() else " " for ch in name.lower().replace("%", " percent "))
    return " ".join(text.split())


def _norm_col(c):
    c = F.regexp_replace(F.lower(c), "%", " percent ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def profile_lines(lines: DataFrame) -> DataFrame:
    """Per file: technology, KPI names and first hour, from its (path, value) text lines.

    The header is the line with three or more cells of which one names an object and one a
    time; banner lines have fewer cells and data lines name nothing.
    """
    cells = F.transform(F.split(F.regexp_replace("value", "^﻿", ""), ","),
                        lambda x: F.trim(F.regexp_replace(x, '"', "")))
    d = lines.withColumn("cells", cells)
    d = d.withColumn("names", F.transform("cells", _norm_col))
    arr = lambda names: F.array(*[F.lit(n) for n in names])
    objects = arr((*CELL_HEADERS, *PARENT_HEADERS, *NODE_HEADERS))
    wide = F.size(F.filter("cells", lambda x: x != "")) >= 3
    header = wide & F.arrays_overlap("names", objects) & F.arrays_overlap(
        "names", arr((*TIME_HEADERS, "date")))
    stamp = local_time(F.element_at("cells", 1))
    g = d.groupBy("path").agg(
        F.min(F.when(header, F.struct("cells", "names"))).alias("h"),
        F.min(F.when(wide & ~header, stamp)).alias("first_time"))
    kind = F.lit("Other")
    for tech, marks in reversed(MARKS):
        kind = F.when(F.arrays_overlap("h.names", arr(marks)), tech).otherwise(kind)
    kpis = F.filter("h.cells", lambda x: (x != "") & ~_norm_col(x).isin(*ID_HEADERS))
    ok = F.col("h").isNotNull() & (F.size(kpis) > 0)
    return g.select("path", F.when(ok, kind).otherwise("unknown").alias("kind"),
                    F.when(ok, kpis).alias("kpis"), F.when(ok, F.col("h.cells")).alias("header"),
                    "first_time")


def split_paths(paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Plain files and archives."""
    zips = [p for p in paths if p.lower().endswith(".zip")]
    return [p for p in paths if not p.lower().endswith(".zip")], zips


def profile_exports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The profile of every export, plain or packed, from the first 256 KiB of each.

    Of a packed one as many packed bytes are read as that takes. Conditions on the path are met
    before anything is read.
    """
    return profile_lines(archives.head_rows(spark, *split_paths(paths)))


# Operator headers (normalised) of the canonical KPIs.
KPI_HEADERS = {
    "4g lte drop call rate with mme percent asiacell": "erab_drop_rate",
    "4g lte drop call rate with mme percent": "erab_drop_rate",
    "4g cssr percent asiacell": "call_setup_sr",
    "4g cssr percent": "call_setup_sr",
    "e rab setup success rate voip percent": "volte_erab_setup_sr",
    "volte completion rate percent npm": "volte_completion_pct",
    "4g data volume gb": "total_traffic_gb",
    "lte availability percent ab": "cell_avail_pct",
    "lte availability percent": "cell_avail_pct",
    "4g cell level availability chen": "cell_avail_pct",
    "hw dl prb avg utilization percent": "dl_prb_util",
    "hw ul prb avg utilization percent": "ul_prb_util",
    "downlink prb utilization rate percent": "dl_prb_util",
    "uplink prb utilization rate percent": "ul_prb_util",
    "4g dl user throughput mbps asiacell": "dl_user_thr_mbps",
    "4g dl user throughput mbps": "dl_user_thr_mbps",
    "4g ul user throughput mbps asiacell": "ul_user_thr_mbps",
    "4g ul user throughput mbps": "ul_user_thr_mbps",
    "outgoing ho exec success rate percent percent asiacell": "ho_sr",
    "outgoing ho exec success rate percent asiacell": "ho_sr",
    "outgoing ho exec success rate percent": "ho_sr",
    "inter frequency handover out success rate percent": "inter_freq_ho_sr",
    "intra frequency handover out success rate percent": "intra_freq_ho_sr",
    "srvcc ho success rate huawei npm": "srvcc_ho_sr",
    "l traffic user avg": "rrc_conn_users_avg",
    "l ul interference avg dbm": "ul_rssi_dbm",
    "cs fallback success rate 4g side only asiacell": "csfb_sr",
    "l rrc setupfail noreply": "rrc_setupfail_noreply",
    "l rrc setupfail rej": "rrc_setupfail_rej",
    "l rrc setupfail resfail": "rrc_setupfail_resfail",
    "l e rab abnormrel radio": "erab_abnorm_rel_radio",
    "l e rab abnormrel mme": "erab_abnorm_rel_mme",
    "l e rab abnormrel hofailure": "erab_abnorm_rel_ho",
    "3g availability ab": "cell_avail_pct",
    "3g availability": "cell_avail_pct",
    "vs ippm rtt means ms": "ipmm_rtt_ms",
    "vs meanrtwp dbm": "ul_rtwp_dbm",
    "vs rscgroup flowctrol dl dropnum": "dl_flowctrl_drops",
}
# The levels that a KPI can plausibly have.
PLAUSIBLE = {"ul_rssi_dbm": (-150.0, -60.0)}


def _hourly_fields(columns: dict[str, Column], kpis: Sequence[str], tech: str | None,
                   kpi_headers: dict[str, str]) -> tuple[list[Column], Column]:
    """The fields of the hourly frame from raw text columns by header, and whether a row counts.

    A wanted KPI is a raw header or a canonical name; of several headers of one KPI the first
    column wins, and a KPI without a column is null.
    """
    names: dict[str, Column] = {}
    for header, c in columns.items():
        names.setdefault(norm_header(header), c)
    first = lambda options: next((names[n] for n in options if n in names), None)
    none = F.lit(None).cast("string")
    or_none = lambda c: none if c is None else c
    time, date = first(TIME_HEADERS), names.get("date")
    stamp = F.lit("") if time is None else time
    if date is not None:
        stamp = F.concat_ws(" ", date, stamp)
    cell, parent, node = first(CELL_HEADERS), first(PARENT_HEADERS), first(NODE_HEADERS)
    obj = F.trim(next((c for c in (cell, node, parent) if c is not None), none))
    local = first(("localcell id", "local cell id"))
    at, site = local_time(stamp), site_code(obj)
    values = []
    for k in kpis:
        raw = norm_header(k)
        headers = [n for n in names if n == raw or kpi_headers.get(n) == k]
        v = clean_number(names[headers[0]]) if headers else F.lit(None).cast("double")
        name = kpi_headers.get(raw, k)
        if headers and headers[0] in ZERO_MISSING:
            v = zero_is_missing(v)
        if name in PLAUSIBLE:
            v = null_outside(v, *PLAUSIBLE[name])
        values.append(v.alias(k))
    fields = [at.alias("datetime"), obj.alias("object"), site.alias("site_id"),
              sector_id(site, sector_no(obj, local)).alias("sector_id"),
              F.substring(site, 1, 3).alias("prefix"),
              F.lit("site" if cell is None else "cell").alias("level"),
              or_none(names.get("cell fdd tdd indication")).alias("duplex"),
              or_none(parent).alias("parent"), F.lit(tech).cast("string").alias("tech"), *values]
    return fields, at.isNotNull() & (F.coalesce(obj, F.lit("")) != "")


def canonical_hourly(raw: DataFrame, kpis: Sequence[str], tech: str | None = None,
                     kpi_headers: dict[str, str] = KPI_HEADERS) -> DataFrame:
    """Raw all-text export rows, named as the operator names them, to the hourly frame.

    Banner and header rows fall out because their time does not parse. The first column wins
    where two headers mean the same.
    """
    fields, counts = _hourly_fields({c: F.col(f"`{c}`") for c in raw.columns}, kpis, tech,
                                    kpi_headers)
    return raw.filter(counts).select(*fields)


def export_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Text lines (path, value) of CSV files and of the text entries of zip archives."""
    plain, zips = split_paths(paths)
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select(
            archives.plain_path(F.col("_metadata.file_path")).alias("path"), "value"))
    if zips:
        parts.append(archives.entry_lines(archives.zip_entries(spark, zips)))
    if not parts:
        raise ValueError("no files are named")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_hourly(spark: SparkSession, paths: Sequence[str], kpis: Sequence[str],
                kpi_headers: dict[str, str] = KPI_HEADERS) -> DataFrame:
    """CSV and zipped exports of any mix of headers as one hourly frame with the wanted KPIs,
    named canonically or as the files name them."""
    return hourly_from_lines(export_lines(spark, paths), kpis, kpi_headers,
                             profile_exports(spark, paths))


def hourly_from_lines(lines: DataFrame, kpis: Sequence[str],
                      kpi_headers: dict[str, str] = KPI_HEADERS,
                      profile: DataFrame | None = None) -> DataFrame:
    """The hourly frame of the (path, value) text lines of any number of exports.

    Only the distinct headers come to the driver. A file's header reaches its lines by a join on
    the path, and all files are parsed in one pass, each line by the columns of its own header.
    `profile` has the headers; without it the lines are read once more for them.
    """
    prof = (profile_lines(lines) if profile is None else profile).filter(
        F.col("kind") != "unknown")
    heads = prof.select("header", "kind").distinct().orderBy("kind", "header").collect()
    if not heads:
        raise ValueError("none of the files is an hourly KPI export")
    number = F.lit(None).cast("int")
    for i, h in enumerate(heads):
        same = (F.col("kind") == h["kind"]) & (F.col("header") == F.array(
            *[F.lit(x) for x in h["header"]]))
        number = F.when(same, i).otherwise(number)
    width = max(len(h["header"]) for h in heads)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    rows = lines.join(prof.select("path", number.alias("_head")), "path").select(
        "_head", F.from_csv("value", schema).alias("_r"))
    out = None
    for i, h in enumerate(heads):
        columns = {name or f"_blank{k}": F.col(f"_r._c{k}") for k, name in enumerate(h["header"])}
        fields, counts = _hourly_fields(columns, kpis, h["kind"], kpi_headers)
        row = F.when((F.col("_head") == i) & counts, F.struct(*fields))
        out = row if out is None else F.coalesce(out, row)
    return rows.select(out.alias("_x")).filter(F.col("_x").isNotNull()).select("_x.*")


def lines_to_rows(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """Text lines of one header as all-text columns."""
    cols = [h or f"_blank{i}" for i, h in enumerate(header)]
    schema = ", ".join(f"`{c}` string" for c in cols)
    parsed = lines.select(F.from_csv("value", schema).alias("r"))
    return parsed.select(*[F.col(f"r.`{c}`").alias(c) for c in cols])


def unpivot_hours(sheets: dict[str, DataFrame], day: str | None = None) -> DataFrame:
    """One wide sheet per KPI (cell_id, duplex, then a column per hour) as one long frame,
    the sheets merged on cell, duplex and hour; without `day` the sheets have a column of it."""
    parts = None
    for kpi, df in sheets.items():
        hours = [c for c in df.columns if ":" in c]
        cells = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"`{h}`").cast("string").alias("v"))
                          for h in hours])
        date = F.lit(day) if day else F.col("day").cast("string")
        long = df.select("cell_id", "duplex", date.alias("_d"), F.explode(cells).alias("x")).select(
            "cell_id", "duplex", local_time(F.concat_ws(" ", "_d", "x.h")).alias("datetime"),
            F.lit(kpi).alias("kpi"), clean_number("x.v").alias("_v"))
        parts = long if parts is None else parts.unionByName(long)
    return parts.groupBy("cell_id", "duplex", "datetime").agg(
        *[F.max(F.when(F.col("kpi") == k, F.col("_v"))).alias(k) for k in sheets])


def region_filter(df: DataFrame, region: str | None, prefixes: Sequence[str] = ()) -> DataFrame:
    """Id prefixes, else the region's text, else the site's text when no region matches."""
    if prefixes:
        return df.filter(F.upper(F.substring("site_id", 1, 3)).isin(*prefixes))
    if not region:
        return df
    by_region = F.coalesce(F.lower("region").contains(region.lower()), F.lit(False))
    by_site = F.coalesce(F.lower("site_id").contains(region.lower()), F.lit(False))
    any_row = df.agg(F.coalesce(F.max(by_region), F.lit(False)).alias("_any"))
    d = df.join(F.broadcast(any_row))
    return d.filter(F.when(F.col("_any"), by_region).otherwise(by_site)).drop("_any")


def granularity(df: DataFrame, time: str = "datetime") -> DataFrame:
    """hour when there is more than one hour or minute and over 1.5 rows per day, else day."""
    t = F.col(time)
    secs = epoch_seconds(time)
    g = df.filter(t.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), (F.max(secs) - F.min(secs)).alias("span"),
        (F.min(F.hour(t)) != F.max(F.hour(t))).alias("h"),
        (F.min(F.minute(t)) != F.max(F.minute(t))).alias("m"))
    per_day = F.col("n") / F.greatest(F.col("span") / 86400.0, F.lit(1.0))
    return g.select(F.when((F.col("h") | F.col("m")) & (per_day > 1.5), "hour").otherwise("day")
                    .alias("granularity"))


def load_kpi(raw: DataFrame, aliases: dict[str, str], technology: str = "LTE",
             region: str | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """A generic KPI file: headers renamed by the alias table (first wins), numbers cleaned,
    dates read year-first or day-first, vendor totals dropped, region kept."""
    cols, seen = [], set()
    for c in raw.columns:
        name = aliases.get(norm_header(c))
        if name and name not in seen:
            seen.add(name)
            cols.append(F.col(f"`{c}`").alias(name))
    d = raw.select(*cols)
    d = d.withColumn("datetime", local_time("datetime"))
    for c in ("region", "site_id", "cell_id"):
        d = d.withColumn(c, F.coalesce(F.trim(c), F.lit("")) if c in seen else F.lit(""))
    kpis = {r["kpi"] for r in catalogue_rows(technology)} & seen
    d = d.withColumns({k: clean_number(k) for k in sorted(kpis)})
    d = d.filter((F.col("cell_id") != "") & ~is_summary_row("cell_id"))
    d = d.withColumn("technology", F.lit(technology)).withColumn(
        "sector_id", sector_id("site_id", sector_no("cell_id")))
    return region_filter(d, region, prefixes)


def describe_input(df: DataFrame, time: str = "datetime", obj: str = "object",
                   site: str = "site_id") -> DataFrame:
    """One row: rows, objects, sites, first and last hour, rows without a time or site."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(obj).alias("objects"),
                  F.count_distinct(site).alias("sites"), F.min(time).alias("first_time"),
                  F.max(time).alias("last_time"),
                  F.count_if(F.col(time).isNull()).alias("no_time"),
                  F.count_if(F.col(site).isNull() | (F.col(site) == "")).alias("no_site"))
