"""Site placemarks of map archives as cell, sector and site tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.text import map_band, site_code, tilt_deg
from radiolake.sources import archives

# The styles of sector placemarks and the status that each stands for.
STATUS = {"onair": "On Air", "planned": "Planned", "offair": "Off Air"}
TECHNOLOGIES = ("2G", "3G", "4G")
# The lines of a sector's text.
SITE_LINE = r"(?i)site code:\s*([a-z0-9]+).*?sector:\s*(\d+).*?azimuth:\s*(-?\d+)"
HEIGHT_LINE = r"(?i)height:\s*([\d.]+)\s*m.*?status:\s*(.+)$"
RET_LINE = r"(?i)^band\s+(\S+)\s*:\s*([\d.]+)"
CELL_LINE = r"^[A-Za-z0-9_.\-/]+\s*:\s*.*="
LINE = "struct<technology:string,line:string>"


def _hit(col, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def placemark_bodies(docs: DataFrame) -> DataFrame:
    """(path, body) of the placemarks of whole documents (path, kml)."""
    blocks = F.regexp_extract_all("kml", F.lit(r"(?s)<Placemark\b[^>]*>(.*?)</Placemark>"), 1)
    return docs.select("path", F.explode(blocks).alias("body"))


def map_placemarks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path!entry, body) of the placemarks in map archives, entry by entry."""
    return archives.entry_placemarks(archives.zip_entries(spark, paths))


def _lines(body: str) -> Column:
    """The lines of a placemark's text, trimmed, without empty ones."""
    raw = F.coalesce(_hit(body, r"(?s)<!\[CDATA\[(.*?)\]\]>"),
                     _hit(body, r"(?s)<description>(.*?)</description>"))
    text = F.regexp_replace(raw, "(?i)<br/?>|</p>", "\n")
    text = F.regexp_replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), "<[^>]+>|&deg;|°", "")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _last(lines, test) -> Column:
    return F.try_element_at(F.filter(lines, test), F.lit(-1))


def _sections(lines) -> Column:
    """(technology, line) of the cell lines and RET lines in order.

    A line that opens a section ("2G cells", "RET actual tilt") names it for those below. A line of
    values without a name goes on with the cell above it in its section.
    """
    def step(acc, line):
        opened = F.coalesce(
            F.nullif(F.upper(F.regexp_extract(line, r"(?i)^([234]g)\b.*cell", 1)), F.lit("")),
            F.when(F.lower(line).startswith("ret actual tilt"), "RET"))
        tech, out = acc["tech"], acc["out"]
        entry = F.array(F.struct(tech.alias("technology"), line.alias("line")))
        last = F.try_element_at(out, F.lit(-1))
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(
            tech.alias("technology"), F.concat_ws(", ", last["line"], line).alias("line"))))
        cell = tech.isin(*TECHNOLOGIES)
        more = (F.when(opened.isNotNull(), out)
                .when(cell & line.rlike(CELL_LINE), F.concat(out, entry))
                .when(cell & line.contains("=") & (last["technology"] == tech), longer)
                .when((tech == "RET") & line.rlike(RET_LINE), F.concat(out, entry))
                .otherwise(out))
        return F.struct(F.coalesce(opened, tech).alias("tech"), more.alias("out"))

    start = F.struct(F.lit("").alias("tech"), F.array().cast(f"array<{LINE}>").alias("out"))
    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def _values(line) -> Column:
    """The key=value parts behind a cell's name; commas in brackets part nothing."""
    parts = F.split(F.regexp_replace(line, r"^[^:=]+:\s*", ""), r",\s*(?![^()]*\))")
    return F.transform(F.filter(parts, lambda x: x.contains("=")), lambda x: F.struct(
        F.lower(F.trim(F.regexp_extract(x, r"(?s)^([^=]*)=", 1))).alias("k"),
        F.trim(F.regexp_extract(x, r"(?s)=(.*)$", 1)).alias("v")))


def _get(kv, key: str) -> Column:
    """The value of a key; the last one counts."""
    return F.try_element_at(F.filter(kv, lambda x: x["k"] == key), F.lit(-1))["v"]


def _number(kv, key: str) -> Column:
    return F.regexp_extract(_get(kv, key), r"(-?\d+\.?\d*)", 1).try_cast("double")


def _tilt(tech, kv) -> Column:
    return (F.when(tech == "2G", tilt_deg(_number(kv, "electrical downtilt")))
            .when(tech == "3G", tilt_deg(_number(kv, "tilt")))
            .otherwise(_number(kv, "max ret") / 10))


def _mean(values) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(F.size(values), F.lit(0))


def _median(values) -> Column:
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.try_element_at(s, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def sector_rows(bodies: DataFrame) -> DataFrame:
    """One row per sector placemark with its cells (technology, name, values, tilt) as an array.

    Towers and labels have another style and fall out, as do texts that name no site.
    """
    p = bodies.withColumn("air", F.lower(_hit("body", r"<styleUrl>#?([^<]+)</styleUrl>")))
    p = p.where(F.col("air").isin(*STATUS)).withColumn("lines", _lines("body"))
    site_line = _last("lines", lambda x: x.rlike(SITE_LINE))
    height_line = _last("lines", lambda x: x.rlike(HEIGHT_LINE))
    name = F.try_element_at(F.filter("lines", lambda x: ~x.rlike(SITE_LINE) & ~x.rlike(HEIGHT_LINE)
                                     & ~F.lower(x).contains("cell")
                                     & ~F.lower(x).contains("site code")), F.lit(1))
    style = F.lit(None).cast("string")
    for k, v in STATUS.items():
        style = F.when(F.col("air") == k, v).otherwise(style)
    point = r"<coordinates>\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)"
    s = p.select(
        "path", "air", _sections("lines").alias("parts"), name.alias("site_name"),
        F.coalesce(F.upper(_hit(site_line, SITE_LINE)), F.nullif(site_code(name), F.lit("")))
        .alias("site_id"),
        F.coalesce(_hit(site_line, SITE_LINE, 2).cast("int"), F.lit(0)).alias("sector"),
        _hit(site_line, SITE_LINE, 3).cast("double").alias("azimuth_deg"),
        _hit(height_line, HEIGHT_LINE).try_cast("double").alias("antenna_height_m"),
        F.coalesce(F.initcap(F.trim(_hit(height_line, HEIGHT_LINE, 2))), style).alias("status"),
        _hit("body", point, 2).cast("double").alias("latitude"),
        _hit("body", point).cast("double").alias("longitude"))
    s = s.where("site_id is not null").withColumn(
        "sector_id", F.concat("site_id", F.lit("-S"), F.col("sector").cast("string")))
    cells = F.transform(F.filter("parts", lambda x: x["technology"] != "RET"), lambda x: F.struct(
        x["technology"].alias("technology"),
        F.regexp_extract(x["line"], r"^([A-Za-z0-9_.\-/]+)\s*:", 1).alias("name"),
        _values(x["line"]).alias("kv")))
    s = s.withColumn("cells", cells)
    tilted = F.transform("cells", lambda c: F.struct(
        c["technology"].alias("technology"), c["name"].alias("name"), c["kv"].alias("kv"),
        _tilt(c["technology"], c["kv"]).alias("tilt")))
    rets = F.transform(F.filter("parts", lambda x: x["technology"] == "RET"), lambda x: F.struct(
        F.upper(F.regexp_extract(x["line"], RET_LINE, 1)).alias("band"),
        F.regexp_extract(x["line"], RET_LINE, 2).cast("double").alias("ret")))
    return s.withColumn("cells", tilted).withColumn("rets", rets).drop("parts")


def sectors_of(rows: DataFrame) -> DataFrame:
    """Sectors: position, status, tilt (median of the cells', else the read RET), RETs, counts."""
    def ret(band: str) -> Column:
        own = F.filter("rets", lambda x: x["band"] == band)
        return _mean(F.transform(own, lambda x: x["ret"])) / 10

    bands = F.array_distinct(F.transform("rets", lambda x: x["band"]))
    per_band = F.transform(bands, lambda b: _mean(F.transform(
        F.filter("rets", lambda x: x["band"] == b), lambda x: x["ret"])) / 10)
    tilts = F.filter(F.transform("cells", lambda c: c["tilt"]), lambda t: t.isNotNull())
    d = rows.withColumn("ret_actual_deg", _mean(per_band)).withColumn("_tilt", _median(tilts))
    count = lambda t: F.size(F.filter("cells", lambda c: c["technology"] == t))
    tilt = F.coalesce("_tilt", "ret_actual_deg")
    return d.select(
        "path", "site_id", "site_name", "sector", "sector_id", "latitude", "longitude",
        "azimuth_deg", "antenna_height_m", tilt.alias("elec_tilt_deg"),
        F.coalesce("ret_actual_deg", tilt).alias("ret_deg"), "status", "air",
        *[count(t).alias(f"n_{t.lower()}") for t in TECHNOLOGIES],
        F.size("cells").alias("n_cells"), ret("U900").alias("ret_u900_deg"),
        ret("U2100").alias("ret_u2100_deg"), "ret_actual_deg")


def cells_of(rows: DataFrame) -> DataFrame:
    """Cells with their values; a cell without a tilt of its own takes the sector's RET."""
    tilts = F.filter(F.transform("cells", lambda c: c["tilt"]), lambda t: t.isNotNull())
    bands = F.array_distinct(F.transform("rets", lambda x: x["band"]))
    per_band = F.transform(bands, lambda b: _mean(F.transform(
        F.filter("rets", lambda x: x["band"] == b), lambda x: x["ret"])) / 10)
    sector_ret = F.coalesce(_mean(per_band), _median(tilts))
    c = rows.withColumn("sector_ret", sector_ret).withColumn("c", F.explode("cells"))
    kv, tech = F.col("c.kv"), F.col("c.technology")
    power = _number(kv, "rs power")
    return c.select(
        "path", "site_id", "site_name", "sector", "sector_id", tech.alias("technology"),
        F.col("c.name").alias("cell_name"), "latitude", "longitude",
        F.coalesce(_number(kv, "azimuth"), "azimuth_deg").alias("azimuth_deg"),
        F.initcap(F.coalesce(F.nullif(_get(kv, "status"), F.lit("")), "status")).alias("status"),
        _get(kv, "band").alias("band"),
        map_band(F.col("c.name"), tech, _number(kv, "earfcn"), _get(kv, "band"),
                 _number(kv, "dl freq")).alias("band_label"),
        *[_get(kv, k).alias(k) for k in ("bcch", "bsic", "tch", "antenna", "bsc", "lac", "sac", "tac")],
        _get(kv, "dl psc").alias("psc"), _number(kv, "dl freq").alias("dl_freq"),
        _number(kv, "pci").alias("pci"), _number(kv, "earfcn").alias("earfcn"),
        _number(kv, "bw").alias("bw_mhz"), _number(kv, "power").alias("cpich_power"),
        F.when(tech == "4G", F.when(power > 40, power / 10).when(power > 0, power))
        .alias("rs_power_dbm"),
        F.when(tech == "4G", _number(kv, "max ret") / 10).alias("max_ret_deg"),
        F.col("c.tilt").alias("elec_tilt_deg"),
        F.coalesce("c.tilt", "sector_ret").alias("ret_deg"))


def sites_of(sectors: DataFrame) -> DataFrame:
    """Sites: mean position of the sectors, their number, that of their cells, commonest status."""
    return sectors.groupBy("site_id").agg(
        F.min("site_name").alias("site_name"), F.mean("latitude").alias("latitude"),
        F.mean("longitude").alias("longitude"), F.count_distinct("sector_id").alias("n_sectors"),
        F.sum("n_cells").alias("n_cells"), F.mode("status", True).alias("status"))


def parse_placemarks(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, sectors) of placemark bodies (path, body)."""
    rows = sector_rows(bodies)
    return cells_of(rows), sectors_of(rows)
