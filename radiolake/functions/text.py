"""Names, identifiers and free text as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.functions.times import plus_hours

# Texts that mean nothing was there.
BLANKS = ("", "nan", "none", "null", "nat", "<na>", "n/a", "na", "-", "--")
NULL_NUMBERS = ("", "-", "--", "nan", "none", "null", "n/a", "na", "nil", "/0", "#div/0!",
                "#n/a", "inf", "-inf")

SITE_CODE = r"([A-Za-z]{2,4}\d{3,6})"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(col) -> Column:
    c = _c(col)
    return c.isNull() | F.lower(F.trim(c)).isin(*BLANKS)


def clean_text(col) -> Column:
    c = F.trim(F.regexp_replace(_c(col).cast("string"), " ", " "))
    return F.when(c.isNull() | F.lower(c).isin("", "nan", "none", "nat"), "").otherwise(c)


def clean_number(col) -> Column:
    """A number as exports write it: null words, percent signs and separators dropped."""
    text = F.trim(_c(col).cast("string"))
    bare = F.regexp_replace(text, "[%, ]", "")
    return F.when(~F.lower(text).isin(*NULL_NUMBERS), bare.try_cast("double"))


def null_outside(col, lo: float, hi: float) -> Column:
    c = _c(col)
    return F.when(c.between(lo, hi), c)


def zero_is_missing(col) -> Column:
    c = _c(col)
    return F.when(c != 0, c)


def site_code(col, which: str = "first") -> Column:
    """The site code inside any name, upper case; the last match on request."""
    if which == "last":
        found = F.regexp_extract_all(_c(col), F.lit(SITE_CODE), 1)
        return F.when(F.size(found) > 0, F.upper(F.element_at(found, -1)))
    hit = F.regexp_extract(_c(col), SITE_CODE, 1)
    return F.when(hit != "", F.upper(hit))


def sector_no(name, local_id=None) -> Column:
    """Trailing -n / _n of the cell name, else a local id of 1..12, else 0."""
    tail = F.regexp_extract(_c(name), r"[-_ ]([1-9])\s*$", 1)
    own = F.when(tail != "", tail.cast("int"))
    if local_id is None:
        return F.coalesce(own, F.lit(0))
    lid = _c(local_id).cast("string").try_cast("int")
    return F.coalesce(own, F.when(lid.between(1, 12), lid), F.lit(0))


def sector_id(site, number) -> Column:
    return F.concat(_c(site), F.lit("-S"), _c(number).cast("string"))


def sector_letter_no(text) -> Column:
    """Sector from S3, 3 or a letter A..F."""
    t = F.upper(F.trim(_c(text)))
    digit = F.regexp_extract(t, r"^S?(\d{1,2})$", 1)
    letter = F.regexp_extract(t, r"^(?:S|SEC(?:TOR)?)?[-_ ]?([A-F])$", 1)
    return F.when(digit != "", digit.cast("int")).when(
        letter != "", F.ascii(letter) - F.ascii(F.lit("A")) + 1)


# Band words in a cell name and LTE channel ranges of KPI files.
BAND_WORD = (r"(?i)\b(L(?:08|8|18|19|21|23|26)00?|L\d{3,4}|U(?:09|21)00|G(?:09|18)00|"
             r"N(?:35|78|28)\d?|LTE\d{3,4}|B\d{1,2})\b")
CHANNEL_BANDS = ((0, 599, "L2100"), (1200, 1949, "L1800"), (2750, 3449, "L2600"),
                 (6150, 6449, "L800"), (2400, 2649, "L2300"), (3450, 3799, "L2500"))
NO_BAND = "UNKNOWN"


def channel_band(name, channel=None) -> Column:
    """Band of a KPI file's cell: the band word in its name, else by its channel, else UNKNOWN."""
    word = F.regexp_extract(_c(name), BAND_WORD, 1)
    out = F.when(word != "", F.upper(word))
    if channel is not None:
        ch = F.floor(_c(channel).cast("string").try_cast("double"))
        for lo, hi, label in CHANNEL_BANDS:
            out = out.when(ch.between(lo, hi), label)
    return out.otherwise(NO_BAND)


# How the site map names bands, by technology, name prefix and channel.
MAP_LTE = ((("L21",), (300.0, 325.0), None, "L2100"),
           (("L26", "L40", "L41"), (), (39000.0, None), "L2600(TDD)"),
           (("L9", "L09", "L8"), (3689.0, 3750.0), None, "L900"),
           (("L23",), (), (38650.0, 39000.0), "L2300(TDD)"))


def map_band(name, tech="4G", channel=None, raw=None, downlink=None) -> Column:
    """Band label of a mapped cell; every technology has a label for what no rule names."""
    tech = F.lit(tech) if isinstance(tech, str) and tech in ("2G", "3G", "4G") else _c(tech)
    prefix = F.upper(F.regexp_extract(F.coalesce(_c(name), F.lit("")), r"^([A-Za-z]+\d*)", 1))
    number = lambda c: (F.lit(None) if c is None else _c(c)).cast("string").try_cast("double")
    any_of = lambda prefixes: reduce(or_, [prefix.startswith(p) for p in prefixes])
    text = F.upper(F.coalesce(F.lit(None).cast("string") if raw is None else _c(raw), F.lit("")))
    gsm = (F.when(text.contains("900"), "G900")
           .when(text.contains("1800") | text.contains("DCS"), "G1800")
           .when(text != "", text).otherwise("GSM"))
    umts = F.when(any_of(("U9", "U09")) | F.coalesce(number(downlink) == 3088, F.lit(False)),
                  "U900").otherwise("U2100")
    ch = number(channel)
    lte = F.when(F.lit(False), "")
    for prefixes, channels, span, label in MAP_LTE:
        hit = any_of(prefixes)
        if channels:
            hit = hit | F.coalesce(ch.isin(*channels), F.lit(False))
        if span:
            lo, hi = span
            hit = hit | F.coalesce((ch >= lo) & (ch < hi if hi else F.lit(True)), F.lit(False))
        lte = lte.when(hit, label)
    return F.when(tech == "2G", gsm).when(tech == "3G", umts).otherwise(lte.otherwise("L1800"))


def fix_latlon(lat, lon, box=((28.0, 34.0), (43.0, 50.0))) -> Column:
    """Swapped coordinates put right, then nulled outside the box of (lat, lon) ranges."""
    la, lo = _c(lat), _c(lon)
    (a, b), (c, d) = box
    swapped = la.between(c, d) & lo.between(a, b)
    x = F.when(swapped, lo).otherwise(la)
    y = F.when(swapped, la).otherwise(lo)
    ok = x.between(a, b) & y.between(c, d)
    return F.struct(F.when(ok, x).alias("latitude"), F.when(ok, y).alias("longitude"))


def mean_of_list(col) -> Column:
    """The mean of a bracketed number list, or the plain number."""
    t = F.trim(_c(col).cast("string"))
    items = F.from_json(t, "array<double>")
    mean = F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.size(items)
    return F.when(t.startswith("["), F.when(F.size(items) > 0, mean)).otherwise(
        t.try_cast("double"))


def tilt_deg(col) -> Column:
    """A tilt above 20 is in tenths."""
    c = _c(col)
    return F.when(c > 20, c / 10).otherwise(c)


def rs_power_dbm(col) -> Column:
    """A power above 40 is in tenths; 3..40 dBm is plausible."""
    c = _c(col)
    v = F.when(F.abs(c) > 40, c / 10).otherwise(c)
    return F.when(v.between(3, 40), v)


SUMMARY_WORDS = r"(?i)(average|total|\bsum\b|all cell|grand)"


def is_summary_row(col) -> Column:
    return F.coalesce(_c(col).rlike(SUMMARY_WORDS), F.lit(False))


# Spellings of a city and the governorate of each.
CITY = {"basrah": "Basrah", "basra": "Basrah", "al-basrah": "Basrah", "nassriya": "Nasiriyah",
        "nasriya": "Nasiriyah", "nasiriya": "Nasiriyah", "nasiriyah": "Nasiriyah",
        "nassiriya": "Nasiriyah", "thi qar": "Nasiriyah", "emarah": "Amarah",
        "amarah": "Amarah", "amara": "Amarah", "maysan": "Amarah", "missan": "Amarah",
        "samawa": "Samawah", "samawah": "Samawah", "al-muthanna": "Samawah",
        "muthanna": "Samawah"}
PREFIX_CITY = {"BAS": "Basrah", "NAS": "Nasiriyah", "EMA": "Amarah", "SAM": "Samawah"}
GOVERNORATE = {"Basrah": "Basrah", "Nasiriyah": "Dhi Qar", "Amarah": "Maysan",
               "Samawah": "Muthanna"}
GOVERNORATE_WORDS = (("basra", "Basrah"), ("thi qar", "Dhi Qar"), ("dhi qar", "Dhi Qar"),
                     ("thiqar", "Dhi Qar"), ("nasir", "Dhi Qar"), ("nassir", "Dhi Qar"),
                     ("nassr", "Dhi Qar"), ("nasr", "Dhi Qar"), ("maysan", "Maysan"),
                     ("missan", "Maysan"), ("amara", "Maysan"), ("emara", "Maysan"),
                     ("muthanna", "Muthanna"), ("samaw", "Muthanna"))


def lookup(col, table: dict[str, str]) -> Column:
    """The table's value for the text, null when it has none."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, _c(col))


def city_name(col, site=None, unknown: str = "") -> Column:
    """One spelling per city; "Region / City" counts by its last part; else the id's prefix."""
    part = F.trim(F.element_at(F.split(clean_text(col), "/"), -1))
    by_prefix = (lookup(F.upper(F.substring(_c(site), 1, 3)), PREFIX_CITY)
                 if site is not None else F.lit(None).cast("string"))
    return F.when(part != "", F.coalesce(lookup(F.lower(part), CITY), part)).otherwise(
        F.coalesce(by_prefix, F.lit(unknown)))


def governorate_name(col, site=None) -> Column:
    """A governorate from a city or governorate in any spelling, else from the site id."""
    t = clean_text(col)
    low = F.lower(t)
    exact = lookup(lookup(low, CITY), GOVERNORATE)
    words = F.lit(None).cast("string")
    for word, gov in reversed(GOVERNORATE_WORDS):
        words = F.when(low.contains(word), gov).otherwise(words)
    own = F.when(t.isin(*set(GOVERNORATE.values())), t)
    by_prefix = (lookup(lookup(F.upper(F.substring(_c(site), 1, 3)), PREFIX_CITY), GOVERNORATE)
                 if site is not None else F.lit(None).cast("string"))
    return F.coalesce(own, exact, words, by_prefix, F.lit(""))


def user_name(col) -> Column:
    """A login such as hw.first.last read as a name."""
    t = F.regexp_replace(clean_text(col), r"(?i)^(hw|user)[.:]", "")
    words = F.filter(F.split(t, r"[._\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def ticket_state(ticket_status, status) -> Column:
    ts, st = F.lower(clean_text(ticket_status)), F.lower(clean_text(status))
    return (F.when((ts == "completed") | ((ts == "") & st.isin("close", "closed")), "Closed")
            .when(st == "sleep", "Sleep").when(st == "pending", "Pending")
            .otherwise("In Progress"))


def reopen_number(col) -> Column:
    n = F.regexp_extract(clean_text(col), r"(\d+(?:\.\d+)?)", 1)
    v = F.when(~is_blank(col) & (n != ""), n.try_cast("double"))
    return v


def ticket_type(reopen, user) -> Column:
    """REOPEN #n, UP OF SLEEP (no reopen count, but a person), else NEW."""
    n = reopen_number(reopen)
    return (F.when(n >= 1, F.concat(F.lit("REOPEN #"), F.floor(n).cast("string")))
            .when((is_blank(reopen) | (n == 0)) & ~is_blank(user), "UP OF SLEEP")
            .otherwise("NEW"))


def norm_name(col) -> Column:
    """A header or KPI name reduced to lower-case words."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", " "))


def unit_of(col) -> Column:
    """The unit in a KPI name: the last bracketed part, or a percent sign."""
    inside = F.regexp_extract_all(_c(col), F.lit(r"\(([^()]*)\)"), 1)
    return F.when(F.size(inside) > 0, F.element_at(inside, -1)).when(
        _c(col).contains("%"), "%").otherwise("")


def clean_site_name(col) -> Column:
    """A site name without its code, height mark and doubled separators."""
    t = F.regexp_replace(_c(col), SITE_CODE, "")
    t = F.regexp_replace(t, r"(?i)[-_ ]*\d+(\.\d+)?\s*m\b", "")
    t = F.trim(F.regexp_replace(t, r"[-_\s]+", " "))
    return t


def is_border_site(col) -> Column:
    """A border-road site by its name: ARB and a capital at the start or after an underscore."""
    return F.coalesce(_c(col).rlike("(?:^|_)ARB[A-Z]"), F.lit(False))


def mast_height(col) -> Column:
    h = F.regexp_extract(_c(col), r"(?i)(\d+(?:\.\d+)?)\s*m\b", 1)
    return F.when(h != "", h.cast("double"))


# What engineers' words point to, first match first where order matters.
COMMENT_SIGNALS = (
    ("non_rf", r"\b(not connected|no issue|ps side|core side|sim|device|handset|barred|provision|"
               r"charging|package|balance|switched? off)\b"),
    ("planned_site", r"\b(planned? site|new site|q[1-4]\s*20\d\d|will be on ?air|nomination|tower)\b"),
    ("ret", r"\b(ret|electrical tilt|tilt|rcu|ale)\b"),
    ("escalated", r"\b(escalat|fme|raised to|forwarded to|hw team|swap)\b"),
    ("alarm_or_outage", r"\b(alarm|outage|down|not on ?air|vswr|hardware|board|transmission|"
                        r"power fail)\b"),
    ("interference", r"\b(interfe|rtwp|jammer|jamming|noise)\b"),
    ("indoor", r"\b(indoor|in-?building|inside|basement|home)\b"),
    ("congestion", r"\b(congest|utiliz|utilis|prb|flow control|high traffic|overload|capacity)\b"),
)
CHECK_WORDS = (
    ("not_technical", r"\b(not? (?:an? )?technical|non[- ]?technical|not connected|no issue|"
                      r"ps side|core side|sim|device|handset|barred|provision\w*|charging|package|"
                      r"balance|switched? off)\b"),
    ("coverage", r"\b(dt|drive[- ]?test\w*)\b"),
    ("flow_control", r"\bflow[- ]?contro\w*"),
    ("interference", r"\b(interfe\w*|rtwp|jamm\w*|noise)\b"),
    ("utilization", r"\b(congest\w*|utili[sz]\w*|prb|high traffic|overload\w*|capacity|load)\b"),
    ("coverage", r"\b(weak|coverage|indoor|in-?building|basement|rsrp|no signal|poor signal)\b"),
    ("planned", r"\b(planned? site|new site|new tower|nomination|will be on ?air)\b"),
)
LOAD_WORDS = CHECK_WORDS[4][1]


def text_signals(col, patterns: Sequence[tuple[str, str]] = COMMENT_SIGNALS) -> Column:
    """The names of every pattern found in the text, in order."""
    c = _c(col)
    hits = F.array(*[F.when(c.rlike("(?i)" + p), F.lit(name)) for name, p in patterns])
    return F.filter(hits, lambda x: x.isNotNull())


def first_signal(col, patterns: Sequence[tuple[str, str]]) -> Column:
    c = _c(col)
    out = F.lit("")
    for name, p in reversed(list(patterns)):
        out = F.when(c.rlike("(?i)" + p), name).otherwise(out)
    return F.when(c.isNull(), "").otherwise(out)


def days_left(expected, today) -> Column:
    t = today if isinstance(today, Column) else F.lit(str(today)).cast("date")
    return F.datediff(_c(expected).cast("date"), t).cast("double")


def window_bounds(pt, hours: float) -> tuple[Column, Column]:
    """From the hour of (time - hours) to time + hours."""
    from radiolake.functions.times import hour_floor
    return hour_floor(plus_hours(_c(pt), -hours)), plus_hours(_c(pt), hours)
