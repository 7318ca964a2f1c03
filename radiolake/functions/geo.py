"""Geometry and radio formulas as native column expressions."""

from __future__ import annotations



from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371008.8
M_PER_DEG = 111_320.0
UE_HEIGHT_M = 1.5
DEFAULT_VBW = 6.5
PATTERN_FLOOR_DB = 25.0
EDGE_CAP_M = 25_000.0


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def at_least(x, floor) -> Column:
    """The larger of the two; a missing value stays missing (`greatest` would skip it)."""
    x, floor = _c(x), _c(floor)
    return F.when(x < floor, floor).otherwise(x)


def at_most(x, cap) -> Column:
    x, cap = _c(x), _c(cap)
    return F.when(x > cap, cap).otherwise(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    s, t = F.sin(dphi / 2), F.sin(dlam / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(at_most(F.sqrt(a), 1.0))


def flat_m(lat1, lon1, lat2, lon2, mean_latitude: bool = False) -> Column:
    """Flat-earth distance; the longitude shrinks with the first point's latitude, or the mean."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    at = (lat1 + lat2) / 2 if mean_latitude else lat1
    dy = (lat2 - lat1) * M_PER_DEG
    dx = (lon2 - lon1) * M_PER_DEG * F.cos(F.radians(at))
    return F.sqrt(dx * dx + dy * dy)


def box_m(lat, lon, box: str, metric: str = "flat", far: bool = False) -> Column:
    """A distance that no position in the box is nearer than (or, if `far`, farther than).

    `box` names a struct of lo_lat, hi_lat, lo_lon and hi_lon; the metric is flat_m or haversine_m
    from the position to the box.
    """
    lat, lon = _c(lat), _c(lon)
    south, north = F.col(f"{box}.lo_lat"), F.col(f"{box}.hi_lat")
    west, east = F.col(f"{box}.lo_lon") - lon, F.col(f"{box}.hi_lon") - lon
    if far:
        dy = F.greatest(F.abs(south - lat), F.abs(north - lat))
        dx = F.greatest(F.abs(west), F.abs(east))
    else:
        dy = F.greatest(south - lat, lat - north, F.lit(0.0))
        dx = F.greatest(west, -east, F.lit(0.0))
    if metric == "flat":
        dy, dx = dy * M_PER_DEG, dx * M_PER_DEG * F.cos(F.radians(lat))
        return F.sqrt(dx * dx + dy * dy)
    holds = lambda x: (west <= x) & (east >= x)
    a, b = F.abs(F.sin(F.radians(west) / 2)), F.abs(F.sin(F.radians(east) / 2))
    cosines = F.cos(F.radians(south)), F.cos(F.radians(north))
    if far:
        t = F.when(holds(-180.0) | holds(180.0), 1.0).otherwise(F.greatest(a, b))
        c = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(*cosines))
    else:
        t = F.when(holds(-360.0) | holds(0.0) | holds(360.0), 0.0).otherwise(F.least(a, b))
        c = F.greatest(F.least(*cosines), F.lit(0.0))
    s = F.sin(F.radians(dy) / 2)
    h = s * s + F.cos(F.radians(lat)) * c * t * t
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(at_most(F.sqrt(h), 1.0))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, 0..360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(dl) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))


def flat_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dx = (lon2 - lon1) * F.cos(F.radians(lat1))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)) + 360.0, F.lit(360.0))


def az_gap(a, b) -> Column:
    """The smallest angle between two directions, 0..180."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def _mast(height, floor: float) -> Column:
    return at_least(_c(height) - UE_HEIGHT_M, floor)


def boresight_m(height, tilt) -> Column:
    """Ground distance where the main lobe's centre lands."""
    return _mast(height, 1.0) / F.tan(F.radians(at_least(tilt, 0.05)))


def edge_m(height, tilt, vbw=DEFAULT_VBW) -> Column:
    """Ground distance of the far 3 dB edge, capped where the beam clears the horizon."""
    angle = _c(tilt) - _c(vbw) / 2
    return F.when(angle <= 0.15, EDGE_CAP_M).otherwise(
        at_most(_mast(height, 1.0) / F.tan(F.radians(angle)), EDGE_CAP_M))


def elevation_deg(height, distance) -> Column:
    return F.degrees(F.atan2(_mast(height, 0.5), at_least(distance, 1.0)))


def optimal_downtilt(height, distance, vbw=DEFAULT_VBW, mode: str = "edge") -> Column:
    """Total downtilt that puts the far edge (or the main lobe) at the distance, 0..16."""
    add = _c(vbw) / 2 if mode == "edge" else F.lit(0.0)
    theta = elevation_deg(height, distance) + add
    return F.bround(at_least(at_most(theta, 16.0), 0.0), 1)


def pattern_db(offset, beamwidth=DEFAULT_VBW, floor: float = PATTERN_FLOOR_DB) -> Column:
    x = _c(offset) / _c(beamwidth)
    return -at_most(F.lit(12.0) * x * x, floor)


def tilt_gain_db(height, distance, tilt_now, tilt_new, vbw=DEFAULT_VBW) -> Column:
    """Change of the vertical pattern towards the distance; positive is stronger."""
    e = elevation_deg(height, distance)
    now = pattern_db(F.abs(e - _c(tilt_now)), vbw)
    new = pattern_db(F.abs(e - _c(tilt_new)), vbw)
    return F.bround(new - now, 2)


def fspl_db(distance, mhz) -> Column:
    km = at_least(distance, 1.0) / 1000.0
    return 32.44 + 20 * F.log10(km) + 20 * F.log10(_c(mhz))


def hata_db(distance, mhz, height=30.0, kind="urban") -> Column:
    """COST-231 Hata median path loss; kind is urban, suburban or rural (text or column)."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    f = at_most(at_least(mhz, 150.0), 2600.0)
    hb = at_most(at_least(height, 20.0), 200.0)
    km = at_least(distance, 20.0) / 1000.0
    lf, lh = F.log10(f), F.log10(hb)
    mobile = (1.1 * lf - 0.7) * UE_HEIGHT_M - (1.56 * lf - 0.8)
    loss = (46.3 + 33.9 * lf - 13.82 * lh - mobile + (44.9 - 6.55 * lh) * F.log10(km)
            + F.when(k == "urban", 3.0).otherwise(0.0))
    ls = F.log10(f / 28.0)
    return (F.when(k == "suburban", loss - (2 * ls * ls + 5.4))
            .when(k == "rural", loss - (4.78 * lf * lf - 18.33 * lf + 40.94)).otherwise(loss))


# Fixed values of the link budget, in dB and dBm.
RS_EPRE_DBM, TX_GAIN_DBI, CABLE_DB, BODY_DB = 15.2, 17.0, 1.5, 3.0
BUDGET_DBM = RS_EPRE_DBM + TX_GAIN_DBI - CABLE_DB - BODY_DB
POWER_HEADROOM_DB = 3.0
H_BEAMWIDTH = 65.0


def predict_rsrp(distance, height, tilt, az_offset, mhz=1800.0, kind="urban",
                 vbw=DEFAULT_VBW) -> Column:
    """Planning-grade RSRP at a ground point: link budget, two patterns, path loss."""
    v = pattern_db(F.abs(elevation_deg(height, distance) - _c(tilt)), vbw)
    h = pattern_db(az_offset, H_BEAMWIDTH)
    return F.bround(BUDGET_DBM + v + h - hata_db(distance, mhz, height, kind), 1)


def power_delta(current, target, tilt_gain=0.0, headroom: float = POWER_HEADROOM_DB) -> Column:
    """needed, applied and residual dB to reach the target, within the headroom."""
    gap = _c(target) - _c(current) - _c(tilt_gain)
    applied = F.when(gap <= 0, 0.0).otherwise(at_most(gap, headroom))
    return F.struct(F.bround(gap, 1).alias("needed_db"), F.bround(applied, 1).alias("applied_db"),
                    F.bround(F.when(gap <= 0, gap).otherwise(gap - applied), 1)
                    .alias("residual_db"),
                    ((gap > 0) & (applied < gap)).alias("limited"))


# Lower bounds of the RSRP classes, best first; and the covered line.
RSRP_BANDS = (("excellent", -85.0), ("good", -95.0), ("fair", -105.0), ("poor", -112.0))
COVERED_DBM = -110.0
RSRP_NAMES = ("excellent", "good", "fair", "poor", "very_poor")


def rsrp_class(value, bands=RSRP_BANDS) -> Column:
    """0 for the best class, one more for every lower bound the value misses."""
    v = _c(value)
    out = F.lit(0)
    for _, lo in bands:
        out = out + F.when(v < lo, 1).otherwise(0)
    return out


def wedge_ring(lat, lon, azimuth, width, radius, steps: int = 12) -> Column:
    """A sector's footprint: the site, an arc of steps + 1 points, and the site again."""
    lat, lon, azimuth, width, radius = map(_c, (lat, lon, azimuth, width, radius))
    point = lambda y, x: F.struct(x.alias("lon"), y.alias("lat"))
    arc = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(
        lat + radius * F.cos(F.radians(azimuth - width / 2 + width * i / steps)) / M_PER_DEG,
        lon + radius * F.sin(F.radians(azimuth - width / 2 + width * i / steps))
        / (F.lit(M_PER_DEG) * F.cos(F.radians(lat)))))
    here = F.array(point(lat, lon))
    return F.concat(here, arc, here)


def beam_length_m(height, tilt, shortest: float = 150.0, longest: float = 1500.0) -> Column:
    """How far a drawn beam reaches: the boresight distance within drawing limits."""
    return at_least(at_most(boresight_m(height, tilt), longest), shortest)


# ------------------------------------------------------------------- lattices
def _step_deg(metres) -> Column:
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return m / F.lit(M_PER_DEG)


def row_width_deg(row: Column, step: Column) -> Column:
    """Longitude width of a lattice row whose cells are `step` degrees of latitude tall."""
    low = row * step
    edge = F.greatest(F.abs(low), F.abs(low + step))
    return step / F.greatest(F.cos(F.radians(edge)), F.lit(0.01))


def cell_key(lat, lon, metres) -> Column:
    """The lattice cell of a position: (row, column) of cells at least `metres` wide."""
    step = _step_deg(metres)
    row = F.floor(_c(lat) / step).cast("bigint")
    return F.struct(row.alias("iy"),
                    F.floor(_c(lon) / row_width_deg(row, step)).cast("bigint").alias("ix"))


def keys_within(lat, lon, metres, margin: float = 1.0) -> Column:
    """Every lattice cell that can hold a position within `metres` of this one."""
    step = _step_deg(metres)
    lat, lon = _c(lat), _c(lon)
    row = F.floor(lat / step).cast("bigint")
    reach = step * margin / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))

    def of_row(y: Column) -> Column:
        width = row_width_deg(y, step)
        return F.transform(F.sequence(F.floor((lon - reach) / width).cast("bigint"),
                                      F.floor((lon + reach) / width).cast("bigint")),
                           lambda x: F.struct(y.alias("iy"), x.alias("ix")))

    return F.flatten(F.transform(F.sequence(row - 1, row + 1), of_row))
