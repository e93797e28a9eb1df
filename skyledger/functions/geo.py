"""Geodesy, local-plane and angle expressions.

Every function takes columns (or literals) and returns a column, so the
arithmetic stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
KM_PER_NM = 1.852
VIEW_EARTH_RADIUS_NM = 3440.065
NM_PER_DEGREE = 60.0
DEFAULT_MAGVAR_E = 5.0


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _norm360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def great_circle_nm(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in nautical miles on a 6371 km sphere."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), F.lit(2.0))
    return F.lit(2.0 * EARTH_RADIUS_KM / KM_PER_NM) * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def view_width_nm(lat, lon_west, lon_east) -> Column:
    """East-west span along a parallel; uses the second, smaller radius."""
    half = F.radians(_c(lon_east) - _c(lon_west)) / 2.0
    h = F.pow(F.cos(F.radians(_c(lat))) * F.sin(half), F.lit(2.0))
    return F.lit(2.0 * VIEW_EARTH_RADIUS_NM) * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def true_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0-360; coincident points give 0."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlon = F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(
        _norm360(F.degrees(F.atan2(east, north)) + 360.0)
    )


def magnetic_bearing_deg(lat1, lon1, lat2, lon2, magvar_e: float = DEFAULT_MAGVAR_E) -> Column:
    return _norm360(true_bearing_deg(lat1, lon1, lat2, lon2) - F.lit(float(magvar_e)))


def shown_bearing(mag: Column) -> Column:
    """Whole-degree heading as printed on a leg: half a degree rounds down."""
    return F.pmod(F.floor(mag - 0.5), F.lit(360)).cast("int")


def leg_seconds(distance_nm: Column, speed_kts) -> Column:
    speed = _c(speed_kts)
    return F.when(speed <= 0.0, F.lit(0.0)).otherwise(
        distance_nm / F.when(speed > 0.0, speed) * 3600.0
    )


def hms(seconds: Column) -> Column:
    """HH:MM:SS, rounding half to even; negative, NaN and infinite become 0."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0.0) & (seconds < float("inf"))
    total = F.bround(F.when(ok, seconds).otherwise(0.0), 0).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(total / 3600).cast("bigint"),
        F.floor(total % 3600 / 60).cast("bigint"),
        total % 60,
    )


# --- angles -----------------------------------------------------------------


def circular_diff_deg(a, b) -> Column:
    d = _norm360(_c(a) - _c(b) + 720.0)
    return F.least(d, 360.0 - d)


def axis_diff_deg(a, b) -> Column:
    d = circular_diff_deg(a, b)
    return F.least(d, 180.0 - d)


def bisector_deg(b1, b2) -> Column:
    """Direction half-way between two bearings; opposite ones give b1 + 90."""
    b1, b2 = _c(b1), _c(b2)
    x = F.sin(F.radians(b1)) + F.sin(F.radians(b2))
    y = F.cos(F.radians(b1)) + F.cos(F.radians(b2))
    return F.when(
        (F.abs(x) < 1e-9) & (F.abs(y) < 1e-9), _norm360(b1 + 90.0)
    ).otherwise(_norm360(F.degrees(F.atan2(x, y)) + 360.0))


def mean_direction_deg(b1, b2) -> Column:
    """Direction of the sum of two unit vectors, whatever rounding leaves of it: opposite north and south give 90."""
    b1, b2 = _c(b1), _c(b2)
    x = F.sin(F.radians(b1)) + F.sin(F.radians(b2))
    y = F.cos(F.radians(b1)) + F.cos(F.radians(b2))
    return _norm360(F.degrees(F.atan2(x, y)) + 360.0)


# --- local plane ------------------------------------------------------------
# One degree of latitude counts 60 nm; longitude shrinks with the cosine of the
# leg's middle latitude. Beyond the leg's ends the distance is great-circle.
# A foot that falls on an end is beside the leg or past it by the last bit, so products
# are taken in the order in which the SQL twins take them.


def _leg_shrink(a_lat, b_lat) -> Column:
    return F.cos(F.radians((a_lat + b_lat) * 0.5)) * NM_PER_DEGREE


def _leg_square(a_lat, a_lon, b_lat, b_lon) -> Column:
    two = F.lit(2.0)
    return F.pow((b_lon - a_lon) * _leg_shrink(a_lat, b_lat), two) + F.pow((b_lat - a_lat) * NM_PER_DEGREE, two)


def leg_fraction(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> Column:
    """Unclamped position of the perpendicular's foot (0 = start, 1 = end).

    NULL for a leg without length.
    """
    k, sq = _leg_shrink(a_lat, b_lat), _leg_square(a_lat, a_lon, b_lat, b_lon)
    along = (p_lon - a_lon) * k * (b_lon - a_lon) * k + (p_lat - a_lat) * NM_PER_DEGREE * (b_lat - a_lat) * NM_PER_DEGREE
    return along / F.when(sq >= 1e-9, sq)


def leg_distance_nm(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> Column:
    """Distance from a point to the leg, ends included."""
    k, two = _leg_shrink(a_lat, b_lat), F.lit(2.0)
    t = leg_fraction(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon)
    dx = (p_lon - a_lon) * k - t * (b_lon - a_lon) * k
    dy = (p_lat - a_lat) * NM_PER_DEGREE - t * (b_lat - a_lat) * NM_PER_DEGREE
    return (
        F.when(t.isNull() | (t <= 0.0), great_circle_nm(p_lat, p_lon, a_lat, a_lon))
        .when(t >= 1.0, great_circle_nm(p_lat, p_lon, b_lat, b_lon))
        .otherwise(F.sqrt(F.pow(dx, two) + F.pow(dy, two)))
    )


def leg_overshoot_nm(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> Column:
    """How far past either end the foot lies, along the leg; 0 when beside it."""
    t = leg_fraction(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon)
    past = F.greatest(F.lit(0.0), -t, t - 1.0) * F.sqrt(_leg_square(a_lat, a_lon, b_lat, b_lon))
    return F.when(t.isNull(), F.lit(0.0)).otherwise(past)


def leg_side(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> Column:
    """+1 left of the leg, -1 right of it, 0 on the line (plain degrees)."""
    cross = (b_lon - a_lon) * (p_lat - a_lat) - (b_lat - a_lat) * (p_lon - a_lon)
    return F.when(cross > 1e-12, 1).when(cross < -1e-12, -1).otherwise(0)


# --- conic projection (unit sphere) -----------------------------------------
# Parallels 29 and 33 N, origin 31 N 35 E.
LCC_PARALLELS = (29.0, 33.0)
LCC_ORIGIN = (31.0, 35.0)


def _lcc_constants() -> tuple[float, float, float]:
    def t(deg: float) -> float:
        return math.tan(math.pi / 4 + math.radians(deg) / 2)

    lo, hi = LCC_PARALLELS
    cone = math.log(math.cos(math.radians(lo)) / math.cos(math.radians(hi))) / math.log(t(hi) / t(lo))
    scale = math.cos(math.radians(lo)) * t(lo) ** cone / cone
    return cone, scale, scale / t(LCC_ORIGIN[0]) ** cone


LCC_CONE, LCC_SCALE, LCC_RHO0 = _lcc_constants()


def lcc_xy(lat, lon) -> tuple[Column, Column]:
    lat, lon = _c(lat), _c(lon)
    rho = LCC_SCALE / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2.0), F.lit(LCC_CONE))
    theta = LCC_CONE * F.radians(lon - LCC_ORIGIN[1])
    return rho * F.sin(theta), LCC_RHO0 - rho * F.cos(theta)


def lcc_latlon(x, y) -> tuple[Column, Column]:
    """Inverse projection; the apex of the cone comes out as 90 N on the central meridian."""
    x, dy = _c(x), LCC_RHO0 - _c(y)
    lon = LCC_ORIGIN[1] + F.degrees(F.atan2(x, dy)) / LCC_CONE
    lat = F.degrees(
        2.0 * F.atan(F.pow(F.hypot(x, dy) / LCC_SCALE, F.lit(-1.0 / LCC_CONE))) - math.pi / 2
    )
    return lat, lon


# --- 11-character coordinates -------------------------------------------------


def format_coord(lat: Column, lon: Column) -> Column:
    """DDMM[NS]DDDMM[EW]; minutes round half to even and carry at 60."""

    def part(v: Column, width: int, pos: str, neg: str) -> Column:
        deg = F.floor(F.abs(v))
        minutes = F.bround((F.abs(v) - deg) * 60.0, 0).cast("bigint")
        return F.concat(
            F.lpad((deg + F.when(minutes >= 60, 1).otherwise(0)).cast("string"), width, "0"),
            F.lpad((minutes % 60).cast("string"), 2, "0"),
            F.when(v >= 0.0, pos).otherwise(neg),
        )

    return F.concat(part(lat, 2, "N", "S"), part(lon, 3, "E", "W"))


COORD_PATTERN = r"^([0-9]{2})([0-9]{2})([NS])([0-9]{3})([0-9]{2})([EW])$"


def parse_coord(token: Column) -> tuple[Column, Column]:
    """Inverse of format_coord; both columns are NULL for an invalid token."""

    # the pattern fixes the place of every part, so it is matched once and parts are cut out
    part = lambda start, n: F.substring(token, start, n)
    lat_d, lat_m, lon_d, lon_m = (part(*p).try_cast("int") for p in ((1, 2), (3, 2), (6, 3), (9, 2)))
    ok = (
        token.rlike(COORD_PATTERN)
        & (lat_m < 60)
        & (lon_m < 60)
        & ((lat_d < 90) | ((lat_d == 90) & (lat_m == 0)))
        & ((lon_d < 180) | ((lon_d == 180) & (lon_m == 0)))
    )
    lat = (lat_d + lat_m / 60.0) * F.when(part(5, 1) == "S", -1.0).otherwise(1.0)
    lon = (lon_d + lon_m / 60.0) * F.when(part(11, 1) == "W", -1.0).otherwise(1.0)
    return F.when(ok, lat), F.when(ok, lon)
