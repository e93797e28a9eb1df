"""Web-Mercator tile arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TILE_PX = 256
MAX_LAT = 85.0511287798066
EARTH_CIRCUMFERENCE_M = 40075016.686
DEFAULT_BOX = (29.3, 33.4, 34.0, 36.0)  # min lat, max lat, min lon, max lon


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clamp_lat(lat) -> Column:
    return F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), _c(lat)))


def world_span(z) -> Column:
    return TILE_PX * F.pow(F.lit(2.0), _c(z))


def world_x(lon, z) -> Column:
    return (_c(lon) + 180.0) / 360.0 * world_span(z)


def world_y(lat, z) -> Column:
    # asinh(tan(lat)) written as ln(tan(45 deg + lat / 2)): one use of the argument,
    # and no cancellation south of the equator.
    merc = F.log(F.tan(math.pi / 4 + F.radians(clamp_lat(lat)) / 2.0))
    return (1.0 - merc / math.pi) / 2.0 * world_span(z)


def lon_of(px, z) -> Column:
    return _c(px) / world_span(z) * 360.0 - 180.0


def lat_of(py, z) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * _c(py) / world_span(z)))))


def tile_x(lon, z) -> Column:
    return F.floor(world_x(lon, z) / TILE_PX).cast("int")


def tile_y(lat, z) -> Column:
    return F.floor(world_y(lat, z) / TILE_PX).cast("int")


def metres_per_pixel(lat, z) -> Column:
    return EARTH_CIRCUMFERENCE_M * F.cos(F.radians(clamp_lat(lat))) / world_span(z)


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    out = F.lit(template)
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out
