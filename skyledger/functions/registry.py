"""SQL functions for sessions: temporary functions that Catalyst inlines."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from skyledger.functions import geo, mercator

_N, _S, _R = (f"{v!r}D" for v in (geo.LCC_CONE, geo.LCC_SCALE, geo.LCC_RHO0))
_T = "tan(pi() / 4 + radians(lat) / 2)"
_H = "(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))"
_POS = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_BRG = (
    "CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN 0D ELSE pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), "
    "cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D) END"
)
_COORD = r"'^([0-9]{2})([0-9]{2})([NS])([0-9]{3})([0-9]{2})([EW])$'"


def _part(group: int) -> str:
    return f"try_cast(regexp_extract(token, {_COORD}, {group}) AS INT)"


_IN_RANGE = " AND ".join(
    f"{_part(m)} < 60 AND ({_part(d)} < {top} OR {_part(d)} = {top} AND {_part(m)} = 0)" for d, m, top in ((1, 2, 90), (4, 5, 180))
)


def _coord(deg: int, letter: int, negative: str) -> str:
    """Degrees of an 11-character coordinate, NULL where geo.parse_coord gives NULL."""
    sign = f"CASE WHEN regexp_extract(token, {_COORD}, {letter}) = '{negative}' THEN -1D ELSE 1D END"
    value = f"({_part(deg)} + {_part(deg + 1)} / 60D) * {sign}"
    return f"CASE WHEN NOT rlike(token, {_COORD}) THEN NULL WHEN {_IN_RANGE} THEN {value} END"


def _text(v: str, width: int, pos: str, neg: str) -> str:
    minutes = f"CAST(bround((abs({v}) - floor(abs({v}))) * 60D, 0) AS BIGINT)"
    deg = f"CAST(floor(abs({v})) AS BIGINT) + CASE WHEN {minutes} >= 60 THEN 1 ELSE 0 END"
    return (
        f"lpad(CAST({deg} AS STRING), {width}, '0'), lpad(CAST({minutes} % 60 AS STRING), 2, '0'), "
        f"CASE WHEN {v} >= 0D THEN '{pos}' ELSE '{neg}' END"
    )


_LIMIT = f"{mercator.MAX_LAT!r}D"
_SECONDS = "bround(CASE WHEN s IS NULL OR isnan(s) OR s < 0 OR s = double('infinity') THEN 0D ELSE s END)"

_EAST, _NORTH = "(sin(radians(a)) + sin(radians(b)))", "(cos(radians(a)) + cos(radians(b)))"
_VIEW = "pow(cos(radians(lat)) * sin(radians(lon_east - lon_west) / 2), 2)"
_LEG = "a_lat DOUBLE, a_lon DOUBLE, b_lat DOUBLE, b_lon DOUBLE, p_lat DOUBLE, p_lon DOUBLE"
_SHRINK = f"(cos(radians((a_lat + b_lat) * 0.5D)) * {geo.NM_PER_DEGREE!r}D)"
_BX, _BY = f"((b_lon - a_lon) * {_SHRINK})", f"((b_lat - a_lat) * {geo.NM_PER_DEGREE!r}D)"
_PX, _PY = f"((p_lon - a_lon) * {_SHRINK})", f"((p_lat - a_lat) * {geo.NM_PER_DEGREE!r}D)"
_LENGTH2 = f"({_BX} * {_BX} + {_BY} * {_BY})"
_FRACTION = f"(({_PX} * {_BX} + {_PY} * {_BY}) / CASE WHEN {_LENGTH2} >= 1e-9D THEN {_LENGTH2} END)"
_CROSS = "((b_lon - a_lon) * (p_lat - a_lat) - (b_lat - a_lat) * (p_lon - a_lon))"
_UV = "u DOUBLE, v DOUBLE, ia DOUBLE, ib DOUBLE, itx DOUBLE, ic DOUBLE, id DOUBLE, ity DOUBLE"
_AX, _AY = "(ia * u + ib * v + itx)", "(ic * u + id * v + ity)"
_LCC_X = f"{_S} / pow({_T}, {_N}) * sin({_N} * radians(lon - 35D))"
_LCC_Y = f"{_R} - {_S} / pow({_T}, {_N}) * cos({_N} * radians(lon - 35D))"
_DIAGONAL = (
    "array_max(flatten(transform(ring, (a, i) -> transform(filter(ring, (b, k) -> k > i), (b, j) -> named_struct("
    "'d2', pow(b.x - a.x, 2) + pow(b.y - a.y, 2), 'i', -i, 'j', -j, 'dx', b.x - a.x, 'dy', b.y - a.y)))))"
)
_TRIMMED = r"regexp_replace(url, r'^\s+|\s+$', '')"
_SCHEME = rf"regexp_extract({_TRIMMED}, r'^([A-Za-z][A-Za-z0-9+.\-]*):', 1)"
_HOST = rf"regexp_extract({_TRIMMED}, r'^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?', 1)"
_URL = r"A-Za-z0-9/%\-._~!$&\x27()*+,;=:@?#"


def _nm(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371D / 1.852D * atan2(sqrt({h}), sqrt(1 - {h})))"


# name -> (parameters, result, expression)
SCALARS: dict[str, tuple[str, str, str]] = {
    "gc_nm": (_POS, "DOUBLE", f"2 * 6371D / 1.852D * atan2(sqrt({_H}), sqrt(1 - {_H}))"),
    "true_bearing": (_POS, "DOUBLE", _BRG),
    "mag_bearing": (_POS + ", var_e DOUBLE", "DOUBLE", f"pmod({_BRG} - var_e, 360D)"),
    "shown_bearing": ("mag DOUBLE", "INT", "CAST(pmod(floor(mag - 0.5D), 360) AS INT)"),
    "leg_seconds": ("nm DOUBLE, kts DOUBLE", "DOUBLE", "CASE WHEN kts <= 0 THEN 0D ELSE nm / nullif(kts, 0D) * 3600D END"),
    "hms": (
        "s DOUBLE", "STRING",
        f"format_string('%02d:%02d:%02d', CAST({_SECONDS} AS BIGINT) div 3600, CAST({_SECONDS} AS BIGINT) % 3600 div 60, CAST({_SECONDS} AS BIGINT) % 60)",
    ),
    "circular_diff": ("a DOUBLE, b DOUBLE", "DOUBLE", "least(pmod(a - b, 360D), 360D - pmod(a - b, 360D))"),
    "axis_diff": (
        "a DOUBLE, b DOUBLE", "DOUBLE",
        "least(least(pmod(a - b, 360D), 360D - pmod(a - b, 360D)), 180D - least(pmod(a - b, 360D), 360D - pmod(a - b, 360D)))",
    ),
    "lcc_x": ("lat DOUBLE, lon DOUBLE", "DOUBLE", f"{_S} / pow({_T}, {_N}) * sin({_N} * radians(lon - 35D))"),
    "lcc_y": ("lat DOUBLE, lon DOUBLE", "DOUBLE", f"{_R} - {_S} / pow({_T}, {_N}) * cos({_N} * radians(lon - 35D))"),
    "lcc_lat": (
        "x DOUBLE, y DOUBLE", "DOUBLE", f"degrees(2 * atan(pow(hypot(x, {_R} - y) / {_S}, -1D / {_N})) - pi() / 2)",
    ),
    "lcc_lon": ("x DOUBLE, y DOUBLE", "DOUBLE", f"35D + degrees(atan2(x, {_R} - y)) / {_N}"),
    "world_px_x": ("lon DOUBLE, z INT", "DOUBLE", "(lon + 180D) / 360D * 256 * pow(2D, z)"),
    "world_px_y": (
        "lat DOUBLE, z INT", "DOUBLE",
        f"(1D - ln(tan(pi() / 4 + radians(greatest(-{_LIMIT}, least({_LIMIT}, lat))) / 2)) / pi()) / 2D * 256 * pow(2D, z)",
    ),
    "tile_x": ("lon DOUBLE, z INT", "INT", "CAST(floor((lon + 180D) / 360D * pow(2D, z)) AS INT)"),
    "tile_y": (
        "lat DOUBLE, z INT", "INT",
        f"CAST(floor((1D - ln(tan(pi() / 4 + radians(greatest(-{_LIMIT}, least({_LIMIT}, lat))) / 2)) / pi()) / 2D * pow(2D, z)) AS INT)",
    ),
    "metres_per_pixel": (
        "lat DOUBLE, z INT", "DOUBLE",
        f"{mercator.EARTH_CIRCUMFERENCE_M!r}D * cos(radians(greatest(-{_LIMIT}, least({_LIMIT}, lat)))) / (256 * pow(2D, z))",
    ),
    "coord_lat": ("token STRING", "DOUBLE", _coord(1, 3, "S")),
    "coord_lon": ("token STRING", "DOUBLE", _coord(4, 6, "W")),
    "coord_text": ("lat DOUBLE, lon DOUBLE", "STRING", f"concat({_text('lat', 2, 'N', 'S')}, {_text('lon', 3, 'E', 'W')})"),
    "bisector": (
        "a DOUBLE, b DOUBLE", "DOUBLE",
        f"CASE WHEN abs({_EAST}) < 1e-9D AND abs({_NORTH}) < 1e-9D THEN pmod(a + 90D, 360D) ELSE pmod(degrees(atan2({_EAST}, {_NORTH})), 360D) END",
    ),
    "view_width": (
        "lat DOUBLE, lon_west DOUBLE, lon_east DOUBLE", "DOUBLE", f"2 * {geo.VIEW_EARTH_RADIUS_NM!r}D * atan2(sqrt({_VIEW}), sqrt(1 - {_VIEW}))",
    ),
    "leg_fraction": (_LEG, "DOUBLE", _FRACTION),
    "leg_distance": (
        _LEG, "DOUBLE",
        f"CASE WHEN {_FRACTION} IS NULL OR {_FRACTION} <= 0 THEN {_nm('p_lat', 'p_lon', 'a_lat', 'a_lon')} "
        f"WHEN {_FRACTION} >= 1 THEN {_nm('p_lat', 'p_lon', 'b_lat', 'b_lon')} ELSE hypot({_PX} - {_FRACTION} * {_BX}, {_PY} - {_FRACTION} * {_BY}) END",
    ),
    "leg_overshoot": (
        _LEG, "DOUBLE", f"CASE WHEN {_FRACTION} IS NULL THEN 0D ELSE greatest(0D, -{_FRACTION}, {_FRACTION} - 1D) * sqrt({_BX} * {_BX} + {_BY} * {_BY}) END",
    ),
    "leg_side": (_LEG, "INT", f"CASE WHEN {_CROSS} > 1e-12D THEN 1 WHEN {_CROSS} < -1e-12D THEN -1 ELSE 0 END"),
    # one row of a sheet's fit: (a, b, tx) gives u, (c, d, ty) gives v
    "sheet_coord": ("lat DOUBLE, lon DOUBLE, m1 DOUBLE, m2 DOUBLE, shift DOUBLE", "DOUBLE", f"m1 * ({_LCC_X}) + m2 * ({_LCC_Y}) + shift"),
    "sheet_lat": (_UV, "DOUBLE", f"degrees(2 * atan(pow(hypot({_AX}, {_R} - ({_AY})) / {_S}, -1D / {_N})) - pi() / 2)"),
    "sheet_lon": (_UV, "DOUBLE", f"35D + degrees(atan2({_AX}, {_R} - ({_AY}))) / {_N}"),
    # a page coordinate on a crop, 0 to 1, NULL outside of it
    "crop_coord": (
        "at DOUBLE, dpi DOUBLE, offset_px DOUBLE, size_px DOUBLE", "DOUBLE",
        "CASE WHEN size_px > 0 AND (at * (dpi / 72D) - offset_px) / size_px BETWEEN 0D AND 1D THEN (at * (dpi / 72D) - offset_px) / size_px END",
    ),
    # twice the signed area of an outline
    "ring_area2": (
        "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", "DOUBLE",
        "aggregate(sequence(1, size(ring)), 0D, (s, i) -> CASE WHEN size(ring) = 0 THEN 0D ELSE s + ring[(i - 1) % size(ring)].x * ring[i % size(ring)].y - ring[i % size(ring)].x * ring[(i - 1) % size(ring)].y END)",
    ),
    # compass direction of an outline's longest diagonal, the first of several; NULL without one
    "ring_axis": (
        "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", "DOUBLE",
        f"CASE WHEN ({_DIAGONAL}).d2 >= 1e-12D THEN pmod(degrees(atan2(({_DIAGONAL}).dx, -({_DIAGONAL}).dy)), 360D) END",
    ),
    "canonical_url": (
        "url STRING", "STRING",
        f"concat(CASE WHEN {_SCHEME} = '' THEN '' ELSE concat(lower({_SCHEME}), ':') END, {_HOST}, "
        f"array_join(transform(regexp_extract_all(substr({_TRIMMED}, length({_SCHEME}) + CASE WHEN {_SCHEME} = '' THEN 1 ELSE 2 END + length({_HOST})), "
        f"r'([{_URL}]+|[^{_URL}]+)', 1), p -> CASE WHEN p RLIKE r'^[{_URL}]' THEN p ELSE replace(url_encode(p), '+', '%20') END), ''))",
    ),
}

def _inline(name: str, **args: str) -> str:
    """A scalar's expression with other names for its parameters (generators cannot call it)."""
    body = SCALARS[name][2]
    for param, value in args.items():
        body = re.sub(rf"\b{param}\b", value, body)
    return body


TILES_FOR_BOX = f"""
CREATE OR REPLACE TEMPORARY FUNCTION tiles_for_box(min_lat DOUBLE, max_lat DOUBLE, min_lon DOUBLE, max_lon DOUBLE, zoom INT)
RETURNS TABLE (z INT, x INT, y INT)
RETURN SELECT q.z, t.x, s.y FROM
  inline(filter(array(named_struct('z', zoom, 'ok', max_lat >= min_lat AND max_lon >= min_lon,
    'x0', {_inline("tile_x", lon="min_lon", z="zoom")}, 'x1', {_inline("tile_x", lon="max_lon", z="zoom")},
    'y0', {_inline("tile_y", lat="max_lat", z="zoom")}, 'y1', {_inline("tile_y", lat="min_lat", z="zoom")})), q -> q.ok)) AS q,
  LATERAL explode(sequence(q.x0, q.x1)) AS t(x), LATERAL explode(sequence(q.y0, q.y1)) AS s(y)
"""


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for name, (params, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark.sql(TILES_FOR_BOX)
    return [*SCALARS, "tiles_for_box"]
