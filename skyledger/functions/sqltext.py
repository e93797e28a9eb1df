"""DuckDB spellings of the geodesy, for the SQL twins only."""

from __future__ import annotations


def gc(a: str, o: str, b: str, q: str) -> str:
    h = (
        f"(pow(sin(radians({b} - {a}) / 2e0), 2) + cos(radians({a})) * cos(radians({b}))"
        f" * pow(sin(radians({q} - {o}) / 2e0), 2))"
    )
    return f"(2e0 * 6371e0 / 1.852e0 * atan2(sqrt({h}), sqrt(1e0 - {h})))"


def bearing(a: str, o: str, b: str, q: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} AND {o} = {q} THEN 0e0 ELSE fmod(degrees(atan2(sin(radians({q} - {o})) * cos(radians({b})),"
        f" cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({q} - {o})))) + 360e0, 360e0) END)"
    )


def coord(lat: str, lon: str) -> str:
    def part(v: str, w: int, pos: str, neg: str) -> str:
        m = f"CAST(round_even((abs({v}) - floor(abs({v}))) * 60e0, 0) AS INT)"
        return (
            f"printf('%0{w}d', CAST(floor(abs({v})) AS INT) + {m} // 60) || printf('%02d', {m} % 60)"
            f" || CASE WHEN {v} >= 0 THEN '{pos}' ELSE '{neg}' END"
        )

    return f"({part(lat, 2, 'N', 'S')} || {part(lon, 3, 'E', 'W')})"


def tile_x(lon: str, z: str) -> str:
    return f"CAST(floor(({lon} + 180e0) / 360e0 * pow(2e0, {z})) AS INT)"


def tile_y(lat: str, z: str) -> str:
    return (
        f"CAST(floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * pow(2e0, {z})) AS INT)"
    )


# Conic projection: cone constant, scale and origin radius spelled out in SQL.
LCC = """
lcc AS (
  SELECT cone, cos(radians(29e0)) * pow(tan(pi() / 4 + radians(29e0) / 2), cone) / cone AS scl,
    cos(radians(29e0)) * pow(tan(pi() / 4 + radians(29e0) / 2), cone) / cone / pow(tan(pi() / 4 + radians(31e0) / 2), cone) AS rho0
  FROM (SELECT ln(cos(radians(29e0)) / cos(radians(33e0))) / ln(tan(pi() / 4 + radians(33e0) / 2) / tan(pi() / 4 + radians(29e0) / 2)) AS cone) c
)"""


def lcc_x(lat: str, lon: str) -> str:
    return f"(scl / pow(tan(pi() / 4 + radians({lat}) / 2), cone) * sin(cone * radians({lon} - 35e0)))"


def lcc_y(lat: str, lon: str) -> str:
    return f"(rho0 - scl / pow(tan(pi() / 4 + radians({lat}) / 2), cone) * cos(cone * radians({lon} - 35e0)))"


def unlcc_lat(x: str, y: str) -> str:
    return f"degrees(2e0 * atan(pow(scl / sqrt(({x}) * ({x}) + (rho0 - ({y})) * (rho0 - ({y}))), 1e0 / cone)) - pi() / 2)"


def unlcc_lon(x: str, y: str) -> str:
    return f"(35e0 + degrees(atan2({x}, rho0 - ({y})) / cone))"
