"""Domain tables derived from the star-schema test tables.

Each view is one SELECT of integer arithmetic that Spark and DuckDB evaluate
alike, apart from three spellings that ``render`` swaps: integer division,
row expansion and calendar functions. Fractional literals are doubles.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("supplier", "part", "orders", "lineitem", "events", "customer", "nation")

VIEWS: dict[str, str] = {}
VIEWS["waypoint"] = """
SELECT s_suppkey AS idx,
  concat(chr(CAST(65 + (s_suppkey DIV 456976) % 26 AS INT)), chr(CAST(65 + (s_suppkey DIV 17576) % 26 AS INT)),
         chr(CAST(65 + (s_suppkey DIV 676) % 26 AS INT)), chr(CAST(65 + (s_suppkey DIV 26) % 26 AS INT)),
         chr(CAST(65 + s_suppkey % 26 AS INT))) AS code,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('Fix ', CAST(s_suppkey % 37 AS VARCHAR(20))) END AS name_he,
  CASE WHEN s_suppkey % 11 = 0 THEN 'ARP' WHEN s_suppkey % 3 = 0 THEN 'M' WHEN s_suppkey % 3 = 1 THEN 'R' ELSE '' END AS rtype,
  29.4e0 + CAST((s_suppkey * 37) % 390 AS DOUBLE) / 100e0 AS lat,
  34.1e0 + CAST((s_suppkey * 53) % 180 AS DOUBLE) / 100e0 AS lon
FROM supplier
"""
# Plan points: k picks a waypoint (0..96); every 4th point is an intermediate, some of
# them exact or drifting copies of their predecessor, and some waypoints repeat.
VIEWS["plan_raw"] = """
SELECT plan_id, n_points, CAST(j DIV 65536 AS INT) AS block, CAST(j AS INT) AS seq,
  (plan_id + j) % 4 <> 3 AS is_wp,
  CASE WHEN j % 5 = 4 AND (plan_id + j) % 4 <> 0 THEN (plan_id * 7 + (j - 1) * 13) % 97
       ELSE (plan_id * 7 + j * 13) % 97 END AS k,
  CASE WHEN (plan_id + j) % 4 = 3 THEN (plan_id % 5) * 4e-7 ELSE 0e0 END AS eps
FROM (SELECT o_orderkey AS plan_id, CAST(3 + o_orderkey % 6 AS INT) AS n_points,
        EXPAND(0, 2 + o_orderkey % 6) AS j FROM orders) t
"""
VIEWS["plan_point"] = """
SELECT plan_id, n_points, block, seq, is_wp,
  CASE WHEN is_wp THEN concat('AA', chr(CAST(65 + (k DIV 676) % 26 AS INT)), chr(CAST(65 + (k DIV 26) % 26 AS INT)), chr(CAST(65 + k % 26 AS INT))) END AS code,
  CASE WHEN is_wp AND k % 5 <> 0 THEN concat('Fix ', CAST(k % 37 AS VARCHAR(20))) WHEN is_wp THEN '' END AS name,
  29.4e0 + CAST((k * 37) % 390 AS DOUBLE) / 100e0 + CASE WHEN is_wp THEN 0e0 WHEN plan_id % 3 = 0 THEN 0e0 ELSE 0.03e0 END + eps AS lat,
  34.1e0 + CAST((k * 53) % 180 AS DOUBLE) / 100e0 + CASE WHEN is_wp THEN 0e0 WHEN plan_id % 3 = 0 THEN 0e0 ELSE 0.02e0 END AS lon
FROM plan_raw
"""
# Long plans of very unequal length: a third of all points belongs to one of them, positions have gaps.
VIEWS["trail_row"] = """SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 + l_orderkey DIV 600 END AS plan_id, l_orderkey * 8 + l_linenumber AS seq, l_linenumber <> 4 AS is_wp,
        CASE WHEN l_linenumber IN (2, 3) THEN l_suppkey % 2 ELSE l_partkey % 97 END AS k
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) d"""
TRAIL_POINT = """
SELECT plan_id, {span} AS n_points, CAST(seq DIV 4096 AS INT) AS block, seq, is_wp,
  CASE WHEN is_wp THEN concat('AA', chr(CAST(65 + (k DIV 676) % 26 AS INT)), chr(CAST(65 + (k DIV 26) % 26 AS INT)), chr(CAST(65 + k % 26 AS INT))) END AS code,
  CAST(NULL AS VARCHAR(9)) AS name,
  29.4e0 + CAST((k * 37) % 390 AS DOUBLE) / 100e0 + CASE WHEN is_wp THEN 0e0 ELSE 0.0355e0 + CAST((seq DIV 8) % 1000 AS DOUBLE) / 100000e0 END AS lat,
  34.1e0 + CAST((k * 53) % 180 AS DOUBLE) / 100e0 AS lon
FROM {rows}
"""
VIEWS["trail_point"] = TRAIL_POINT.format(span="CAST(max(seq) OVER (PARTITION BY plan_id) + 1 AS INT)", rows=f"({VIEWS['trail_row']}) t")
VIEWS["trail_span"] = """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 + l_orderkey DIV 600 END AS plan_id, CAST(max(l_orderkey * 8 + l_linenumber) + 1 AS INT) AS n_points
FROM lineitem GROUP BY 1
"""
# Plans that drift: a third of all points belongs to one, whose points are near-equal from
# one waypoint to the next over many blocks; all others are short.
VIEWS["drift_row"] = """SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 + l_orderkey DIV 30 END AS plan_id, l_orderkey AS k, l_linenumber AS m
      FROM lineitem GROUP BY l_orderkey, l_linenumber"""
DRIFT_POINT = """
SELECT plan_id, n_points, CAST(i DIV 4096 AS INT) AS block, CAST(i AS INT) AS seq, since = 0 AS is_wp,
  CASE WHEN since = 0 THEN concat('DR', chr(CAST(65 + (i DIV 26) % 26 AS INT)), chr(CAST(65 + i % 26 AS INT))) END AS code,
  CAST(NULL AS VARCHAR(9)) AS name, 29.5e0 + CAST(i AS DOUBLE) * 4e-7 AS lat, 34.5e0 AS lon, since
FROM (SELECT plan_id, n_points, i, CASE WHEN plan_id = 0 THEN i % 50001 ELSE i % 40 END AS since
  FROM {rows}) u
"""
VIEWS["drift_point"] = DRIFT_POINT.format(rows=f"""(SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY k, m) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS n_points
    FROM ({VIEWS["drift_row"]}) d) t""")
def code_sql(k: str) -> str:
    """Five-letter base-26 code of an integer expression, as in ``waypoint``."""
    parts = ", ".join(f"chr(CAST(65 + (({k}) DIV {26 ** e}) % 26 AS INT))" for e in (4, 3, 2, 1, 0))
    return f"concat({parts})"


# One plan line per order: valid lines, unknown codes, doubled spaces, bad minutes, stray text.
VIEWS["plan_text"] = f"""
SELECT o_orderkey AS plan_id,
  concat(CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE '' END,
    CASE WHEN o_orderkey % 23 = 5 THEN 'ZZZZZ' ELSE {code_sql("(o_orderkey * 7) % 97")} END, ' ',
    CASE WHEN o_orderkey % 4 = 0 THEN concat('31', lpad(CAST((o_orderkey * 11) % 63 AS VARCHAR(2)), 2, '0'), 'N034',
                                              lpad(CAST((o_orderkey * 17) % 60 AS VARCHAR(2)), 2, '0'), 'E')
         WHEN o_orderkey % 31 = 2 THEN '' WHEN o_orderkey % 37 = 3 THEN 'ab12'
         ELSE {code_sql("(o_orderkey * 7 + 13) % 97")} END, ' ',
    {code_sql("(o_orderkey * 7 + 26) % 97")},
    CASE WHEN o_orderkey % 4 = 1 THEN concat(' ', {code_sql("(o_orderkey * 5 + 39) % 101")}) ELSE '' END,
    CASE WHEN o_orderkey % 41 = 0 THEN ' 9001N18000W' ELSE '' END) AS text
FROM orders
"""
# Hand edits on the first leg of every plan: six edits, some of them invalid.
VIEWS["leg_edit"] = f"""
SELECT plan_id, {code_sql("(plan_id * 7) % 97")} AS from_label, {code_sql("(plan_id * 7 + 13) % 97")} AS to_label,
  CASE WHEN e = 0 THEN 'distance' WHEN e = 1 THEN 'altitude' WHEN e = 2 THEN 'bearing' WHEN e = 3 THEN 'distance'
       WHEN e = 4 THEN 'freq' ELSE 'ctr' END AS field,
  CASE WHEN e = 0 OR e = 3 THEN
      CASE WHEN (plan_id + e) % 8 = 0 THEN '0.04' WHEN (plan_id + e) % 8 = 1 THEN '1.25' WHEN (plan_id + e) % 8 = 2 THEN ' 12.34 '
           WHEN (plan_id + e) % 8 = 3 THEN 'abc' WHEN (plan_id + e) % 8 = 4 THEN '0' WHEN (plan_id + e) % 8 = 5 THEN '9999.99'
           ELSE concat(CAST(plan_id % 300 AS VARCHAR(10)), '.', CAST(plan_id % 10 AS VARCHAR(2)), '5') END
    WHEN e = 1 THEN CASE WHEN plan_id % 4 = 0 THEN '1600,800' WHEN plan_id % 4 = 1 THEN '0' WHEN plan_id % 4 = 2 THEN '900 , 2100' ELSE '' END
    WHEN e = 2 THEN CASE WHEN plan_id % 3 = 0 THEN '400' WHEN plan_id % 3 = 1 THEN '7' ELSE '360' END
    WHEN e = 4 THEN CASE WHEN plan_id % 2 = 0 THEN '123.4' ELSE '123.45' END ELSE 'Center' END AS text,
  CAST(e AS INT) AS edit_no
FROM (SELECT o_orderkey AS plan_id, EXPAND(0, 5) AS e FROM orders) t
"""
VIEWS["click"] = """
SELECT CAST(o * 4 + j AS BIGINT) AS click_id, o AS plan_id,
  29.4e0 + CAST((o * 37 + j * 11) % 3900 AS DOUBLE) / 1000e0 AS lat, 34.1e0 + CAST((o * 53 + j * 7) % 1800 AS DOUBLE) / 1000e0 AS lon
FROM (SELECT o_orderkey AS o, EXPAND(0, 1) AS j FROM orders) t
"""
VIEWS["plan_click"] = """
SELECT CAST(plan_id * 16 + seq AS BIGINT) AS click_id, plan_id, lat + CAST(plan_id % 11 AS DOUBLE) / 100e0 AS lat, lon + CAST(plan_id % 13 AS DOUBLE) / 200e0 AS lon
FROM plan_point
"""
VIEWS["ping"] = """
SELECT date_trunc('hour', ts) AS snapshot_ts, event_id AS pos, event_id AS cid,
  concat('CS', CAST(user_id AS VARCHAR(20))) AS callsign,
  28.8e0 + CAST((event_id * 37) % 5600 AS DOUBLE) / 1000e0 AS lat, 33.2e0 + CAST((event_id * 53) % 3600 AS DOUBLE) / 1000e0 AS lon,
  (event_id * 131) % 42000 - 300 AS altitude_ft, (event_id * 53) % 300 - 5 AS groundspeed_kts,
  CAST((event_id * 7) % 360 AS INT) AS heading_deg,
  CASE event_id % 9 WHEN 0 THEN 'B738' WHEN 1 THEN 'A388/X' WHEN 2 THEN 'C172' WHEN 3 THEN 'XX/h/b738' WHEN 4 THEN 'H/A333/L'
    WHEN 5 THEN ' c172 ' WHEN 6 THEN 'ZZZZ' WHEN 7 THEN '/A388' END AS aircraft_type,
  CASE event_id % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'I' WHEN 2 THEN ' v ' ELSE '' END AS flight_rules,
  CASE WHEN event_id % 3 = 0 THEN 'LLBG' ELSE '' END AS departure, CASE WHEN event_id % 5 = 0 THEN 'LLHA' ELSE '' END AS arrival
FROM events
"""
VIEWS["wake_dim"] = """
SELECT * FROM (VALUES ('B738', 'M'), ('A333', 'H'), ('A388', 'J'), ('C172', 'L'), ('B744', 'H'), ('P28A', 'L')) AS t(type_code, wake)
"""
# The fields of feed entries (two per event) before they become JSON text.
VIEWS["feed_elem"] = """
SELECT event_id AS doc, CAST(j AS INT) AS pos, date_trunc('second', ts) AS snapshot_ts,
  event_id * 2 + j AS cid, (event_id + j) % 17 = 0 AS no_cid, (event_id + j) % 19 = 1 AS no_lat, (event_id + j) % 23 = 5 AS not_object,
  28.8e0 + CAST((event_id * 37) % 5600 AS DOUBLE) / 1000e0 AS lat, 33.2e0 + CAST((event_id * 53) % 3600 AS DOUBLE) / 1000e0 AS lon,
  (event_id + j) % 13 AS alt_kind, (event_id * 131) % 42000 AS alt, (event_id * 7 + j) % 720 - 180 AS heading,
  (event_id + j) % 7 AS plan_kind, event_id % 29 = 3 AS broken, event_id % 31 = 4 AS no_list
FROM (SELECT event_id, ts, EXPAND(0, 1) AS j FROM events) t
"""
# Unique by (provider, z, x, y): a third of all files belongs to one provider, the rest to providers of 2,667 each.
VIEWS["inventory"] = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'prov0' ELSE concat('prov', CAST(event_id DIV 4000 + 1 AS VARCHAR(20))) END AS provider, z,
  CAST(CASE z WHEN 12 THEN 2432 WHEN 13 THEN 4867 WHEN 14 THEN 9736 ELSE 19475 END + i % 25 AS INT) AS x,
  CAST(CASE z WHEN 12 THEN 1640 WHEN 13 THEN 3286 WHEN 14 THEN 6580 ELSE 13170 END + (i DIV 25) % 700 + i DIV 17500 * 1000 AS INT) AS y,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE (event_id * 7919) % 20000 + 1 END AS bytes,
  CASE WHEN event_id % 5 = 0 THEN date_trunc('day', ts) ELSE ts END AS mtime
FROM (SELECT event_id, ts, CAST(12 + event_id % 4 AS INT) AS z,
        CASE WHEN event_id % 3 = 0 THEN event_id DIV 12 ELSE (event_id % 4000) DIV 4 END AS i FROM events) t
"""
VIEWS["tile_file"] = """
SELECT concat('/cache/', provider, '/', CAST(z AS VARCHAR(3)), '/',
    CASE WHEN bytes % 53 = 7 THEN 'x' ELSE '' END, CAST(x AS VARCHAR(9)), '/', CAST(y AS VARCHAR(9)),
    CASE WHEN bytes % 41 = 3 THEN '.jpg.tmp' WHEN bytes % 41 = 4 THEN '.png' ELSE '.jpg' END) AS path,
  bytes AS length, mtime AS modificationTime
FROM inventory
"""
VIEWS["box"] = """
SELECT s_suppkey AS box_id, 29.3e0 + CAST((s_suppkey * 37) % 390 AS DOUBLE) / 100e0 AS min_lat,
  29.3e0 + CAST((s_suppkey * 37) % 390 AS DOUBLE) / 100e0 + CASE WHEN s_suppkey % 13 = 0 THEN -0.1e0 ELSE CAST(s_suppkey % 20 AS DOUBLE) / 100e0 END AS max_lat,
  34.0e0 + CAST((s_suppkey * 53) % 180 AS DOUBLE) / 100e0 AS min_lon,
  34.0e0 + CAST((s_suppkey * 53) % 180 AS DOUBLE) / 100e0 + CAST(s_suppkey % 17 AS DOUBLE) / 100e0 AS max_lon
FROM supplier
"""
VIEWS["viewport"] = """
SELECT event_id AS view_id, 29.4e0 + CAST((event_id * 37) % 3900 AS DOUBLE) / 1000e0 AS min_lat,
  29.4e0 + CAST((event_id * 37) % 3900 AS DOUBLE) / 1000e0 + CAST(20 + event_id % 30 AS DOUBLE) / 1000e0 AS max_lat,
  34.1e0 + CAST((event_id * 53) % 1800 AS DOUBLE) / 1000e0 AS min_lon,
  34.1e0 + CAST((event_id * 53) % 1800 AS DOUBLE) / 1000e0 + CAST(20 + event_id % 40 AS DOUBLE) / 1000e0 AS max_lon
FROM events
"""
VIEWS["bulk_point"] = """
SELECT 29.4e0 + CAST((l_partkey * 37 + l_suppkey * 11) % 39000 AS DOUBLE) / 10000e0 AS lat,
  34.1e0 + CAST((l_partkey * 53 + l_orderkey) % 18000 AS DOUBLE) / 10000e0 AS lon
FROM lineitem
"""
VIEWS["attempt"] = """
SELECT CAST(12 + (event_id DIV 7) % 4 AS INT) AS z, CAST((event_id DIV 7) % 1000 AS INT) AS x, CAST((event_id DIV 7) DIV 1000 AS INT) AS y,
  CAST(event_id % 7 + CASE WHEN event_id % 7 > 2 THEN event_id DIV 7 % 5 ELSE 0 END AS INT) AS attempt_no,
  CAST(CASE (event_id * 7919 DIV 13) % 11 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 403
    WHEN 7 THEN 503 WHEN 8 THEN 200 WHEN 9 THEN 429 END AS INT) AS status,
  (event_id * 31) % 600 AS bytes,
  CASE WHEN event_id % 5 = 0 THEN '12' WHEN event_id % 5 = 1 THEN 'soon' WHEN event_id % 5 = 2 THEN '-3' WHEN event_id % 5 = 3 THEN '0' END AS retry_after,
  CASE WHEN (event_id * 7919 DIV 13) % 11 = 10 THEN 'timeout' END AS error
FROM events
"""
# Seven anchors per sheet, two sheets per edition; three codes are shared inside an edition.
VIEWS["anchor"] = """
SELECT p_partkey DIV 14 AS edition, CASE WHEN (p_partkey DIV 7) % 2 = 0 THEN 'north' ELSE 'south' END AS sheet,
  CASE WHEN i < 3 THEN concat(' shr', CAST(i AS VARCHAR(2)))
       ELSE concat(CASE WHEN (p_partkey DIV 7) % 2 = 0 THEN 'N' ELSE 'S' END,
                   CAST(CASE WHEN (p_partkey DIV 14) % 19 = 5 AND i = 6 THEN 5 ELSE i END AS VARCHAR(2))) END AS code,
  CASE WHEN (p_partkey DIV 14) % 23 = 7 THEN 31e0 ELSE lat END AS lat, lon,
  (lon - 34.0e0) / 2.2e0 + CAST(i % 3 AS DOUBLE) / 5000e0 AS u,
  CASE WHEN (p_partkey DIV 7) % 2 = 0 THEN (33.5e0 - lat) / 2.6e0 ELSE (31.6e0 - lat) / 2.4e0 END + CAST(i % 4 AS DOUBLE) / 7000e0 + (lon - 35e0) / 90e0 AS v
FROM (SELECT p_partkey, p_partkey % 7 AS i,
    CASE WHEN p_partkey % 7 < 3 THEN 31.3e0 + CAST(p_partkey % 7 AS DOUBLE) / 20e0
         WHEN (p_partkey DIV 7) % 2 = 0 THEN 31.6e0 + CAST((p_partkey * 37) % 170 AS DOUBLE) / 100e0
         ELSE 29.5e0 + CAST((p_partkey * 37) % 170 AS DOUBLE) / 100e0 END AS lat,
    CASE WHEN p_partkey % 7 < 3 THEN 34.6e0 + CAST((p_partkey % 7) * (p_partkey % 7) AS DOUBLE) / 6e0 ELSE 34.2e0 + CAST((p_partkey * 53) % 170 AS DOUBLE) / 100e0 END AS lon
  FROM part) t
"""
VIEWS["sheet_size"] = """
SELECT edition, CAST(4000 + edition % 7 * 100 AS DOUBLE) AS north_w, CAST(6000 + edition % 5 * 100 AS DOUBLE) AS north_h,
  CAST(4100 + edition % 3 * 100 AS DOUBLE) AS south_w, CAST(5600 + edition % 4 * 100 AS DOUBLE) AS south_h
FROM (SELECT DISTINCT p_partkey DIV 14 AS edition FROM part) t
"""
# Positions and scene points to place on the sheets of an edition.
VIEWS["chart_item"] = """
SELECT p_partkey AS item_id, p_partkey DIV 14 AS edition, CASE WHEN p_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS sheet,
  29.0e0 + CAST((p_partkey * 41) % 470 AS DOUBLE) / 100e0 AS lat, 33.7e0 + CAST((p_partkey * 59) % 270 AS DOUBLE) / 100e0 AS lon,
  CAST((p_partkey * 97) % 5000 AS DOUBLE) AS scene_x, CAST((p_partkey * 89) % 11000 AS DOUBLE) AS scene_y,
  CAST((p_partkey * 7) % 100 AS DOUBLE) / 100e0 AS u, CAST((p_partkey * 13) % 100 AS DOUBLE) / 100e0 AS v,
  CAST(12 AS INT) AS z, CAST(2434 + p_partkey % 24 AS INT) AS x, CAST(1645 + p_partkey % 50 AS INT) AS y
FROM part
"""
# Raw reporting-point cells: 500 rows per edition, two sheets, strict and recognised texts,
# repeated rows, missing hemispheres, letters read for digits.
VIEWS["cell"] = f"""
SELECT edition, CASE WHEN edition % 2 = 0 THEN 'vec' ELSE 'rec' END AS mode_id,
  CASE WHEN i < 250 THEN 'north' ELSE 'south' END AS sheet, CAST(i DIV 250 AS INT) AS sheet_ord, CAST(i % 250 AS INT) AS ord,
  CASE WHEN edition % 2 = 0 THEN 'vector' ELSE 'recognised' END AS strategy,
  CASE WHEN k % 29 = 3 THEN 'Code Letter' WHEN k % 31 = 4 THEN 'AB1' ELSE {code_sql("k0")} END AS code,
  CASE WHEN k % 17 = 3 THEN concat(CAST(d AS VARCHAR(2)), 'x')
       WHEN edition % 2 = 0 THEN concat(CAST(d AS VARCHAR(2)), '° ', lpad(CAST(m AS VARCHAR(2)), 2, '0'), ' ', chr(39), lpad(CAST(s AS VARCHAR(2)), 2, '0'), '.5" N')
       ELSE replace(replace(concat(CAST(d AS VARCHAR(2)), '.', lpad(CAST(m AS VARCHAR(2)), 2, '0'), ' ', lpad(CAST(s AS VARCHAR(2)), 2, '0'), 'N'), '0', 'O'), '1', 'l') END AS lat_text,
  CASE WHEN edition % 2 = 0 THEN concat(CAST(od AS VARCHAR(2)), '°', CAST(om AS VARCHAR(2)), chr(39), lpad(CAST(s AS VARCHAR(2)), 2, '0'), '"E')
       ELSE replace(concat(CAST(od AS VARCHAR(2)), lpad(CAST(om AS VARCHAR(2)), 2, '0'), lpad(CAST(s AS VARCHAR(2)), 2, '0')), '5', 'S') END AS lon_text,
  d, m, s, od, om, k, CAST(k0 % 17 AS INT) AS name_kind
FROM (
  SELECT *, CAST(29 + k0 * 37 % 4 AS INT) AS d, CAST(k0 * 7 % 60 AS INT) AS m, CAST(k0 * 11 % 60 AS INT) AS s,
    CAST(34 + k0 % 2 AS INT) AS od, CAST(k0 * 13 % 60 AS INT) AS om
  FROM (SELECT p_partkey AS k, p_partkey DIV 500 AS edition, p_partkey % 500 AS i,
          CASE WHEN p_partkey % 10 = 7 THEN p_partkey - 3 ELSE p_partkey END AS k0 FROM part) p
) q
"""
# Short plans (six points) over the chart, and chart arrows in small stacks.
VIEWS["hop_point"] = """
SELECT plan_id, 6 AS n_points, 0 AS block, seq, is_wp, CASE WHEN is_wp THEN concat('W', CAST(seq AS VARCHAR(3))) END AS code, CAST(NULL AS VARCHAR(9)) AS name, lat, lon
FROM (
  SELECT c AS plan_id, CAST(j AS INT) AS seq, (c + j) % 4 <> 3 AS is_wp,
    29.6e0 + CAST((c * 37) % 350 AS DOUBLE) / 100e0 + CAST(j * ((c * 7) % 9 - 4) AS DOUBLE) / 25e0 + CAST(j % 2 * ((c * 3) % 5) AS DOUBLE) / 20e0 AS lat,
    34.2e0 + CAST((c * 53) % 160 AS DOUBLE) / 100e0 + CAST(j * ((c * 11) % 9 - 4) AS DOUBLE) / 25e0 AS lon
  FROM (SELECT c_custkey AS c, EXPAND(0, 5) AS j FROM customer) t
) u
"""
VIEWS["chart_arrow"] = """
SELECT 'north' AS sheet, s_suppkey AS arrow_no,
  29.50137e0 + CAST(((s_suppkey DIV 3) * 61) % 370 AS DOUBLE) / 100e0 + CAST(s_suppkey % 3 AS DOUBLE) / 400e0 AS lat,
  34.15e0 + CAST(((s_suppkey DIV 3) * 43) % 170 AS DOUBLE) / 100e0 + CAST(s_suppkey % 3 AS DOUBLE) / 700e0 AS lon,
  CAST(((s_suppkey DIV 3) * 47 + (s_suppkey % 3) * 5) % 360 AS DOUBLE) AS bearing_deg, (s_suppkey DIV 3) % 4 = 0 AS bidirectional,
  CAST(300 + (s_suppkey * 700) % 9000 AS INT) AS alt1, CAST(300 + (s_suppkey DIV 3) * 700 % 9000 AS INT) AS alt2
FROM supplier
"""
# Chart drawings: arrows up, right and down, rectangles, off-colour shapes; 200 per sheet.
VIEWS["drawing"] = """
SELECT p_partkey DIV 400 AS edition, CASE WHEN (p_partkey DIV 200) % 2 = 0 THEN 'north' ELSE 'south' END AS sheet, p_partkey AS drawing_id,
  CAST(p_partkey % 5 AS INT) AS kind, CAST(50 + (p_partkey % 200) % 20 * 40 + p_partkey % 7 AS DOUBLE) AS x0, CAST(60 + (p_partkey % 200) DIV 20 * 40 + p_partkey % 3 AS DOUBLE) AS y0,
  CASE WHEN p_partkey % 5 = 1 THEN 20e0 ELSE 12e0 END AS w, CASE WHEN p_partkey % 5 = 1 THEN 12e0 ELSE 20e0 END AS h
FROM part
"""
VIEWS["span"] = """
SELECT edition, sheet, drawing_id * 2 + j AS span_id, drawing_id, CAST(j AS INT) AS j,
  CASE WHEN drawing_id % 11 = 5 THEN '450' WHEN drawing_id % 11 = 6 THEN '12a' WHEN drawing_id % 11 = 7 THEN '9600'
       WHEN j = 1 AND drawing_id % 2 = 0 THEN '300' ELSE concat(' ', CAST(300 + (drawing_id * 700 + j * 1100) % 9200 AS VARCHAR(6))) END AS text,
  x0 + 2 AS x0, y0 + 2 + 7 * j AS y0, x0 + 8 AS x1, y0 + 6 + 7 * j AS y1
FROM (SELECT edition, sheet, drawing_id, x0, y0, EXPAND(0, 1) AS j FROM drawing) t
"""
# Catalogues of 60 waypoints per edition to choose anchors from.
VIEWS["anchor_pool"] = f"""
SELECT p_partkey DIV 60 AS edition, p_partkey % 60 AS ord,
  CASE WHEN p_partkey % 60 = 7 THEN 'SDROT' WHEN p_partkey % 60 = 11 THEN 'OMMER' WHEN p_partkey % 60 = 20 AND (p_partkey DIV 60) % 3 <> 0 THEN 'engdi' ELSE {code_sql("p_partkey")} END AS code,
  CASE WHEN p_partkey % 13 = 0 THEN ' Arp' ELSE '' END AS reporting_type,
  CASE WHEN p_partkey % 60 IN (7, 11, 20) THEN 31.3e0 + CAST(p_partkey % 60 AS DOUBLE) / 100e0 ELSE 29.5e0 + CAST((p_partkey * 7919) % 38000 AS DOUBLE) / 10007e0 END AS lat,
  34.2e0 + CAST((p_partkey * 6007) % 17000 AS DOUBLE) / 10009e0 AS lon
FROM part
"""
# Route edits per user, a third of all on one plan: adds on or beside waypoints, removes, and a few clears.
VIEWS["route_edit"] = """
SELECT plan_id, event_id AS edit_no, edit_ts,
  CASE WHEN event_id % 97 = 0 AND (plan_id > 0 OR event_id % 10 = 0) THEN 'clear' WHEN event_id % 5 = 4 THEN 'remove' ELSE 'add' END AS action,
  29.4e0 + CAST((k * 37) % 390 AS DOUBLE) / 100e0 + CASE WHEN event_id % 3 = 0 THEN 0.04e0 ELSE 0.004e0 END AS lat,
  34.1e0 + CAST((k * 53) % 180 AS DOUBLE) / 100e0 AS lon
FROM (SELECT event_id, CASE WHEN event_id % 9 < 3 THEN 0 ELSE user_id + 1 END AS plan_id, date_trunc('second', ts) AS edit_ts,
        (event_id - CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END) * 7 % 97 AS k FROM events) t
"""
# Fingerprints of chart files: present state and what the last ingest recorded.
VIEWS["source_now"] = """
SELECT p_partkey DIV 2 AS edition, CASE WHEN p_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS sheet, p_partkey * 1000 AS mtime_ns,
  CASE WHEN p_partkey % 23 = 4 THEN NULL ELSE p_partkey * 7 END AS size, 'https://charts.example/a%20b/x.pdf' AS url,
  CAST(p_partkey AS DOUBLE) AS layout_x, 5e0 AS layout_y, CASE WHEN p_partkey % 41 = 7 THEN NULL ELSE 1e0 END AS layout_scale
FROM part WHERE p_partkey % 29 <> 8
"""
VIEWS["source_then"] = """
SELECT p_partkey DIV 2 AS edition, CASE WHEN p_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS sheet,
  p_partkey * 1000 + CASE WHEN p_partkey % 19 = 3 THEN 1 ELSE 0 END AS mtime_ns, p_partkey * 7 AS size,
  CASE WHEN p_partkey % 37 = 9 THEN 'https://charts.example/other.pdf' ELSE 'HTTPS://charts.example/a b/x.pdf' END AS url,
  CAST(p_partkey AS DOUBLE) + CASE WHEN p_partkey % 17 = 2 THEN 0.6e0 WHEN p_partkey % 17 = 3 THEN 0.5e0 ELSE 0e0 END AS layout_x, 5e0 AS layout_y, 1.00005e0 AS layout_scale,
  p_partkey % 43 <> 5 AS version_ok, p_partkey % 47 <> 6 AS valid
FROM part WHERE p_partkey % 31 <> 11
"""
DEPENDS = {"plan_point": ("plan_raw",), "plan_click": ("plan_point",), "tile_file": ("inventory",), "span": ("drawing",)}


def with_dependencies(names: Iterable[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, ()):
            visit(dep)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def render(sql: str, dialect: str) -> str:
    if dialect == "spark":
        sql = re.sub(r"\bEXPAND\(", "explode(sequence(", sql)
        # close the extra parenthesis of explode(sequence(a, b))
        return re.sub(r"(explode\(sequence\((?:[^()]|\([^()]*\))*\))", r"\1)", sql).replace("EPOCH(", "unix_timestamp(")
    sql = re.sub(r"\bEXPAND\(", "unnest(generate_series(", sql)
    sql = re.sub(r"(unnest\(generate_series\((?:[^()]|\([^()]*\))*\))", r"\1)", sql)
    return sql.replace(" DIV ", " // ").replace("EPOCH(", "epoch(")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (or a base table) as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = render(VIEWS[name], "spark")
    names = {n for n in [*BASE_TABLES, *VIEWS] if re.search(rf"\b{n}\b", sql) and n != name}
    frames = {n: load(spark, sf_dir, n) for n in names if re.search(rf"(FROM|JOIN)\s+{n}\b", sql)}
    for n in frames:
        sql = re.sub(rf"(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **frames)


def oracle(select: str, *views: str) -> str:
    """DuckDB text: the derived views as common table expressions, then ``select``."""
    ctes = ",\n".join(f"{v} AS MATERIALIZED ({render(VIEWS[v], 'duckdb')})" for v in with_dependencies(views))
    body = select.strip()
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
