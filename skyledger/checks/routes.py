"""Route queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyledger.functions import mercator, registry, sqltext
from skyledger.operators import blocks, routes
from skyledger.plans.views import DRIFT_POINT, TRAIL_POINT, load, oracle, render
from skyledger.session import checkpoint_dir
from skyledger.sources import catalogue

QUERIES = {}
ORACLES = {}


def _points(spark, sf):
    raw = load(spark, sf, "plan_point")
    return routes.assemble_plans(raw)


def _legs(spark, sf):
    return routes.plan_legs(load(spark, sf, "plan_point"))


# SQL twin of the assembly: the repeats are found with windows over whole plans, the
# near-equal intermediates with a recursive walk (plans here have at most 8 points).
ASSEMBLED = """
walk AS (
  SELECT plan_id, 0 AS seq, is_wp AS keep,
         CASE WHEN is_wp THEN lat END AS llat, CASE WHEN is_wp THEN lon END AS llon,
         CASE WHEN is_wp THEN code END AS lcode, is_wp AS any_kept
  FROM plan_point WHERE seq = 0
  UNION ALL
  SELECT p.plan_id, p.seq, d.keep,
         CASE WHEN d.keep THEN p.lat ELSE w.llat END, CASE WHEN d.keep THEN p.lon ELSE w.llon END,
         CASE WHEN d.keep THEN p.code ELSE w.lcode END, w.any_kept OR d.keep
  FROM walk w JOIN plan_point p ON p.plan_id = w.plan_id AND p.seq = w.seq + 1,
  LATERAL (SELECT CASE WHEN p.is_wp THEN w.lcode IS NULL OR w.lcode <> p.code
                       ELSE w.any_kept AND NOT (abs(p.lat - w.llat) < 1e-6 AND abs(p.lon - w.llon) < 1e-6) END AS keep) d
),
assembled AS (
  SELECT p.plan_id, CAST(row_number() OVER (PARTITION BY p.plan_id ORDER BY p.seq) - 1 AS INT) AS seq,
         p.is_wp, p.code, p.name, p.lat, p.lon
  FROM plan_point p JOIN walk w ON w.plan_id = p.plan_id AND w.seq = p.seq WHERE w.keep
)"""
LABELLED = ASSEMBLED + """,
islands AS (
  SELECT *, count(*) FILTER (WHERE is_wp) OVER (PARTITION BY plan_id ORDER BY seq) AS isl FROM assembled
),
labelled AS (
  SELECT *, CASE WHEN is_wp THEN code ELSE
    coalesce(first_value(code) OVER (PARTITION BY plan_id, isl ORDER BY seq), 'VIA') || '.' ||
    CAST(row_number() OVER (PARTITION BY plan_id, isl ORDER BY seq) - CASE WHEN isl > 0 THEN 1 ELSE 0 END AS VARCHAR) END AS label
  FROM islands
)"""
LEGS = LABELLED + """,
paired AS (
  SELECT plan_id, seq + 1 AS leg_no, label AS from_label, lead(label) OVER w AS to_label,
    is_wp AS from_is_wp, lead(is_wp) OVER w AS to_is_wp,
    lat AS a, lon AS o, lead(lat) OVER w AS b, lead(lon) OVER w AS q
  FROM labelled WINDOW w AS (PARTITION BY plan_id ORDER BY seq)
),
measured AS (
  SELECT *, pow(sin(radians(b - a) / 2e0), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(q - o) / 2e0), 2) AS h
  FROM paired WHERE to_label IS NOT NULL
),
leg AS (
  SELECT *, 2e0 * 6371e0 / 1.852e0 * atan2(sqrt(h), sqrt(1e0 - h)) AS nm,
    CASE WHEN a = b AND o = q THEN 0e0 ELSE fmod(degrees(atan2(sin(radians(q - o)) * cos(radians(b)),
      cos(radians(a)) * sin(radians(b)) - sin(radians(a)) * cos(radians(b)) * cos(radians(q - o)))) + 360e0, 360e0) END AS brg
  FROM measured
)"""


def plan_legs(spark, sf):
    return routes.with_times(_legs(spark, sf), 90.0).select(
        "plan_id", "leg_no", "from_label", "to_label",
        F.round("distance_nm", 6).alias("distance_nm"),
        F.round("mag_bearing_deg", 5).alias("mag_bearing_deg"),
        "shown_bearing", "time_text",
    )


QUERIES["route_legs"] = plan_legs
ORACLES["route_legs"] = oracle("WITH RECURSIVE " + LEGS.lstrip() + """
SELECT plan_id, CAST(leg_no AS INT) AS leg_no, from_label, to_label, round(nm, 6) AS distance_nm,
  round(fmod(brg - 5e0 + 360e0, 360e0), 5) AS mag_bearing_deg,
  CAST((CAST(floor(fmod(brg - 5e0 + 360e0, 360e0) - 0.5e0) AS INT) + 360) % 360 AS INT) AS shown_bearing,
  printf('%02d:%02d:%02d', CAST(s // 3600 AS INT), CAST(s % 3600 // 60 AS INT), CAST(s % 60 AS INT)) AS time_text
FROM (SELECT *, CAST(round_even(nm / 90e0 * 3600e0, 0) AS BIGINT) AS s FROM leg)
""", "plan_point")


def plan_totals(spark, sf):
    return routes.route_totals(_legs(spark, sf), 90.0).select(
        "plan_id", "n_legs", F.round("total_nm", 6).alias("total_nm"),
        F.round("total_seconds", 4).alias("total_seconds"), "over_speed",
    )


QUERIES["route_totals"] = plan_totals
ORACLES["route_totals"] = oracle("WITH RECURSIVE " + LEGS.lstrip() + """
SELECT plan_id, count(*) AS n_legs, round(sum(nm), 6) AS total_nm, round(sum(nm / 90e0 * 3600e0), 4) AS total_seconds,
  false AS over_speed FROM leg GROUP BY plan_id
""", "plan_point")


def assembled(spark, sf):
    return _points(spark, sf).select(
        "plan_id", "seq", "is_wp", "code", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


QUERIES["plan_assembly"] = assembled
ORACLES["plan_assembly"] = oracle("WITH RECURSIVE " + ASSEMBLED.lstrip() + """
SELECT plan_id, seq, is_wp, code, round(lat, 6) AS lat, round(lon, 6) AS lon FROM assembled
""", "plan_point")


def labels(spark, sf):
    return routes.assembled_labels(load(spark, sf, "plan_point")).select("plan_id", "seq", "label")


QUERIES["point_labels"] = labels
ORACLES["point_labels"] = oracle(
    "WITH RECURSIVE " + LABELLED.lstrip() + " SELECT plan_id, seq, label FROM labelled", "plan_point"
)


def plan_tokens(spark, sf):
    tokens, _ = routes.parse_plans(load(spark, sf, "plan_text"))
    return tokens.select(
        "plan_id", "position", "kind", "code", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


def plan_errors(spark, sf):
    return routes.parse_plans(load(spark, sf, "plan_text"))[1]


TOKENISED = r"""
tok AS (
  SELECT plan_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS position
  FROM (SELECT plan_id, string_split(trim(text), ' ') AS parts FROM plan_text) q
),
judged AS (
  SELECT *, regexp_full_match(token, '[A-Z]{4,5}') AS is_code,
    regexp_full_match(token, '[0-9]{4}[NS][0-9]{5}[EW]') AS is_coord,
    TRY_CAST(substr(token, 1, 2) AS INT) AS ad, TRY_CAST(substr(token, 3, 2) AS INT) AS am,
    TRY_CAST(substr(token, 6, 3) AS INT) AS od, TRY_CAST(substr(token, 9, 2) AS INT) AS om FROM tok
),
graded AS (
  SELECT *, CASE WHEN token = '' THEN 'empty token' WHEN is_code THEN NULL
    WHEN is_coord AND am < 60 AND om < 60 AND ad * 60 + am <= 5400 AND od * 60 + om <= 10800 THEN NULL
    WHEN is_coord THEN 'coordinate out of range' ELSE 'not a code or coordinate' END AS reason FROM judged
),
bad AS (SELECT plan_id, min(position) AS position FROM graded WHERE reason IS NOT NULL GROUP BY plan_id),
good AS (
  SELECT plan_id, CAST(position AS INT) AS position, CASE WHEN is_code THEN 'code' ELSE 'coord' END AS kind,
    CASE WHEN is_code THEN token END AS code,
    CASE WHEN NOT is_code THEN (ad + am / 60e0) * CASE WHEN token LIKE '____S%' THEN -1 ELSE 1 END END AS lat,
    CASE WHEN NOT is_code THEN (od + om / 60e0) * CASE WHEN token LIKE '%W' THEN -1 ELSE 1 END END AS lon
  FROM graded WHERE plan_id NOT IN (SELECT plan_id FROM bad)
)"""

QUERIES["plan_tokens"] = plan_tokens
ORACLES["plan_tokens"] = oracle("WITH " + TOKENISED.lstrip() + """
SELECT plan_id, position, kind, code, round(lat, 6) AS lat, round(lon, 6) AS lon FROM good
""", "plan_text")
QUERIES["plan_parse_errors"] = plan_errors
ORACLES["plan_parse_errors"] = oracle("WITH " + TOKENISED.lstrip() + """
SELECT g.plan_id, CAST(g.position AS INT) AS position, g.token, g.reason FROM graded g JOIN bad b USING (plan_id, position)
""", "plan_text")


def _resolved(spark, sf):
    tokens, _ = routes.parse_plans(load(spark, sf, "plan_text"))
    return routes.resolve_plans(tokens, load(spark, sf, "waypoint"))


def resolved_points(spark, sf):
    return _resolved(spark, sf)[0].select(
        "plan_id", "seq", "is_wp", "code", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


RESOLVED = TOKENISED + """,
looked AS (SELECT g.*, w.code AS wcode, w.name_he, w.lat AS wlat, w.lon AS wlon FROM good g LEFT JOIN waypoint w ON w.code = g.code),
unknown AS (SELECT plan_id, min(position) AS position FROM looked WHERE kind = 'code' AND wcode IS NULL GROUP BY plan_id)"""

QUERIES["plan_resolve"] = resolved_points
ORACLES["plan_resolve"] = oracle("WITH " + RESOLVED.lstrip() + """
SELECT plan_id, CAST(position - 1 AS INT) AS seq, kind = 'code' AS is_wp, wcode AS code, name_he AS name,
  round(coalesce(wlat, lat), 6) AS lat, round(coalesce(wlon, lon), 6) AS lon
FROM looked WHERE plan_id NOT IN (SELECT plan_id FROM unknown)
""", "plan_text", "waypoint")
QUERIES["plan_resolve_errors"] = lambda spark, sf: _resolved(spark, sf)[1]
ORACLES["plan_resolve_errors"] = oracle("WITH " + RESOLVED.lstrip() + """
SELECT l.plan_id, l.position, l.code AS token, 'unknown code' AS reason FROM looked l JOIN unknown u USING (plan_id, position)
""", "plan_text", "waypoint")


def strings(spark, sf):
    return routes.plan_strings(_points(spark, sf), filed=True)


QUERIES["plan_strings"] = strings
ORACLES["plan_strings"] = oracle("WITH RECURSIVE " + ASSEMBLED.lstrip() + f"""
SELECT plan_id,
  string_agg(CASE WHEN is_wp THEN code ELSE {sqltext.coord('lat', 'lon')} END, ' ' ORDER BY seq) AS plan_text,
  string_agg(CASE WHEN is_wp THEN CASE WHEN name = '' THEN code ELSE name END ELSE {sqltext.coord('lat', 'lon')} END, ' ' ORDER BY seq) AS local_text,
  string_agg(code, ' ' ORDER BY seq) FILTER (WHERE is_wp) AS filed_text
FROM assembled GROUP BY plan_id
""", "plan_point")
QUERIES["plan_names"] = lambda spark, sf: routes.plan_names(_points(spark, sf))
ORACLES["plan_names"] = oracle("WITH RECURSIVE " + ASSEMBLED.lstrip() + """
SELECT plan_id, CASE WHEN a IS NULL THEN 'flight-plan' WHEN a = b THEN a ELSE a || '-' || b END AS plan_name
FROM (SELECT plan_id, arg_min(code, seq) FILTER (WHERE is_wp) AS a, arg_max(code, seq) FILTER (WHERE is_wp) AS b FROM assembled GROUP BY plan_id) t
""", "plan_point")


def _overridden(spark, sf):
    return routes.apply_overrides(_legs(spark, sf), load(spark, sf, "leg_edit"), 90.0)


def overridden_legs(spark, sf):
    return _overridden(spark, sf).select(
        "plan_id", "leg_no", F.round("eff_distance_nm", 6).alias("eff_distance_nm"), "eff_bearing",
        F.array_join(F.transform("eff_altitudes_ft", lambda v: v.cast("string")), ",").alias("eff_altitudes"),
        F.round("eff_seconds", 4).alias("eff_seconds"), "ctr", "freq",
    )


OVERRIDDEN = LEGS + r""",
valid AS (
  SELECT *, trim(text) AS t FROM leg_edit
),
canon AS (
  SELECT plan_id, from_label, to_label, field, edit_no,
    CASE WHEN field = 'distance' AND regexp_full_match(t, '[0-9]{1,4}([.][0-9]{1,2})?') AND CAST(t AS DOUBLE) > 0 THEN format('{:.1f}', CAST(t AS DOUBLE))
      WHEN field = 'altitude' AND regexp_full_match(t, '[0-9]{1,5}(\s*,\s*[0-9]{1,5})*') AND NOT regexp_matches(',' || replace(t, ' ', '') || ',', ',0+,') THEN replace(t, ' ', '')
      WHEN field = 'bearing' AND regexp_full_match(t, '[0-9]{1,3}') AND CAST(t AS INT) <= 360 THEN t
      WHEN field = 'freq' AND regexp_full_match(t, '[0-9]{3}[.]([0-9]{3}|[0-9])') THEN t
      WHEN field = 'ctr' AND t <> '' THEN t END AS v
  FROM valid
),
side AS (
  SELECT plan_id, from_label, to_label,
    arg_max(v, edit_no) FILTER (WHERE field = 'distance') AS d, arg_max(v, edit_no) FILTER (WHERE field = 'altitude') AS al,
    arg_max(v, edit_no) FILTER (WHERE field = 'bearing') AS br, arg_max(v, edit_no) FILTER (WHERE field = 'freq') AS freq,
    arg_max(v, edit_no) FILTER (WHERE field = 'ctr') AS ctr
  FROM canon WHERE v IS NOT NULL GROUP BY ALL
),
eff AS (
  SELECT l.*, CASE WHEN regexp_full_match(d, '[0-9]{1,4}([.][0-9]{1,2})?') AND CAST(d AS DOUBLE) > 0 THEN CAST(d AS DOUBLE) ELSE nm END AS ed,
    coalesce(CAST(br AS INT), CAST((CAST(floor(fmod(brg - 5e0 + 360e0, 360e0) - 0.5e0) AS INT) + 360) % 360 AS INT)) AS eb, coalesce(al, '') AS ea, ctr, freq
  FROM leg l LEFT JOIN side s ON s.plan_id = l.plan_id AND s.from_label = l.from_label AND s.to_label = l.to_label
)"""
QUERIES["leg_overrides"] = overridden_legs
ORACLES["leg_overrides"] = oracle("WITH RECURSIVE " + OVERRIDDEN.lstrip() + """
SELECT plan_id, CAST(leg_no AS INT) AS leg_no, round(ed, 6) AS eff_distance_nm, eb AS eff_bearing, ea AS eff_altitudes,
  round(ed / 90e0 * 3600e0, 4) AS eff_seconds, ctr, freq FROM eff
""", "plan_point", "leg_edit")


def overridden_totals(spark, sf):
    speed = (F.lit(90.0) + F.col("plan_id") % 120).cast("double")
    return routes.route_totals(_overridden(spark, sf), speed).select(
        "plan_id", "n_legs", F.round("total_nm", 5).alias("total_nm"),
        F.round("total_seconds", 3).alias("total_seconds"), "max_altitude_ft", "over_speed",
    )


QUERIES["route_totals_effective"] = overridden_totals
ORACLES["route_totals_effective"] = oracle("WITH RECURSIVE " + OVERRIDDEN.lstrip() + """
SELECT plan_id, count(*) AS n_legs, round(sum(ed), 5) AS total_nm, round(sum(ed / (90e0 + plan_id % 120) * 3600e0), 3) AS total_seconds,
  max(CASE WHEN ea <> '' THEN list_max(list_transform(string_split(ea, ','), lambda x: CAST(x AS INT))) END) AS max_altitude_ft,
  bool_or(90 + plan_id % 120 > 180) AS over_speed
FROM eff GROUP BY plan_id
""", "plan_point", "leg_edit")


def trail_points(spark, sf):
    """The view ``trail_point``, without its window that holds a plan in one task."""
    rows = load(spark, sf, "trail_row").join(load(spark, sf, "trail_span"), "plan_id")
    return spark.sql(render(TRAIL_POINT, "spark").replace("{span}", "n_points").replace("{rows}", "{points}"), points=rows)


def drift_points(spark, sf):
    """The view ``drift_point``: rows are numbered per block of keys, blocks by their counts."""
    rows = load(spark, sf, "drift_row").withColumn("part", F.floor(F.col("k") / blocks.BLOCK_ROWS))
    spans = rows.groupBy("plan_id").agg(F.count("*").alias("n_points"))
    numbered = blocks.running_total(rows, ["plan_id"], ["k", "m"], F.lit(1), "i", block="part").withColumn("i", F.col("i") - 1)
    return spark.sql(render(DRIFT_POINT, "spark").replace("{rows}", "{points}"), points=numbered.join(spans, "plan_id"))


def trail_totals(spark, sf):
    return routes.route_totals(routes.plan_legs(trail_points(spark, sf), block_rows=4096), 90.0).select(
        "plan_id", "n_legs", F.round("total_nm", 3).alias("total_nm"), F.round("total_seconds", 1).alias("total_seconds")
    )


QUERIES["trail_totals"] = trail_totals
ORACLES["trail_totals"] = oracle(f"""
WITH before AS (SELECT *, lag(is_wp) OVER w AS p_wp, lag(code) OVER w AS p_code FROM trail_point WINDOW w AS (PARTITION BY plan_id ORDER BY seq)),
kept AS (SELECT * FROM before WHERE NOT (is_wp AND coalesce(p_wp, FALSE) AND code = p_code)),
started AS (SELECT *, max(is_wp) OVER (PARTITION BY plan_id ORDER BY seq) AS seen FROM kept),
paired AS (SELECT plan_id, lat AS a, lon AS o, lead(lat) OVER w AS b, lead(lon) OVER w AS q FROM started WHERE seen WINDOW w AS (PARTITION BY plan_id ORDER BY seq)),
leg AS (SELECT plan_id, {sqltext.gc('a', 'o', 'b', 'q')} AS nm FROM paired WHERE b IS NOT NULL)
SELECT plan_id, count(*) AS n_legs, round(sum(nm), 3) AS total_nm, round(sum(nm / 90e0 * 3600e0), 1) AS total_seconds FROM leg GROUP BY plan_id
""", "trail_point")


def drift_totals(spark, sf):
    legs = routes.kept_legs(drift_points(spark, sf), block_rows=4096)
    is_leg = F.col("to_label").isNotNull()
    totals = legs.groupBy("plan_id").agg(
        F.count("*").alias("n_kept"), F.sum(F.col("leg_no") - 1).alias("seq_sum"), F.count_if("from_is_wp").alias("n_wp"),
        F.nullif(F.count_if(is_leg), F.lit(0)).alias("n_legs"), F.sum(F.when(is_leg, F.col("distance_nm"))).alias("total_nm"),
    )
    return totals.withColumn("total_nm", F.round("total_nm", 5))


QUERIES["drift_totals"] = drift_totals
# Steps of 4e-7 degrees: every third point is kept, counted from the waypoint before.
ORACLES["drift_totals"] = oracle(f"""
WITH kept AS (SELECT plan_id, is_wp, lat, lon, row_number() OVER (PARTITION BY plan_id ORDER BY seq) - 1 AS k FROM drift_point WHERE since % 3 = 0),
paired AS (SELECT plan_id, is_wp, k, lat AS a, lon AS o, lead(lat) OVER w AS b, lead(lon) OVER w AS q FROM kept WINDOW w AS (PARTITION BY plan_id ORDER BY k)),
leg AS (SELECT *, CASE WHEN b IS NOT NULL THEN {sqltext.gc('a', 'o', 'b', 'q')} END AS nm FROM paired)
SELECT plan_id, count(*) AS n_kept, sum(k) AS seq_sum, count(*) FILTER (WHERE is_wp) AS n_wp, nullif(count(nm), 0) AS n_legs, round(sum(nm), 5) AS total_nm FROM leg GROUP BY plan_id
""", "drift_point")


def exported_plans(spark, sf):
    path = f"{checkpoint_dir(spark)}/plans-{uuid.uuid4().hex}"
    catalogue.export_plans(_points(spark, sf), path)
    return spark.read.parquet(path).select("plan_id", "plan_text", "local_text", "plan_name")


QUERIES["plan_export"] = exported_plans
ORACLES["plan_export"] = oracle("WITH RECURSIVE " + ASSEMBLED.lstrip() + f"""
SELECT plan_id,
  string_agg(CASE WHEN is_wp THEN code ELSE {sqltext.coord('lat', 'lon')} END, ' ' ORDER BY seq) AS plan_text,
  string_agg(CASE WHEN is_wp THEN CASE WHEN name = '' THEN code ELSE name END ELSE {sqltext.coord('lat', 'lon')} END, ' ' ORDER BY seq) AS local_text,
  CASE WHEN arg_min(code, seq) FILTER (WHERE is_wp) IS NULL THEN 'flight-plan'
    WHEN arg_min(code, seq) FILTER (WHERE is_wp) = arg_max(code, seq) FILTER (WHERE is_wp) THEN arg_min(code, seq) FILTER (WHERE is_wp)
    ELSE (arg_min(code, seq) FILTER (WHERE is_wp)) || '-' || (arg_max(code, seq) FILTER (WHERE is_wp)) END AS plan_name
FROM assembled GROUP BY plan_id
""", "plan_point")


def sql_functions(spark, sf):
    registry.register(spark)
    return load(spark, sf, "click").selectExpr(
        "click_id", "round(gc_nm(lat, lon, 31D, 35D), 6) AS nm", "round(true_bearing(lat, lon, 31D, 35D), 6) AS brg",
        "round(mag_bearing(lat, lon, 31D, 35D, 5D), 6) AS mag", "coord_text(lat, lon) AS token",
        "round(coord_lat(coord_text(lat, lon)) * 60D, 0) AS lat_minutes", "round(coord_lon(coord_text(lat, lon)) * 60D, 0) AS lon_minutes",
        "coord_lat(replace(coord_text(lat, lon), 'N', '9')) AS no_lat", "tile_x(lon, 13) AS x", "tile_y(lat, 13) AS y",
        "hms(leg_seconds(gc_nm(lat, lon, 31D, 35D), 90D)) AS took", "round(circular_diff(lat * 10, 5D), 6) AS apart",
        "round(axis_diff(lat * 10, 5D), 6) AS axis", "round(bisector(CAST(click_id % 72 * 5 AS DOUBLE), CAST(click_id % 72 * 5 + (click_id DIV 72) % 5 * 45 AS DOUBLE)), 6) AS half",
        "shown_bearing(mag_bearing(lat, lon, 31D, 35D, 5D)) AS shown", "round(world_px_x(lon, 13), 4) AS px", "round(world_px_y(lat, 13), 4) AS py",
        "round(metres_per_pixel(lat, 13), 6) AS mpp", "round(view_width(lat, lon, lon + 0.5D), 6) AS wide",
        "round(lcc_x(lat, lon), 9) AS cx", "round(lcc_y(lat, lon), 9) AS cy",
        "round(lcc_lat(lcc_x(lat, lon), lcc_y(lat, lon)), 8) AS back_lat", "round(lcc_lon(lcc_x(lat, lon), lcc_y(lat, lon)), 8) AS back_lon",
        "round(leg_fraction(30D, 34.2D, 32.5D, 35.1D, lat, lon), 9) AS part", "round(leg_distance(30D, 34.2D, 32.5D, 35.1D, lat, lon), 6) AS away",
        "round(leg_overshoot(30D, 34.2D, 32.5D, 35.1D, lat, lon), 6) AS past", "leg_side(30D, 34.2D, 32.5D, 35.1D, lat, lon) AS side",
        "round(sheet_coord(lat, lon, 20D, 1.5D, 0.4D), 8) AS u",
        "round(sheet_lat(lcc_x(lat, lon) * 20D, lcc_y(lat, lon) * 20D, 0.05D, 0D, 0D, 0D, 0.05D, 0D), 8) AS sheet_lat",
        "round(sheet_lon(lcc_x(lat, lon) * 20D, lcc_y(lat, lon) * 20D, 0.05D, 0D, 0D, 0D, 0.05D, 0D), 8) AS sheet_lon",
        "round(crop_coord(CAST(click_id % 700 AS DOUBLE), 144D, 100D, 900D), 9) AS crop",
        "round(ring_area2(array(struct(0D AS x, 0D AS y), struct(lon AS x, 0D AS y), struct(lon AS x, lat AS y), struct(0D AS x, lat AS y))), 6) AS area2",
        "round(ring_axis(array(struct(0D AS x, 0D AS y), struct(lon AS x, 0D AS y), struct(lon AS x, -lat AS y))), 6) AS axis_of",
        "canonical_url(concat(' HTTPS://charts.example/a b/', CAST(click_id AS STRING), '.pdf?q=%20 ')) AS url",
    )


_nm, _brg = sqltext.gc("lat", "lon", "31e0", "35e0"), sqltext.bearing("lat", "lon", "31e0", "35e0")
_sec = f"CAST(round_even({_nm} / 90e0 * 3600e0, 0) AS BIGINT)"
_apart = "least(fmod(lat * 10 - 5e0 + 360e0, 360e0), 360e0 - fmod(lat * 10 - 5e0 + 360e0, 360e0))"
ORACLES_SQL_FUNCTIONS = f"""
WITH {sqltext.LCC.lstrip()}
SELECT click_id, round({_nm}, 6) AS nm, round({_brg}, 6) AS brg, round(fmod({_brg} - 5e0 + 360e0, 360e0), 6) AS mag, {sqltext.coord('lat', 'lon')} AS token,
  floor(lat) * 60e0 + round_even((lat - floor(lat)) * 60e0, 0) AS lat_minutes, floor(lon) * 60e0 + round_even((lon - floor(lon)) * 60e0, 0) AS lon_minutes, CAST(NULL AS DOUBLE) AS no_lat,
  {sqltext.tile_x('lon', '13')} AS x, {sqltext.tile_y('lat', '13')} AS y,
  printf('%02d:%02d:%02d', {_sec} // 3600, {_sec} % 3600 // 60, {_sec} % 60) AS took, round(least(fmod(lat * 10 - 5e0 + 360e0, 360e0), 360e0 - fmod(lat * 10 - 5e0 + 360e0, 360e0)), 6) AS apart,
  round(least({_apart}, 180e0 - {_apart}), 6) AS axis,
  round(fmod(CASE WHEN (click_id // 72) % 5 = 4 THEN click_id % 72 * 5 + 90e0 ELSE click_id % 72 * 5 + (click_id // 72) % 5 * 22.5e0 END, 360e0), 6) AS half,
  CAST((CAST(floor(fmod({_brg} - 5e0 + 360e0, 360e0) - 0.5e0) AS INT) + 360) % 360 AS INT) AS shown,
  round((lon + 180e0) / 360e0 * 256 * 8192, 4) AS px, round((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 256 * 8192, 4) AS py,
  round({mercator.EARTH_CIRCUMFERENCE_M!r}::DOUBLE * cos(radians(lat)) / (256 * 8192), 6) AS mpp,
  round(2e0 * 3440.065e0 * asin(cos(radians(lat)) * sin(radians(0.5e0) / 2)), 6) AS wide,
  round({sqltext.lcc_x('lat', 'lon')}, 9) AS cx, round({sqltext.lcc_y('lat', 'lon')}, 9) AS cy, round(lat, 8) AS back_lat, round(lon, 8) AS back_lon,
  round(t, 9) AS part,
  round(CASE WHEN t <= 0 THEN {sqltext.gc('lat', 'lon', '30e0', '34.2e0')} WHEN t >= 1 THEN {sqltext.gc('lat', 'lon', '32.5e0', '35.1e0')} ELSE sqrt(pow(wx - t * ex, 2) + pow(wy - t * ey, 2)) END, 6) AS away,
  round(greatest(0e0, -t, t - 1e0) * sqrt(ex * ex + ey * ey), 6) AS past,
  CAST(CASE WHEN side > 1e-12 THEN 1 WHEN side < -1e-12 THEN -1 ELSE 0 END AS INT) AS side,
  round(20e0 * {sqltext.lcc_x('lat', 'lon')} + 1.5e0 * {sqltext.lcc_y('lat', 'lon')} + 0.4e0, 8) AS u, round(lat, 8) AS sheet_lat, round(lon, 8) AS sheet_lon,
  CASE WHEN (click_id % 700 * 2e0 - 100e0) / 900e0 BETWEEN 0 AND 1 THEN round((click_id % 700 * 2e0 - 100e0) / 900e0, 9) END AS crop,
  round(2e0 * lat * lon, 6) AS area2, round(degrees(atan2(lon, lat)), 6) AS axis_of,
  'https://charts.example/a%20b/' || click_id || '.pdf?q=%20' AS url
FROM (SELECT *, (wx * ex + wy * ey) / (ex * ex + ey * ey) AS t FROM (
  SELECT *, 0.9e0 * k AS ex, 150e0 AS ey, (lon - 34.2e0) * k AS wx, (lat - 30e0) * 60e0 AS wy, 0.9e0 * (lat - 30e0) - 2.5e0 * (lon - 34.2e0) AS side
  FROM (SELECT *, cos(radians(31.25e0)) * 60e0 AS k FROM click, lcc)))
"""
QUERIES["sql_functions"] = sql_functions
ORACLES["sql_functions"] = oracle(ORACLES_SQL_FUNCTIONS, "click")
