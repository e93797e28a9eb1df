"""Source and sink queries: documents are built from the given tables, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyledger.checks import routes as route_checks
from skyledger.checks.waypoints import CLEANED, clean
from skyledger.operators import routes, waypoints
from skyledger.plans.views import load, oracle
from skyledger.session import checkpoint_dir, spread
from skyledger.sources import catalogue, charts
from skyledger.sources import feed as feed_source

QUERIES = {}
ORACLES = {}


def stored_arrows(spark, sf):
    s = lambda c: F.col(c).cast("string")
    n = F.col("p_partkey")
    one = F.concat(
        F.lit('{"u":'), (n % 100 / 100.0).cast("string"), F.lit(',"v":0.5,"bearing_deg":'), (n % 360).cast("string"),
        F.lit(',"altitudes_ft":[1600,800]'), F.when(n % 3 == 0, F.lit(',"bidirectional":true')).otherwise(F.lit("")), F.lit("}"),
    )
    bad = F.when(n % 5 == 1, F.lit('{"u":"x"}')).when(n % 5 == 2, F.lit("3")).otherwise(
        F.lit('{"u":0.25,"v":0.75,"bearing_deg":10.5,"altitudes_ft":[3000]}')
    )
    docs = spread(load(spark, sf, "part").select("p_partkey")).select(
        n.alias("edition"), F.lit("north").alias("sheet"),
        F.try_parse_json(
            F.concat(
                F.lit('{"format_version":'), F.when(n % 7 == 3, F.lit("6")).otherwise(F.lit("7")),
                F.lit(',"render_dpi":288.0,"crop":{"offset_x":1,"offset_y":2,"source_w":30,"source_h":40,"cropped_w":20,"cropped_h":'),
                F.when(n % 11 == 4, F.lit("31")).otherwise(F.lit("30")), F.lit('},"arrows":['), one, F.lit(","), bad, F.lit("]}"),
            )
        ).alias("v"),
    )
    crop = load(spark, sf, "part").select(
        n.alias("edition"), F.lit("north").alias("sheet"), F.lit(288.0).alias("render_dpi"),
        *[F.lit(v).alias(k) for k, v in zip(charts.CROP_FIELDS, (1, 2, 30, 40, 20, 30))],
    )
    return charts.arrow_rows(docs, crop).select(
        "edition", "arrow_no", "u", "v", "bearing_deg",
        F.array_join(F.transform("altitudes_ft", lambda a: a.cast("string")), ",").alias("altitudes"), "bidirectional",
    )


QUERIES["stored_arrows"] = stored_arrows
ORACLES["stored_arrows"] = """
WITH p AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 7 <> 3 AND p_partkey % 11 <> 4)
SELECT n AS edition, 0 AS arrow_no, n % 100 / 100e0 AS u, 0.5e0 AS v, CAST(n % 360 AS DOUBLE) AS bearing_deg, '1600,800' AS altitudes, n % 3 = 0 AS bidirectional FROM p
UNION ALL SELECT n, 1, 0.25e0, 0.75e0, 10.5e0, '3000', false FROM p WHERE n % 5 NOT IN (1, 2)
"""


def stored_anchors(spark, sf):
    n = F.col("p_partkey")
    point = lambda i: F.concat(
        F.lit(f'{{"code":"A{i}","lat":'), (n % 4 + 29 + i / 10).cast("string"), F.lit(f',"lon":34.{i},"u":0.{i},"v":'),
        F.when((n % 6 == 5) & F.lit(i == 2), F.lit('"?"')).otherwise(F.lit("0.5")), F.lit("}"),
    )
    pts = lambda k: F.concat(F.lit("["), F.concat_ws(",", *[point(i) for i in range(1, k + 1)]), F.lit("]"))
    docs = spread(load(spark, sf, "part").select("p_partkey")).select(
        n.alias("edition"),
        F.try_parse_json(
            F.concat(
                F.lit('{"version":1,"north":{"points":'), F.when(n % 5 == 0, pts(2)).otherwise(pts(4)),
                F.lit('},"south":'), F.when(n % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"points":'), pts(3), F.lit("}"))), F.lit("}"),
            )
        ).alias("v"),
    )
    return charts.anchor_rows(docs).select("edition", "sheet", "ord", "code", F.round("lat", 6).alias("lat"), "lon", "u", "v")


QUERIES["stored_anchors"] = stored_anchors
ORACLES["stored_anchors"] = """
WITH s AS (
  SELECT p_partkey AS n, 'north' AS sheet, 4 AS k FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'south', 3 FROM part WHERE p_partkey % 3 <> 0
),
x AS (SELECT n, sheet, unnest(generate_series(1, k)) AS i FROM s WHERE n % 6 <> 5)
SELECT n AS edition, sheet, CAST(i - 1 AS INT) AS ord, 'A' || i AS code, round(n % 4 + 29 + i / 10e0, 6) AS lat, CAST('34.' || i AS DOUBLE) AS lon, CAST('0.' || i AS DOUBLE) AS u, 0.5e0 AS v FROM x
"""


QUERIES["stale_sources"] = lambda spark, sf: charts.stale_sources(load(spark, sf, "source_now"), load(spark, sf, "source_then"))
ORACLES["stale_sources"] = oracle("""
WITH j AS (
  SELECT coalesce(c.edition, r.edition) AS edition, coalesce(c.sheet, r.sheet) AS sheet, c.size IS NOT NULL AS here, r.size IS NOT NULL AS known, c.mtime_ns AS cm, r.mtime_ns AS rm,
    c.size AS cs, r.size AS rs, r.url LIKE '%other%' AS other, version_ok, valid, c.layout_x AS cx, r.layout_x AS rx, c.layout_scale AS cz, r.layout_scale AS rz
  FROM source_now c FULL JOIN source_then r ON c.edition = r.edition AND c.sheet = r.sheet
),
q AS (
  SELECT edition, sheet, here <> known AS odd, CASE WHEN NOT here OR NOT known THEN 'missing' WHEN NOT version_ok THEN 'version' WHEN other THEN 'moved address'
    WHEN cm <> rm OR cs <> rs THEN 'changed' WHEN NOT valid THEN 'invalid' WHEN cz IS NULL THEN 'no layout' WHEN abs(cx - rx) > 0.5 OR abs(cz - rz) > 1e-4 THEN 'moved' END AS reason
  FROM j
),
z AS (SELECT edition, sheet, coalesce(reason, CASE WHEN bool_or(odd) OVER (PARTITION BY edition) THEN 'sheet set differs' END) AS reason FROM q)
SELECT edition, sheet, reason FROM z WHERE reason IS NOT NULL
""", "source_now", "source_then")


def leg_sheet(spark, sf):
    df = catalogue.leg_sheet(route_checks._overridden(spark, sf))
    renamed = {c: f"c{i:02d}" for i, c in enumerate(catalogue.LEG_COLUMNS)}
    return df.withColumnsRenamed(renamed)


QUERIES["leg_sheet"] = leg_sheet
ORACLES["leg_sheet"] = oracle("WITH RECURSIVE " + route_checks.OVERRIDDEN.lstrip() + """
SELECT plan_id, CAST(leg_no AS INT) AS leg_no, from_label AS c00, to_label AS c01, '' AS c02, '' AS c03, coalesce(ctr, '') AS c04, coalesce(freq, '') AS c05, '' AS c06, '' AS c07,
  printf('%03d', eb % 360) || '°M' AS c08, CASE WHEN ea = '' THEN 'unknown' ELSE ea END AS c09, format('{:.1f}', ed) AS c10,
  printf('%02d:%02d:%02d', CAST(s // 3600 AS INT), CAST(s % 3600 // 60 AS INT), CAST(s % 60 AS INT)) AS c11
FROM (SELECT *, CAST(round_even(ed / 90e0 * 3600e0, 0) AS BIGINT) AS s FROM eff) q
""", "plan_point", "leg_edit")


def waypoint_sheet(spark, sf):
    df = waypoints.merge_waypoints(clean(spark, sf))
    return catalogue.waypoint_sheet(df).withColumnsRenamed({c: f"c{i}" for i, c in enumerate(catalogue.WAYPOINT_COLUMNS)})


QUERIES["waypoint_sheet"] = waypoint_sheet
ORACLES["waypoint_sheet"] = oracle("WITH " + CLEANED.lstrip() + """
SELECT code AS c0, name_he AS c1, reporting_type AS c2, format('{:.6f}', lat) AS c3, format('{:.6f}', lon) AS c4, lat_dms AS c5, lon_dms AS c6 FROM merged
""", "cell")


def wake_documents(spark, sf):
    """One dimension document per part, with keys to trim and values to drop."""
    n = F.col("p_partkey").cast("string")
    docs = load(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 13 == 0, F.lit("[oops")).otherwise(
            F.concat(F.lit('{"version":1,"types":{" t'), n, F.lit('":"M","U'), n, F.lit('":"X","V'), n, F.lit('":"H"}}'))
        ).alias("value")
    )
    return feed_source.wake_dimension(docs)


QUERIES["wake_dimension"] = wake_documents
ORACLES["wake_dimension"] = """
SELECT 'T' || p_partkey AS type_code, 'M' AS wake FROM part WHERE p_partkey % 13 <> 0
UNION ALL SELECT 'V' || p_partkey, 'H' FROM part WHERE p_partkey % 13 <> 0
"""

QUERIES["cell_rows"] = lambda spark, sf: catalogue.table_rows(
    load(spark, sf, "cell").select(
        "k", (F.col("ord") % 40).alias("row_no"),
        F.slice(F.array(*[F.struct(F.lit(float(i)).alias("x0"), F.lit("t").alias("text")) for i in range(3)]), F.lit(1), (F.col("k") % 4).cast("int")).alias("meta"),
    )
).select("k")
ORACLES["cell_rows"] = oracle("SELECT k FROM cell WHERE ord % 40 > 0 AND k % 4 >= 2", "cell")


def _stored_waypoints(spark, sf):
    path = f"{checkpoint_dir(spark)}/waypoints-{uuid.uuid4().hex}"
    catalogue.write_waypoint_files(load(spark, sf, "waypoint").withColumn("mode_id", F.col("idx") % 2), path)
    return path


def waypoint_files(spark, sf):
    return spark.read.parquet(_stored_waypoints(spark, sf)).select("mode_id", "idx", "code", "name_he", F.round("lat", 6).alias("lat"))


QUERIES["waypoint_table"] = waypoint_files
ORACLES["waypoint_table"] = oracle("SELECT CAST(idx % 2 AS INT) AS mode_id, idx, code, name_he, round(lat, 6) AS lat FROM waypoint", "waypoint")

CODES = ["aaaab", " AAAAD ", "AAAAE", "AAABZ", "ZZZZZ"]
QUERIES["waypoint_lookup"] = lambda spark, sf: catalogue.waypoints_by_code(spark, _stored_waypoints(spark, sf), 1, CODES).select("idx", "code")
ORACLES["waypoint_lookup"] = oracle("SELECT idx, code FROM waypoint WHERE idx % 2 = 1 AND code IN ('AAAAB', 'AAAAD', 'AAAAE', 'AAABZ', 'ZZZZZ')", "waypoint")


def tile_range(spark, sf):
    path = f"{checkpoint_dir(spark)}/tiles-{uuid.uuid4().hex}"
    charts.write_tile_table(load(spark, sf, "inventory"), path)
    return charts.tiles_in_range(spark, path, "prov0", 13, (4870, 4880), (3286, 3300)).select("provider", "z", "x", "y", "bytes")


QUERIES["tile_table_range"] = tile_range
ORACLES["tile_table_range"] = oracle("""
SELECT provider, z, x, y, bytes FROM inventory WHERE provider = 'prov0' AND z = 13 AND x BETWEEN 4870 AND 4880 AND y BETWEEN 3286 AND 3300
""", "inventory")


def tile_updates(spark, sf):
    """A second listing of zoom 14: some files gone, some of another size, some new."""
    path = f"{checkpoint_dir(spark)}/tiles-{uuid.uuid4().hex}"
    first = load(spark, sf, "inventory")
    charts.write_tile_table(first, path)
    again = first.where("z = 14 AND bytes % 11 <> 3").withColumn("bytes", F.when(F.col("bytes") % 7 == 2, F.col("bytes") + 1).otherwise(F.col("bytes")))
    more = first.where("z = 14 AND bytes % 13 = 5").withColumn("x", F.col("x") + 100000)
    changed = charts.update_tile_table(spark, path, again.unionByName(more))
    after = spark.read.parquet(path).groupBy("provider", "z").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"))
    counts = changed.groupBy("provider", "z").agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "changed", "gone")])
    return after.join(counts, ["provider", "z"], "left").na.fill(0, ["n_new", "n_changed", "n_gone"])


QUERIES["tile_table_update"] = tile_updates
ORACLES["tile_table_update"] = oracle("""
WITH s AS (SELECT provider, z, bytes, CASE WHEN z = 14 AND bytes % 11 = 3 THEN 0 ELSE 1 END AS stays, CASE WHEN z = 14 AND bytes % 11 <> 3 AND bytes % 7 = 2 THEN 1 ELSE 0 END AS grows,
  CASE WHEN z = 14 AND bytes % 13 = 5 THEN 1 ELSE 0 END AS twin FROM inventory)
SELECT provider, z, CAST(sum(stays + twin) AS BIGINT) AS n_files, CAST(sum(stays * (bytes + grows) + twin * bytes) AS BIGINT) AS n_bytes,
  CAST(sum(twin) AS BIGINT) AS n_new, CAST(sum(grows) AS BIGINT) AS n_changed, CAST(sum(1 - stays) AS BIGINT) AS n_gone FROM s GROUP BY provider, z
""", "inventory")


def plan_files(spark, sf):
    """Plan lines in files of their own, the first of every 97th plan, read back with trimmed ends."""
    path = f"{checkpoint_dir(spark)}/plans-{uuid.uuid4().hex}"
    lines = load(spark, sf, "plan_text").select((F.col("plan_id") % 97).alias("bundle"), F.concat(F.lit(" "), F.trim("text"), F.lit(" ")).alias("value"), "plan_id")
    # a file holds the first plan of its bundle
    firsts = lines.groupBy("bundle").agg(F.min_by("value", "plan_id").alias("value"))
    firsts.coalesce(1).write.partitionBy("bundle").text(path)
    plans = catalogue.read_plans(spark, f"{path}/bundle=*")
    return plans.select(F.regexp_extract("plan_id", "bundle=([0-9]+)/", 1).cast("bigint").alias("bundle"), "text")


QUERIES["plan_files"] = plan_files
ORACLES["plan_files"] = oracle("SELECT plan_id % 97 AS bundle, trim(arg_min(text, plan_id), ' ') AS text FROM plan_text GROUP BY 1", "plan_text")
