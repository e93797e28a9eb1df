"""Tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import mercator, registry, sqltext
from skyledger.operators import tiles
from skyledger.plans.views import load, oracle

QUERIES = {}
ORACLES = {}
ZOOMS = (12, 13, 14)

QUERIES["tile_inventory"] = lambda spark, sf: tiles.parse_tile_paths(load(spark, sf, "tile_file"))
ORACLES["tile_inventory"] = oracle(r"""
SELECT provider, CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, length AS bytes, modificationTime AS mtime FROM (
  SELECT *, split_part(path, '/', 3) AS provider, split_part(path, '/', 4) AS z, split_part(path, '/', 5) AS x, replace(split_part(path, '/', 6), '.jpg', '') AS y FROM tile_file
) f WHERE length > 0 AND path LIKE '%.jpg' AND TRY_CAST(x AS INT) IS NOT NULL AND TRY_CAST(y AS INT) IS NOT NULL
""", "tile_file")

QUERIES["tile_density"] = lambda spark, sf: tiles.tile_density(load(spark, sf, "bulk_point"), 13)
ORACLES["tile_density"] = oracle(f"""
SELECT 13 AS z, {sqltext.tile_x('lon', '13')} AS x, {sqltext.tile_y('lat', '13')} AS y, count(*) AS n_points FROM bulk_point GROUP BY ALL
""", "bulk_point")

BOXED = f"""
span AS (
  SELECT box_id, z, {sqltext.tile_x('min_lon', 'z')} AS x0, {sqltext.tile_x('max_lon', 'z')} AS x1, {sqltext.tile_y('max_lat', 'z')} AS y0, {sqltext.tile_y('min_lat', 'z')} AS y1
  FROM box, (SELECT CAST(unnest([12, 13, 14]) AS INT) AS z) zz WHERE max_lat >= min_lat AND max_lon >= min_lon
),
strip AS (SELECT box_id, z, unnest(generate_series(x0, x1)) AS x, y0, y1 FROM span),
boxed AS (SELECT box_id, z, CAST(x AS INT) AS x, CAST(unnest(generate_series(y0, y1)) AS INT) AS y FROM strip)"""
QUERIES["tiles_for_boxes"] = lambda spark, sf: tiles.tiles_for_boxes(load(spark, sf, "box"), ZOOMS)
ORACLES["tiles_for_boxes"] = oracle("WITH " + BOXED.lstrip() + " SELECT box_id, z, x, y FROM boxed", "box")


def tiles_in_sql(spark, sf):
    """The table function beside a table of boxes, for each zoom that the box names."""
    registry.register(spark)
    zooms = F.explode(F.array(*[F.lit(z) for z in ZOOMS]))
    boxes = load(spark, sf, "box").withColumn("zoom", zooms)
    return spark.sql("SELECT b.box_id, t.z, t.x, t.y FROM {boxes} AS b, LATERAL tiles_for_box(b.min_lat, b.max_lat, b.min_lon, b.max_lon, b.zoom) AS t", boxes=boxes)


QUERIES["tiles_for_boxes_sql"] = tiles_in_sql
ORACLES["tiles_for_boxes_sql"] = ORACLES["tiles_for_boxes"]


def missing(spark, sf):
    provider = F.when(F.col("box_id") % 2 == 0, "prov0").otherwise("prov1")
    required = tiles.tiles_for_boxes(load(spark, sf, "box"), ZOOMS).withColumn("provider", provider)
    return tiles.missing_tiles(required, load(spark, sf, "inventory"))


QUERIES["missing_tiles"] = missing
ORACLES["missing_tiles"] = oracle("WITH " + BOXED.lstrip() + """,
asked AS (SELECT DISTINCT CASE WHEN box_id % 2 = 0 THEN 'prov0' ELSE 'prov1' END AS provider, z, x, y FROM boxed)
SELECT provider, z, x, y, 'https://tiles.example/' || z || '/' || y || '/' || x AS url FROM asked b
WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.provider = b.provider AND i.bytes > 0 AND i.z = b.z AND i.x = b.x AND i.y = b.y)
""", "box", "inventory")

QUERIES["viewport_tiles"] = lambda spark, sf: tiles.viewport_tiles(
    load(spark, sf, "viewport").withColumn("provider", F.concat(F.lit("prov"), (F.col("view_id") % 3).cast("string"))),
    load(spark, sf, "inventory"), 13,
)
_wx = lambda c: f"(({c} + 180e0) / 360e0 * 8192e0)"
_wy = lambda c: f"((1e0 - ln(tan(radians({c})) + 1e0 / cos(radians({c}))) / pi()) / 2e0 * 8192e0)"
ORACLES["viewport_tiles"] = oracle(f"""
WITH w AS (SELECT view_id, {_wx('min_lon')} AS x0, {_wx('max_lon')} AS x1, {_wy('max_lat')} AS y0, {_wy('min_lat')} AS y1 FROM viewport),
g AS (SELECT view_id, unnest(generate_series(CAST(floor(x0 - (x1 - x0) / 2) AS INT), CAST(floor(x1 + (x1 - x0) / 2) AS INT))) AS x,
  CAST(floor(y0 - (y1 - y0) / 2) AS INT) AS a, CAST(floor(y1 + (y1 - y0) / 2) AS INT) AS b FROM w),
t AS (SELECT view_id, CAST(x AS INT) AS x, CAST(unnest(generate_series(a, b)) AS INT) AS y FROM g)
SELECT view_id, 'prov' || view_id % 3 AS provider, 13 AS z, x, y, EXISTS (SELECT 1 FROM inventory i WHERE i.provider = 'prov' || view_id % 3 AND i.z = 13 AND i.x = t.x AND i.y = t.y AND i.bytes > 0) AS cached FROM t
""", "viewport", "inventory")

QUERIES["tile_coverage"] = lambda spark, sf: tiles.tile_coverage(
    load(spark, sf, "inventory"), mercator.DEFAULT_BOX, (12, 13, 14, 15)
)
ORACLES["tile_coverage"] = oracle(f"""
WITH r AS (
  SELECT z, {sqltext.tile_x('34e0', 'z')} AS x0, {sqltext.tile_x('36e0', 'z')} AS x1, {sqltext.tile_y('33.4e0', 'z')} AS y0, {sqltext.tile_y('29.3e0', 'z')} AS y1
  FROM (SELECT CAST(unnest([12, 13, 14, 15]) AS INT) AS z) zz
),
c AS (SELECT p.provider, r.z, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS total,
  (SELECT count(*) FROM inventory i WHERE i.provider = p.provider AND i.z = r.z AND i.x BETWEEN x0 AND x1 AND i.y BETWEEN y0 AND y1 AND i.bytes > 0) AS cached
  FROM r, (SELECT DISTINCT provider FROM inventory) p)
SELECT provider, z, total, least(cached, total) AS cached, total > 0 AND cached >= total AS done FROM c
""", "inventory")

QUERIES["inventory_size"] = lambda spark, sf: tiles.inventory_size(load(spark, sf, "inventory"))
ORACLES["inventory_size"] = oracle(
    "SELECT provider, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM inventory GROUP BY 1", "inventory"
)

QUERIES["eviction_plan"] = lambda spark, sf: tiles.eviction_plan(load(spark, sf, "inventory"), 15_000_000).select(
    "provider", "z", "x", "y", "bytes"
)
ORACLES["eviction_plan"] = oracle("""
SELECT provider, z, x, y, bytes FROM (
  SELECT *, sum(bytes) OVER (PARTITION BY provider) AS total,
    coalesce(sum(bytes) OVER (PARTITION BY provider ORDER BY mtime, z, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older
  FROM inventory
) t WHERE total - older > 15000000
""", "inventory")

GRADED = """
graded AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'network_error' WHEN status IN (404, 410) THEN 'missing' WHEN status = 429 THEN 'rate_limited'
    WHEN status BETWEEN 500 AND 599 THEN 'network_error' WHEN status <> 200 THEN 'http_error' WHEN bytes < 256 THEN 'missing' ELSE 'fetched' END AS outcome
  FROM attempt
),
timed AS (
  SELECT *, outcome IN ('rate_limited', 'network_error') AS transient,
    CASE WHEN outcome = 'rate_limited' THEN CASE WHEN TRY_CAST(retry_after AS DOUBLE) > 0 THEN TRY_CAST(retry_after AS DOUBLE) ELSE 30e0 END WHEN outcome = 'network_error' THEN 5e0 END AS wait_s
  FROM graded
),
island AS (SELECT *, sum(CASE WHEN transient THEN 0 ELSE 1 END) OVER (PARTITION BY z, x, y ORDER BY attempt_no) AS isl FROM timed),
runs AS (SELECT *, count(*) FILTER (WHERE transient) OVER (PARTITION BY z, x, y, isl ORDER BY attempt_no) AS run FROM island),
given AS (SELECT *, transient AND run > 0 AND run % 3 = 0 AS gave_up, CASE WHEN NOT (transient AND run > 0 AND run % 3 = 0) THEN wait_s END AS backoff_s FROM runs)"""
QUERIES["attempt_outcomes"] = lambda spark, sf: tiles.with_give_up(
    tiles.attempt_outcomes(load(spark, sf, "attempt"))
).select("z", "x", "y", "attempt_no", "outcome", "backoff_s", "gave_up")
ORACLES["attempt_outcomes"] = oracle(
    "WITH " + GRADED.lstrip() + " SELECT z, x, y, attempt_no, outcome, backoff_s, gave_up FROM given", "attempt"
)
QUERIES["attempt_summary"] = lambda spark, sf: tiles.attempt_summary(load(spark, sf, "attempt"), total=300, prior=10)
ORACLES["attempt_summary"] = oracle("WITH " + GRADED.lstrip() + """
SELECT z, count(*) AS n_attempts, count(*) FILTER (WHERE outcome = 'fetched') AS n_fetched, count(*) FILTER (WHERE outcome = 'missing') AS n_missing,
  count(*) FILTER (WHERE outcome = 'rate_limited') AS n_rate_limited, count(*) FILTER (WHERE outcome = 'network_error') AS n_network_error,
  count(*) FILTER (WHERE gave_up OR outcome = 'http_error') AS n_errors, count(*) FILTER (WHERE gave_up) AS n_given_up,
  sum(coalesce(backoff_s, 0e0)) AS backoff_s, least(count(*) FILTER (WHERE outcome = 'fetched') + 10, 300) AS progress
FROM given GROUP BY z
""", "attempt")
