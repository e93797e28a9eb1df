"""Feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import feed
from skyledger.plans.views import load, oracle
from skyledger.sources import feed as feed_source

QUERIES = {}
ORACLES = {}


def feed_documents(spark, sf):
    """Two-entry JSON documents built from ``feed_elem``, with the faults spelled out."""
    s = lambda c: F.col(c).cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    altitude = (
        F.when(F.col("alt_kind") == 2, F.lit('"FL230"'))
        .when(F.col("alt_kind") == 3, F.lit('"12.7"'))
        .when(F.col("alt_kind") == 4, F.concat(s("alt"), F.lit(".9")))
        .when(F.col("alt_kind") == 5, F.lit("null"))
        .when(F.col("alt_kind") == 6, q(s("alt")))
        .otherwise(s("alt"))
    )
    plan = (
        F.when(F.col("plan_kind") == 0, F.lit("null"))
        .when(F.col("plan_kind") == 1, F.lit('{"aircraft_short":"B738","flight_rules":"I","departure":"LLBG","arrival":null}'))
        .when(F.col("plan_kind") == 2, F.lit('{"aircraft_short":"","aircraft_faa":" C172 ","flight_rules":"V"}'))
        .when(F.col("plan_kind") == 3, F.lit('{"aircraft_short":"  ","aircraft_faa":"C172"}'))
        .when(F.col("plan_kind") == 4, F.lit('{"aircraft_short":null,"aircraft":"A333/H-SDE","arrival":"LLHA"}'))
        .otherwise(F.lit("{}"))
    )
    entry = F.when(F.col("not_object"), F.lit("17")).otherwise(
        F.concat(
            F.lit('{"cid":'), F.when(F.col("no_cid"), F.lit("null")).otherwise(s("cid")),
            F.lit(',"callsign":'), F.when(F.col("cid") % 11 == 0, F.lit("null")).otherwise(q(F.concat(F.lit("CS"), s("cid")))),
            F.when(F.col("no_lat"), F.lit("")).otherwise(F.concat(F.lit(',"latitude":'), s("lat"))),
            F.lit(',"longitude":'), s("lon"),
            F.lit(',"altitude":'), altitude,
            F.lit(',"groundspeed":100,"transponder":"0021","heading":'), s("heading"),
            F.lit(',"flight_plan":'), plan, F.lit("}"),
        )
    )
    elems = load(spark, sf, "feed_elem").withColumn("entry", entry)
    return elems.groupBy("doc", "snapshot_ts", "broken", "no_list").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda e: e.entry), ",").alias("body")
    ).select(
        F.col("doc").cast("string").alias("doc_id"),
        F.when(F.col("broken"), F.lit('{"pilots": ['))
        .otherwise(
            F.concat(
                F.lit('{"general":{"update_timestamp":"'), F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                F.lit('"},"pilots":'), F.when(F.col("no_list"), F.lit('{"a":1}')).otherwise(F.concat(F.lit("["), "body", F.lit("]"))),
                F.lit("}"),
            )
        )
        .alias("value"),
    )


def pilots_from_documents(spark, sf):
    entries = feed_source.feed_entries(feed_documents(spark, sf))
    return feed.clean_pilots(entries).select(
        F.col("doc_id").cast("bigint").alias("doc"), "snapshot_ts", "pos", "cid", "callsign",
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "altitude_ft", "heading_deg",
        "transponder", "aircraft_type", "flight_rules", "departure", "arrival",
    )


QUERIES["feed_pilots"] = pilots_from_documents
ORACLES["feed_pilots"] = oracle("""
SELECT doc, snapshot_ts, pos, cid, CASE WHEN cid % 11 = 0 THEN '' ELSE 'CS' || cid END AS callsign,
  round(lat, 6) AS lat, round(lon, 6) AS lon,
  CASE WHEN alt_kind IN (2, 5) THEN 0 WHEN alt_kind = 3 THEN 12 ELSE alt END AS altitude_ft,
  CAST((heading + 360) % 360 AS INT) AS heading_deg, '0021' AS transponder,
  CASE plan_kind WHEN 1 THEN 'B738' WHEN 2 THEN 'C172' WHEN 4 THEN 'A333/H-SDE' END AS aircraft_type,
  CASE plan_kind WHEN 1 THEN 'I' WHEN 2 THEN 'V' ELSE '' END AS flight_rules,
  CASE plan_kind WHEN 1 THEN 'LLBG' ELSE '' END AS departure, CASE plan_kind WHEN 4 THEN 'LLHA' ELSE '' END AS arrival
FROM feed_elem WHERE NOT broken AND NOT no_list AND NOT no_cid AND NOT no_lat AND NOT not_object
""", "feed_elem")
QUERIES["feed_bad_documents"] = lambda spark, sf: feed_source.bad_documents(feed_documents(spark, sf))
ORACLES["feed_bad_documents"] = oracle(
    "SELECT DISTINCT CAST(doc AS VARCHAR) AS doc_id, 'not valid JSON' AS reason FROM feed_elem WHERE broken", "feed_elem"
)

# Upper-case word lookup on the first known part; parts are tried left to right.
WAKED = """
parts AS (
  SELECT aircraft_type, unnest(string_split(aircraft_type, '/')) AS part, generate_subscripts(string_split(aircraft_type, '/'), 1) AS n
  FROM (SELECT DISTINCT aircraft_type FROM ping WHERE aircraft_type IS NOT NULL) d
),
hit AS (SELECT aircraft_type, arg_min(wake, n) AS wake FROM parts JOIN wake_dim ON upper(trim(part)) = type_code GROUP BY 1),
waked AS (SELECT p.*, coalesce(h.wake, 'unknown') AS wake FROM ping p LEFT JOIN hit h ON h.aircraft_type = p.aircraft_type),
ground AS (SELECT *, groundspeed_kts < CASE wake WHEN 'M' THEN 100 WHEN 'H' THEN 120 WHEN 'J' THEN 140 ELSE 50 END AS on_ground FROM waked)"""


def _waked(spark, sf):
    return feed.with_wake(load(spark, sf, "ping"), load(spark, sf, "wake_dim"))


QUERIES["wake_lookup"] = lambda spark, sf: _waked(spark, sf).select("cid", "aircraft_type", "wake")
ORACLES["wake_lookup"] = oracle("WITH " + WAKED.lstrip() + " SELECT cid, aircraft_type, wake FROM waked", "ping", "wake_dim")

QUERIES["traffic_in_box"] = lambda spark, sf: feed.in_bbox(load(spark, sf, "ping"), pad=0.05).select(
    "cid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
)
ORACLES["traffic_in_box"] = oracle("""
SELECT cid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ping
WHERE lat BETWEEN 29e0 - 0.05e0 AND 34e0 + 0.05e0 AND lon BETWEEN 33.5e0 - 0.05e0 AND 36.5e0 + 0.05e0
""", "ping")

QUERIES["traffic_board"] = lambda spark, sf: feed.traffic_board(feed.in_bbox(_waked(spark, sf))).select(
    "cid", "on_ground", "top_line", "bottom_line", "detail_text"
)
ORACLES["traffic_board"] = oracle("WITH " + WAKED.lstrip() + """
SELECT cid, on_ground, callsign || CASE WHEN trim(coalesce(aircraft_type, '')) <> '' THEN '/' || trim(aircraft_type) ELSE '' END AS top_line,
  CASE WHEN on_ground THEN 'GRND' WHEN aircraft_type IS NULL OR upper(trim(flight_rules)) = 'V' THEN CAST(greatest(0, altitude_ft) AS VARCHAR) || 'ft'
    ELSE 'FL' || printf('%03d', CAST(greatest(0, altitude_ft) // 100 AS INT)) END || '/' || CAST(greatest(0, groundspeed_kts) AS VARCHAR) || 'kt' AS bottom_line,
  callsign || chr(10) || coalesce(aircraft_type, '(no flight plan)') || ' · ' || wake || chr(10) ||
    'ALT ' || altitude_ft || ' ft · GS ' || groundspeed_kts || ' kt · HDG ' || printf('%03d', heading_deg) || '°' ||
    CASE WHEN departure <> '' OR arrival <> '' THEN chr(10) || coalesce(nullif(departure, ''), '?') || ' → ' || coalesce(nullif(arrival, ''), '?') ELSE '' END AS detail_text
FROM ground WHERE lat BETWEEN 29 AND 34 AND lon BETWEEN 33.5 AND 36.5
""", "ping", "wake_dim")

QUERIES["presence_changes"] = lambda spark, sf: feed.presence_changes(load(spark, sf, "ping"))
ORACLES["presence_changes"] = oracle("""
WITH seen AS (SELECT DISTINCT callsign, snapshot_ts FROM ping),
ord AS (SELECT snapshot_ts, row_number() OVER (ORDER BY snapshot_ts) AS n FROM (SELECT DISTINCT snapshot_ts FROM ping) d),
s AS (SELECT callsign, n FROM seen JOIN ord USING (snapshot_ts))
SELECT a.callsign, o.snapshot_ts, 'lost' AS change FROM s a JOIN ord o ON o.n = a.n + 1
WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.callsign = a.callsign AND b.n = a.n + 1)
UNION ALL
SELECT a.callsign, o.snapshot_ts, 'appeared' AS change FROM s a JOIN ord o ON o.n = a.n
WHERE a.n > 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.callsign = a.callsign AND b.n = a.n - 1)
""", "ping")

QUERIES["traffic_counts"] = lambda spark, sf: feed.traffic_counts(feed.in_bbox(_waked(spark, sf)))
ORACLES["traffic_counts"] = oracle("WITH " + WAKED.lstrip() + """
SELECT snapshot_ts, wake, on_ground, count(*) AS n_aircraft FROM ground
WHERE lat BETWEEN 29 AND 34 AND lon BETWEEN 33.5 AND 36.5 GROUP BY 1, 2, 3
""", "ping", "wake_dim")

QUERIES["traffic_rollup"] = lambda spark, sf: feed.traffic_rollup(_waked(spark, sf))
ORACLES["traffic_rollup"] = oracle("WITH " + WAKED.lstrip() + """
SELECT snapshot_ts, wake, count(*) AS n_aircraft, CAST(grouping(snapshot_ts, wake) AS INT) AS level FROM waked GROUP BY ROLLUP (snapshot_ts, wake)
""", "ping", "wake_dim")

QUERIES["current_traffic"] = lambda spark, sf: feed.current_traffic(load(spark, sf, "ping")).select(
    "snapshot_ts", "cid", "callsign"
)
ORACLES["current_traffic"] = oracle(
    "SELECT snapshot_ts, cid, callsign FROM ping WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM ping)", "ping"
)


def deduped(spark, sf):
    entries = feed_source.feed_entries(feed_documents(spark, sf))
    again = entries.where(F.col("pos") == 0)  # documents that landed twice
    return feed.dedupe_snapshots(entries.unionByName(again)).select("snapshot_ts", "pos")


QUERIES["snapshot_dedupe"] = deduped
ORACLES["snapshot_dedupe"] = oracle(
    "SELECT DISTINCT snapshot_ts, pos FROM feed_elem WHERE NOT broken AND NOT no_list", "feed_elem"
)


def sketched_traffic(spark, sf):
    """Sketches of six hours rolled up to ten days, beside the exact counts: is each estimate within its error?"""
    pings = _waked(spark, sf).withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp"))
    guess = feed.distinct_traffic(feed.traffic_sketches(pings, "6 hours", "wake"), "10 days", "wake")
    exact = pings.groupBy(F.window("snapshot_ts", "10 days")["start"].alias("window_start"), "wake").agg(F.count_distinct("callsign").alias("n_exact"))
    near = F.abs(F.col("n_aircraft") - F.col("n_exact")) <= F.greatest(F.col("n_exact") * 0.05, F.lit(1.0))
    return exact.join(guess, ["window_start", "wake"], "full").select("window_start", "wake", "n_exact", near.alias("within"))


QUERIES["distinct_traffic"] = sketched_traffic
ORACLES["distinct_traffic"] = oracle("WITH " + WAKED.lstrip() + """
SELECT time_bucket(INTERVAL '10 days', snapshot_ts, TIMESTAMP '1970-01-01') AS window_start, wake, count(DISTINCT callsign) AS n_exact, TRUE AS within
FROM waked GROUP BY ALL
""", "ping", "wake_dim")
