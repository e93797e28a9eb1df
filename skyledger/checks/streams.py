"""Streaming queries: each runs a file stream over the given tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyledger.functions import sqltext
from skyledger.operators import feed, spatial
from skyledger.plans.views import load, oracle
from skyledger.session import checkpoint_dir
from skyledger.sources import feed as feed_source
from skyledger.streaming import edits, traffic

QUERIES = {}
ORACLES = {}


def _finish(spark, stream, mode):
    """Run a stream over everything available and read back what it wrote."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def _pings(spark, sf):
    """Stream of (snapshot_ts, pos, callsign, aircraft_type) as in the batch view ``ping``."""
    e = F.col("event_id")
    types = ["B738", "A388/X", "C172", "XX/h/b738", "H/A333/L", " c172 ", "ZZZZ", "/A388"]
    kind = F.get(F.array(*[F.lit(t) for t in types]), (e % 9).cast("int"))
    return _events(spark, sf).select(
        F.date_trunc("hour", "ts").cast("timestamp").alias("snapshot_ts"), e.alias("pos"),
        F.concat(F.lit("CS"), F.col("user_id").cast("string")).alias("callsign"), kind.alias("aircraft_type"),
    )


def _wake_by_type(spark, sf):
    """Wake of every type text in the table: a static side for stream-static joins."""
    types = load(spark, sf, "ping").select("aircraft_type").distinct()
    return feed.with_wake(types, load(spark, sf, "wake_dim"))


def _land_feed(spark, sf):
    """One document per hour of pings in files of their own, some broken, some landed a second time; then ingested."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    entry = F.to_json(F.struct(F.col("cid"), "callsign", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.struct(F.col("aircraft_type").alias("aircraft_short")).alias("flight_plan")))
    hours = load(spark, sf, "ping").groupBy("snapshot_ts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]), ",").alias("body"))
    hour = F.floor(F.unix_timestamp("snapshot_ts") / 3600)
    text = F.concat(F.lit('{"general":{"update_timestamp":"'), F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"},"pilots":['), "body", F.lit("]}"))
    value = F.when(hour % 29 == 3, F.lit('{"pilots": [')).when(hour % 31 == 4, F.lit("[1, 2]")).otherwise(text)
    docs = hours.select(value.alias("value"), hour.alias("hour"))
    again = docs.where("hour % 7 = 0").withColumn("hour", -F.col("hour"))
    docs.unionByName(again).coalesce(4).write.partitionBy("hour").text(f"{base}/landed")
    feed_source.ingest_feed(spark, f"{base}/landed/hour=*", f"{base}/feed").awaitTermination()
    return f"{base}/feed"


def ingested_stream(spark, sf):
    """Landed files, ingested, read again as a stream with event time and freed of snapshots that landed twice."""
    entries = feed_source.ingested_entries(spark, _land_feed(spark, sf), streaming=True, delay="31 days")
    once = traffic.dedupe_snapshots(entries)
    return feed.clean_pilots(_finish(spark, once.withColumn("entry", F.to_json("entry")), "append").withColumn("entry", F.parse_json("entry"))).select(
        "snapshot_ts", "pos", "cid", "callsign", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "aircraft_type"
    )


_HOUR = "(epoch(snapshot_ts)::BIGINT // 3600)"
QUERIES["feed_ingest_stream"] = ingested_stream
ORACLES["feed_ingest_stream"] = oracle(f"""
SELECT snapshot_ts, CAST(row_number() OVER (PARTITION BY snapshot_ts ORDER BY pos) - 1 AS INT) AS pos, cid, callsign, round(lat, 6) AS lat, round(lon, 6) AS lon, nullif(trim(aircraft_type), '') AS aircraft_type
FROM ping WHERE {_HOUR} % 29 <> 3 AND {_HOUR} % 31 <> 4
""", "ping")


def rejected_stream(spark, sf):
    found = feed_source.rejected_documents(spark, _land_feed(spark, sf))
    return found.select(F.regexp_extract("doc_id", "hour=([^/]+)/", 1).cast("bigint").alias("hour"), "reason")


QUERIES["feed_rejected_stream"] = rejected_stream
ORACLES["feed_rejected_stream"] = oracle(f"""
WITH h AS (SELECT DISTINCT {_HOUR} AS hour FROM ping), landed AS (SELECT hour, hour AS h FROM h UNION ALL SELECT -hour, hour FROM h WHERE hour % 7 = 0)
SELECT hour, CASE WHEN h % 29 = 3 THEN 'not valid JSON' ELSE 'root is not an object' END AS reason FROM landed WHERE h % 29 = 3 OR h % 31 = 4
""", "ping")


def counts_stream(spark, sf):
    pings = traffic.with_event_time(_pings(spark, sf), "10 minutes")
    waked = pings.join(_wake_by_type(spark, sf), "aircraft_type", "left").withColumn(
        "wake", F.coalesce("wake", F.lit(feed.UNKNOWN_WAKE))
    )
    return _finish(spark, traffic.windowed_counts(waked, "6 hours"), "append").select(
        "window_start", "window_end", "wake", "n_aircraft"
    )


COUNTED = """
WITH w AS (
  SELECT snapshot_ts, CASE WHEN aircraft_type IN ('B738', 'XX/h/b738') THEN 'M' WHEN aircraft_type IN ('A388/X', '/A388') THEN 'J'
    WHEN trim(aircraft_type) IN ('C172', 'c172') THEN 'L' WHEN aircraft_type = 'H/A333/L' THEN 'H' ELSE 'unknown' END AS wake FROM ping
)
SELECT time_bucket(INTERVAL '6 hours', snapshot_ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL '6 hours', snapshot_ts, TIMESTAMP '1970-01-01') + INTERVAL '6 hours' AS window_end, wake, count(*) AS n_aircraft
FROM w GROUP BY ALL"""
QUERIES["windowed_counts_stream"] = counts_stream
# Windows that the watermark has not passed when the stream ends stay open.
ORACLES["windowed_counts_stream"] = oracle(
    f"SELECT * FROM ({COUNTED}) t WHERE window_end <= (SELECT max(snapshot_ts) - INTERVAL '10 minutes' FROM ping)", "ping"
)
QUERIES["windowed_counts"] = lambda spark, sf: traffic.windowed_counts(
    feed.with_wake(load(spark, sf, "ping"), load(spark, sf, "wake_dim")).withColumn(
        "snapshot_ts", F.col("snapshot_ts").cast("timestamp")
    ),
    "6 hours", "2 hours",
)
ORACLES["windowed_counts"] = oracle(COUNTED.replace(
    "SELECT time_bucket(INTERVAL '6 hours', snapshot_ts, TIMESTAMP '1970-01-01') AS window_start,\n  time_bucket(INTERVAL '6 hours', snapshot_ts, TIMESTAMP '1970-01-01') + INTERVAL '6 hours' AS window_end, wake, count(*) AS n_aircraft\nFROM w GROUP BY ALL",
    "SELECT s AS window_start, s + INTERVAL '6 hours' AS window_end, wake, count(*) AS n_aircraft\nFROM (SELECT wake, time_bucket(INTERVAL '2 hours', snapshot_ts, TIMESTAMP '1970-01-01') - INTERVAL '2 hours' * unnest([0, 1, 2]) AS s FROM w) q GROUP BY ALL",
), "ping")


def dedupe_stream(spark, sf):
    pings = traffic.with_event_time(_pings(spark, sf), "10 minutes").select("snapshot_ts", "pos")
    twice = pings.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _finish(spark, traffic.dedupe_snapshots(twice), "append").select("snapshot_ts", "pos")


QUERIES["snapshot_dedupe_stream"] = dedupe_stream
ORACLES["snapshot_dedupe_stream"] = oracle("SELECT snapshot_ts, pos FROM ping", "ping")


def lost_stream(spark, sf):
    pings = traffic.with_event_time(_pings(spark, sf), "10 minutes")
    return _finish(spark, traffic.presence_stream(pings, 3600.0, 60.0), "append").select(
        "callsign", "last_seen", "snapshot_ts"
    )


def current_stream(spark, sf):
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        _pings(spark, sf).writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        .foreachBatch(traffic.keep_current(f"{base}/now")).start()
    )
    query.awaitTermination()
    return traffic.read_current(spark, f"{base}/now").select("snapshot_ts", "pos", "callsign")


QUERIES["current_traffic_stream"] = current_stream
ORACLES["current_traffic_stream"] = oracle(
    "SELECT snapshot_ts, pos, callsign FROM ping WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM ping)", "ping"
)

QUERIES["presence_stream"] = lost_stream
# The last snapshots have not outlived watermark (10 min) plus grace (1 min) when the stream ends.
ORACLES["presence_stream"] = oracle("""
WITH seen AS (SELECT DISTINCT callsign, snapshot_ts AS t FROM ping), m AS (SELECT max(t) AS last FROM seen)
SELECT callsign, t AS last_seen, t + INTERVAL '1 hour' AS snapshot_ts FROM seen a, m
WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.callsign = a.callsign AND b.t = a.t + INTERVAL '1 hour')
  AND t + INTERVAL '61 minutes' <= last - INTERVAL '10 minutes'
""", "ping")

def replay_stream(spark, sf):
    """Edits landed by spans of five days, a seventh of them one span late; what is final when the stream ends."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = load(spark, sf, "route_edit")
    span = F.floor(F.unix_timestamp("edit_ts") / (5 * 86400)) + (F.col("edit_no") % 7 == 3).cast("int")
    log = log.withColumn("span", span)
    log.repartition("span").write.partitionBy("span").parquet(f"{base}/spans")
    spans = spark.read.schema(log.schema).parquet(f"{base}/spans")  # a span is read by itself
    files = 4  # of a span, which are read together
    for number in sorted(r[0] for r in spans.select("span").distinct().collect()):
        spans.where(F.col("span") == number).select(*log.drop("span").columns).repartition(files, "edit_no").write.mode("append").parquet(f"{base}/in")
    landed = spark.readStream.schema(log.drop("span").schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    stream = edits.edit_stream(landed.withWatermark("edit_ts", "11 days"), load(spark, sf, "waypoint"))
    return edits.current_routes(_finish(spark, stream, "append"))


QUERIES["route_replay_stream"] = replay_stream

QUERIES["route_replay"] = lambda spark, sf: edits.replay_edits(load(spark, sf, "route_edit"), load(spark, sf, "waypoint"))
# Edit by edit, every plan's route as a list.
_near = sqltext.gc("r.lat", "r.lon", "w.lat", "w.lon")
_to = sqltext.gc("e.lat", "e.lon", "p.lat", "p.lon")
REPLAYED = f"""
WITH RECURSIVE snap AS (
  SELECT r.plan_id, r.edit_no, w.code, w.lat, w.lon, row_number() OVER (PARTITION BY r.plan_id, r.edit_no ORDER BY {_near}, w.idx) AS rn
  FROM route_edit r JOIN waypoint w ON r.action = 'add' AND abs(w.lat - r.lat) < 1 AND {_near} < {spatial.SNAP_NM!r}
),
e AS (
  SELECT r.plan_id, r.action, r.lat, r.lon, s.code, s.lat AS wlat, s.lon AS wlon, row_number() OVER (PARTITION BY r.plan_id ORDER BY r.edit_no) AS k
  FROM route_edit r LEFT JOIN snap s ON s.plan_id = r.plan_id AND s.edit_no = r.edit_no AND s.rn = 1
),
walk AS (
  SELECT plan_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(is_wp BOOLEAN, code VARCHAR, lat DOUBLE, lon DOUBLE)[]) AS route FROM (SELECT DISTINCT plan_id FROM e) d
  UNION ALL
  SELECT q.plan_id, q.k, CASE
      WHEN action = 'clear' THEN []
      WHEN action = 'remove' THEN CASE WHEN list_min(ds) < {spatial.REMOVE_NM!r} THEN list_concat(route[:list_position(ds, list_min(ds)) - 1], route[list_position(ds, list_min(ds)) + 1:]) ELSE route END
      WHEN action = 'add' AND code IS NOT NULL THEN CASE WHEN len(route) > 0 AND last.is_wp AND last.code = code THEN route
        ELSE list_append(route, {{'is_wp': TRUE, 'code': code, 'lat': wlat, 'lon': wlon}}) END
      WHEN action = 'add' AND len(route) > 0 AND (abs(last.lat - lat) >= 1e-6 OR abs(last.lon - lon) >= 1e-6)
        THEN list_append(route, {{'is_wp': FALSE, 'code': CAST(NULL AS VARCHAR), 'lat': lat, 'lon': lon}})
      ELSE route END
  FROM (SELECT e.*, s.route, s.route[len(s.route)] AS last, list_transform(s.route, lambda p: {_to}) AS ds FROM walk s JOIN e ON e.plan_id = s.plan_id AND e.k = s.k + 1) q
),
ended AS (SELECT plan_id, arg_max(route, k) AS route FROM walk GROUP BY plan_id)
SELECT plan_id, CAST(unnest(range(len(route))) AS INT) AS seq, unnest(list_transform(route, lambda p: p.is_wp)) AS is_wp,
  unnest(list_transform(route, lambda p: p.code)) AS code, unnest(list_transform(route, lambda p: p.lat)) AS lat, unnest(list_transform(route, lambda p: p.lon)) AS lon
FROM ended
"""
ORACLES["route_replay"] = oracle(REPLAYED, "route_edit", "waypoint")
# Edits that the watermark (11 days behind) has not passed are not applied yet.
ORACLES["route_replay_stream"] = oracle(
    REPLAYED.replace("FROM route_edit r JOIN", "FROM final r JOIN").replace("FROM route_edit r LEFT JOIN", "FROM final r LEFT JOIN").replace(
        "WITH RECURSIVE snap AS", "WITH RECURSIVE final AS (SELECT * FROM route_edit WHERE edit_ts <= (SELECT max(edit_ts) FROM route_edit) - INTERVAL '11 days'), snap AS"
    ), "route_edit", "waypoint")

