"""Plans that share a timer, and waypoints that share a place."""

import pandas as pd

from skyledger.streaming import edits

SCHEMA = "plan_id bigint, edit_no bigint, edit_ts timestamp, action string, lat double, lon double"


def test_plans_of_one_bucket_and_copied_waypoints(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    spots = [(i, f"W{i}", 31.0 + i % 10 / 5, 35.0) for i in range(40)]  # four waypoints at each place
    waypoints = spark.createDataFrame(spots, "idx bigint, code string, lat double, lon double")
    rows = []
    for n in range(300):
        plan = n % 7
        action = "clear" if n % 101 == 50 else "remove" if n % 9 == 4 else "add"
        rows.append((plan, n, start + timedelta(hours=n), action, 31.0 + n * 7 % 10 / 5 + (0.001 if n % 3 else 0.06), 35.0))
    files = [rows[:120], rows[120:220], rows[220:], [(99, 9999, start + timedelta(days=400), "clear", 0.0, 0.0)]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("edit_ts", "2 days")
    q = (
        edits.edit_stream(stream, waypoints, buckets=2).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = edits.current_routes(spark.read.parquet(f"{tmp_path}/out")).collect()
    log = spark.createDataFrame(rows, SCHEMA).drop("edit_ts")
    want = edits.replay_edits(log, waypoints).collect()
    key = lambda r: (r.plan_id, r.seq, r.is_wp, r.code, r.lat, r.lon)
    assert sorted(map(key, got), key=repr) == sorted(map(key, want), key=repr)
    assert got and {r.code for r in got if r.is_wp} <= {f"W{i}" for i in range(10)}


def test_a_new_pack_costs_the_same_however_many_wait(spark, tmp_path):
    """No state value of a bucket holds all of its waiting edits: a pack is put beside the others, and only those of a day that is due are read."""
    held = {"days": None, "due": {}, "moved": 0}

    class Value:
        exists = lambda self: held["days"] is not None
        get = lambda self: held["days"]

        def update(self, value):
            held["days"] = value

    class Map:
        def __init__(self):
            self.kept = {}

        def updateValue(self, key, value):
            held["moved"] += sum(len(v) for v in value if isinstance(v, bytes))
            self.kept[key] = value

        def getValue(self, key):
            return self.kept[key]

        def containsKey(self, key):
            return key in self.kept

        def removeKey(self, key):
            del self.kept[key]

    class Handle:
        timers = set()
        getMapState = lambda self, *a: Map()
        getValueState = lambda self, *a: Value()
        registerTimer = lambda self, ms: self.timers.add(ms)
        deleteTimer = lambda self, ms: self.timers.discard(ms)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def batch(n):
        return pd.DataFrame({
            "plan_id": [0] * 100, "edit_ts": pd.to_datetime([n * 3600] * 100, unit="s"), "edit_no": range(n * 100, n * 100 + 100), "action": ["add"] * 99 + ["clear"],
            "lat": [31.0 + i / 10 for i in range(100)], "lon": [35.0] * 100, "idx": [None] * 100, "code": [None] * 100, "wp_lat": [None] * 100, "wp_lon": [None] * 100, "nm": [None] * 100,
        }).astype({c: "float64" for c in ("idx", "wp_lat", "wp_lon", "nm")})

    processor = processor_of(spark, tmp_path)
    processor.init(handle := Handle())
    moved = []
    for n in range(48):
        before = held["moved"]
        list(processor.handleInputRows(("0",), iter([batch(n)]), None))
        moved.append(held["moved"] - before)
    assert max(moved) < 1.5 * min(moved)
    assert handle.timers == {0} and len(processor.due.kept) == 48
    list(processor.handleExpiredTimer(("0",), Times(30 * 3_600_000), None))
    assert len(processor.due.kept) == 1 and 31 * 3_600_000 in handle.timers  # the second day's later edits, as one pack


def processor_of(spark, tmp_path):
    """The processor that the stream is given."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kept = []

    class Grouped:
        def transformWithStateInPandas(self, statefulProcessor, **how):
            kept.append(statefulProcessor)

    waypoints = spark.createDataFrame([(1, "W", 31.0, 35.0)], "idx bigint, code string, lat double, lon double")
    rows = spark.createDataFrame([], SCHEMA)
    group_by = type(rows).groupBy
    try:
        type(rows).groupBy = lambda self, *c: Grouped() if c == ("bucket",) else group_by(self, *c)
        edits.edit_stream(rows, waypoints)
    finally:
        type(rows).groupBy = group_by
    assert isinstance(kept[0], StatefulProcessor)
    return kept[0]
