"""Callsigns that share the state and the timer of a bucket."""

import datetime as dt
import random

from skyledger.streaming import traffic

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def lost(spark, files, folder, **more):
    """(callsign, last seen) in hours, of lists of (callsign, hour) that land one after the other."""
    schema = "callsign string, snapshot_ts timestamp"
    for rows in files:
        timed = [(c, None if h is None else START + h * HOUR) for c, h in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("snapshot_ts", "10 minutes")
    found = traffic.presence_stream(stream, 3600.0, 60.0, **more)
    q = (
        found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/cp")
        .option("path", f"{folder}/out").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert all(r.snapshot_ts - r.last_seen == HOUR for r in rows)
    return sorted(((r.callsign, (r.last_seen - START) / HOUR) for r in rows), key=str), q


def plain(rows, end):
    seen = {r for r in rows if r[1] is not None}
    return sorted(((c, float(h)) for c, h in seen if (c, h + 1) not in seen and h + 61 / 60 <= end - 1 / 6), key=str)


def test_buckets_report_each_callsign_at_its_own_time(spark, tmp_path):
    rnd = random.Random(4)
    names = [*(f"CS{i}" for i in range(40)), None, ""]
    files = []
    for first in (0, 5, 11, 20):  # callsigns that stay over files, come back and come once
        files.append([(c, h) for h in range(first, first + 7) for c in names if rnd.random() < 0.4] * 2)
    files = [[r for r in f if r[1] >= n] for f, n in zip(files, (0, 7, 12, 20))]  # none late
    rows = [r for f in files for r in f] + [("END", 60)]
    files[1].append(("CS0", None))
    got, q = lost(spark, [*files, [("END", 60)]], tmp_path, buckets=3)
    assert got == plain(rows, 60) and len(got) > 100
    states = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert max(states) <= 3 * 4, states  # a value, a timer and its indexes for each bucket, not for each callsign
