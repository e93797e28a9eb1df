import datetime as dt
import random

from pyspark.sql import functions as F

from skyledger.streaming import edits, traffic

EDIT = "plan_id bigint, edit_no bigint, action string, lat double, lon double"


def edit_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = rng.choices(["add", "remove", "clear"], [8, 3, 0.4])[0]
        lat, lon = 31 + rng.randint(0, 5) / 10, 35 + rng.randint(0, 3) / 10
        rows.append((rng.randint(0, 5), i, action, lat + rng.choice([0.0, 0.004, 0.03, 0.03]), lon))
    return rows


def waypoints(spark):
    rows = [(i, f"W{i}", 31 + (i % 6) / 10, 35 + (i // 6) / 10) for i in range(24)]
    return spark.createDataFrame(rows, "idx int, code string, lat double, lon double")


def brute(rows):
    import math

    def nm(a, o, b, q):
        p, r = math.radians(a), math.radians(b)
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin(math.radians(q - o) / 2) ** 2
        return 2 * 6371.0 / 1.852 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    wps = [(f"W{i}", 31 + (i % 6) / 10, 35 + (i // 6) / 10) for i in range(24)]
    plans = {}
    for pid, _, action, lat, lon in rows:
        route = plans.setdefault(pid, [])
        if action == "clear":
            route.clear()
        elif action == "remove":
            c = [(d, i) for i, p in enumerate(route) if (d := nm(lat, lon, p[1], p[2])) < 4.0]
            if c:
                route.pop(min(c)[1])
        else:
            c = [(d, i) for i, w in enumerate(wps) if (d := nm(lat, lon, w[1], w[2])) < 1.0]
            if c:
                w = wps[min(c)[1]]
                if not (route and route[-1][0] == w[0]):
                    route.append(w)
            elif route and not (abs(route[-1][1] - lat) < 1e-6 and abs(route[-1][2] - lon) < 1e-6):
                route.append((None, lat, lon))
    return {p: [x[0] for x in r] for p, r in plans.items() if r}


def routes_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.plan_id, r.seq)):
        out.setdefault(r.plan_id, []).append(r.code)
    return out


def test_replay_equals_sequential_edits(spark):
    rows = edit_rows(400, 2)
    got = routes_of(edits.replay_edits(spark.createDataFrame(rows, EDIT), waypoints(spark)).collect())
    assert got == brute(rows)


def run_edits(spark, files, folder, delay):
    """Lands lists of edits one after the other; returns all changes."""
    schema = EDIT + ", edit_ts timestamp"
    start = dt.datetime(2024, 1, 1)
    for rows in files:
        timed = [(*r, start + dt.timedelta(minutes=r[1])) for r in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("edit_ts", delay)
    q = (
        edits.edit_stream(stream, waypoints(spark)).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_replay_with_late_files_equals_batch(spark, tmp_path):
    rows = edit_rows(90, 4)
    end = [(99, 100_000, "clear", 0.0, 0.0)]  # the watermark passes all others
    late = [r for r in rows if r[1] % 5 == 2]
    files = [
        [r for r in rows if r[1] < 40 and r not in late],
        [r for r in rows if 40 <= r[1] < 70 and r not in late] + [r for r in late if r[1] < 40],
        [r for r in rows if r[1] >= 70 and r not in late] + [r for r in late if r[1] >= 40],
        end,
    ]
    changes = run_edits(spark, files, tmp_path, "75 minutes")
    assert routes_of(edits.current_routes(changes).collect()) == brute(rows)


def test_stream_retracts_rows_of_cleared_and_shorter_routes(spark, tmp_path):
    add = lambda n, i, plan=1: (plan, n, "add", 31 + i / 10, 35.0)
    files = [
        [add(0, 0), add(1, 1), add(2, 2), add(0, 0, 2)],
        [(99, 150, "clear", 0.0, 0.0)],
        [(1, 200, "remove", 31.1, 35.0), (2, 201, "clear", 0.0, 0.0)],
        [(99, 100_000, "clear", 0.0, 0.0)],
    ]
    changes = run_edits(spark, files, tmp_path, "10 minutes")
    got = [(r.plan_id, r.version, r.seq, r.removed, r.code) for r in changes.orderBy("plan_id", "version", "seq").collect()]
    assert got == [
        (1, 1, 0, False, "W0"), (1, 1, 1, False, "W1"), (1, 1, 2, False, "W2"), (1, 2, 1, False, "W2"), (1, 2, 2, True, None),
        (2, 1, 0, False, "W0"), (2, 2, 0, True, None),
    ]
    assert routes_of(edits.current_routes(changes).collect()) == {1: ["W0", "W2"]}


def test_an_edit_costs_the_same_on_a_long_route():
    import time

    Route = edits._new_route(4.0)
    spent = []
    for n in (2_000, 20_000):
        route, start = Route(), time.process_time()
        for i in range(n):
            route.apply("add", 29.5 + (i * 37 % 3900) / 1000, 34.1 + (i * 53 % 1800) / 1000 + i * 1e-7, None if i else "AAAAA", 29.5, 34.1)
            if i % 3 == 2:
                route.apply("remove", 29.5 + (i * 7 % 3900) / 1000, 34.1 + (i * 11 % 1800) / 1000, None, None, None)
        spent.append(time.process_time() - start)
    assert len(route.points) > 10_000 and spent[1] < 60 * spent[0]


def test_current_snapshot_sink(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    write = traffic.keep_current(str(tmp_path / "now"))
    batch = lambda rows: spark.createDataFrame(rows, "snapshot_ts timestamp, callsign string")
    hour = dt.timedelta(hours=1)
    write(batch([(t, "A"), (t + hour, "B"), (t + hour, "C")]), 0)
    write(batch([(t, "OLD")]), 1)
    write(batch([]), 2)
    assert sorted(r.callsign for r in traffic.read_current(spark, str(tmp_path / "now")).collect()) == ["B", "C"]
    for n in range(3, 7):
        write(batch([(t + n * hour, f"N{n}")]), n)
        write(batch([(t + n * hour, f"N{n}")]), n)  # a repeated batch
    assert [r.callsign for r in traffic.read_current(spark, str(tmp_path / "now")).collect()] == ["N6"]
    assert sorted(p.name for p in (tmp_path / "now").iterdir()) == ["version=5", "version=6"]


def test_windows_batch(spark):
    t = dt.datetime(2024, 1, 1, 0, 14)
    df = spark.createDataFrame([(t, "L"), (t, "L"), (t + dt.timedelta(minutes=2), "L")], "snapshot_ts timestamp, wake string")
    assert sorted(r.n_aircraft for r in traffic.windowed_counts(df, "15 minutes").collect()) == [1, 2]
