import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import calib, feed, tiles
from skyledger.sources import charts
from skyledger.sources import feed as feed_source


def test_feed_documents(spark, tmp_path):
    good = {
        "general": {"update_timestamp": "2026-05-17T12:30:00Z"},
        "pilots": [
            {"cid": 1, "callsign": "A", "latitude": 32.0, "longitude": 34.9, "altitude": "FL230", "groundspeed": 100.9, "heading": -1,
             "transponder": "0021", "flight_plan": {"aircraft_short": "", "aircraft_faa": "H/B738/L", "flight_rules": "I"}},
            7,
            {"cid": 2, "longitude": 34.9},
            {"cid": "3", "latitude": "31.5", "longitude": 35, "altitude": "12.7", "heading": 360, "flight_plan": None},
            {"cid": 4, "latitude": 31, "longitude": 35, "flight_plan": {"aircraft_short": "  ", "aircraft_faa": "C172"}},
        ],
    }
    for name, text in {"a": json.dumps(good), "b": "{oops", "c": "[1]", "d": '{"pilots": 3}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    entries, bad = feed_source.read_feed(spark, str(tmp_path))
    assert entries.count() == 5
    assert sorted(r.reason for r in bad.collect()) == ["not valid JSON", "root is not an object"]
    rows = {r.cid: r for r in feed.clean_pilots(entries).collect()}
    assert sorted(rows) == [1, 3, 4]
    assert (rows[1].altitude_ft, rows[1].groundspeed_kts, rows[1].heading_deg, rows[1].transponder) == (0, 100, 359, "0021")
    assert (rows[3].altitude_ft, rows[3].heading_deg, rows[3].aircraft_type) == (12, 0, None)
    assert rows[1].aircraft_type == "H/B738/L" and rows[4].aircraft_type is None
    (tmp_path / "wake").mkdir()
    (tmp_path / "wake" / "w.json").write_text(json.dumps({"types": {" b738 ": "M", "X": "Q", "Y": 5}}))
    wake = feed_source.read_wake(spark, str(tmp_path / "wake"))
    assert [tuple(r) for r in wake.collect()] == [("B738", "M")]
    assert feed_source.read_wake(spark, str(tmp_path / "none")).count() == 0
    waked = {r.cid: r.wake for r in feed.with_wake(feed.clean_pilots(entries), wake).collect()}
    assert waked == {1: "M", 3: "unknown", 4: "unknown"}


def test_box_edges_and_ground_threshold(spark):
    df = spark.createDataFrame([(29.0, 33.5), (34.0, 36.5), (28.999, 34.0)], "lat double, lon double")
    assert feed.in_bbox(df).count() == 2
    g = spark.createDataFrame([("M", 99), ("M", 100), ("unknown", 49), ("?", 50)], "wake string, groundspeed_kts int")
    assert [r.g for r in g.select(feed.on_ground().alias("g")).collect()] == [True, False, True, False]


@pytest.mark.parametrize("z,n", [(12, 1344), (13, 5217), (14, 20240), (15, 80154), (16, 319740)])
def test_closed_form_counts(z, n):
    assert tiles.tile_count((29.3, 33.4, 34.0, 36.0), z) == n


def test_inverted_box(spark):
    boxes = spark.createDataFrame([(1, 31.0, 30.0, 34.0, 35.0), (2, 31.0, 31.0, 35.0, 35.0)], "box_id int, min_lat double, max_lat double, min_lon double, max_lon double")
    assert [r.box_id for r in tiles.tiles_for_boxes(boxes, [12]).collect()] == [2]
    assert tiles.tile_count((31.0, 30.0, 34.0, 35.0), 12) == 0


def test_eviction_stops_exactly_at_target(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("p", 12, i, 0, 10, t + dt.timedelta(seconds=i // 2)) for i in range(10)] + [("q", 12, 0, 0, 5, t)]
    df = spark.createDataFrame(rows, "provider string, z int, x int, y int, bytes bigint, mtime timestamp")
    for target, n in ((100, 0), (99, 1), (70, 3), (61, 4), (60, 4), (0, 10)):
        got = sorted(r.x for r in tiles.eviction_plan(df, target).collect() if r.provider == "p")
        assert got == list(range(n)), target


@pytest.mark.parametrize("block_rows", [2, 100])
def test_give_up_every_third_failure(spark, block_rows):
    statuses = [503, 429, 500, 503, 200, 503, 503, 404, 500, 500, 500, 500, 500, 500]
    rows = [(12, 1, 1, i, s, 300 if i != 4 else 255, None, None) for i, s in enumerate(statuses)]
    log = spark.createDataFrame(rows, "z int, x int, y int, attempt_no int, status int, bytes int, retry_after string, error string")
    out = tiles.with_give_up(tiles.attempt_outcomes(log), block_rows).orderBy("attempt_no").collect()
    assert [r.attempt_no for r in out if r.gave_up] == [2, 10, 13]
    assert out[4].outcome == "missing"  # 255 bytes
    assert [r.backoff_s for r in out][:4] == [5.0, 30.0, None, 5.0]


def test_give_up_counts_attempts_not_numbers(spark):
    rows = [(12, 1, 1, n, 503, 0, None, None) for n in (0, 5, 9, 400, 401)]
    log = spark.createDataFrame(rows, "z int, x int, y int, attempt_no int, status int, bytes int, retry_after string, error string")
    out = tiles.with_give_up(tiles.attempt_outcomes(log), 7).orderBy("attempt_no").collect()
    assert [r.attempt_no for r in out if r.gave_up] == [9]


def test_listing(spark, tmp_path):
    for rel, size in {"p/12/1/2.jpg": 5, "p/12/1/3.jpg": 0, "p/12/1/4.jpg.tmp": 5, "p/12/x/5.jpg": 5}.items():
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"a" * size)
    df = charts.read_tile_inventory(spark, str(tmp_path))
    assert [(r.provider, r.z, r.x, r.y, r.bytes) for r in df.collect()] == [("p", 12, 1, 2, 5)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_canonical_url(spark):
    raw = "  HTTPS://Host.example/ב'-03%20a b.pdf?q=é 1#f"
    got = spark.createDataFrame([(raw,)], "u string").select(charts.canonical_url(F.col("u")).alias("u")).first().u
    assert got == "https://Host.example/%D7%91'-03%20a%20b.pdf?q=%C3%A9%201#f"


def test_fit_recovers_affine_and_rejects(spark):
    from skyledger.functions import geo

    pts = [(1, "north", f"C{i}", 31 + (i * 7 % 5) / 4, 34.3 + i / 5) for i in range(6)]
    pts += [(2, "north", f"C{i}", 31.0 + i / 10, 34.0) for i in range(2)] + [(3, "north", "C0", 31.0 + i, 34.0 + i * i) for i in range(4)]
    df = spark.createDataFrame(pts, "edition int, sheet string, code string, lat double, lon double")
    x, y = geo.lcc_xy(F.col("lat"), F.col("lon"))
    uv = df.withColumn("u", 20.0 * x + 0.5 * y + 0.4).withColumn("v", 0.3 * x - 25.0 * y + 0.6)
    fits = calib.fit_sheets(uv).collect()
    assert [f.edition for f in fits] == [1]
    f = fits[0]
    assert [f.a, f.b, f.c, f.d, f.tx, f.ty] == pytest.approx([20.0, 0.5, 0.3, -25.0, 0.4, 0.6], abs=1e-9)
    assert f.residual_uv == pytest.approx(0.0, abs=1e-12)


def test_placement_equals_linear_solve(spark):
    from skyledger.functions import geo, mercator

    fit = (1, "north", 18.0, 0.4, -0.3, -24.0, 0.5, 0.45, 4000.0, 6000.0)
    fits = spark.createDataFrame([fit], "edition int, sheet string, a double, b double, c double, d double, tx double, ty double, width double, height double")
    t = spark.createDataFrame([(1, "north", 12, 2440, 1660)], "edition int, sheet string, z int, x int, y int")
    r = tiles.tile_placement(t, fits).first()

    def px(fx, fy):
        lon = mercator.lon_of(F.lit((2440 + fx) * 256.0), F.lit(12))
        lat = mercator.lat_of(F.lit((1660 + fy) * 256.0), F.lit(12))
        X, Y = geo.lcc_xy(lat, lon)
        row = spark.range(1).select(X.alias("X"), Y.alias("Y")).first()
        return ((18.0 * row.X + 0.4 * row.Y + 0.5) * 4000, (-0.3 * row.X - 24.0 * row.Y + 0.45) * 6000)

    m, rhs = [], []
    for sx, sy in ((0, 0), (1, 0), (1, 1), (0, 1)):
        dx, dy = px(sx, sy)
        sx, sy = sx * 256.0, sy * 256.0
        m += [[sx, sy, 1, 0, 0, 0, -dx * sx, -dx * sy], [0, 0, 0, sx, sy, 1, -dy * sx, -dy * sy]]
        rhs += [dx, dy]
    want = np.linalg.solve(np.array(m), np.array(rhs))
    got = [r.m11, r.m21, r.m31, r.m12, r.m22, r.m32, r.m13, r.m23]
    assert got == pytest.approx(list(want), rel=1e-6, abs=1e-9)
    assert r.residual_px < 1.0
