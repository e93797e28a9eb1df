"""Plans that keep time, shuffle and memory in proportion to the input."""

import random

import __spark_entry__ as entry
from skyledger.checks import routes
from skyledger.operators import routes as operators
from skyledger.operators import spatial
from skyledger.plans.views import load
from test_matching import nm

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def tasks_of(df) -> int:
    return df.rdd.getNumPartitions()


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark):
    assert tasks_of(spark.read.parquet(f"{SF}/part.parquet")) == 1
    for name in ("waypoint_clean", "stored_anchors", "stored_arrows"):
        assert tasks_of(entry.queries()[name](spark, SF)) >= 4, name


def test_clicks_on_short_plans_have_no_copies(spark):
    points = spark.range(200).selectExpr("id DIV 5 AS plan_id", "5 AS n_points", "CAST(id % 5 AS int) AS seq", "30D + id / 100 AS lat", "35D AS lon")
    out = spatial.nearest_plan_point(points.selectExpr("plan_id", "seq AS click_id", "lat", "lon"), points)
    assert all(r.near_seq == r.click_id and r.near_nm == 0 for r in out.collect())
    done = plan_of(out).split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    assert "gx" not in done and "gy" not in done


def test_clicks_on_long_and_short_plans(spark):
    rng = random.Random(11)
    size = {0: 3, 1: 64, 2: 65, 3: 200}
    points = [(p, n, s, 30 + rng.random(), 35 + rng.random()) for p, n in size.items() for s in range(n)]
    points += [(1, 64, 70, points[10][3], points[10][4]), (3, 200, 300, points[150][3], points[150][4]), (0, 3, 9, None, 35.0)]
    clicks = [(i, i % 5, 30 + rng.random(), 35 + rng.random()) for i in range(400)]
    clicks += [(500, 1, points[10][3], points[10][4]), (501, 3, points[150][3], points[150][4]), (502, 1, None, 35.0), (503, None, 30.5, 35.5), clicks[0]]
    out = spatial.nearest_plan_point(
        spark.createDataFrame(clicks, "click_id int, plan_id int, lat double, lon double"),
        spark.createDataFrame(points, "plan_id int, n_points int, seq int, lat double, lon double"), 4.0,
    )
    rows = out.collect()
    assert sorted(r.click_id for r in rows) == sorted(c[0] for c in clicks) and out.columns == ["click_id", "plan_id", "lat", "lon", "near_seq", "near_nm"]
    for r in rows:
        near = [(d, s) for p, _, s, a, o in points if None not in (r.lat, a) and p == r.plan_id and (d := nm(r.lat, r.lon, a, o)) < 4.0]
        assert r.near_seq == (min(near)[1] if near else None)


def test_strings_and_drifts_walk_their_plans_once(spark):
    for name in ("plan_strings", "drift_totals"):
        tree = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert tree.count("next_label") > 0 and sum("MapInPandas" in line and "next_label" in line for line in tree.split("\n")) == 1, name


def test_long_plans_are_no_window(spark):
    """No window runs over a whole plan's rows; those of drift_totals are per block or over one row per block."""
    tree = entry.queries()["trail_totals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in tree
    for name, points in (("trail_point", routes.trail_points), ("drift_point", routes.drift_points)):
        want = load(spark, SF, name)
        got = points(spark, SF).select(*want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0


def test_an_override_text_is_trimmed_once(spark):
    legs = spark.createDataFrame([(1, "A", "B", 10.0, 90.0)], "plan_id long, from_label string, to_label string, distance_nm double, mag_bearing_deg double")
    edits = spark.createDataFrame([(1, "A", "B", "distance", " 1.25 ", 0), (1, "A", "B", "distance", "x", 1), (1, "A", "B", "ctr", " C ", 2)], "plan_id long, from_label string, to_label string, field string, text string, edit_no int")
    out = operators.apply_overrides(legs, edits, 90.0)
    row = out.first()
    assert (row.eff_distance_nm, row.eff_bearing, row.ctr, row.freq) == (1.2, 89, "C", None)
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("regexp_replace(") == 1
