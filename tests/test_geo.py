import math

import pytest
from pyspark.sql import functions as F

from skyledger.functions import geo, mercator, registry


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_distance_bearing_and_degenerate(spark):
    assert one(spark, geo.great_circle_nm(31.0, 35.0, 32.0, 35.0)) == pytest.approx(60.0405, abs=1e-3)
    assert one(spark, geo.true_bearing_deg(31.0, 35.0, 31.0, 35.0)) == 0.0
    assert one(spark, geo.true_bearing_deg(31.0, 35.0, 30.0, 35.0)) == pytest.approx(180.0)
    assert one(spark, geo.magnetic_bearing_deg(31.0, 35.0, 32.0, 35.0)) == pytest.approx(355.0)


@pytest.mark.parametrize("s,text", [(0.5, "00:00:00"), (1.5, "00:00:02"), (3661.0, "01:01:01"), (-4.0, "00:00:00"), (float("nan"), "00:00:00"), (float("inf"), "00:00:00")])
def test_hms_rounds_half_even(spark, s, text):
    assert one(spark, geo.hms(F.lit(s))) == text


def test_shown_bearing_and_zero_speed(spark):
    assert one(spark, geo.shown_bearing(F.lit(0.4))) == 359
    assert one(spark, geo.shown_bearing(F.lit(0.5))) == 0
    assert one(spark, geo.leg_seconds(F.lit(10.0), 0.0)) == 0.0


def test_coordinates(spark):
    assert one(spark, geo.format_coord(F.lit(31.55), F.lit(34.55))) == "3133N03433E"
    assert one(spark, geo.format_coord(F.lit(31.9951), F.lit(-34.999))) == "3200N03500W"
    rows = spark.createDataFrame([(t,) for t in ("3133N03433E", "9000S18000W", "9001N00000E", "3160N03400E", "3100N18001E", "x")], "t string")
    lat, lon = geo.parse_coord(F.col("t"))
    got = [(r.a, r.o) for r in rows.select(lat.alias("a"), lon.alias("o")).collect()]
    assert got[0] == (pytest.approx(31.55), pytest.approx(34.55))
    assert got[1] == (-90.0, -180.0)
    assert got[2:] == [(None, None)] * 4


def test_angles_and_leg_measures(spark):
    assert one(spark, geo.circular_diff_deg(350.0, 10.0)) == pytest.approx(20.0)
    assert one(spark, geo.axis_diff_deg(350.0, 170.0)) == pytest.approx(0.0)
    assert one(spark, geo.bisector_deg(10.0, 190.0)) == pytest.approx(100.0)
    args = [F.lit(v) for v in (31.0, 35.0, 32.0, 35.0, 31.5, 35.01)]
    assert one(spark, geo.leg_distance_nm(*args)) == pytest.approx(0.6 * math.cos(math.radians(31.5)), abs=1e-6)
    assert one(spark, geo.leg_side(*args)) == -1
    past = [F.lit(v) for v in (31.0, 35.0, 32.0, 35.0, 32.01, 35.0)]
    assert one(spark, geo.leg_overshoot_nm(*past)) == pytest.approx(0.6, abs=1e-6)


def test_projection_round_trip(spark):
    x, y = geo.lcc_xy(F.lit(32.3), F.lit(34.6))
    lat, lon = geo.lcc_latlon(x, y)
    assert one(spark, lat) == pytest.approx(32.3, abs=1e-10)
    assert one(spark, lon) == pytest.approx(34.6, abs=1e-10)
    ax, ay = geo.lcc_xy(F.lit(31.0), F.lit(35.0))
    assert one(spark, ax) == pytest.approx(0.0, abs=1e-12) and one(spark, ay) == pytest.approx(0.0, abs=1e-12)


def test_mercator(spark):
    assert one(spark, mercator.tile_x(F.lit(0.0), F.lit(1))) == 1
    assert one(spark, mercator.tile_y(F.lit(0.0), F.lit(1))) == 1
    assert one(spark, mercator.world_y(F.lit(89.9), F.lit(3))) == pytest.approx(0.0, abs=1e-9)
    assert one(spark, mercator.lat_of(mercator.world_y(F.lit(-31.5), F.lit(12)), F.lit(12))) == pytest.approx(-31.5, abs=1e-9)
    assert one(spark, mercator.tile_url("u/{z}/{y}/{x}", F.lit(3), F.lit(1), F.lit(2))) == "u/3/2/1"


def test_sql_functions_agree_with_columns(spark):
    registry.register(spark)
    df = spark.createDataFrame([(31.2, 34.7, 32.4, 35.3), (29.9, 35.0, 29.9, 35.0)], "a double, o double, b double, q double")
    a, o, b, q = (F.col(c) for c in "aobq")
    pairs = [
        ("gc_nm(a, o, b, q)", geo.great_circle_nm(a, o, b, q)),
        ("mag_bearing(a, o, b, q, 5D)", geo.magnetic_bearing_deg(a, o, b, q)),
        ("lcc_x(a, o)", geo.lcc_xy(a, o)[0]), ("lcc_y(a, o)", geo.lcc_xy(a, o)[1]),
        ("tile_x(o, 14)", mercator.tile_x(o, F.lit(14))), ("tile_y(a, 14)", mercator.tile_y(a, F.lit(14))),
        ("metres_per_pixel(a, 14)", mercator.metres_per_pixel(a, F.lit(14))),
        ("circular_diff(a * 10, q * 9)", geo.circular_diff_deg(a * 10, q * 9)),
        ("hms(a * 100)", geo.hms(a * 100)),
    ]
    row = df.select(*[F.expr(s).alias(f"s{i}") for i, (s, _) in enumerate(pairs)], *[c.alias(f"c{i}") for i, (_, c) in enumerate(pairs)]).collect()
    for r in row:
        for i in range(len(pairs)):
            assert r[f"s{i}"] == (pytest.approx(r[f"c{i}"], rel=1e-12) if not isinstance(r[f"c{i}"], str) else r[f"c{i}"])
    assert spark.sql("SELECT count(*) FROM tiles_for_box(29.3D, 33.4D, 34D, 36D, 12)").first()[0] == 1344


def test_sql_coordinates_follow_the_same_rules(spark):
    from skyledger.functions import registry

    registry.register(spark)
    tokens = ["3112N03446E", "3199N03400E", "9901N03400E", "3100N18159E", "9000S18000W", "9001N18000W", "abc", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    lat, lon = geo.parse_coord(F.col("t"))
    rows = df.select("t", lat.alias("a"), lon.alias("b"), F.expr("coord_lat(t)").alias("c"), F.expr("coord_lon(t)").alias("d")).collect()
    assert [(r.c, r.d) for r in rows] == [(r.a, r.b) for r in rows]
    assert [r.t for r in rows if r.c is not None] == ["3112N03446E", "9000S18000W"]
    back = df.where("coord_lat(t) is not null").select("t", F.expr("coord_text(coord_lat(t), coord_lon(t))").alias("s")).collect()
    assert all(r.s == r.t for r in back)
    assert spark.sql("SELECT bisector(350D, 20D) AS b").first().b == pytest.approx(5.0)


def test_sql_geometry_agrees_with_columns(spark):
    from skyledger.sources import charts

    registry.register(spark)
    pairs = spark.range(72 * 3).selectExpr("CAST(id % 72 * 5 AS DOUBLE) AS a", "CAST(id % 72 * 5 + 180 + (id DIV 72) * 35 AS DOUBLE) AS b")
    for r in pairs.select("a", "b", F.expr("bisector(a, b)").alias("s"), geo.bisector_deg(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.s == pytest.approx(r.c, abs=1e-9)
    legs = spark.createDataFrame([(31.0, 35.0, 31.5, 35.2, p, q) for p in (30.9, 31.2, 31.6) for q in (34.9, 35.1, 35.3)] + [(31.0, 35.0, 31.0, 35.0, 31.1, 35.0)], "a_lat double, a_lon double, b_lat double, b_lon double, p_lat double, p_lon double")
    args = [F.col(c) for c in legs.columns]
    for name, column in (("fraction", geo.leg_fraction), ("distance", geo.leg_distance_nm), ("overshoot", geo.leg_overshoot_nm), ("side", geo.leg_side)):
        for r in legs.select(F.expr(f"leg_{name}({', '.join(legs.columns)})").alias("s"), column(*args).alias("c")).collect():
            assert r.s == (r.c if r.c is None else pytest.approx(r.c, abs=1e-12))
    urls = spark.createDataFrame([(u,) for u in (" HTTP://h/a b?c=%20#d e ", "no scheme/ü'x", "x:y", "", "file:///a\"b")], "url string")
    for r in urls.select(F.expr("canonical_url(url)").alias("s"), charts.canonical_url(F.col("url")).alias("c")).collect():
        assert r.s == r.c
    row = spark.sql("SELECT ring_area2(array()) AS e, ring_axis(array(struct(0D AS x, 0D AS y))) AS none, view_width(0D, 0D, 1D) AS w, crop_coord(10D, 72D, 0D, 0D) AS bad").first()
    assert (row.e, row.none, row.bad) == (0.0, None, None) and row.w == pytest.approx(3440.065 * 3.141592653589793 / 180)
