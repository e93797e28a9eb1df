"""Choices that hang on the last bit of a distance: Spark and the SQL twins take the same steps."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skyledger.checks import spatial as checks
from skyledger.functions import geo
from skyledger.operators import anchors

LEG = "a DOUBLE, o DOUBLE, b DOUBLE, q DOUBLE, p DOUBLE, s DOUBLE"


def test_foot_on_the_end_of_a_leg(spark):
    """Arrows at the longitude of a due-east leg's end: beside or past, as in the SQL twin."""
    rows = []
    for i in range(400):
        o, q = 34.2 + (i * 53) % 160 / 100.0, 34.2 + (i * 53) % 160 / 100.0 + (i % 4 + 1) / 25.0
        a = 29.6 + (i * 37) % 350 / 100.0
        rows.append((a, o, a, q, a + 0.004, (o, q)[i % 2]))
    df = spark.createDataFrame(rows, LEG)
    cols = [F.col(c) for c in "aobqps"]
    got = df.select(*cols, geo.leg_fraction(*cols).alias("t"), (geo.leg_overshoot_nm(*cols) > 0).alias("past"), geo.leg_distance_nm(*cols).alias("d")).collect()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE flat0 ({LEG})")
    con.executemany("INSERT INTO flat0 VALUES (?, ?, ?, ?, ?, ?)", rows)
    parts = checks.MEASURED[checks.MEASURED.index("foot AS (") : checks.MEASURED.index("graded AS")].rstrip().rstrip(",")
    want = con.execute(f"WITH flat AS (SELECT *, cos(radians((a + b) * 0.5e0)) * 60e0 AS k, 0e0 AS bearing_deg, 0e0 AS brg FROM flat0), {parts} SELECT a, o, q, s, t, ov > 0, d FROM dist").fetchall()
    want = {r[:4]: r[4:] for r in want}
    differing = [r for r in got if want[r.a, r.o, r.q, r.s][:2] != (r.t, r.past)]
    assert not differing
    assert all(want[r.a, r.o, r.q, r.s][2] == pytest.approx(r.d, abs=1e-9) for r in got)


def test_direction_of_opposite_bearings(spark):
    r = spark.range(1).select(geo.mean_direction_deg(180.0, 0.0).alias("x"), geo.mean_direction_deg(0.0, 180.0).alias("y"), geo.mean_direction_deg(350.0, 20.0).alias("z")).first()
    assert r.x == pytest.approx(90.0) and r.y == pytest.approx(90.0) and r.z == pytest.approx(5.0)
    # the operator's rule stays that of the reference
    assert spark.range(1).select(geo.bisector_deg(180.0, 0.0).alias("x")).first().x == pytest.approx(270.0)


def test_anchor_distance_is_that_of_the_twin(spark):
    rows = [(29.5 + (i * 7919) % 38000 / 10007.0, 34.2 + (i * 6007) % 17000 / 10009.0, 29.5 + (i * 4001) % 38000 / 10007.0, 34.2 + (i * 911) % 17000 / 10009.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, o double, b double, q double")
    got = df.select("a", "o", anchors._km(*[F.col(c) for c in "aobq"], F.lit(0.0)).alias("d")).collect()
    want = [(((o - q) * 111) ** 2.0 + ((a - b) * 111) ** 2.0) ** 0.5 for a, o, b, q in rows]
    assert sorted(r.d for r in got) == sorted(want)
