"""Altitude matching writes no table of (leg, arrow) pairs and matches equal plans once."""

import math
import random

import __spark_entry__ as entry
from skyledger.operators import matching, routes, spatial
from test_matching import POINT, brg, brute

ARROW = "sheet string, arrow_no bigint, lat double, lon double, bearing_deg double, altitudes_ft array<int>, bidirectional boolean"


def world(seed):
    rng = random.Random(seed)
    plans, arrows = {}, []
    for p in range(12):
        lat, lon, pts = 31 + rng.random() / 5, 34.6 + rng.random() / 5, []
        for j in range(5):
            pts.append((lat, lon, j == 0 or rng.random() < 0.75))
            lat, lon = lat + rng.uniform(-0.06, 0.06), lon + rng.uniform(-0.06, 0.06)
        plans[p] = pts
    for _ in range(150):
        a, b = rng.choice([(x, y) for pts in plans.values() for x, y in zip(pts, pts[1:])])
        t = rng.random()
        arrows.append(
            {"lat": a[0] + t * (b[0] - a[0]) + rng.uniform(-0.02, 0.02), "lon": a[1] + t * (b[1] - a[1]) + rng.uniform(-0.02, 0.02),
             "brg": (brg(*a[:2], *b[:2]) + rng.choice([0, 5, 60, 90, 120]) + rng.uniform(-9, 9)) % 360, "bi": rng.random() < 0.2, "alts": rng.choice([[800], [1600, 800], [2000]])}
        )
    return plans, arrows


def tables(spark, plans, arrows):
    rows = [(p, len(pts), 0, i, w, f"P{i}" if w else None, None, la, lo) for p, pts in plans.items() for i, (la, lo, w) in enumerate(pts)]
    chart = [("north", i, a["lat"], a["lon"], a["brg"], a["alts"], a["bi"]) for i, a in enumerate(arrows)]
    return routes.legs(spark.createDataFrame(rows, POINT)), spatial.union_arrows(spark.createDataFrame(chart, ARROW))


def written(monkeypatch):
    """The tables that matching writes from here on."""
    kept, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    return kept


def test_pairs_are_not_written_and_equal_plans_are_matched_once(spark, monkeypatch):
    plans, arrows = world(3)
    flown = {p + 100 * n: pts for p, pts in plans.items() for n in range(6)}
    legs, chart = tables(spark, flown, arrows)
    kept = written(monkeypatch)
    got = {(r.plan_id, r.leg_no): list(r.altitudes_ft) for r in matching.match_altitudes(legs, chart).collect()}
    assert got == {(p, s + 1): alts for p, pts in flown.items() for s, alts in enumerate(brute(pts, arrows))}
    assert sum(map(bool, got.values())) > 60
    pairs = matching.arrow_leg_candidates(legs, chart).count()
    most = max(df.count() for df in kept if {"leg_no", "arrow_ord"} <= set(df.columns))
    assert most * 6 < pairs / 3, (most, pairs)


def test_plans_without_a_number_and_rows_that_come_twice(spark):
    plans, arrows = world(5)
    legs, chart = tables(spark, {**plans, **{p + 100: pts[: 3 + p % 3] for p, pts in plans.items()}}, arrows)
    odd = legs.unionByName(legs.where("plan_id % 5 = 1")).unionByName(legs.where("plan_id = 2").selectExpr("CAST(NULL AS BIGINT) AS plan_id", *legs.columns[1:]))
    seen = [(r.plan_id, r.leg_no, tuple(r.altitudes_ft)) for r in matching.match_altitudes(odd, chart).collect()]
    assert len(seen) == odd.count() and all(not alts for p, _, alts in seen if p is None)
    want = {(p, s + 1): tuple(alts) for p, pts in plans.items() if p % 5 != 1 for s, alts in enumerate(brute(pts, arrows))}
    assert {(p, s): alts for p, s, alts in seen if (p, s) in want} == want


def test_measures_are_refined_once_per_geometry(spark):
    plans, arrows = world(7)
    legs, chart = tables(spark, {p + 100 * n: pts for p, pts in plans.items() for n in range(4)}, arrows)
    plain = matching.arrow_leg_candidates(legs, chart)
    seen = spark.sparkContext.accumulator(0)
    out = matching.arrow_leg_candidates(legs, chart, refine=lambda m: m.mapInPandas(count_rows(seen), m.schema))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.select(out.columns).collect()))
    assert seen.value * 4 == plain.count() and math.isfinite(plain.selectExpr("sum(score) AS s").first().s)


def count_rows(seen):
    def fold(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return fold


def test_listed_candidates_are_rounded_before_legs_get_them(spark):
    tree = entry.queries()["arrow_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("round(") == 2 and tree.index("Join") < tree.index("round(")
