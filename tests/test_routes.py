import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import blocks, routes

POINT = "plan_id bigint, n_points int, block int, seq int, is_wp boolean, code string, name string, lat double, lon double"


def table(spark, plans, block_rows=blocks.BLOCK_ROWS):
    rows = []
    for pid, pts in plans.items():
        for i, (code, lat, lon) in enumerate(pts):
            rows.append((pid, len(pts), i // block_rows, i, code is not None, code, None, lat, lon))
    return spark.createDataFrame(rows, POINT)


def walk(pts):
    kept = []
    for code, lat, lon in pts:
        if code is not None:
            if kept and kept[-1][0] == code:
                continue
        elif not kept or (abs(kept[-1][1] - lat) < 1e-6 and abs(kept[-1][2] - lon) < 1e-6):
            continue
        kept.append((code, lat, lon))
    return kept


def random_plans(n, seed):
    rng = random.Random(seed)
    places = {c: (30 + i / 10, 34 + i / 7) for i, c in enumerate(["AAAAA", "BBBBB", "CCCCC"])}
    plans = {}
    for pid in range(n):
        pts = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.4 or not pts:
                code = rng.choice(list(places)) if rng.random() < 0.9 else None
                pts.append((code, *places[code]) if code else (None, 33.0, 35.0))
            elif kind < 0.85:  # drifting or equal to the previous point
                _, lat, lon = pts[-1]
                pts.append((None, lat + rng.choice([0, 4e-7, 8e-7, 1.5e-6, 3e-6]), lon + rng.choice([0, 4e-7])))
            else:
                pts.append((None, 31 + rng.random(), 35.0))
        plans[pid] = pts
    return plans


@pytest.mark.parametrize("block_rows", [1, 2, 3, 5, blocks.BLOCK_ROWS])
def test_assembly_equals_sequential_walk(spark, block_rows):
    plans = random_plans(150, 7)
    got = {}
    out = routes.assemble_plans(table(spark, plans, block_rows), block_rows)
    for r in out.orderBy("plan_id", "seq").collect():
        assert r.seq == len(got.setdefault(r.plan_id, []))
        got[r.plan_id].append((r.code, r.lat, r.lon))
    assert got == {pid: kept for pid, pts in plans.items() if (kept := walk(pts))}


def slow_plans():
    """Runs of near-equal points over many blocks: drifts of several paces, hovering, waypoints of one code at two places."""
    rng = random.Random(11)
    plans = {}
    for pid, pace in enumerate([1e-9, 3e-8, 2.5e-7, 4e-7, 9.9e-7, 0.0]):
        plans[pid] = [("AAAAA", 31.0, 35.0)] + [(None, 31.0 + pace * i, 35.0 - pace * (i % 7)) for i in range(120)]
    plans[10] = [("AAAAA", 31.0, 35.0)] + [(None, 31.0 + rng.uniform(-9e-7, 9e-7), 35.0 + rng.uniform(-9e-7, 9e-7)) for _ in range(120)]
    plans[11] = [(None, 31.0, 35.0)] * 30 + [("AAAAA", 31.0 + (i % 2) * 7e-7, 35.0) if i % 3 else (None, 31.0 + rng.uniform(0, 2e-6), 35.0) for i in range(60)]
    plans[12] = [(None, 31.0, 35.0)] * 20
    plans[13] = [("AAAAA", 31.0, 35.0)] * 50 + [("BBBBB", 31.0, 35.0)]
    return plans


@pytest.mark.parametrize("block_rows", [2, 7, 16])
def test_long_runs_equal_sequential_walk(spark, block_rows):
    plans = {**slow_plans(), **{100 + p: pts for p, pts in random_plans(60, 5).items()}}
    want = {pid: walk(pts) for pid, pts in plans.items()}
    got = {}
    for r in routes.assembled_labels(table(spark, plans, block_rows), block_rows).orderBy("plan_id", "seq").collect():
        got.setdefault(r.plan_id, []).append((r.seq, r.code, r.lat, r.lon, r.label))
    labelled = {}
    for pid, kept in want.items():
        base, since = None, 0
        for i, p in enumerate(kept):
            base, since = (p[0], 0) if p[0] else (base, since + 1)
            labelled.setdefault(pid, []).append((i, *p, p[0] or f"{base}.{since}"))
    assert got == labelled
    cols = ["plan_id", "leg_no", "from_label", "to_label", "distance_nm", "from_is_wp", "to_is_wp"]
    one_pass = routes.plan_legs(table(spark, plans, block_rows), block_rows=block_rows).select(*cols)
    apart = routes.legs(table(spark, {p: k for p, k in want.items() if k})).select(*cols)
    assert sorted(map(tuple, one_pass.collect())) == sorted(map(tuple, apart.collect()))


def test_a_block_has_few_walks():
    import json

    import pandas as pd

    from skyledger.operators import assembly

    rows = [(1, i // 4096, False, None, 31.0 + 4e-7 * i, 35.0) for i in range(20_000)]
    pdf = pd.DataFrame(rows, columns=["plan_id", "block", "is_wp", "code", "lat", "lon"])
    out = pd.concat(assembly._summary(1e-6)(iter([pdf.iloc[:5000], pdf.iloc[5000:]])))
    assert out["block"].tolist() == [0, 1, 2, 3, 4]
    assert all(len(json.loads(w)) <= 8 for w in out["what"])


def test_blocks_do_not_change_legs(spark):
    plans = {p: walk(pts) for p, pts in random_plans(60, 3).items()}
    plans[99] = [(None, 31.0, 35.0), (None, 31.1, 35.0), ("AAAAA", 31.2, 35.0), (None, 31.3, 35.0)]
    cols = ["plan_id", "leg_no", "from_label", "to_label", "distance_nm"]
    whole = sorted(map(tuple, routes.legs(table(spark, plans)).select(*cols).collect()))
    cut = sorted(map(tuple, routes.legs(table(spark, plans, 2), block_rows=2).select(*cols).collect()))
    assert whole == cut
    assert [r[2:4] for r in whole if r[0] == 99] == [("VIA.1", "VIA.2"), ("VIA.2", "AAAAA"), ("AAAAA", "AAAAA.1")]


def test_parse_reports_first_error_only(spark):
    texts = ["AAAAA BBBBB", "", "  ", "AAAAA  BBBB", "LLBG 3133N03433E", "AAA 9999N00000E", "AAAAA 3160N03400E", "aaaa"]
    tokens, errors = routes.parse_plans(spark.createDataFrame(list(enumerate(texts)), "plan_id bigint, text string"))
    bad = {r.plan_id: (r.position, r.token) for r in errors.collect()}
    assert bad == {1: (None, None), 2: (None, None), 3: (2, ""), 5: (1, "AAA"), 6: (2, "3160N03400E"), 7: (1, "aaaa")}
    assert sorted({r.plan_id for r in tokens.collect()}) == [0, 4]


def test_resolve_prefers_name_then_index_and_rejects_whole_plan(spark):
    wps = spark.createDataFrame(
        [(2, "AAAAA", "b", 1.0, 1.0), (1, "aaaaa", "c", 2.0, 2.0), (3, "BBBBB", None, 3.0, 3.0)],
        "idx int, code string, name_he string, lat double, lon double",
    )
    texts = [(0, "AAAAA BBBBB"), (1, "BBBBB ZZZZZ YYYYY")]
    points, errors = routes.resolve_plans(routes.parse_plans(spark.createDataFrame(texts, "plan_id bigint, text string"))[0], wps)
    assert [(r.plan_id, r.lat) for r in points.orderBy("seq").collect()] == [(0, 1.0), (0, 3.0)]
    assert [(r.plan_id, r.position, r.token) for r in errors.collect()] == [(1, 2, "ZZZZZ")]


@pytest.mark.parametrize(
    "kind,text,stored",
    [
        ("distance", "1.25", "1.2"), ("distance", "1.15", "1.1"), ("distance", "1.35", "1.4"), ("distance", "0.04", "0.0"),
        ("distance", "12", "12.0"), ("distance", "0", None), ("distance", "1.234", None), ("distance", "2.75", "2.8"),
        ("bearing", "7", "007"), ("bearing", "361", None), ("bearing", "x", None), ("altitude", "1600 , 800", "1600,800"),
        ("altitude", "0", None), ("frequency", "123.4", "123.4"), ("frequency", "123.45", None),
    ],
)
def test_override_texts(spark, kind, text, stored):
    assert spark.createDataFrame([(text,)], "t string").select(routes.parse_override(kind, F.col("t")).alias("s")).first().s == stored


def test_tenths_match_correct_rounding(spark):
    texts = [f"{c // 100}.{c % 100:02d}" for c in range(1, 3000, 1)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", routes.parse_override("distance", F.col("t")).alias("s")).collect()}
    assert got == {t: f"{float(t):.1f}" for t in texts}


def test_overrides_fall_back_and_names(spark):
    legs = routes.legs(table(spark, {1: [("AAAAA", 31.0, 35.0), ("BBBBB", 31.5, 35.0)]}))
    edits = spark.createDataFrame(
        [(1, "AAAAA", "BBBBB", "distance", "0.04", 2), (1, "AAAAA", "BBBBB", "altitude", "900", 1), (1, "AAAAA", "BBBBB", "altitude", "bad", 2)],
        "plan_id bigint, from_label string, to_label string, field string, text string, edit_no int",
    )
    r = routes.apply_overrides(legs, edits, 90.0).first()
    assert r.eff_distance_nm == pytest.approx(r.distance_nm) and r.eff_altitudes_ft == [900]
    plans = {1: [("AAAA", 1.0, 1.0), (None, 2.0, 2.0)], 2: [(None, 1.0, 1.0)], 3: [("A-B1", 1.0, 1.0), ("LLBG", 2.0, 2.0)]}
    names = {r.plan_id: r.plan_name for r in routes.plan_names(table(spark, plans)).collect()}
    assert names == {1: "AAAA", 2: "flight-plan", 3: "AB1-LLBG"}
    texts = {r.plan_id: r.plan_text for r in routes.plan_strings(table(spark, plans, 1)).collect()}
    assert texts[1] == "AAAA 0200N00200E"
