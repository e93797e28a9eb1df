import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import matching, routes, spatial

POINT = "plan_id bigint, n_points int, block int, seq int, is_wp boolean, code string, name string, lat double, lon double"


def nm(a, o, b, q):
    p, r = math.radians(a), math.radians(b)
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin(math.radians(q - o) / 2) ** 2
    return 2 * 6371.0 / 1.852 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brg(a, o, b, q):
    p, r, d = math.radians(a), math.radians(b), math.radians(q - o)
    return math.degrees(math.atan2(math.sin(d) * math.cos(r), math.cos(p) * math.sin(r) - math.sin(p) * math.cos(r) * math.cos(d))) % 360


def turn(x, y):
    d = (x - y) % 360
    return min(d, 360 - d)


def measure(leg, arrow):
    (a, o, _), (b, q, _) = leg
    k = 60 * math.cos(math.radians((a + b) / 2))
    bx, by, px, py = (q - o) * k, (b - a) * 60, (arrow["lon"] - o) * k, (arrow["lat"] - a) * 60
    length = math.hypot(bx, by)
    t = (px * bx + py * by) / length**2
    d = nm(arrow["lat"], arrow["lon"], a, o) if t <= 0 else nm(arrow["lat"], arrow["lon"], b, q) if t >= 1 else math.hypot(px - t * bx, py - t * by)
    cross = (q - o) * (arrow["lat"] - a) - (b - a) * (arrow["lon"] - o)
    side = (cross > 1e-12) - (cross < -1e-12)
    diff = turn(arrow["brg"], brg(a, o, b, q))
    if arrow["bi"]:
        diff = min(diff, 180 - diff)
    over = max(0, -t, t - 1) * length
    cls = 2 if arrow["bi"] else 0 if side < 0 else 1
    return {"d": d, "over": over, "side": side, "diff": diff, "key": (cls, int(over > 0), d + 0.01 * diff)}


def brute(points, arrows):
    """All legs against all arrows of one plan, rule by rule, as lists."""
    legs = list(zip(points, points[1:]))
    real = [a[2] and b[2] for a, b in legs]
    m = [[measure(leg, ar) for ar in arrows] for leg in legs]
    ids, span = range(len(arrows)), range(len(legs))

    def fits(s, i):
        x = m[s][i]
        return x["d"] <= (0.65 if real[s] else 1.3) and x["over"] <= 0.3 and x["diff"] <= (15 if x["over"] > 0 else 30)

    owner = {i: min(c)[1] for i in ids if (c := [(m[s][i]["key"], s) for s in span if fits(s, i)])}

    def first(s, owned):
        c = [(m[s][i]["key"], i) for i, w in owned.items() if w == s]
        return min(c)[1] if c else None

    def stacked(s, p, i):
        x, y = arrows[p], arrows[i]
        if i == p or x["bi"] != y["bi"] or nm(x["lat"], x["lon"], y["lat"], y["lon"]) > 0.55:
            return False
        return x["bi"] or (turn(x["brg"], y["brg"]) <= 15 and m[s][p]["side"] * m[s][i]["side"] >= 0)

    for s in span:
        if real[s] and (p := first(s, owner)) is not None:
            for i in ids:
                if i in owner and owner[i] != s and not real[owner[i]] and stacked(s, p, i):
                    owner[i] = s
    res = [[] for _ in legs]
    for s in span:
        if (p := first(s, owner)) is not None:
            mates = sorted((nm(arrows[p]["lat"], arrows[p]["lon"], arrows[i]["lat"], arrows[i]["lon"]), i) for i in ids if owner.get(i, s) == s and stacked(s, p, i))
            res[s] = list(arrows[p]["alts"])
            for _, i in mates:
                res[s] += [v for v in arrows[i]["alts"] if v not in res[s]]
    for s in span[:-1]:
        b1, b2 = brg(*legs[s][0][:2], *legs[s][1][:2]), brg(*legs[s + 1][0][:2], *legs[s + 1][1][:2])
        if real[s] and real[s + 1] and not res[s] and not res[s + 1] and turn(b1, b2) >= 30:
            mid = math.degrees(math.atan2(math.sin(math.radians(b1)) + math.sin(math.radians(b2)), math.cos(math.radians(b1)) + math.cos(math.radians(b2)))) % 360
            c = [(min(m[s][i]["d"], m[s + 1][i]["d"]) + 0.01 * turn(arrows[i]["brg"], mid), i) for i in ids
                 if i not in owner and not arrows[i]["bi"] and turn(arrows[i]["brg"], mid) <= 15 and min(m[s][i]["d"], m[s + 1][i]["d"]) <= 0.5]
            if c:
                i = min(c)[1]
                owner[i] = s
                res[s] = res[s + 1] = list(arrows[i]["alts"])
    wants = []
    for i in ids:
        if i not in owner and not arrows[i]["bi"]:
            c = [(m[s][i]["key"][2], s) for s in span if real[s] and not res[s] and m[s][i]["over"] <= 0 and m[s][i]["side"] and m[s][i]["diff"] <= 20
                 and m[s][i]["d"] <= (1.8 if m[s][i]["side"] < 0 else 0.9)]
            if c:
                wants.append((min(c)[0], i, min(c)[1]))
    for _, i, s in sorted(wants):
        if not res[s]:
            res[s] = list(arrows[i]["alts"])
    return res


def test_matching_equals_brute_force(spark):
    rng = random.Random(11)
    plans = {}
    for p in range(40):
        lat, lon = 31 + rng.random() / 3, 34.6 + rng.random() / 3
        pts = []
        for j in range(7):
            pts.append((lat, lon, j == 0 or rng.random() < 0.75))
            lat, lon = lat + rng.uniform(-0.06, 0.06), lon + rng.uniform(-0.06, 0.06)
        plans[p] = pts
    arrows = []
    for k in range(420):
        a, b = (lambda q: (q[0], q[1]))(rng.choice([(x, y) for pts in plans.values() for x, y in zip(pts, pts[1:])]))
        t = rng.random()
        base = brg(*a[:2], *b[:2])
        arrows.append(
            {"lat": a[0] + t * (b[0] - a[0]) + rng.uniform(-0.02, 0.02), "lon": a[1] + t * (b[1] - a[1]) + rng.uniform(-0.02, 0.02),
             "brg": (base + rng.choice([0, 0, 5, 20, 40, 180]) + rng.uniform(-9, 9)) % 360, "bi": rng.random() < 0.2, "alts": rng.choice([[800], [1600, 800], [2000], [1200, 700]])}
        )
    rows = [(p, 7, 0, i, w, f"P{i}" if w else None, None, la, lo) for p, pts in plans.items() for i, (la, lo, w) in enumerate(pts)]
    legs = routes.legs(spark.createDataFrame(rows, POINT))
    chart = spatial.union_arrows(
        spark.createDataFrame(
            [("north", i, a["lat"], a["lon"], a["brg"], a["alts"], a["bi"]) for i, a in enumerate(arrows)],
            "sheet string, arrow_no bigint, lat double, lon double, bearing_deg double, altitudes_ft array<int>, bidirectional boolean",
        )
    )
    got = {(r.plan_id, r.leg_no): list(r.altitudes_ft) for r in matching.match_altitudes(legs, chart).collect()}
    want = {(p, s + 1): alts for p, pts in plans.items() for s, alts in enumerate(brute(pts, arrows))}
    assert got == want
    assert sum(map(bool, want.values())) > 60


def test_nearest_is_strict_and_ties_go_to_first(spark):
    wps = spark.createDataFrame([(2, "B", 31.0, 35.01), (1, "A", 31.0, 34.99), (3, "C", 31.0, 34.99)], "idx int, code string, lat double, lon double")
    pts = spark.createDataFrame([(1, 31.0, 35.0)], "click_id int, lat double, lon double")
    d = nm(31.0, 35.0, 31.0, 35.01)
    assert spatial.nearest_waypoint(pts, wps, d * 1.0001).first().near_code in ("A", "B")
    assert spatial.nearest_waypoint(pts, wps.where("idx <> 2"), d * 1.0001).first().near_code == "A"
    one = spatial.nearest_waypoint(pts, wps.where("idx = 2"), 5.0).first()
    assert one.near_code == "B"
    assert spatial.nearest_waypoint(pts, wps.where("idx = 2"), one.near_nm).first().near_code is None


def test_nearest_plan_point(spark):
    rng = random.Random(5)
    pts = [(p, 9, s, 30 + rng.random() / 5, 35 + rng.random() / 5) for p in range(6) for s in range(9)]
    clicks = [(i, i % 6, 30 + rng.random() / 5, 35 + rng.random() / 5) for i in range(60)]
    out = spatial.nearest_plan_point(
        spark.createDataFrame(clicks, "click_id int, plan_id int, lat double, lon double"),
        spark.createDataFrame(pts, "plan_id int, n_points int, seq int, lat double, lon double"), 4.0,
    )
    got = {r.click_id: r.near_seq for r in out.collect()}
    for i, p, la, lo in clicks:
        c = [(d, s) for q, _, s, a, o in pts if q == p and (d := nm(la, lo, a, o)) < 4.0]
        assert got[i] == (min(c)[1] if c else None)


def test_cells_along_a_line_hold_every_place_in_reach(spark):
    import math
    import random

    from skyledger.operators import grid

    rng = random.Random(2)
    legs, places = [], []
    for n in range(40):
        a = (rng.uniform(29, 33), rng.uniform(34, 36))
        b = (a[0] + rng.choice([0, 0, 1]) * rng.uniform(-1.5, 1.5), a[1] + rng.choice([0, 1]) * rng.uniform(-1.5, 1.5))
        legs.append((n, *a, *b))
        for _ in range(30):
            t, turn, off = rng.uniform(0, 1), rng.uniform(0, 2 * math.pi), rng.uniform(0, 1.99) / 60
            lat, lon = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
            places.append((n, lat + off * math.cos(turn), lon + off * math.sin(turn) / math.cos(math.radians(lat))))
    df = spark.createDataFrame(legs, "n int, a double, o double, b double, q double")
    ends = tuple(F.col(c) for c in "aobq")
    pad = F.lit(2.0 / 60 * 1.02)
    cells = grid.with_cells_along(df, ends, pad, pad / F.cos(F.radians(F.greatest("a", "b") + 1.0)), 4.0)
    have = {(r.n, r.gy, r.gx) for r in cells.collect()}
    gy, gx = grid.cell_of(F.col("lat"), F.col("lon"), 4.0)
    want = {(r.n, r.gy, r.gx) for r in spark.createDataFrame(places, "n int, lat double, lon double").select("n", gy.alias("gy"), gx.alias("gx")).collect()}
    assert want <= have
    length = sum(math.hypot((b - a) * 60, (q - o) * 60 * math.cos(math.radians(a))) for _, a, o, b, q in legs)
    assert len(have) <= 2 * (length / 4 * 3 + 9 * len(legs))  # three cells side by side, and the ends
