import math

import numpy as np
import pytest

from skyledger.llm import forest


def by_hand(rows, asked, k=10):
    ok = [(i, np.array(v, "float64")) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q in asked:
            near = {}
            for i, y in ok:
                if i != q:
                    near[i] = min(near.get(i, math.inf), float(np.sqrt(((x - y) ** 2).sum())))
            out[q] = sorted((s, i) for i, s in near.items())[:k]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    asked = set(range(0, 2000, 20))
    want = by_hand(rows, asked)
    got = as_dict(forest.forest_neighbours(vectors, vectors.filter("vec_id % 20 = 0")).collect())
    assert got.keys() == want.keys() and all(len(found) == 10 for found in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("offset, spread, big", [(1e6, 0.01, 1), (1e200, 1e190, 1), (0.0, 1.0, 1e300), (0.0, 1e-200, 1), (3.0, 1.0, 1), (0.0, 1e150, 1e-100)])
def test_a_block_is_exact_at_any_scale(offset, spread, big):
    rnd = np.random.default_rng(4)
    x = offset + rnd.normal(size=(300, 16)) * spread
    x[::50] *= big
    x[7] = x[8]
    ids = rnd.permutation(300)
    got = forest.nearest_of(x[:40], ids[:40], x, ids, 10)
    for q in range(40):
        d = []
        for y, i in zip(x, ids):
            if i != ids[q]:
                off = x[q] / 4 - y / 4  # a power of two: exact, and in range
                top = np.abs(off).max() or 1.0
                d.append((float(np.sqrt(((off / top) ** 2).sum()) * top * 4), int(i)))
        want = sorted(d)[:10]
        rows = got[got["query_id"] == ids[q]]
        assert rows["score"].tolist() == pytest.approx([s for s, _ in want], rel=1e-9)
        assert len(rows) == 10 and len({*rows["vec_id"]} & {i for _, i in want}) >= 9  # order within rounding


def test_rows_of_one_id_count_once():
    x = np.array([[0.0], [1.0], [1.1], [1.2], [1.3], [5.0], [6.0]])
    got = forest.nearest_of(x[:1], np.array([9]), x, np.array([9, 3, 3, 3, 3, 4, 2]), 3)
    assert got[["vec_id", "score"]].to_numpy().tolist() == [[3, 1.0], [4, 5.0], [2, 6.0]]


def test_large_offsets_through_the_forest(frame):
    rnd = np.random.default_rng(6)
    for offset, spread in ((1e6, 0.01), (1e200, 1e198)):
        rows = [(i, [float(v) for v in offset + rnd.normal(size=4) * spread]) for i in range(400)]
        df = frame(rows, "vec_id long, embedding array<double>")
        got = as_dict(forest.hundredth_queries(df).collect())
        assert sorted(got) == [0, 100, 200, 300]
        for q, found in got.items():
            d = {i: float(forest.distances(np.array([rows[q][1]]), np.array([v]))[0]) for i, v in rows if i != q}
            want = sorted(d, key=lambda i: (d[i], i))[:10]
            assert len(found) == 10 and len({i for _, i in found} & {*want}) >= 9


def test_odd_rows_and_hot_vectors(frame, monkeypatch):
    monkeypatch.setattr(forest, "ROW_BLOCK", 7)
    monkeypatch.setattr(forest, "QUERY_BLOCK", 3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(60)] + [(100 + i, [float(i), 1.0, -1.0]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (5, [1.0, 2.0, 0.5]), (206, [])]
    df = frame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, leaf string, rank int")
    got = as_dict(forest.forest_neighbours(df, df.filter("vec_id % 10 = 0"), leaves=8).collect())
    same(got, by_hand(rows, {*range(0, 60, 10), *range(100, 130, 10), 200}))


def test_few_candidates_and_empty_table(frame):
    two = frame([(0, [1.0, 0.0]), (7, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in forest.hundredth_queries(two).collect()] == [(0, 1, 7, pytest.approx(math.sqrt(10)))]
    assert forest.hundredth_queries(two.limit(0)).count() == 0
    assert forest.hundredth_queries(two.filter("vec_id = 0")).count() == 0
