import math
from collections import Counter
from fractions import Fraction

import numpy as np

from skyledger.llm import whitening


def plain(rows, components=8, by_count=True):
    """(key, n, deviation) of every sound row, and whitened values of one sign choice by (key position, component)."""
    sound = [(k, [math.floor(1024 * float(c)) + 100_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    counts = Counter(tuple(x) for _, x in sound)
    fit = [np.array(x, "float64") for x, c in counts.items() for _ in range(c if by_count else 1)]
    n, sums = len(fit), [sum(x[i] * (c if by_count else 1) for x, c in counts.items()) for i in range(len(sound[0][1]))]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    d = np.array(fit) - mean
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = [(k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x, "float64") - mean) @ axes / np.sqrt(np.maximum(values, 1e-300))) for k, x in sound]
    return out, values, float(np.trace(d.T @ d / n))


def compare(got, rows, components=8, by_count=True):
    want, values, trace = plain(rows, components, by_count)
    kept = len(values)
    assert len(got) == len(want) * kept
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, kept + 1):
        sign = np.sign(sum(by[k, c].whitened * z[c - 1] for k, _, _, z in want))
        for k, n, deviation, z in want:
            r = by[k, c]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.whitened - sign * z[c - 1]) < 1e-7 * (1 + abs(z[c - 1]))
            assert abs(r.explained - values[c - 1] / trace) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_given_table_equals_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whitening.whitened_embeddings(vectors).collect()
    compare(got, [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_equal_vectors_weigh_by_count_or_one(frame):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5] + 300
    rows = [(i, [float(v) for v in base[0 if i % 3 == 0 else i % 60]]) for i in range(240)]
    table = frame(rows, "vec_id long, embedding array<double>")
    compare(whitening.whiten(table, components=4).collect(), rows, 4)
    compare(whitening.whiten(table, components=4, by_count=False).collect(), rows, 4, by_count=False)


def test_large_numbers_stay_exact(frame):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rnd.normal(size=3) * 1e9 + 1e12]) for i in range(50)]
    compare(whitening.whiten(frame(rows, "vec_id long, embedding array<double>"), components=3).collect(), rows, 3)


def test_odd_rows(frame):
    rnd = np.random.default_rng(3)
    good = [(i, [float(v) for v in rnd.normal(size=4)]) for i in range(30)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0]), (93, [math.nan] * 4), (94, [math.inf, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0, 0.0])]
    table = frame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS w", "'a' AS component", "3 AS deviation")
    compare(whitening.whiten(table, components=8).collect(), good)  # four dimensions: four components
    again = frame([(None, good[0][1]), (5, good[5][1]), *good], "vec_id long, embedding array<double>")
    assert Counter(r.vec_id for r in whitening.whiten(again).collect()) == Counter([None, 5, *range(30)] * 4)


def test_without_variance_or_rows(frame):
    same = frame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whitened_embeddings(same).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in range(4) for c in (1, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(4, 0, None, None, None)}
    line = frame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whitened_embeddings(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9
    empty = whitening.whitened_embeddings(same.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
