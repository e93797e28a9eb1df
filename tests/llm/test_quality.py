import random
import zlib

import numpy as np

from skyledger.llm import quality

SF = "/root/testdata/sf0.01"


def rank_area(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * zeros)


def test_held_out_rows_of_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rows["doc_id"], rows["held_out"]))
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    seen = rows[rows["held_out"] & rows["quality"].notna()]
    y = seen["quality"].to_numpy()
    assert rank_area(seen["score"].to_numpy(), y) > 0.97
    assert seen["predicted"].to_numpy()[y == 1].mean() > 0.97


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, labels, 60), quality.fit_quality(docs, turned, 60)
    assert a == b


def test_descent_reaches_the_optimum():
    rnd = np.random.default_rng(0)
    rows = [rnd.choice(12, 4, replace=False) for _ in range(60)]
    values, y = rnd.normal(size=12), np.where(rnd.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.3)
    w, b = quality.descend(rows, values, y, cost, 2000)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - t * (w[r] @ values[r] + b)) for r, t, c in zip(rows, y, cost))

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rnd.normal(size=12) * 1e-2, b + rnd.normal() * 1e-2) >= best - 1e-6


def test_odd_rows(frame):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice(["the", "cat", "sat", "on"]) for _ in range(20)), "x") for i in range(40)]
    bad = [(100 + i, "!!! BUY BUY " * 5, "x") for i in range(40)]
    odd = [(None, "the cat", "x"), (500, None, "x"), (501, "", "x"), (502, "!!! BUY BUY " * 20_000, "x"), (1, good[1][1], "x")]
    docs = frame([*good, *bad, *odd], "doc_id long, text string, score string")
    labels = frame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (500, None, 0), (501, 7, 0)], "doc_id long, quality int, text int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 85
    by = {r.doc_id: r for r in rows}
    assert by[502].predicted == 0 and by[1].predicted == 1 and by[None].held_out
    assert by[500].score == by[501].score


def test_no_labels_one_class_empty_table(frame):
    docs = frame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = frame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [0.5, 0.5]
    one = frame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.quality_scores(docs, one).collect())
    assert quality.quality_scores(frame([], "doc_id long, text string"), one).count() == 0


def test_every_frequent_enough_n_gram_is_learnt(frame):
    # 200,000 words in 4 texts each: more than were kept before; their class is known by them only
    rows = [(4 * i + k, " ".join(f"{'gb'[i % 2]}{i}x{j}" for j in range(2500)), 1 - i % 2) for i in range(80) for k in range(4)]
    model = quality.fit(frame(rows, "doc_id long, text string, label int"), epochs=3)
    known = set(model.weights)
    assert len(known) >= 80 * (2500 + 2499)
    assert all(quality._hash(w) in known for _, text, _ in rows for w in text.split())
