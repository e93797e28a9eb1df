import hashlib
import random
import re

from skyledger.llm import anchors


def by_hand(rows, window=13):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in anchors.dedup_digests(df).collect()), key=str)


def test_random_repeats_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(anchors, "_PACK_BYTES", 2000)
    monkeypatch.setattr(anchors, "_BUCKET_BYTES", 5000)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    pieces = [[rnd.choice(vocab) for _ in range(rnd.randint(8, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(pieces) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))]
        rows.append((i * 3 - 50, " ".join(words)))
    assert got(frame(rows, "doc_id long, text string", 5)) == by_hand(rows)


def test_odd_rows(frame):
    run = " ".join(f"x{i}" for i in range(14))
    rows = [
        (5, run, 1), (5, run, 1), (2, run + " tail", 0), (None, run, 2), (9, None, 3), (8, "", 4), (7, "  \n\t", 5),
        (10, " ".join(["a"] * 60), 6), (11, " ".join(["a"] * 13), 7), (12, run.replace(" ", "\n"), 8), (1, "x1 x2", 9), (-3, "É " * 20, 0),
    ]
    df = frame(rows, "doc_id long, text string, pack int")
    assert got(df) == by_hand([r[:2] for r in rows])
    spans = {r.doc_id: r.spans for r in anchors.anchor_dedup(df).collect() if r.doc_id in (11, 12)}
    assert [tuple(s) for s in spans[11]] == [(0, 13)] and [tuple(s) for s in spans[12]] == [(0, 14)]


def test_empty_table(frame):
    assert anchors.dedup_digests(frame([], "doc_id long, text string")).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == by_hand([(r.doc_id, r.text) for r in docs.collect()])
