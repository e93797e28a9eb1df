import random
import zlib

import numpy as np

from skyledger.llm import bytenet


def tongue(seed, n=40):
    rnd = random.Random(seed)
    letters = "".join(rnd.sample("abcdefghijklmnopqrstuvwxyzäöüéñèç", 9))
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 8))) for _ in range(n)]


def texts(seed, rows, lang):
    rnd, words = random.Random(f"{seed}{lang}"), tongue(lang)
    return [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 30, 400]))).capitalize() for _ in range(rows)]


def test_windows_cover_every_run_once():
    for n in (0, 1, 4, 5, 255, 256, 257, 252 + 256, 252 + 257, 3000):
        data = bytes(random.Random(n).randrange(97, 123) for _ in range(n))
        parts = bytenet.windows(data.decode())
        runs = [p[i : i + 5] for p in parts for i in range(len(p) - 4)]
        assert runs == [data[i : i + 5] for i in range(n - 4)]
        assert n >= 5 or parts == [data]
    assert bytenet.windows("ÀB")[0] == "Àb".encode()  # A-Z only


def test_gradients_equal_differences():
    net = bytenet.start(["a", "b", "c"], seed=5)
    for name in ("embed", "filters", "bias", "dense", "shift"):
        setattr(net, name, getattr(net, name).astype("float64"))
    net.bias += 0.1
    x = bytenet.symbols([b"some words here", b"other text that is longer " * 9, b"x"])
    y = np.array([0, 2, 1])
    _, found = bytenet.gradients(net, x, y)
    rnd = np.random.default_rng(0)
    for name in ("embed", "filters", "bias", "dense", "shift"):
        value, checked = getattr(net, name), 0
        for at in rnd.permutation(np.flatnonzero(found[name]))[:12]:
            old, eps = value.flat[at], 1e-6
            value.flat[at] = old + eps
            up, _ = bytenet.gradients(net, x, y)
            value.flat[at] = old - eps
            down, _ = bytenet.gradients(net, x, y)
            value.flat[at] = old
            assert abs((up - down) / (2 * eps) - found[name].flat[at]) < 1e-5
            checked += 1
        assert checked


def test_a_text_is_the_average_of_its_windows():
    net = bytenet.start(["a", "b"], seed=1)
    all_texts = ["abc def " * 500, "xyz", None, "", "123 .", "é", "ab " * 90]
    langs, scores = net.predict(all_texts)
    for t, lang, score in zip(all_texts, langs, scores):
        if t is None or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        parts = bytenet.windows(t)
        values = np.array([net.outputs([p])[0] for p in parts])
        mean = (values * np.array([[len(p)] for p in parts])).sum(0) / sum(map(len, parts))
        p = bytenet.softmax(mean)
        assert lang == net.langs[p.argmax()] and abs(score - p.max()) < 1e-5


def test_held_out_accuracy_and_odd_rows(frame):
    rows = [(i, t, lang) for lang in ("aa", "bb", "cc") for i, t in enumerate(texts(7, 80, lang))]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 -", "cc"), (903, "q", None), (904, "wort " * 30_000, None), (None, rows[0][1], "zz"), (5, rows[5][1], "aa")]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    docs = frame([*rows, *odd], "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS found", "3 AS k")
    got = bytenet.language_rows(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[d].lang_pred == lang for d, _, lang in held) >= 0.97 * len(held) > 0
    assert {d: by[d].held_out for d, _, _ in rows} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    assert [(by[d].lang_pred, by[d].score) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(by[d].lang_pred in ("aa", "bb", "cc") and 0 < by[d].score <= 1 for d in (903, 904, None))
    assert by[None].held_out
    wide = bytenet.predict(docs, bytenet.start(["aa", "bb"]))
    assert wide.columns == docs.columns
    none = bytenet.language_rows(docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "lang_pred", "score"]
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in bytenet.language_rows(unlabelled).collect()} == {("und", 0.0)}


def test_given_table_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in bytenet.language_rows(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang is not None]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    print(right, len(held))
    assert right >= 0.95 * len(held)
