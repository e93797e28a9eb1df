import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd

from skyledger.llm import phrases


def plain(rows, least=30, top=2000, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        covered = any(
            len(v) > len(w) and 100 * b >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (other, v), b in cand.items() if other == lang
        )
        if not covered:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=1, texts=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "Wort", "a b", "the", "THE"]
    out = []
    for _ in range(texts):
        words = [rnd.choice(vocab[: rnd.choice([3, 10, 46])]) for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.5:
            words[3:3] = ["in", "The", "middle", "of", "it"]
        out.append(("".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ",;"]) for w in words), rnd.choice(["en", "de", None, "und"])))
    return out


def test_small_corpus_equals_brute_force_with_any_budget(frame):
    rows = corpus()
    docs = frame(rows, "text string, lang string").selectExpr("*", "'x' AS phrase", "1 AS c", "2 AS w1", "3 AS `group`")
    for budget in (2_000_000, 150, 8, 1):  # the smaller, the more prefixes are extended, to four words
        assert rows_of(phrases.collocations(docs, least=8, budget=budget)) == plain(rows, 8) != []
    assert rows_of(phrases.collocations(docs, least=8, top=3, inside=101)) == plain(rows, 8, 3, 101)


def test_given_table_equals_its_sql(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(phrases.COLLOCATION_SQL).fetchall())
    assert rows_of(phrases.collocations(docs)) == want != []


def test_odd_rows(frame):
    long = "la la " * 30_000
    rows = [(None, "en"), ("", "en"), (" \n.", None), ("tick tock " * 40, None), (long, "fr"), ("tick tock " * 40, "und"), ("one word", "en")]
    got = rows_of(phrases.collocations(frame(rows, "text string, lang string")))
    assert got == plain(rows)
    assert {(r[0], r[6]) for r in got} == {("und", 160), ("fr", 60_000)}
    assert phrases.collocations(frame(rows, "text string, lang string").limit(0)).count() == 0


def test_counts_past_64_bits(frame):
    big = 4 * 10**18
    tree = frame([("en", "a", 1, big), ("en", "b", 1, big + 5), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, f long")
    n = frame([("en", big + 7)], "lang string, n long")
    assert rows_of(phrases.ranked(tree, n)) == [("en", 1, "a b", big - 1, big, big + 5, big + 7, 2_000_000 * (big - 1) // (2 * big + 5))]


def test_blocks_of_a_few_words_give_the_same(frame, monkeypatch):
    rows = corpus(5, 60)
    many = [(t, f"l{i % 7}") for i, (t, _) in enumerate(rows)]
    want, want_many = plain(rows, 6), plain(many, 3)
    monkeypatch.setattr(phrases, "_FLUSH", 50)  # the driver's copy: the functions run here
    for given, least, expected in ((rows, 6, want), (many, 3, want_many)):
        texts = [pd.DataFrame({"lang": ["und" if x is None else x for _, x in given], "text": [t for t, _ in given]})]
        part = phrases.Partition([("en", b"the"), ("en", b"in the"), ("l1", b"w1")], 5)
        sent = pd.concat(list(phrases._send(part)(iter(texts))))
        tree = pd.concat([phrases._subtrees(least)(g) for _, g in sent.groupby("group")])
        got = {(r.lang, r.phrase): r.f for r in tree.itertuples()}
        f = Counter()
        for text, lang in given:
            low = (text or "").translate({c: c + 32 for c in range(65, 91)})
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
        extended = {("en", "the"), ("l1", "w1")}  # "in the" is listed, but not "in"
        assert got == {k: v for k, v in f.items() if v >= least and k not in extended} and expected
