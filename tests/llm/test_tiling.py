import random

from skyledger.llm import tiling


def plain_tiles(item, doc, match):
    """The longest common unmarked run, again and again."""
    fa, fb = [True] * len(item), [True] * len(doc)
    out = []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < match:
            return out
        i, j, k = best
        fa[i : i + k] = [False] * k
        fb[j : j + k] = [False] * k
        out.append(best)


def test_tiles_equal_the_plain_greedy_search():
    rnd = random.Random(4)
    for _ in range(60):
        item = [rnd.choice("abcdef") for _ in range(rnd.randint(3, 25))]
        doc = []
        for _ in range(rnd.randint(1, 5)):
            s = rnd.randrange(len(item))
            doc += item[s : s + rnd.randint(1, 9)] + [rnd.choice("abcxyz") for _ in range(rnd.randint(0, 3))]
        got = tiling.tile(item, doc, [(0, len(doc))], 3)
        assert got == plain_tiles(item, doc, 3)


def plain(rows, items, match=5, coverage=0.5):
    out = []
    for d, t in rows:
        doc = tiling.words_of(t)
        hits = []
        for i, x in sorted({r for r in items if r[0] is not None and r[1] is not None}):
            item = tiling.words_of(x)
            if len(item) >= match and (tiles := plain_tiles(item, doc, match)):
                hits.append((sum(k for _, _, k in tiles) / len(item), i))
        best = max((h[0] for h in hits), default=0.0)
        held = sorted({i for c, i in hits if c >= coverage})
        out.append((d, best, min((i for c, i in hits if c == best), default=None), held, bool(held)))
    return sorted(out, key=str)


def got(docs, items):
    return sorted([(r.doc_id, r.coverage, r.item_id, list(r.item_ids), r.contaminated) for r in tiling.contamination(docs, items).collect()], key=str)


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    some = [(r.doc_id, r.text) for r in docs.collect()]
    short = [(d, t) for d, t in some if len(t) < 1500]
    have = {r[0]: r for r in got(docs, items)}
    assert len(have) == len(some)
    assert sorted([have[d] for d, _ in short], key=str) == plain(short, [(r.item_id, r.text) for r in items.collect()])
    assert any(r[4] for r in have.values())


def test_odd_rows_and_reordered_passages(frame, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 12)
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "Éa ß one two three four"), (3, "few words"), (None, "alpha beta gamma delta epsilon"), (4, None), (2, "Éa ß one two three four"), (5, "")]
    rows = [
        (1, "zeta eta theta iota kappa, then ALPHA beta gamma: delta epsilon"), (2, "alpha beta gamma delta zeta"), (3, "x ÉA ß one two three"),
        (4, None), (5, ""), (None, items[0][1]), (7, "few words"), (8, "filler " * 500_000 + items[1][1]), (1, "zeta eta theta iota kappa, then ALPHA beta gamma: delta epsilon"),
    ]
    docs = frame([(*r, "x", 1) for r in rows], "doc_id long, text string, hits string, coverage int")
    want = plain([(d, t if d != 8 else "filler " + items[1][1]) for d, t in rows], items)
    bench = frame(items, "item_id long, text string")
    assert got(docs, bench) == want
    full = {r.doc_id: r for r in tiling.tiled(docs, bench).collect()}
    assert full[1].coverage == 1 and full[1].hits[0].covered == 10 and {t.n for t in full[1].hits[0].tiles} == {5}
    assert got(docs.limit(0), bench) == [] and not any(r[4] for r in got(docs, bench.limit(0)))
