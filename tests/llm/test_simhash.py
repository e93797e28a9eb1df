import random
import re

import numpy as np
import xxhash

from skyledger.llm import simhash
from skyledger.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_components(rows):
    fps = {i: plain_fingerprint(t) for i, (_, t) in enumerate(rows)}
    pairs = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 2]
    root = union(fps, pairs)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted([(d, f"{fps[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows)], key=str)


def got(df):
    return sorted([tuple(r) for r in simhash.component_rows(df).collect()], key=str)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == plain_components([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(frame):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(4, None), (3, ""), (9, "\n"), (5, "One"), (6, "oNE"), (None, "one"), (7, "ÉA b"), (None, "alone here now"), (1, long), (2, long + " x"), (1, long)]
    df = frame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component int")
    assert got(df) == plain_components(rows)
    assert simhash.component_rows(frame([], "doc_id long, text string")).count() == 0


def test_links_connect_what_brute_force_connects(frame):
    rnd = random.Random(2)
    fps = set()
    for _ in range(40):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            for _ in range(rnd.randint(0, 3)):
                at ^= 1 << rnd.randrange(64)
            fps.add(at)
    hot = rnd.getrandbits(64)
    fps |= {hot ^ (1 << rnd.randrange(20)) ^ (1 << rnd.randrange(20)) ^ (1 << rnd.randrange(64)) for _ in range(150)}
    signed = [int(np.uint64(f).astype("int64")) for f in fps]
    for radius in (0, 1, 2, 3):
        want = union(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius])
        for crowd in (5, 2048):
            links = simhash.links(frame([(s,) for s in signed], "fp long"), radius, crowd)
            pairs = [(int(np.int64(r.a).astype("uint64")), int(np.int64(r.b).astype("uint64"))) for r in links.collect()]
            assert union(fps, pairs) == want


def test_pairs_of_large_groups():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 3, dtype="uint64")
    fps = np.unique(base[rnd.integers(0, 3, 5000)] ^ (np.uint64(1) << rnd.integers(0, 64, 5000, dtype="uint64")) ^ (np.uint64(1) << rnd.integers(0, 64, 5000, dtype="uint64")))
    i, j = simhash.close_pairs(fps, np.zeros(len(fps), int), 2)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = np.argwhere(np.triu(near, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


def test_components_of_chains_and_stars(frame):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (-5, 559)]
    got_ = {r.node: r.component for r in components(frame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = union({x for p in real for x in p}, real)
    assert got_ == want
