"""Near copies by SimHash links and the exact similarity of their five-word shingles.

Two texts are near copies if their sets of shingles have a Jaccard similarity of at
least `least`. The first candidates are the links of `simhash`: fingerprints that differ
in at most two bits, found by bit planes inside pigeonhole buckets. Few near copies lie as
close as that, so candidates of MinHash bands follow: a band is four minima of the set
under four hash functions, and of 32 bands a pair at 0.8 shares at least one but for
5 pairs in 10^8 (a pair at 0.9: in 10^15). Every candidate pair that is linked has been
compared set against set, so a fingerprint or band shared by chance or by a common passage links nothing.

Texts of equal sets become one before that. A bucket (texts of one band) is never compared
all against all. In a few rounds its members are compared with one of them, another one
each round, which is linear in the bucket and joins near copies into components. Texts of
buckets that still hold several components, such as texts with a common passage, are then
compared by a prefix filter: the shingles of each set are put in order, the rarest first,
and only sets that share one of their first shingles can be similar. Shingles of a common
passage come last, so such texts don't meet unless they are near copies in fact. The filter
is exact, so the bands' recall is that of the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm import simhash
from skyledger.llm.common import cut, drop_cut
from skyledger.llm.components import components

BANDS, ROWS = 32, 4
ROUNDS = 3
COUNTERS = 1 << 20
_PART = 512  # shingles whose minima are taken at once
_rnd = np.random.default_rng(5)
_FLIP = _rnd.integers(0, 1 << 64, (BANDS * ROWS, 1), "uint64")
_TIMES = _rnd.integers(0, 1 << 63, (BANDS * ROWS, 1), "uint64") * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text in order; none without words. Fewer words than a shingle make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, "uint64")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in spans], "uint64"))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, "int64")
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, "uint64")
    for i in range(0, len(hashes), _PART):
        np.minimum(least, ((hashes[None, i : i + _PART] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1).astype("uint64")
    for i in range(ROWS):
        keys = (keys ^ least[:, i]) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.view("int64")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Is the Jaccard similarity of two ordered sets at least `least`?"""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of `node` whose sets are similar, with all their columns; texts: node, n, _text, one row per node."""
    names, kinds = pairs.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    sizes = texts.select("node", "n")
    # sets whose sizes differ too much can't be similar
    pairs = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    pairs = cut(pairs.filter(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).select(*names))
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                yield pd.DataFrame({"node": part["node"], "hashes": [shingles(t, size).tobytes() for t in part["_text"]]})

    known = cut(texts.join(wanted, "node", "left_semi").select("node", "_text").mapInPandas(sets, "node long, hashes binary"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [similar(np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64"), least) for x, y in zip(batch["x"], batch["y"])]
            yield batch.loc[np.array(found, bool), names]

    sided = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    out = cut(sided.select(*names, "x", "y").mapInPandas(compare, kinds))
    for used in (pairs, known):
        drop_cut(used)
    return out


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of `node` that connect the nodes whose fingerprints do; texts: node, _text. One pair per node and link."""
    marked = cut(simhash.fingerprints(texts, "_text").select("node", "fp"))
    hubs = marked.groupBy("fp").agg(F.min("node").alias("hub"))
    equal = marked.join(hubs, "fp").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    close = simhash.links(marked).join(hubs.toDF("a", "x"), "a").join(hubs.toDF("b", "y"), "b")
    out = cut(equal.unionByName(close.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    drop_cut(marked)
    return out


def _common(sets: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each of COUNTERS hash classes occur; a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, size) for t in batch["_text"]]
            at, c = np.unique(np.concatenate([np.zeros(0, "uint64"), *found]) % np.uint64(COUNTERS), return_counts=True)
            yield pd.DataFrame({"at": at.astype("int64"), "c": c})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": [batch.to_numpy("<i8").tobytes()]})

    counted = sets.select("_text").mapInPandas(count, "at long, c long").groupBy("at").agg(F.sum("c").alias("c"))
    out = np.zeros(COUNTERS, "int64")
    for r in counted.select("at", "c").mapInPandas(pack, "part binary").toLocalIterator():
        rows = np.frombuffer(r.part, "<i8").reshape(-1, 2)
        out[rows[:, 0]] = rows[:, 1]
    return np.minimum(out, np.iinfo("uint32").max).astype("uint32")


def prefix_pairs(sets: DataFrame, size: int, least: float) -> DataFrame:
    """Distinct candidate pairs (a, b) of different components, all pairs of `least` similarity among them.

    sets: node, c (component) and _text. Shingles are put in one order for all sets, those
    of rare hash classes first (classes are counted in a table of fixed size; a class of
    many shingles only makes the order worse, not the result). Of two similar sets the
    first shared shingle lies within the first n - ceil(2 t / (1 + t) n) + 1 of the smaller
    set and the first n - ceil(t n) + 1 of the larger one.
    """
    common = sets.sparkSession.sparkContext.broadcast(_common(sets, size))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, c, text in zip(batch["node"].tolist(), batch["c"].tolist(), batch["_text"]):
                found = shingles(text, size)
                n = len(found)
                f = common.value[found % np.uint64(COUNTERS)]
                reach = max(0, n - math.ceil(n * least - 1e-9) + 1)
                order = np.lexsort((found, f))[:reach]
                # a class that one shingle of one set has leads nowhere, but it takes its place
                at = np.flatnonzero(f[order] > 1)
                yield pd.DataFrame({"h": found[order[at]].view("int64"), "node": node, "c": c, "n": n, "at": at + 1})

    placed = cut(sets.select("node", "c", "_text").mapInPandas(first, "h long, node long, c long, n long, at long"))
    index = F.col("n") - F.ceil(F.col("n") * (2 * least / (1 + least)) - 1e-9) + 1
    small = placed.filter(F.col("at") <= index).toDF("h", "a", "ca", "na", "ata")
    large = placed.toDF("h", "b", "cb", "nb", "atb")
    after = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) + 1
    meet = (
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("ca") != F.col("cb")) & (F.col("na") >= F.col("nb") * least - 1e-9)
        & (after >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    )
    return small.join(large, "h").filter(meet).select("a", "b").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest key, the first read of several.

    A row with a NULL key stays only where its component has no other. NULL texts and
    those without words are copies of each other.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all")).withColumn("row", F.monotonically_increasing_id())
    # written once, so that a row keeps its number whatever happens to its task
    rows = cut(rows)
    kind = docs.schema[key].dataType.simpleString()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = (shingles(t, size) for t in batch["_text"])
            marks = [(xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), bands(s)) for s in sets]
            out = pd.DataFrame({"row": batch["row"], "_key": batch["_key"]})
            yield out.assign(sig=[m[0] for m in marks], n=np.array([m[1] for m in marks], "int64"), bands=[m[2] for m in marks])

    texts = rows.select("row", F.col(f"all.`{key}`").alias("_key"), F.col(f"all.`{text}`").alias("_text"))
    marked = texts.mapInPandas(mark, f"row long, _key {kind}, sig string, n long, bands array<long>")
    # bands and n are those of the set, so they decide nothing here
    place = F.struct(F.col("_key").isNull(), "_key", "row", "n", "bands")
    each = cut(marked.groupBy("sig").agg(F.min(place).alias("least")))
    # the row that stands for a set also names it
    texts_of = each.select(F.col("least.row").alias("row"), F.col("least.n").alias("n")).join(texts.select("row", "_text"), "row")
    one = texts_of.select(F.col("row").alias("node"), "n", "_text")

    near = _fingerprint_pairs(one.select("node", "_text"))
    alike = _verified(near, one, size, least)
    found = cut(components(alike))
    links = found.toDF("a", "b")
    members = each.select(F.col("least.row").alias("node"), F.explode("least.bands").alias("k")).join(found, "node", "left")
    members = members.select("node", "k", F.coalesce("component", "node").alias("c"))
    used, looked_at, linked = [near, alike], [], [found]
    for turn in range(ROUNDS):
        # buckets of one component are done with
        mixed = members.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "c")).alias("hub"))
        mixed = mixed.filter("lo <> hi").select("k", F.col("hub.node").alias("a"), F.col("hub.c").alias("ca"))
        members = cut(members.join(mixed, "k"))
        for old in used:
            drop_cut(old)
        used = [members]
        if members.isEmpty():
            break
        if not turn:
            # only texts that share a bucket are looked at from here on
            one = cut(one.join(members.select("node").distinct(), "node", "left_semi"))
            looked_at = [one]
        stars = members.filter("c <> ca").select("a", F.col("node").alias("b"), "ca", F.col("c").alias("cb")).distinct()
        alike = _verified(stars, one, size, least)
        # components are linked, not their members: what was found before is not gone through again
        found = cut(components(alike.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        links = links.unionByName(found.toDF("a", "b"))
        linked.append(found)
        used = [members, alike]
        members = members.select("node", "k", "c").join(found.toDF("c", "component"), "c", "left").select("node", "k", F.coalesce("component", "c").alias("c"))

    mixed = members.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k")
    left = members.join(mixed, "k", "left_semi").select("node", "c").distinct()
    sets = cut(one.join(left, "node").select("node", "c", "_text"))
    for old in used:
        drop_cut(old)
    if not sets.isEmpty():
        alike = _verified(prefix_pairs(sets, size, least), one, size, least)
        links = links.unionByName(alike)
        linked.append(alike)
    for old in [sets, *looked_at]:
        drop_cut(old)

    found = components(links)
    for old in linked:
        drop_cut(old)
    kept = each.select(F.col("least.row").alias("node"), F.struct("least.col1", "least._key", "least.row").alias("least")).join(found, "node", "left")
    kept = kept.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col(f"all.`{c}`").alias(c) for c in names])
