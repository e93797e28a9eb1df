"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit where more than half of the shingle hashes have it. Equal
fingerprints become one. Two that differ in at most `radius` of 64 bits agree in two
of radius + 2 equal blocks, so every pair of blocks makes a table of buckets, and
only fingerprints of one bucket are compared. A bucket above `crowd` members is split
once more in the same way by its other bits; what is then left open is so few bits
that the members are bounded by the number of different fingerprints there can be.

Within a bucket bits are stored as planes: word w of plane k holds bit k of 64
fingerprints. One exclusive-or and a few bitwise steps then add a bit to the 64
distances, kept as carry-save counters of a few planes; when all lanes of a block
have passed the radius, the rest of its planes is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut
from skyledger.llm.components import components

_PART = 1 << 16  # hashes whose bits are counted at once
_LANES = 4096  # fingerprints in a block of planes
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint of a text; 0 without words. Fewer words than a shingle make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "uint64")
    counts = np.zeros(64, "int64")
    for i in range(0, len(hashes), _PART):
        part = hashes[i : i + _PART].view("uint8").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("uint64")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """All columns of `docs` and `fp`, the fingerprint as a signed long. NULL and empty texts have fingerprint zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], "uint64").view("int64"))

    return docs.withColumn("fp", of(F.col(text)))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane k holds bit k of all fingerprints, 64 to a word; the last word is filled with zeros."""
    bits = np.unpackbits(fps.astype("<u8").view("uint8").reshape(-1, 8), axis=1, bitorder="little")
    width = -(-len(fps) // 64) * 64
    padded = np.zeros((64, width), "uint8")
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("uint64")


def within(differ: Iterator[np.ndarray], radius: int) -> np.ndarray:
    """Lanes with at most `radius` bits set over the planes given one after another."""
    width = radius.bit_length()
    counters: list[np.ndarray] | None = None
    for k, d in enumerate(differ):
        if counters is None:
            # counters start so high that the first bit too many overflows them
            bias = (1 << width) - 1 - radius
            counters = [np.full_like(d, _ALL if bias >> i & 1 else 0) for i in range(width)]
            over = np.zeros_like(d)
        carry = d
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if k % 8 == 7 and (over == _ALL).all():
            break
    return ~over


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view("uint8"), axis=-1, bitorder="little")[..., :n].astype(bool)


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of one group whose fingerprints differ in at most `radius` bits; groups lie together."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(heads, len(group)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # members of small groups, each against the one `shift` places on
    left = np.repeat(np.where(sizes <= 64, heads + sizes, 0), sizes) - np.arange(len(group)) - 1
    for shift in range(1, int(sizes[sizes <= 64].max(initial=0))):
        i = np.flatnonzero(left >= shift)
        a, b = planes(fps[i]), planes(fps[i + shift])
        i = i[_lanes(within((a[k] ^ b[k] for k in range(64)), radius), len(i))]
        found.append((i, i + shift))
    # members of large groups, 64 at a time against blocks of the others
    for head, size in zip(heads[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for b0 in range(0, size, _LANES):
            block = fps[head + b0 : head + min(size, b0 + _LANES)]
            stored = planes(block)
            for q0 in range(0, min(size, b0 + _LANES), 64):
                q = fps[head + q0 : head + min(size, q0 + 64)]
                bits = np.unpackbits(q.view("uint8").reshape(-1, 8), axis=1, bitorder="little").astype("uint64")
                near = within((stored[k] ^ (bits[:, k, None] * _ALL) for k in range(64)), radius)
                i, j = np.nonzero(_lanes(near, len(block)))
                i, j = i + q0, j + b0
                found.append((head + i[i < j], head + j[i < j]))
    if not found:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place each of n places is connected with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            return root


def _buckets(rows: DataFrame, widths: list[int], shift: int, cols: list[str], name: str) -> DataFrame:
    """A row per pair of blocks, `name` naming the pair and the bits in both; `_free` lists the other bits."""
    starts = [shift + sum(widths[:i]) for i in range(len(widths))]
    pairs = []
    for t, (x, y) in enumerate(itertools.combinations(range(len(widths)), 2)):
        part = lambda k: F.shiftrightunsigned("_bits", starts[k]).bitwiseAND(F.lit((1 << widths[k]) - 1))
        pairs.append(F.shiftleft(part(x), widths[y]).bitwiseOR(part(y)).bitwiseOR(F.lit(t << 48)))
    return rows.select(*cols, F.explode(F.array(*pairs)).alias(name))


def links(fps: DataFrame, radius: int = 2, crowd: int = 2048) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints `fp` within `radius` bits of each other.

    Not every close pair is listed: within a bucket each member is linked to the root of
    what it is connected with there. `crowd` only says where buckets are split again.
    """
    n = radius + 2
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6")
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    rows = fps.filter("fp IS NOT NULL").select("fp").distinct().withColumn("_bits", F.col("fp"))
    first = _buckets(rows, widths, 0, ["fp"], "k1")
    members = first.groupBy("k1").count().filter("count > 1")
    first = first.join(members, "k1")
    # a crowded bucket: the blocks its key leaves open, each cut into n parts, so that a second pair of parts agrees
    pairs = list(itertools.combinations(range(n), 2))
    starts = [sum(widths[:i]) for i in range(n)]

    def rest(t: int):
        """The open bits of table t, moved together at the low end."""
        out, at = F.lit(0).cast("long"), 0
        for k in range(n):
            if k not in pairs[t]:
                piece = F.shiftrightunsigned("fp", starts[k]).bitwiseAND(F.lit((1 << widths[k]) - 1))
                out, at = out.bitwiseOR(F.shiftleft(piece, at)), at + widths[k]
        return out

    table = F.shiftrightunsigned("k1", 48)
    open_bits = F.when(table == 0, rest(0))
    for t in range(1, len(pairs)):
        open_bits = open_bits.when(table == t, rest(t))
    small = first.filter(F.col("count") <= crowd).select("k1", F.lit(-1).cast("long").alias("k2"), "fp")
    free = 64 - 2 * min(widths)
    again = [free // n + (i < free % n) for i in range(n)]
    large = first.filter(F.col("count") > crowd).select("k1", "fp", open_bits.alias("_bits"))
    large = _buckets(large, again, 0, ["k1", "fp"], "k2").select("k1", "k2", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pd.DataFrame:
            fp = np.ascontiguousarray(rows[:, 2]).view("uint64")
            group = np.cumsum(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            root = _roots(len(fp), *close_pairs(fp, group, radius))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            return pd.DataFrame({"a": rows[linked, 2], "b": rows[root[linked], 2]})

        for batch in batches:
            if not len(batch):
                continue
            rows = batch[["k1", "k2", "fp"]].to_numpy("int64")
            # all but the last group are complete
            last = int((rows[:, :2] == rows[-1, :2]).all(axis=1).argmax())
            if kept and (rows[0, :2] != kept[-1][-1, :2]).any():
                yield done(np.concatenate(kept))
                kept = []
            if last:
                yield done(np.concatenate([*kept, rows[:last]]))
                kept = []
            kept.append(rows[last:])
        if kept:
            yield done(np.concatenate(kept))

    grouped = small.unionByName(large).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return grouped.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component_id): the smallest key whose fingerprint is reached by links of at most `radius` bits.

    NULL and empty texts have fingerprint zero and are linked like any other. Rows with
    a NULL key belong to the component of their fingerprint but don't name it; a
    component of such rows only has a NULL id. Equal rows share their component. Other
    columns play no part; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs.select(key, F.col(text).alias("_text")), "_text", size).select(key, "fp"))
    each = marked.groupBy("fp").agg(F.min(key).alias("_least"))
    found = components(links(each, radius))
    named = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    of_fp = named.join(ids, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest key, the first read of several.

    A row with a NULL key stays only where its component has no other.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all")).withColumn("row", F.monotonically_increasing_id())
    # written once, so that a row keeps its number whatever happens to its task
    rows = cut(rows)
    texts = rows.select("row", F.col(f"all.`{key}`").alias("_key"), F.col(f"all.`{text}`").alias("_text"))
    marked = cut(fingerprints(texts, "_text", size).select("row", "_key", "fp"))
    place = F.struct(F.col("_key").isNull(), "_key", "row")
    each = marked.groupBy("fp").agg(F.min(place).alias("least"))
    found = components(links(each, radius)).withColumnRenamed("node", "fp")
    kept = each.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col(f"all.`{c}`").alias(c) for c in names])


def component_rows(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
