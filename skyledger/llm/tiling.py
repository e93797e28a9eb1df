"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased
text. A document and an item that share `match` words in a row are a candidate pair.
Such a pair is tiled: running Karp-Rabin hashes find the longest common runs of words
not yet marked; they are marked on both sides and the search goes on with shorter
runs, down to `match` words. The share of the item's words under tiles says how much of
it the document holds, in whatever order; from `coverage` on the document counts as
contaminated.

Seeds are looked up for all words of a batch at once, on hashes; only texts with a hit
are split into words. The benchmark is read in blocks of bounded size, each broadcast
with its seeds, and every document passes all blocks in one stage without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 400_000  # words of the benchmark in one block
_PIECE = 1 << 21  # bytes hashed at once
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_PRIME = (1 << 61) - 1
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_HITS = "array<struct<item_id:long,covered:int,words:int,tiles:array<struct<item_at:int,doc_at:int,n:int>>>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _WordHashes:
    """Hashes of all words of a byte string: sums of byte times a power of a fixed number, moved to the word's start."""

    def __init__(self):
        chars = np.zeros(256, bool)
        chars[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
        chars[128:] = True
        self.chars = chars
        self.up = np.cumprod(np.full(_PIECE + 1, _R, "uint64"), dtype="uint64")
        self.down = np.cumprod(np.full(_PIECE + 1, pow(_R, -1, 1 << 64), "uint64"), dtype="uint64")

    def piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words."""
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.chars[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, "uint64")
        np.cumsum(data.astype("uint64") * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32)), starts

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, "uint8")
        if len(raw) <= _PIECE:
            return self.piece(raw)
        hashes, starts, at = [], [], 0
        while at < len(raw):
            end = min(len(raw), at + _PIECE)
            if end < len(raw):  # cut between words; a word longer than a piece is no benchmark's
                gaps = np.flatnonzero(~self.chars[raw[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
            h, s = self.piece(raw[at:end])
            hashes.append(h)
            starts.append(s + at)
            at = end
        return np.concatenate(hashes), np.concatenate(starts)


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, "uint64")
    for i in range(size):
        out = out * np.uint64(_R) + h[i : i + n]
    return out ^ (out >> np.uint64(31))


class Block:
    """Items of the benchmark with their seeds."""

    def __init__(self, items: list[tuple[int, list[str]]], match: int):
        self.match, self.items = match, items
        self.seeds: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for n, (_, words) in enumerate(items):
            for seed in dict.fromkeys(zip(*[words[k:] for k in range(match)])):
                self.seeds[seed].append(n)
        hashes = _WordHashes()
        known = [_rolling(hashes(" ".join(seed).encode("utf-8", "surrogatepass"))[0], match) for seed in self.seeds]
        self.hashes = np.unique(np.concatenate(known)) if known else np.zeros(0, "uint64")
        self.marked = np.zeros(1 << 20, bool)  # by the low bits of the seeds' hashes
        self.marked[(self.hashes & np.uint64((1 << 20) - 1)).astype("int64")] = True

    def may_hold(self, texts: list[bytes], hashes: _WordHashes) -> np.ndarray:
        """True for texts with a seed's hash; texts are looked at together in batches of some length."""
        out = np.zeros(len(texts), bool)
        if not len(self.hashes):
            return out
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) < _PIECE // 2:
                size += len(texts[last]) + 1
                last += 1
            h, starts = hashes(b"\n".join(texts[first:last]))
            g = _rolling(h, self.match)
            p = np.flatnonzero(self.marked[(g & np.uint64((1 << 20) - 1)).astype("int64")])
            p = p[np.isin(g[p], self.hashes)]
            if len(p):
                ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
                a = np.searchsorted(ends, starts[p], side="right")
                b = np.searchsorted(ends, starts[p + self.match - 1], side="right")
                out[first + a[a == b]] = True
            first = last
        return out

    def hits(self, text: str) -> list[dict]:
        """The items that share a seed with the text, tiled."""
        words, m = words_of(text), self.match
        places: dict[int, list[int]] = defaultdict(list)
        for p, seed in enumerate(zip(*[words[k:] for k in range(m)])):
            for n in self.seeds.get(seed, ()):
                places[n].append(p)
        out = []
        for n in sorted(places):
            item_id, item = self.items[n]
            # only words of shared seeds can be under a tile
            spans = []
            for p in places[n]:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + m
                else:
                    spans.append([p, p + m])
            tiles = tile(item, words, spans, m)
            out.append({
                "item_id": item_id, "covered": sum(t[2] for t in tiles), "words": len(item),
                "tiles": [{"item_at": i, "doc_at": d, "n": k} for i, d, k in tiles],
            })
        return out


def _windows(words: list[int], free: list[bool], spans, size: int):
    """(start, running hash) of every run of `size` unmarked words within the spans."""
    top = pow(_R, size - 1, _PRIME)
    for a, b in spans:
        h = run = 0
        for p in range(a, b):
            if not free[p]:
                h = run = 0
                continue
            if run == size:
                h = (h - words[p - size] * top) % _PRIME
            else:
                run += 1
            h = (h * _R + words[p]) % _PRIME
            if run == size:
                yield p - size + 1, h


def tile(item: list[str], doc: list[str], spans, match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item_at, doc_at, n), longest first, ties to the smaller places; spans: parts of the document to look at."""
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a, b = [number[w] for w in item], {p: number.get(doc[p], 0) for s, e in spans for p in range(s, e)}
    free_a, free_b = [True] * len(a), dict.fromkeys(b, True)
    tiles: list[tuple[int, int, int]] = []
    size = len(item)
    while size >= match:
        table = defaultdict(list)
        for p, h in _windows(a, free_a, [(0, len(a))], size):
            table[h].append(p)
        found = []
        if table:
            for q, h in _windows(b, free_b, spans, size):
                for p in table.get(h, ()):
                    if all(a[p + k] == b[q + k] for k in range(size)):
                        found.append((p, q))
        marked = False
        for p, q in sorted(found):
            if all(free_a[p : p + size]) and all(free_b[q + k] for k in range(size)):
                free_a[p : p + size] = [False] * size
                free_b.update(dict.fromkeys(range(q, q + size), False))
                tiles.append((p, q, size))
                marked = True
        left = longest_run(free_a)
        size = min(size - 1, left)
        if marked and left < match:
            break
    return tiles


def longest_run(free: list[bool]) -> int:
    best = run = 0
    for f in free:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def benchmark_blocks(items: DataFrame, match: int, key: str, text: str) -> list[Block]:
    """The benchmark as blocks of at most BLOCK_WORDS words (or one item). NULL ids, NULL texts and texts of fewer than `match` words are left out."""
    blocks, now, size = [], [], 0
    for r in items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).distinct().orderBy("k", "t").toLocalIterator():
        words = words_of(r["t"])
        if r["k"] is None or len(words) < match:
            continue
        if now and size + len(words) > BLOCK_WORDS:
            blocks.append(Block(now, match))
            now, size = [], 0
        now.append((r["k"], words))
        size += len(words)
    return [*blocks, Block(now, match)] if now else blocks


def tiled(docs: DataFrame, items: DataFrame, text: str = "text", match: int = 5, item_key: str = "item_id", item_text: str = "text", hits: str = "hits") -> DataFrame:
    """All columns of `docs` and `hits`: the items tiled with it, each with its covered words, its words and its tiles.

    NULL and empty texts have no hits. A column of the name of `hits` is replaced.
    """
    context = docs.sparkSession.sparkContext

    def finder(block: Block) -> Column:
        shared = context.broadcast(block)

        @F.pandas_udf(_HITS)
        def find(texts: pd.Series) -> pd.Series:
            hashes = _WordHashes()
            lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
            may = shared.value.may_hold(lowered, hashes)
            return pd.Series([shared.value.hits(t) if m else [] for t, m in zip(texts, may)], dtype="object")

        return find(F.col(text))

    found = [finder(b) for b in benchmark_blocks(items, match, item_key, item_text)]
    return docs.withColumn(hits, F.concat(*found) if found else F.array().cast(_HITS))


def contamination(docs: DataFrame, items: DataFrame, match: int = 5, coverage: float = 0.5) -> DataFrame:
    """Per document: doc_id, coverage (the largest share of an item under tiles), item_id (that item, the smallest of several), item_ids (those from `coverage` on), contaminated.

    Repeated items count once, items that share an id by themselves. Without a hit coverage is 0 and item_id NULL.
    """
    share = lambda h: h["covered"] / h["words"]
    out = tiled(docs.select("doc_id", "text"), items, match=match).select("doc_id", "hits")
    best = F.coalesce(F.array_max(F.transform("hits", share)), F.lit(0.0))
    out = out.withColumn("coverage", best)
    held = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: share(h) >= coverage), lambda h: h["item_id"])))
    first = F.array_min(F.transform(F.filter("hits", lambda h: share(h) == F.col("coverage")), lambda h: h["item_id"]))
    return out.select("doc_id", "coverage", first.alias("item_id"), held.alias("item_ids"), (F.size(held) > 0).alias("contaminated"))
