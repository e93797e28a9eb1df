"""Substring dedup with fixed-block anchors.

A repeat is a run of `window` words that also starts in a document with a smaller
id; every word such a run covers goes. Blocks of (window + 1) // 2 words at fixed,
non-overlapping places of every document are the index. A run of `window` words
holds such a block whole wherever it starts, so probing the index with every rolling
window of block length finds all repeats: hits are blocks seen in two documents.
Hits are then extended: the runs of `window` words that hold a hit are compared in
full, which together give the maximal exact repeats.

Documents are dealt into packs of a few MB by their id. A pack sends each distinct
hash once, with what the comparison needs (is it a block; the smallest document),
so a passage that a third of all documents share is one entry per pack. Hashes meet
by bucket, and a pack gets one bit back for each hash it sent. Packs and buckets are
sized by the total length of the text, so tasks stay alike at any size; the text
itself is shuffled once, and all three passes read that shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PACK_BYTES = 4 << 20
_BUCKET_BYTES = 10 << 20  # text whose windows share a bucket
_LOW32 = np.uint64(0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word, computed once."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words, by place in the run."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, "uint64")
    for i in range(size):
        out += words[i : i + n] * np.uint64(xxhash.xxh64_intdigest(b"place", seed=i) | 1)
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _bytes(a: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their steps, which compress well."""
    steps = np.diff(a, prepend=a.dtype.type(0))
    return steps.view("uint8").reshape(-1, a.itemsize).T.tobytes()


def _unbytes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, "uint8").reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class _Pack:
    """The words of a pack's documents, in order of their ids, as one array."""

    def __init__(self, pdf: pd.DataFrame, block: int, window: int, buckets: int):
        self.pdf = pdf.sort_values("_doc", kind="stable", na_position="last").reset_index(drop=True)
        self.block, self.window, self.buckets = block, window, buckets
        memo = _Hashes()
        self.words = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in self.pdf["_text"]]
        self.words = [w.split() for w in self.words]  # at ASCII white space only
        lengths = np.fromiter(map(len, self.words), "int64", len(self.words))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        hashes = np.empty(int(self.ends[-1]) if len(lengths) else 0, "uint64")
        for s, e, w in zip(self.starts, self.ends, self.words):
            hashes[s:e] = np.fromiter(map(memo.__getitem__, w), "uint64", len(w))
            if len(memo) > 500_000:
                memo.clear()
        self.hashes = hashes
        known = self.pdf["_doc"].notna().to_numpy()
        ids = self.pdf["_doc"].fillna(0).to_numpy("int64")
        self.ids = np.repeat(ids, lengths)  # of each word
        self.room = np.repeat(np.where(known, self.ends, 0), lengths) - np.arange(len(hashes))  # words from here on

    def rolling(self) -> None:
        """Distinct (bucket, hash) keys of all rolling windows; `back` leads from a window to its key."""
        h = _rolling(self.hashes, self.block)
        self.at = np.flatnonzero(self.room[: len(h)] >= self.block)
        h = h[self.at]
        key = (h >> np.uint64(32)) % np.uint64(self.buckets) << np.uint64(32) | h & _LOW32
        self.keys, self.back, first, last = _distinct(key)
        docs = self.ids[self.at]
        aligned = (self.at - np.repeat(self.starts, self.ends - self.starts)[self.at]) % self.block == 0
        self.flags = np.zeros(len(self.keys), "uint8")
        self.flags[self.back[aligned]] = 1
        self.flags |= (docs[first] != docs[last]).astype("uint8") << 1

    def runs(self, hit: np.ndarray) -> None:
        """Distinct hashes of the full runs that hold a hit, with the smallest document of each."""
        marks = np.zeros(len(self.hashes) + 1, "int32")
        marks[self.at[hit[self.back]]] = 1
        upto = np.concatenate([[0], np.cumsum(marks)])
        n = max(0, len(self.hashes) - self.window + 1)
        p = np.arange(n)
        # a window of block length may start anywhere in the run but its last block - 1 words
        holds = upto[p + self.window - self.block + 1] > upto[p]
        self.run_at = p[holds & (self.room[:n] >= self.window)]
        h = _rolling(self.hashes, self.window)[self.run_at]
        self.run_keys, self.run_back, first, _ = _distinct(h)
        self.run_docs = self.ids[self.run_at[first]]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """A mask of the words to remove; earlier: a smaller document of another pack has the run."""
        gone = earlier[self.run_back] | (self.ids[self.run_at] > self.run_docs[self.run_back])
        steps = np.zeros(len(self.hashes) + 1, "int32")
        np.add.at(steps, self.run_at[gone], 1)
        np.add.at(steps, self.run_at[gone] + self.window, -1)
        return np.cumsum(steps)[:-1] > 0


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the way back to them, and the first and last place of each."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    back = np.empty(len(key), "int64")
    back[order] = np.cumsum(new) - 1
    tails = np.append(heads[1:], len(s)) - 1
    return s[heads], back, order[heads], order[tails] if len(s) else heads


def _slices(keys: np.ndarray, buckets: int):
    """Bucket number and range of each bucket's keys; the bucket is in the high half."""
    cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype="uint64") << np.uint64(32))
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            yield b, slice(cuts[b], cuts[b + 1])


def _run_slices(pack: _Pack):
    cuts = np.searchsorted(pack.run_keys, np.array([(b << 64) // pack.buckets for b in range(pack.buckets)], "uint64"))
    cuts = np.append(cuts, len(pack.run_keys))
    for b in range(pack.buckets):
        if cuts[b + 1] > cuts[b]:
            yield b, slice(cuts[b], cuts[b + 1])


def _replies(rows: pd.DataFrame, slices, size: int) -> np.ndarray:
    got = dict(zip(rows["bucket"], rows["bits"]))
    out = np.zeros(size, bool)
    for b, part in slices:
        out[part] = np.unpackbits(np.frombuffer(got[b], "uint8"), count=part.stop - part.start).astype(bool)
    return out


def _answer(pdf: pd.DataFrame, hits: np.ndarray, lengths: list[int]) -> pd.DataFrame:
    parts = np.split(hits, np.cumsum(lengths)[:-1])
    return pd.DataFrame({"pack": pdf["pack"], "bucket": pdf["bucket"], "bits": [np.packbits(x).tobytes() for x in parts]})


def anchor_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """Per row: key, `n_words`, `spans` (removed word ranges, [start, end) each) and `kept_text` (words, one space between).

    Words are runs of characters other than ASCII white space, unchanged. NULL texts
    have no words. A row without an id is left whole and is nobody's earlier document.
    Rows that share an id are one document: they don't remove each other's words, and
    a row of theirs is dealt with like any other. Other columns play no part.
    """
    block = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    packs = max(4, -(-total // _PACK_BYTES))
    buckets = max(4, -(-total // _BUCKET_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    # rows without an id are spread by their text
    spread = F.coalesce(F.xxhash64(F.when(F.col(key).isNotNull(), F.col(key)), F.when(F.col(key).isNull(), F.col(text))), F.lit(0))
    rows = docs.select(F.pmod(spread, F.lit(packs)).cast("int").alias("pack"), F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))

    def load(pdf: pd.DataFrame) -> _Pack:
        pack = _Pack(pdf, block, window, buckets)
        pack.rolling()
        return pack

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        pack = load(pdf)
        out = [
            (b, _bytes((pack.keys[part] & _LOW32).astype("uint32")), np.packbits(pack.flags[part] & 1).tobytes(), np.packbits(pack.flags[part] >> 1).tobytes())
            for b, part in _slices(pack.keys, buckets)
        ]
        return pd.DataFrame(out, columns=["bucket", "hashes", "blocks", "several"]).assign(pack=pdf["pack"].iloc[0])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [_unbytes(x, "uint32") for x in pdf["hashes"]]
        sizes = [len(x) for x in sent]
        bits = lambda col: np.concatenate([np.unpackbits(np.frombuffer(x, "uint8"), count=n) for x, n in zip(pdf[col], sizes)])
        keys, back, _, _ = _distinct(np.concatenate(sent))
        packs_with = np.bincount(back, minlength=len(keys))
        block_of = np.bincount(back, weights=bits("blocks"), minlength=len(keys)) > 0
        several = np.bincount(back, weights=bits("several"), minlength=len(keys)) > 0
        return _answer(pdf, (block_of & (several | (packs_with > 1)))[back], sizes)

    def extend(key_: tuple, pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            pack = load(pdf)
            pack.runs(_replies(hits, _slices(pack.keys, buckets), len(pack.keys)))
            out = [(b, pack.run_keys[part].tobytes(), pack.run_docs[part].tobytes()) for b, part in _run_slices(pack)]
        return pd.DataFrame(out, columns=["bucket", "hashes", "docs"]).assign(pack=int(key_[0]))

    def earliest(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [np.frombuffer(x, "uint64") for x in pdf["hashes"]]
        ids = np.concatenate([np.frombuffer(x, "int64") for x in pdf["docs"]])
        keys, back, _, _ = _distinct(np.concatenate(sent))
        least = np.full(len(keys), np.iinfo("int64").max)
        np.minimum.at(least, back, ids)
        return _answer(pdf, least[back] < ids, [len(x) for x in sent])

    def remove(_: tuple, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"_doc": [], "n_words": [], "spans": [], "kept_text": []})
        pack = load(pdf)
        pack.runs(_replies(replies[replies["step"] == 1], _slices(pack.keys, buckets), len(pack.keys)))
        gone = pack.removed(_replies(replies[replies["step"] == 2], _run_slices(pack), len(pack.run_keys)))
        spans, kept = [], []
        for s, e, words in zip(pack.starts, pack.ends, pack.words):
            g = gone[s:e]
            if g.any():
                edges = np.flatnonzero(np.diff(g.astype("int8"), prepend=0, append=0))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                words = [w for w, x in zip(words, g.tolist()) if not x]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"_doc": pack.pdf["_doc"].astype("Int64"), "n_words": pack.ends - pack.starts, "spans": spans, "kept_text": kept})

    reply = "pack int, bucket int, bits binary"
    dealt = rows.groupBy("pack")
    hits = (
        dealt.applyInPandas(probe, "bucket int, hashes binary, blocks binary, several binary, pack int")
        .groupBy("bucket")
        .applyInPandas(meet, reply)
    )
    firsts = (
        dealt.cogroup(hits.groupBy("pack"))
        .applyInPandas(extend, "bucket int, hashes binary, docs binary, pack int")
        .groupBy("bucket")
        .applyInPandas(earliest, reply)
    )
    both = hits.withColumn("step", F.lit(1)).unionByName(firsts.withColumn("step", F.lit(2)))
    out = dealt.cogroup(both.groupBy("pack")).applyInPandas(
        remove, "_doc long, n_words long, spans array<struct<start:long,end:long>>, kept_text string"
    )
    return out.select(F.col("_doc").cast(kind).alias(key), "n_words", "spans", "kept_text")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    out = anchor_dedup(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
