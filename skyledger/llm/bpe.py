"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled once into a deterministic automaton whose paths are the
correct token sequences. It starts with one state that every base symbol leads
back to. The gadget of a merge (a, b) makes the pair a, b impassable and adds the
arc of the merged token: the state that `a` leads to is copied without its arc
`b` (or loses it, where only `a` leads there), `a` now leads to the copy, and wherever `a` could be read, the new token can
be read too and leads where `b` led. The target of an arc depends on its label
alone, so the automaton is one state number per token and one table of bits
(state x token: may the token be read there). Tokens at a word's end lead nowhere.

A word is encoded by reading it from left to right: the tokens that start at a
place and are readable in the state reached there open later places. Every prefix
has one correct token sequence, so a place is reached once at most, and the path
to the end is the encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-tokenizer of the vocabulary file, and the mark of a word's last token.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_MEMO = 200_000  # words a task remembers; it then forgets all and starts again
_TEXTS = 256  # texts whose results a task sends on at once


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Automaton:
    """Bit s & 7 of byte `(s >> 3) * size + t` of `arcs`: may token t be read in state s; `target[t]`: the state it leads to, -1 at a word's end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        self.vocab, self.added = vocab, added
        size = max([*vocab.values(), *added.values()]) + 1
        self.labels = [""] * size
        for token, i in [*vocab.items(), *added.items()]:
            self.labels[i] = token
        self.size = size
        self.starts = {t[:k] for t in vocab for k in range(1, len(t.removesuffix(WORD_END)) + 1)}
        target, arcs = self._compile(merges, size)
        self.target, self.arcs = target.tolist(), arcs.tobytes()

    def _compile(self, merges: list[tuple[str, str]], size: int) -> tuple[np.ndarray, np.ndarray]:
        vocab = self.vocab
        # about a state for every fourth merge; memory is taken as rows are touched
        arcs = np.zeros((len(merges) // 32 + 16, size), np.uint8)
        target = np.full(size, -1, np.int32)
        users = {0: 0}  # arcs' labels that lead to a state
        made = {a + b for a, b in merges}
        for token, i in vocab.items():
            if token not in made:
                arcs[0, i] = 1
                target[i] = -1 if token.endswith(WORD_END) else 0
                users[0] += target[i] == 0
        fresh = 1
        for a, b in merges:
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if arcs[:, both].any():
                raise ValueError(f"two merges make the token {a + b!r}")
            old = int(target[left])
            if old < 0 or not arcs[old >> 3, right] >> (old & 7) & 1:
                continue  # the pair cannot occur
            beyond = int(target[right])
            if users[old] == 1 and a != b:
                new = old
            else:
                new, fresh = fresh, fresh + 1
                if new >> 3 == len(arcs):
                    arcs = np.concatenate([arcs, np.zeros((len(arcs) // 4 + 1, size), np.uint8)])
                arcs[new >> 3] |= (arcs[old >> 3] >> (old & 7) & 1) << (new & 7)
                users[old] -= 1
                users[new] = 1
            arcs[new >> 3, right] &= 0xFF ^ (1 << (new & 7))
            target[left] = new
            arcs[:, both] = arcs[:, left]
            target[both] = beyond
            if beyond >= 0:
                users[beyond] += 1
        return target, arcs[: (fresh + 7) // 8]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in byte symbols."""
        n, vocab, arcs, target, starts = len(word), self.vocab, self.arcs, self.target, self.starts
        state = [-1] * (n + 1)
        came: list[tuple[int, int]] = [(-1, -1)] * (n + 1)
        state[0] = 0
        for i in range(n):
            s = state[i]
            if s < 0:
                continue
            row, bit = (s >> 3) * self.size, s & 7
            for j in range(i + 1, n + 1):
                part = word[i:j]
                if part not in starts:
                    break
                t = vocab.get(part if j < n else part + WORD_END)
                if t is not None and arcs[row + t] >> bit & 1:
                    came[j] = (i, t)
                    state[j] = target[t]
        out, at = [], n
        while at > 0:
            at, t = came[at]
            if t < 0:
                raise ValueError(f"no path for the word {word!r}")
            out.append(t)
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one space between them, as a vocabulary without a decoder gives them."""
        return " ".join(map(self.labels.__getitem__, ids))


def load_automaton(path: str) -> Automaton:
    """Read a vocabulary file with merges; only the kind this module encodes is accepted."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or spec.get("decoder") is not None:
        raise ValueError(f"{path} is not a vocabulary of word-end BPE without a decoder")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


class Encoder:
    """Encodes texts in one task, remembering words already seen."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.symbols = byte_symbols()
        self.split = regex.compile(PRE_SPLIT).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.added)) + ")") if automaton.added else None
        self.memo: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        symbols = "".join(map(self.symbols.__getitem__, word.encode("utf-8")))
        got = np.array(self.automaton.encode_word(symbols), "<u4").tobytes()
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        self.memo[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        # white space only separates words, so it need not be made one space first
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter: the rule for a final sigma is not applied
        words = self.split(text.replace("Σ", "σ").lower())
        memo, out = self.memo, []
        for w in words:
            got = memo.get(w)
            out.append(got if got is not None else self._word(w))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.special is None or not any(t in text for t in self.automaton.added):
            return self._plain(text)
        out = []
        for part in self.special.split(text):
            added = self.automaton.added.get(part)
            out.append(self._plain(part) if added is None else np.array([added], "<u4").tobytes())
        return b"".join(out)


def encode_texts(docs: DataFrame, automaton: Automaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and `ids` (array of int). NULL and empty texts give no ids; other columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # bounded by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t), "<u4").astype("int32") for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "ids": ids})

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, automaton: Automaton, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the key and `text`, the labels of the ids. NULL ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(automaton.labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = shared.value
        for batch in batches:
            yield pd.DataFrame(
                {"key": batch["key"], "text": ["" if x is None else " ".join(map(labels.__getitem__, x.tolist())) for x in batch["ids"]]}
            )

    kind = encoded.schema[key].dataType.simpleString()
    slim = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return slim.mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)


def token_digests(docs: DataFrame, automaton: Automaton, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Per document: the columns `keep`, n_tokens, the SHA-256 of its ids and of the text decoded from them, and `ids` if asked for.

    Encoding and decoding happen in one pass, a few texts at a time, so a task holds
    little beside the texts it was sent. NULL texts count as empty, whose ids and decoded
    text are empty. Equal rows are kept as they are; columns not named play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for start in range(0, len(batch), _TEXTS):
                part = batch.iloc[start : start + _TEXTS]
                counts, arrays, ids_sha, text_sha = [], [], [], []
                for text in part["_text"]:
                    ids = encoder.encode(text)
                    array = np.frombuffer(ids, "<u4")
                    counts.append(len(array))
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.automaton.decode(array.tolist()).encode("utf-8")).hexdigest())
                    if with_ids:
                        arrays.append(array.astype("int32"))
                out = part[[*keep]].reset_index(drop=True)
                out = out.assign(n_tokens=np.array(counts, "int64"), ids_sha256=ids_sha, decoded_sha256=text_sha)
                yield out.assign(ids=arrays) if with_ids else out

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    slim = docs.select(*keep, F.col("text").alias("_text"))
    return slim.mapInPandas(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
