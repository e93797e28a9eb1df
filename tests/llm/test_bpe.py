import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from skyledger.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " \n\t ", "Hello world's I've don't 123 456!!", "a<|endoftext|>b <|startoftext|>", "ΟΔΥΣΣΕΥΣ İstanbul ﬁ é Å K",
    "x\x1cy\x85z q r", "你好 🙂🙂 مرحبا", "l" * 200, "aaaa " * 50 + "ababab" * 30, "lé ẹ̀", "\u0000\u0007",
]


@pytest.fixture(scope="module")
def automaton():
    return bpe.load_automaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_decoded_text_as_the_library(spark, automaton, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in table] + ODD
    encoder = bpe.Encoder(automaton)
    for text in texts:
        want = library.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == want
        assert automaton.decode(got) == library.decode(want, skip_special_tokens=False)


def test_digests_of_odd_rows(frame, automaton, library):
    rows = [(i, t, "de") for i, t in enumerate(ODD)] + [(3, ODD[3], "de"), (None, "and", None)]
    got = bpe.token_digests(frame(rows, "doc_id long, text string, ids_sha256 string"), automaton).collect()
    assert len(got) == len(rows)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(frame, automaton, library):
    docs = frame([(1, "the cat's 12 hats"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode_texts(docs, automaton)
    out = {r.doc_id: r.text for r in bpe.decode_ids(encoded, automaton).collect()}
    assert out[2] == "" and out[1] == library.decode(library.encode("the cat's 12 hats", add_special_tokens=False).ids)


def test_empty_table(frame, automaton):
    assert bpe.token_digests(frame([], "doc_id long, text string"), automaton).count() == 0


def test_words_forget_and_go_on(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 2)
    text = "one two three four five one two three"
    assert bpe.Encoder(automaton).encode(text) == b"".join(bpe.Encoder(automaton).encode(w) for w in text.split())
