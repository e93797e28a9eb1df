"""N-grams are strings of their own, so scoring names none of them a second time."""

import math

import xxhash

from skyledger.llm import quality


def test_grams_are_named_once():
    grams = quality.Grams()("Go go Home, 12 home")
    assert {"go", "go\tgo", "\t A".replace("A", "Aa"), "12\thome"} <= grams
    assert all(isinstance(g, str) for g in grams)
    assert quality.Grams()(None) == {"<none>"}
    assert quality._hash("a\ud800b") == xxhash.xxh64_intdigest("a\ud800b".encode("utf-8", "surrogatepass"))


def test_scores_add_the_weights_of_distinct_grams():
    model = quality.Model({quality._hash("go"): 0.5, quality._hash("go\thome"): -2.0}, 0.25, 1.0, 0.0)
    want = [0.25 + 0.5 - 2.0, 0.25 + 0.5, 0.25]
    assert model.scores(["go home go home", "go \ud800", None]).tolist() == [1 / (1 + math.exp(-m)) for m in want]
