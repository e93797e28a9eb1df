"""Quality classifier: naive Bayes scaled n-grams under a linear hinge loss.

Features are indicators of n-grams: words and pairs of words, and runs of one to
three word shapes. A shape says how a word is written (letter case, digits, the
marks at its end) and whether it repeats the word before, so habits of writing
count beyond the words of the sample. Each indicator is scaled by its log-count
ratio between the classes, and a linear support-vector machine is fitted on the
scaled indicators by dual coordinate descent. A logistic curve, fitted on rows held
back from the descent, turns margins into scores between 0 and 1.

N-grams are counted by Spark over a bounded sample of labelled rows, the descent runs
on the driver over that sample, and every document is scored in one pass. All n-grams
that occur in enough rows are kept; they go by 64-bit hashes, so the driver holds numbers only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEMO = 100_000
_digest = xxhash.xxh64_intdigest


def _shape(word: str) -> str:
    core = word.rstrip("".join(sorted(set(re.findall(r"[^\w]", word)))))
    tail = word[len(core) :]
    if not core:
        case = "-"
    elif core.isdigit():
        case = "9"
    elif core.isupper():
        case = "A" if len(core) > 1 else "I"
    elif core.islower():
        case = "a"
    elif core[0].isupper() and core[1:].islower():
        case = "Aa"
    else:
        case = "x"
    return case + tail[:4]


class Grams:
    """The distinct n-grams of a text; words already seen keep their shape."""

    def __init__(self):
        self.memo: dict[str, str] = {}

    def __call__(self, text: str | None) -> set:
        words = (text or "").split()
        if not words:
            return {"<none>"}
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = _shape(w)
        shapes = list(map(memo.__getitem__, words))
        again = [" "] + ["=" if a == b else " " for a, b in zip(words, words[1:])]
        marks = list(map(str.__add__, again, shapes))
        low = list(map(str.lower, words))
        # one string per n-gram; words hold no white space, so the tab keeps kinds and parts apart
        join, bars = "\t".join, ("|",) * len(marks)
        return {
            *low, *map(join, zip(low, low[1:])), *map("\t".__add__, marks),
            *map(join, zip(marks, marks[1:], bars)), *map(join, zip(marks, marks[1:], marks[2:], bars)),
        }


def _hash(gram: str) -> int:
    try:
        return _digest(gram)  # of its UTF-8
    except UnicodeEncodeError:
        return _digest(gram.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    weights: dict[int, float]  # by hashed n-gram
    bias: float
    slope: float
    shift: float

    def scores(self, texts) -> np.ndarray:
        grams, get = Grams(), self.weights.get
        margins = []
        for t in texts:
            found = grams(t)
            try:
                hashes = list(map(_digest, found))
            except UnicodeEncodeError:
                hashes = list(map(_hash, found))
            margins.append(self.bias + math.fsum(map(get, hashes, repeat(0.0))))
        return 1.0 / (1.0 + np.exp(-(self.slope * np.array(margins, "float64") + self.shift)))


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss.

    rows: feature numbers of each row, whose values are `values` of those numbers;
    y: -1 or 1; cost: the bound of each row's dual variable. The bias is one more
    feature of value 1. Returns the weights of scaled features and the bias.
    """
    w, bias = np.zeros(len(values)), 0.0
    dual = np.zeros(len(rows))
    square = np.array([(values[r] ** 2).sum() + 1.0 for r in rows])
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rnd.permutation(len(rows)):
            r = rows[i]
            v = values[r]
            slope = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = new - dual[i]
            if step:
                w[r] += step * y[i] * v
                bias += step * y[i]
                dual[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on slightly smoothed targets; the slope stays positive."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        g = np.array([((p - goal) * margins).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = max(a - step[0], 0.05), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _numbers(df: DataFrame) -> np.ndarray:
    """A table of longs as an array, sent to the driver as bytes."""
    width = len(df.columns)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": [batch.to_numpy("<i8").tobytes()]})

    parts = [r.part for r in df.mapInPandas(pack, "part binary").collect()]
    return np.frombuffer(b"".join(parts), "<i8").reshape(-1, width)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", sample: int = 8000, least: int = 4, cost: float = 0.05, epochs: int = 25) -> Model:
    """Fit on at most `sample` labelled rows (label 0 or 1), those with the smallest hashed keys.

    `least`: rows an n-gram must occur in; all that do are kept.
    Rows with NULL labels or keys are left out. Without rows of both classes the model
    scores every text with the share of class 1 (0.5 without rows).
    """
    rows = labelled.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    rows = rows.select(F.xxhash64(F.col(key).cast("string")).alias("_h"), F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).cast("int").alias("_y"))
    rows = rows.orderBy("_h", "_key", "_text", "_y").limit(sample).repartition(16, "_h")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            found = [np.fromiter(map(_hash, grams(t)), "uint64").view("int64") for t in batch["_text"]]
            yield pd.DataFrame({"gram": np.concatenate(found or [np.zeros(0, "int64")]), "y": np.repeat(batch["_y"].to_numpy("int32"), list(map(len, found)))})

    counted = (
        rows.mapInPandas(spread, "gram long, y int")
        .groupBy("gram").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
        .filter(F.col("n") >= least)
    )
    counted = _numbers(counted.select("gram", "ones", "n"))
    counted = counted[np.argsort(counted[:, 0])]
    known = np.ascontiguousarray(counted[:, 0])
    shared = labelled.sparkSession.sparkContext.broadcast(known)  # 8 bytes an n-gram of the sample

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, known = Grams(), shared.value
        for batch in batches:
            found = []
            for t in batch["_text"]:
                own = np.sort(np.fromiter(map(_hash, grams(t)), "uint64").view("int64"))
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                found.append(at[known[at] == own].astype("<i4").tobytes() if len(known) else b"")
            yield pd.DataFrame({"h": batch["_h"], "y": batch["_y"], "grams": found})

    data = rows.mapInPandas(vectors, "h long, y int, grams binary").toPandas().sort_values("h", kind="stable")
    y = np.where(data["y"].to_numpy() == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = (y > 0).mean() if len(y) else 0.5
        return Model({}, 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    ones, n = counted[:, 1].astype("float64"), counted[:, 2].astype("float64")
    p, q = 1 + ones, 1 + n - ones
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    vecs = [np.frombuffer(g, "<i4") for g in data["grams"]]
    del data
    part = np.arange(len(y)) % 5 == 0  # held back for the curve
    train = np.flatnonzero(~part) if len(set(y[part])) == 2 and len(set(y[~part])) == 2 else np.arange(len(y))
    held = np.flatnonzero(part) if len(train) < len(y) else train
    # the rarer class weighs as much as the other
    share = (y[train] > 0).mean()
    costs = cost * np.where(y[train] > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias = descend([vecs[i] for i in train], ratio, y[train], costs, epochs)
    scaled = w * ratio
    margins = np.array([scaled[vecs[i]].sum() + bias for i in held])
    slope, shift = _logistic(margins, y[held])
    return Model({g: x for g, x in zip(known.view("uint64").tolist(), scaled.tolist()) if x}, float(bias), slope, shift)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` and the score of every whole text; NULL texts count as empty, a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the kept n-grams

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return docs.withColumn(name, of(F.col(text)))


def fold(key: str = "doc_id"):
    """True for held-out rows: the checksum of the id as text leaves no remainder by 5. NULL ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """Fit `labels.quality` on the texts of rows that are not held out."""
    known = labels.filter(~fold()).select("doc_id", F.col("quality").alias("label"))
    texts = docs.filter(~fold()).select("doc_id", "text")
    # the sample is taken from the labels first, so that few texts are joined
    picked = known.filter(F.col("label").isin(0, 1)).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(sample)
    return fit(texts.join(picked, "doc_id"), sample=sample)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 8000, least_score: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from `least_score` on)."""
    scored = score(docs.select("doc_id", "text"), fit_quality(docs, labels, sample))
    return scored.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"))
