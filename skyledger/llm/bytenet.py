"""Language ID by a byte convolutional network.

A window is a fixed number of bytes of a UTF-8 text, A-Z in lower case. Each byte has a
short learned vector; filters of several widths run over the window, the greatest answer
of each filter is kept (max pooling), and a softmax layer turns those into languages. The
network is trained in numpy on windows drawn from a bounded sample of labelled texts.

A text is cut into windows that overlap by less than the widest filter, so every run of
bytes is seen once; the outputs of all its windows are averaged by their bytes before the
softmax. Windows of many texts go through the network in one batch of fixed size, so memory
does not depend on a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import free_name

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS, DEPTH = 16, 8
_WIDE = max(WIDTHS)
_PAD = 256  # stands past the end of a text
_BATCH = 64
UNKNOWN = "und"


def windows(text: str) -> list[bytes]:
    """All windows of a text; one, that may be empty, at least."""
    data = text.encode("utf-8", "surrogatepass").lower()
    step = WINDOW - _WIDE + 1
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - _WIDE + 1), step)]


def symbols(parts: list[bytes]) -> np.ndarray:
    """Windows as rows of symbols, padded to full length."""
    out = np.full((len(parts), WINDOW), _PAD, "int64")
    for row, part in zip(out, parts):
        row[: len(part)] = np.frombuffer(part, "uint8")
    return out


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # symbol -> vector; zero for the padding
    filters: np.ndarray  # (widest * DEPTH) x filters, zero past a filter's width
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def spans(self, x: np.ndarray) -> np.ndarray:
        """One row per place of each window: the vectors of the bytes under the widest filter."""
        v = np.ascontiguousarray(self.embed[x])
        n, length, depth = v.shape
        wide = np.lib.stride_tricks.as_strided(v, (n, length - _WIDE + 1, _WIDE * depth), (v.strides[0], v.strides[1], v.itemsize))
        return np.ascontiguousarray(wide)

    def pooled(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        answers = (spans.reshape(-1, spans.shape[2]) @ self.filters).reshape(*spans.shape[:2], -1)
        return answers, np.maximum(answers.max(axis=1) + self.bias, 0)

    def outputs(self, parts: list[bytes]) -> np.ndarray:
        """The languages' values before the softmax, one row per window."""
        out = [self.pooled(self.spans(symbols(parts[i : i + _BATCH])))[1] @ self.dense + self.shift for i in range(0, len(parts), _BATCH)]
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Language and score of each text; UNKNOWN with score 0 where it is None or has no letter."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        sums = np.zeros((len(texts), len(self.langs)))
        weights = np.zeros(len(texts))
        parts, owners = [], []

        def through() -> None:
            sizes = np.array([len(p) for p in parts], "float64")
            np.add.at(sums, owners, self.outputs(parts) * sizes[:, None])
            np.add.at(weights, owners, sizes)
            parts.clear()
            owners.clear()

        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                for part in windows(text):
                    parts.append(part)
                    owners.append(i)
                    if len(parts) == 4 * _BATCH:
                        through()
        if parts:
            through()
        for i in np.flatnonzero(weights):
            p = softmax(sums[i] / weights[i])
            best = int(p.argmax())
            langs[i], scores[i] = self.langs[best], float(p[best])
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def start(langs: list[str], seed: int = 3) -> Network:
    rnd = np.random.default_rng(seed)
    embed = rnd.normal(0, 0.5, (_PAD + 1, DEPTH)).astype("float32")
    embed[_PAD] = 0
    filters = np.zeros((_WIDE * DEPTH, FILTERS * len(WIDTHS)), "float32")
    for k, width in enumerate(WIDTHS):
        filters[: width * DEPTH, k * FILTERS : (k + 1) * FILTERS] = rnd.normal(0, (width * DEPTH) ** -0.5, (width * DEPTH, FILTERS))
    n = filters.shape[1]
    return Network(langs, embed, filters, np.zeros(n, "float32"), rnd.normal(0, n**-0.5, (n, len(langs))).astype("float32"), np.zeros(len(langs), "float32"))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of a batch and its gradient by parameter; only the place of a filter's greatest answer counts."""
    n = len(x)
    spans = net.spans(x)
    answers, top = net.pooled(spans)
    p = softmax(top @ net.dense + net.shift)
    loss = float(-np.log(p[np.arange(n), y] + 1e-30).mean())
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.dense.T) * (top > 0)
    places = answers.argmax(axis=1)  # window x filter
    seen = spans[np.arange(n)[:, None], places]  # window x filter x span
    filters = np.einsum("nf,nfs->sf", back, seen, optimize=True) * (net.filters != 0)
    into = (back[:, :, None] * net.filters.T[None]).reshape(-1, _WIDE, DEPTH)
    under = x[np.arange(n)[:, None, None], places[:, :, None] + np.arange(_WIDE)].reshape(-1)
    embed = np.stack([np.bincount(under, into[:, :, d].ravel(), _PAD + 1) for d in range(DEPTH)], axis=1)
    embed[_PAD] = 0
    return loss, {"dense": top.T @ p, "shift": p.sum(0), "bias": back.sum(0), "filters": filters, "embed": embed}


def train(parts: list[bytes], y: np.ndarray, langs: list[str], steps: int = 900, rate: float = 0.004, seed: int = 3) -> Network:
    """Adam over random batches; a third of the windows is cut short at random, as short texts are."""
    net, rnd = start(langs, seed), np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "dense", "shift")
    first = {k: np.zeros(getattr(net, k).shape) for k in names}
    second = {k: np.zeros(getattr(net, k).shape) for k in names}
    for t in range(1, steps + 1 if len(langs) > 1 else 1):
        pick = rnd.integers(0, len(parts), _BATCH)
        short = np.where(rnd.random(_BATCH) < 0.33, rnd.integers(6, WINDOW, _BATCH), WINDOW)
        _, found = gradients(net, symbols([parts[i][:s] for i, s in zip(pick, short)]), y[pick])
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k in names:
            g = found[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            step = pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            getattr(net, k)[...] -= step.astype("float32")
    return net


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 1500, langs: int = 100, draws: int = 3, steps: int = 900) -> Network:
    """Train on the first `draws` windows, spread over the text, of at most `per_lang` texts of each language.

    The sample holds the texts of the smallest hashed keys, of a share of the rows that a
    second hash draws so that about 4 * `per_lang` are left, of the `langs` most frequent
    languages. Rows with a NULL key, text or language and texts without letters are left
    out. The choice of windows depends on the text alone. Without rows the network knows
    no language.
    """
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna().filter(F.col("text").rlike(r"\p{L}"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    # ids first, texts only of those drawn; about four times as many as wanted are put in order, however many there are
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    near = F.shiftrightunsigned(F.xxhash64("k", F.lit(1)), 11) < F.lit(4.0 * per_lang * 2.0**53) / F.col("n")
    drawn = rows.join(known, "lang").filter(near).select("lang", "k").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_lang).select("lang", "k")

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                parts = windows(row.text)
                at = sorted({round(i * (len(parts) - 1) / max(1, draws - 1)) for i in range(draws)})
                yield pd.DataFrame({"lang": row.lang, "k": row.k, "at": at, "part": [parts[i] for i in at]})

    # at most per_lang * langs keys, so texts need no shuffle
    sample = rows.join(F.broadcast(drawn), ["lang", "k"]).mapInPandas(some, "lang string, k string, at int, part binary").toPandas()
    sample = sample.sort_values(["lang", "k", "at", "part"], kind="stable")
    names = sorted(set(sample["lang"]))
    y = np.array([names.index(v) for v in sample["lang"]], "int64")
    return train([bytes(p) for p in sample["part"]], y, names, steps)


def predict(docs: DataFrame, net: Network, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs`, the predicted language and its score; columns of those names are replaced.

    NULL texts and those without a letter are UNKNOWN with score 0, as is every text if the network knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some tens of kilobytes

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict([None if t is None or t != t else t for t in texts])
        return pd.DataFrame({"lang": np.array(lang, object), "score": np.array(score, "float64")})

    found = free_name(docs, "found")
    return docs.withColumn(found, of(F.col(text))).withColumns({names[0]: F.col(f"{found}.lang"), names[1]: F.col(f"{found}.score")}).drop(found)


def fold(key: str = "doc_id") -> Column:
    """True for held-out rows: the checksum of the id as text leaves 2 by 4. NULL ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def language_rows(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    net = fit(docs.filter(~fold()))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", fold().alias("held_out"), "lang_pred", "score")
