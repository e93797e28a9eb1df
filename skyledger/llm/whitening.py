"""Embedding whitening: the covariance of counted distinct vectors, each of them whitened once.

Entries become whole numbers, x = floor(1024 * c) + 100000. Equal x vectors are grouped
first; a group carries the number of its rows (or one, if distinct vectors are to weigh
alike), and that number is its weight in the fit. Sums per dimension are exact. The
covariance is a weighted product of centred vectors: every task adds up its own matrix,
whose entries Spark sums by (row, column). What reaches the driver is that matrix and the
sums, whose size depends on the dimensions alone. Every distinct vector is projected once,
and the rows get the result back by a join on x.

A group of equal vectors is counted before it is shuffled, so a vector that a third of all
rows share is one row of the fit; the join back is one that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, drop_cut, free_name

SCALE, SHIFT = 1024.0, 100_000
_LIMIT = 2.0**52  # beyond it 1024 * c leaves little room in a long


def _whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x of the rows that take part."""
    item = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(item, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _LIMIT)), F.lit(False))
    x = F.transform(item, lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    return vectors.filter(sound).select(F.col(key), x.alias("x"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("int64") if len(column) else np.zeros((0, dim), "int64")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row sums of a * b, exact: in 64 bits where they fit, else in Python's whole numbers."""
    if not a.size:
        return np.zeros(len(a), object)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**62:
        return (a * b).sum(1).astype(object)
    return (a.astype(object) * b.astype(object)).sum(1)


def _sums(distinct: DataFrame, dim: int) -> list[int]:
    """The weighted sum of each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [0] * dim
        for batch in batches:
            x, w = _matrix(batch["x"], dim), batch["w"].to_numpy("int64")
            part = _dot(x.T, np.broadcast_to(w, (dim, len(x)))) if len(x) else [0] * dim
            total = [t + int(p) for t, p in zip(total, part)]
        yield pd.DataFrame({"at": range(dim), "s": [str(t) for t in total]})

    found = distinct.mapInPandas(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["at"]: int(r["s"]) for r in found}
    return [by[i] for i in range(dim)]


def _covariance(distinct: DataFrame, dim: int, n: int, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    whole, rest = centre

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            d = (_matrix(batch["x"], dim) - whole) - rest / n
            total += (d * batch["w"].to_numpy("float64")[:, None]).T @ d
        i, j = np.triu_indices(dim)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    v = np.zeros((dim, dim))
    for r in distinct.mapInPandas(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["v"] / n
    return v


def _identity_error(white: DataFrame, sound: int, n: int) -> float:
    """The largest absolute entry of the covariance of the whitened components minus the identity."""
    z = lambda i: F.col("z")[i]
    means = white.agg(*[(F.sum(z(i) * F.col("w")) / n).alias(f"m{i}") for i in range(sound)]).first()
    pairs = [(i, j) for i in range(sound) for j in range(i + 1)]
    products = white.agg(*[(F.sum((z(i) - means[i]) * (z(j) - means[j]) * F.col("w")) / n).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(p - (i == j)) for p, (i, j) in zip(products, pairs))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, by_count: bool = True) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every row that takes part and its first components.

    Rows whose vector is NULL or holds a NULL or non-finite entry are left out, as are
    vectors of another length than the usual one (that of most rows, the shorter of two)
    and those with an entry of 2^52 or more, whose x leaves the range of a long. Rows
    with a NULL key and repeated rows stay, each by itself. `by_count`: a vector weighs as
    many times as it occurs; else every distinct vector weighs one. n is the sum of the
    weights; `deviation` (decimal(38,0)) the exact sum over dimensions of (n * x - S)^2,
    NULL beyond 38 digits. A vector of fewer than `components` dimensions has fewer
    components. Components without variance (all vectors equal, or fewer vectors than
    dimensions) have a NULL `whitened`, and `identity_error` is that of the others, NULL if
    there are none; `explained` is NULL if nothing varies. Without rows the result is
    empty. Other columns play no part.
    """
    rows = _whole(vectors, key, vector)
    distinct = cut(rows.groupBy("x").agg((F.count("*") if by_count else F.lit(1).cast("long")).alias("w")))
    sizes = distinct.groupBy(F.size("x").alias("dim")).agg(F.sum("w").alias("n")).filter("dim > 0")
    usual = sizes.orderBy(F.desc("n"), "dim").first()
    name = key if key not in ("component", "n", "deviation", "whitened", "explained", "identity_error") else free_name(rows, key)
    if usual is None:
        drop_cut(distinct)
        return rows.limit(0).select(
            F.col(key).alias(name), *[F.lit(None).cast(t).alias(c) for c, t in
            (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]
        )
    dim, n = usual["dim"], int(usual["n"])
    fitted = distinct.filter(F.size("x") == dim)
    parts = [divmod(s, n) for s in _sums(fitted, dim)]
    whole, rest = np.array([p[0] for p in parts], "int64"), np.array([p[1] for p in parts], "int64")
    v = _covariance(fitted, dim, n, (whole, rest))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, dim)
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(0), range(kept)])
    trace = float(np.trace(v))
    sound = int((values[:kept] > max(values[0], 0.0) * dim * 1e-14).sum())
    onto = axes[:, :sound] / np.sqrt(values[:sound])
    constant = n * n, 2 * n, sum(int(r) ** 2 for r in rest)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["x"], dim)
            off = x - whole
            # the sum of (n * off - rest)^2
            squares, mixed = _dot(off, off), _dot(off, np.broadcast_to(rest, off.shape))
            deviation = [str(constant[0] * int(a) - constant[1] * int(b) + constant[2]) for a, b in zip(squares, mixed)]
            yield pd.DataFrame({"x": batch["x"], "w": batch["w"], "deviation": deviation, "z": list((off - rest / n) @ onto)})

    white = cut(fitted.mapInPandas(project, "x array<long>, w long, deviation string, z array<double>"))
    error = _identity_error(white, sound, n) if sound else None
    drop_cut(distinct)
    explained = F.lit([float(e / trace) for e in values[:kept]]) if trace > 0 else F.lit(None).cast("array<double>")
    numbers = F.explode(F.sequence(F.lit(1), F.lit(kept)))
    joined = rows.join(white.select("x", "deviation", "z"), "x").select(F.col(key).alias(name), "deviation", "z", numbers.alias("component"))
    return joined.select(
        name, "component", F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        F.try_element_at("z", "component").alias("whitened"), F.try_element_at(explained, F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def whitened_embeddings(vectors: DataFrame) -> DataFrame:
    """The first eight components of every vector; `deviation` as a long, NULL where it does not fit one."""
    found = whiten(vectors)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
