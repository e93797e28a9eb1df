"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves a bounded sample of the vectors again and again, each time by the
direction between two of them, into about `leaves` leaves. Every row of the table is
then put into its leaf of each tree. A query searches all trees through one priority queue, ordered by how far a branch lies beyond the planes passed
so far, and takes leaves until they hold `share` of the rows.
Within each leaf its queries meet its rows as two blocks of vectors, and each query
keeps the exact nearest ones; those of all leaves are ranked once more.

Leaves and queries are dealt into blocks of bounded size, so neither a leaf that holds a
third of all rows nor one that every query wants lands in one task. What is broadcast
is the forest, which the sample bounds; what reaches the driver is one count per leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Tree:
    """Inner node k splits at `offsets[k]` along `planes[k]`; children below zero are leaves -1 - n."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.offsets) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.planes[k]) > self.offsets[k]
            at[inner] = self.children[k, side.astype(int)]
        return -1 - at


def grow(x: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    rnd = np.random.default_rng(seed)
    planes, offsets, children = [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        number = None
        if len(rows) > leaf_rows:
            for _ in range(4):  # equal rows give no direction
                a, b = rnd.choice(rows, 2, replace=False)
                plane = x[a] - x[b]
                along = x[rows] @ plane
                offset = np.median(along)
                left = along <= offset
                if 0 < left.sum() < len(rows):
                    number = len(offsets)
                    planes.append(plane / np.linalg.norm(plane))
                    offsets.append(offset / np.linalg.norm(plane))
                    children.append([0, 0])
                    todo += [(rows[left], number, 0), (rows[~left], number, 1)]
                    break
        if number is None:
            number, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            children[parent][side] = number
    dim = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(planes, "float64").reshape(-1, dim), np.array(offsets, "float64"), np.array(children, "int64").reshape(-1, 2), leaves)


def search(trees: list[Tree], counts: list[np.ndarray], x: np.ndarray, rows: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until they hold `rows` rows."""
    queue = [(0.0, t, 0 if len(tree.offsets) else -1) for t, tree in enumerate(trees)]
    margins = [tree.planes @ x - tree.offsets for tree in trees]
    out, held = [], 0
    while queue and held < rows:
        beyond, t, at = heapq.heappop(queue)
        while at >= 0:
            m = margins[t][at]
            near, far = trees[t].children[at, [int(m > 0), int(m <= 0)]].tolist()
            heapq.heappush(queue, (max(beyond, abs(m)), t, far))
            at = near
        out.append((t, -1 - at))
        held += counts[t][-1 - at]
    return out


def _power(x: np.ndarray) -> float:
    """A power of two by which x is brought to at most 1/4 (1 for zeros)."""
    top = float(np.abs(x).max()) if x.size else 0.0
    return float(np.exp2(-np.float64(min(max(np.frexp(top)[1] + 2, -1000), 1020)))) if top else 1.0


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, also where squares leave its range."""
    with np.errstate(over="ignore", under="ignore"):
        d = q - x
        plain = np.sqrt((d * d).sum(1))
        odd = ~((plain > 1e-140) & (plain < 1e140)) & (d != 0).any(1)
        if odd.any():
            d = q[odd] / 4 - x[odd] / 4
            top = np.abs(d).max(1)
            top[top == 0] = 1.0
            d /= top[:, None]
            plain[odd] = np.sqrt((d * d).sum(1)) * top * 4
    return plain


def nearest_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, ties to the smaller id, its own id left out; distances in double precision.

    A quick form of the distance, with a bound of its rounding error for each pair, tells
    which rows can be among the nearest; those are measured exactly. The rows are scaled by
    a power of two and moved to their middle before, so offsets and large numbers cost nothing.
    """
    by_id = np.argsort(xid, kind="stable")
    q, x, xid = q.astype("float64"), x[by_id].astype("float64"), xid[by_id]
    scale = min(_power(q), _power(x))
    xs, qs = x * scale, q * scale
    middle = xs.mean(0)
    xs, qs = xs - middle, qs - middle
    scale = min(_power(qs), _power(xs))
    xs, qs = xs * scale, qs * scale
    # rounding of both shifts, the products and their sums, with room to spare
    eps = 8 * (x.shape[1] + 8) * np.finfo("float64").eps
    x2 = (xs * xs).sum(1)
    _, first = np.unique(xid, return_index=True)  # rows of one id count once
    parts = []
    for start in range(0, len(q), 256):
        at = slice(start, start + 256)
        q2 = (qs[at] * qs[at]).sum(1)
        rough = q2[:, None] + x2[None] - 2 * (qs[at] @ xs.T)
        slack = eps * (q2[:, None] + x2[None]) + 1e-300
        own = qid[at][:, None] == xid[None]
        upper = rough + slack
        upper[own] = np.inf
        if len(first) < len(xid):
            upper = np.minimum.reduceat(upper, first, axis=1)
        kth = np.partition(upper, min(k, len(first)) - 1, axis=1)[:, min(k, len(first)) - 1]
        i, j = np.nonzero((rough - slack <= kth[:, None]) & ~own)
        score = distances(q[at][i], x[j])
        order = np.lexsort((score, xid[j], i))
        i, j, score = i[order], j[order], score[order]
        best = np.ones(len(i), bool)
        best[1:] = (np.diff(i) != 0) | (np.diff(xid[j]) != 0)
        i, j, score = i[best], j[best], score[best]
        order = np.lexsort((xid[j], score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append((qid[at][i[keep]], xid[j[keep]], score[keep]))
    query, found, score = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"query_id": query, "vec_id": found, "score": score})


def forest_neighbours(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
    trees: int = 16, sample: int = 65_536, leaves: int = 128, share: float = 0.8,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, by Euclidean distance.

    Rows of both tables take part if their id is not NULL and their vector has the
    usual length (the most frequent one in `vectors`), holds only finite numbers and is
    not zero. A query's own id is no candidate. Rows that share an id count once, at
    their smallest distance. Fewer candidates than k give fewer rows; none give none.
    `share` trades time for recall: rows in the searched leaves, all trees together, per
    row of the table, and k + 1 rows a tree at any rate, so that k are found. A query visits
    about `leaves` * `share` leaves at any table size. Other columns play no part.
    """
    item = F.col(vector)
    sound = F.col(key).isNotNull() & F.coalesce(
        F.forall(item, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(item, lambda v: v != 0), F.lit(False)
    )
    size = vectors.filter(sound).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size["n"] if size else 1
    kind = "float32" if "float" in vectors.schema[vector].dataType.simpleString() else "float64"
    cast = f"array<{'float' if kind == 'float32' else 'double'}>"
    slim = lambda df: df.filter(sound & (F.size(vector) == dim)).select(F.col(key).cast("long").alias("id"), item.cast(cast).alias("v"))
    rows, asked = slim(vectors), slim(queries)
    spark = vectors.sparkSession

    def matrix(column) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(kind) if len(column) else np.zeros((0, dim), kind)

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    base = matrix(drawn["v"]).astype("float64")
    forest = [grow(base, max(1, len(base) // leaves), seed) for seed in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    def sort_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["v"]).astype("float64")
                at = np.stack([t.leaf_of(x) for t in shared.value])
                yield pd.DataFrame({"tree": np.repeat(np.arange(trees), len(batch)), "leaf": at.ravel()})

    counts = [np.zeros(t.leaves, "int64") for t in forest]
    for r in rows.mapInPandas(sort_in, "tree int, leaf int").groupBy("tree", "leaf").count().collect():
        counts[r["tree"]][r["leaf"]] = r["count"]
    total = int(counts[0].sum()) if trees else 0
    # the rows of one tree's leaves are all different, so this is never fewer than k and the query itself
    wanted = max(share * total, trees * (k + 1))

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = [search(shared.value, counts, x, wanted) for x in matrix(batch["v"]).astype("float64")]
                yield pd.DataFrame({
                    "id": np.repeat(batch["id"].to_numpy(), [len(f) for f in found]),
                    "tree": [t for f in found for t, _ in f], "leaf": [n for f in found for _, n in f],
                })

    wants = [np.zeros(t.leaves, "int64") for t in forest]
    for r in asked.mapInPandas(probes, "id long, tree int, leaf int").groupBy("tree", "leaf").count().collect():
        wants[r["tree"]][r["leaf"]] = r["count"]
    row_blocks = [np.maximum(1, -(-c // ROW_BLOCK)) for c in counts]
    query_blocks = [np.maximum(1, -(-c // QUERY_BLOCK)) for c in wants]
    deal = lambda n, ids: (pd.util.hash_array(ids.astype("int64")) % n.astype("uint64")).astype("int64")

    def spread(ids, vecs, tree, leaf, own, other, names) -> pd.DataFrame:
        """A line per (tree, leaf): dealt to one of its own blocks, repeated for each block of the other side."""
        copies = other
        block = np.repeat(deal(own, ids), copies)
        again = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        pick = np.repeat(np.arange(len(ids)), copies)
        return pd.DataFrame({"tree": tree[pick], "leaf": leaf[pick], names[0]: block, names[1]: again, "id": ids[pick], "v": [vecs[p] for p in pick]})

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, ids = matrix(batch["v"]), batch["id"].to_numpy()
            packed = [v.tobytes() for v in x]
            for t, tree in enumerate(shared.value):
                leaf = tree.leaf_of(x.astype("float64"))
                use = wants[t][leaf] > 0
                if use.any():
                    f = leaf[use]
                    yield spread(ids[use], [p for p, u in zip(packed, use) if u], np.full(len(f), t), f, row_blocks[t][f], query_blocks[t][f], ("rb", "qb"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, v in zip(batch["id"].tolist(), matrix(batch["v"])):
                at = np.array(search(shared.value, counts, v.astype("float64"), wanted), "int64").reshape(-1, 2)
                own = np.array([query_blocks[t][n] for t, n in at], "int64")
                other = np.array([row_blocks[t][n] for t, n in at], "int64")
                yield spread(np.full(len(at), i), [v.tobytes()] * len(at), at[:, 0], at[:, 1], own, other, ("qb", "rb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        unpack = lambda col: np.frombuffer(b"".join(col), kind).reshape(-1, dim)
        return nearest_of(unpack(left["v"]), left["id"].to_numpy(), unpack(right["v"]), right["id"].to_numpy(), k)

    line = "tree int, leaf int, {} int, {} int, id long, v binary"
    by = ["tree", "leaf", "rb", "qb"]
    found = (
        asked.mapInPandas(ask, line.format("qb", "rb")).groupBy(*by)
        .cogroup(rows.mapInPandas(post, line.format("rb", "qb")).groupBy(*by))
        .applyInPandas(meet, "query_id long, vec_id long, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hundredth_queries(vectors: DataFrame) -> DataFrame:
    """The 10 nearest rows of every row whose vec_id is divisible by 100."""
    return forest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
