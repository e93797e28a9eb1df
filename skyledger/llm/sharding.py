"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 64-bit hashes; a row's home is the
owner of the first point at or after its key's hash. A shard takes at most its
load bound; rows that find it full go on clockwise to the next point whose shard
has room. The bound is exact: the row count divided by the shards, the first
shards taking one more where it does not divide. So counts differ by one at most,
and only the rows above a shard's bound leave home.

Which rows leave is settled with counts, not row by row: rows are ranked along the
ring by one distributed sort, the driver gets one count per arc and per sorted
partition (bounded by shards x vnodes and the partition count), and walks the
overflow of whole arcs. Each row then finds its place from its rank alone.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut

_LOW = (1 << 33) - 1  # monotonically_increasing_id() keeps the row's place in its partition below this bit


def ring_points(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Positions of all virtual nodes in ring order, as signed 64-bit numbers, and their shards."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    points.sort()
    return [p for p, _ in points], [s for _, s in points]


def ring_plan(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int]]:
    """Segments (first rank, shard, first slot) in ring order for the row counts of the arcs.

    Arc i ends at point i; the arc after the last point belongs to the first one again.
    Home rows come first; then, in ring order, what is left of an arc goes clockwise.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    starts, at = [], 0
    for c in counts:
        starts.append(at)
        at += c
    pieces = []  # first rank, rows, shard
    left = []
    for i, c in enumerate(counts):
        owner = owners[i % len(owners)]
        take = min(c, room[owner])
        room[owner] -= take
        if take:
            pieces.append((starts[i], take, owner))
        if c > take:
            left.append((i, starts[i] + take, c - take))
    # the points that still have room, thinned as they fill up
    open_points = [i for i in range(len(owners)) if room[owners[i]]]
    for i, rank, rows in left:
        while rows:
            k = bisect.bisect_right(open_points, i % len(owners))
            point = open_points[k % len(open_points)]
            owner = owners[point]
            take = min(rows, room[owner])
            if take:
                room[owner] -= take
                pieces.append((rank, take, owner))
                rank, rows = rank + take, rows - take
            if not room[owner]:
                open_points = [p for p in open_points if owners[p] != owner]
    pieces.sort()
    slots = [0] * shards
    plan = []
    for rank, rows, owner in pieces:
        plan.append((rank, owner, slots[owner]))
        slots[owner] += rows
    return plan


def ring_shards(rows: DataFrame, key: str, keep: list[str], shards: int = 40, vnodes: int = 64) -> DataFrame:
    """Place every row: the columns `key` and `keep`, with `shard` and `slot` (0, 1, ... within the shard).

    `keep` should be slim, as these columns are sorted along the ring; equal keys, NULL
    keys included, share a position, and what exceeds a shard there moves on as
    elsewhere. Rows equal in all given columns are interchangeable. An empty table
    gives an empty result. Columns of `rows` that are not named play no part.
    """
    points, owners = ring_points(shards, vnodes)
    cols = [key, *[c for c in keep if c != key]]
    ring = rows.select(*cols).withColumn("_h", F.xxhash64(F.col(key).cast("string")))
    # the row's own number splits runs of equal keys over partitions; it decides nothing else
    ring = ring.withColumn("_row", F.monotonically_increasing_id())
    order = ["_h", *cols, "_row"]
    ranked = ring.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = ranked.drop("_row").withColumn("_at", F.monotonically_increasing_id())

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(points), h.to_numpy()).astype("int32"))

    ranked = cut(ranked.withColumn("_arc", arc("_h")).drop("_h"))
    counts = [0] * (len(points) + 1)
    for r in ranked.groupBy("_arc").count().collect():
        counts[r["_arc"]] = r["count"]
    sizes = {r["_part"]: r["n"] for r in ranked.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()}
    offsets, total = np.zeros(max(sizes, default=0) + 1, "int64"), 0
    for part in sorted(sizes):
        offsets[part] = total
        total += sizes[part]
    plan = np.array(ring_plan(counts, owners, shards) or [(0, 0, 0)], "int64")

    @F.pandas_udf("shard int, slot long")
    def place(at: pd.Series) -> pd.DataFrame:
        at = at.to_numpy()
        rank = offsets[at >> 33] + (at & _LOW)
        k = np.searchsorted(plan[:, 0], rank, side="right") - 1
        return pd.DataFrame({"shard": plan[k, 1].astype("int32"), "slot": plan[k, 2] + rank - plan[k, 0]})

    placed = ranked.withColumn("_place", place("_at"))
    return placed.select(*cols, F.col("_place.shard").alias("shard"), F.col("_place.slot").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """Documents (doc_id, text) in shards of equal row counts.

    size: UTF-8 bytes of the text (NULL: none) plus 16; text_crc32: of the same bytes
    (NULL: 0); law: always `rows`; grown_shard: NULL, as that law says nothing of it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = ring_shards(slim, "doc_id", ["size", "text_crc32"], shards, vnodes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
