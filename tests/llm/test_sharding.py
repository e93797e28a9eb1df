import zlib
from collections import Counter

from skyledger.llm import sharding


def by_hand(counts, owners, shards):
    """One row at a time: home first, then clockwise."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out, late, at = {}, [], 0
    for i, c in enumerate(counts):
        for _ in range(c):
            owner = owners[i % len(owners)]
            if room[owner]:
                room[owner] -= 1
                out[at] = owner
            else:
                late.append((i, at))
            at += 1
    for i, rank in late:
        k = i + 1
        while not room[owners[k % len(owners)]]:
            k += 1
        owner = owners[k % len(owners)]
        room[owner] -= 1
        out[rank] = owner
    return out


def test_plan_equals_row_by_row_walk():
    owners = [2, 0, 1, 2, 1, 0, 3]
    for counts in ([5, 0, 0, 9, 1, 0, 2, 3], [0] * 8, [40, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 33], [1, 2, 3, 4, 5, 6, 7, 8]):
        plan = sharding.ring_plan(counts, owners, 4)
        got = {}
        for (rank, owner, slot), end in zip(plan, [p[0] for p in plan[1:]] + [sum(counts)]):
            for r in range(rank, end):
                got[r] = owner
        assert got == by_hand(counts, owners, 4)


def check(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    every = [sizes.get(s, 0) for s in range(shards)]
    assert max(every) - min(every) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes.get(s, 0)))


def test_law_slots_and_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    check(rows, 40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


def test_hot_and_null_keys_repeated_rows_clashing_columns(frame):
    rows = [(7, "x", i) for i in range(300)] + [(None, None, 1)] * 50 + [(i, "", 2) for i in range(100)]
    got = sharding.shard_documents(frame(rows, "doc_id long, text string, shard int", 5), shards=6).collect()
    assert len(got) == 450
    check(got, 6)
    assert {r["size"] for r in got if r.doc_id is None} == {16} and {r.text_crc32 for r in got if r.doc_id is None} == {0}


def test_empty_and_fewer_rows_than_shards(frame):
    assert sharding.shard_documents(frame([], "doc_id long, text string")).count() == 0
    check(sharding.shard_documents(frame([(1, "a"), (2, "b")], "doc_id long, text string")).collect(), 40)


def test_one_more_shard_moves_few(frame):
    docs = frame([(i, str(i)) for i in range(4000)], "doc_id long, text string")
    before = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 10).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 11).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.5 * len(before)
