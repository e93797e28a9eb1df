import random

from skyledger.llm import lines


def by_hand(rows, min_lines=2, line_words=5):
    """Every repeated run of every length, straight from the definition."""
    seqs = []
    for order, (d, t) in enumerate(rows):
        whole = [] if t is None else t.split("\n")
        seqs.append((d is None, d or 0, order, whole, [i for i, x in enumerate(whole) if x.strip(" \t\n\v\f\r")]))
    first = {}
    out = {}
    for _, _, order, whole, full in sorted(seqs, key=lambda s: s[:3]):
        gone = set()
        for a in range(len(full)):
            for n in range(1, len(full) - a + 1):
                run = tuple(whole[i] for i in full[a : a + n])
                if run in first:
                    if n >= min_lines or (n == 1 and len(run[0].split()) >= line_words):
                        gone.update(full[a : a + n])
                else:
                    first[run] = True
        out[order] = (len(gone), None if rows[order][1] is None else "\n".join(x for i, x in enumerate(whole) if i not in gone))
    return [out[i] for i in range(len(rows))]


def test_random_documents_equal_brute_force(spark):
    rnd = random.Random(3)
    pool = ["a", "b c", "one two three four five", "", " ", "d", "six of the best lines here"]
    rows = [(i, "\n".join(rnd.choice(pool + [f"own {i} {k}" for k in range(6)]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for m, w in ((2, 5), (1, 1), (3, 100), (5, 5)):
        got = {r.doc_id: (sum(x.n for x in r.removed), r.text) for r in lines.dedup_lines(docs, min_lines=m, line_words=w).collect()}
        assert got == {d: x for (d, _), x in zip(rows, by_hand(rows, m, w))}


def test_odd_rows_keep_their_columns(spark):
    run = "first line\nsecond line\nthird"
    rows = [(5, run, "u", 1), (5, run, "u", 1), (None, run + "\nlast", "v", 2), (3, None, None, 3), (4, "", "w", 4), (2, "x\n" * 60, "x", 5), (9, "third", "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_lines int").coalesce(1)
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "row", "n_lines", "removed"]
    want = by_hand([r[:2] for r in rows])
    got = sorted([(str(r.doc_id), r.text, r.n_lines, sum(x.n for x in r.removed)) for r in out.collect()], key=str)
    counts = [0 if r[1] is None else r[1].count("\n") + 1 for r in rows]
    assert got == sorted([(str(r[0]), x[1], n, x[0]) for r, x, n in zip(rows, want, counts)], key=str)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {d: x[1] for (d, _), x in zip(rows, by_hand(rows))}
