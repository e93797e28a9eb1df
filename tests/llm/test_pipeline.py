import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from skyledger.llm import quality, tiling
from test_jaccard import plain_set
from test_lines import by_hand
from test_simhash import union
from test_tiling import plain_tiles

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_run(rows, items, model):
    """rows (doc_id, text, lang, source), in order of reading; all stages, one document at a time."""
    rows = [r for r in rows if model.scores([r[1]])[0] >= corpus_pipeline.LEAST_SCORE]
    rows = [(r[0], x[1], *r[2:]) for r, x in zip(rows, by_hand([r[:2] for r in rows]))]
    sets = [plain_set(r[1]) for r in rows]
    root = union(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])
    best = {}
    for i, r in enumerate(rows):
        best[root[i]] = min(best.get(root[i], (True, 0, i)), (r[0] is None, r[0] or 0, i)) if root[i] in best else (r[0] is None, r[0] or 0, i)
    rows = [rows[b[2]] for b in best.values()]
    clean = []
    for r in rows:
        doc = tiling.words_of(r[1])
        seen = set(doc)
        leak = False
        for _, text in items:
            item = tiling.words_of(text)
            if len(item) >= 5 and len(seen & set(item)) * 2 >= len(set(item)):
                leak |= sum(k for _, _, k in plain_tiles(item, doc, 5)) >= 0.5 * len(item)
        if not leak:
            clean.append(r)
    out = []
    for d, text, lang, source in clean:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        out.append((d, lang, source, tuple(ids), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted([(r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()], key=str)


def test_given_tables_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.orderBy("doc_id").collect()]
    want = plain_run(rows, [(r.item_id, r.text) for r in bench.collect()], quality.fit_quality(docs, labels))
    got = as_rows(corpus_pipeline.run(spark, d))
    assert got == want and 0 < len(got) < len(rows)


def test_stages_keep_the_columns_and_survive_odd_rows(spark, tmp_path):
    run = "first line of five words here\nsecond line of five words\n"
    item = "one two three four five six seven eight nine ten"
    rows = [(1, run + "own", "en", "a", 1, "x"), (1, run + "own", "en", "a", 1, "x"), (None, None, None, None, None, None), (3, "", "en", "b", 0, "y"), (4, "filler words " + item + " and more", "de", "c", 9, "z"), (5, "long " * 50_000, "en", "d", 0, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits string").coalesce(1)
    docs = docs.selectExpr("*", "'a' AS score", "1 AS n_lines", "2 AS removed", "3 AS fp", "4 AS row", "5 AS `all`")
    tables = {"documents": docs, "labels": spark.createDataFrame([(1, 1)], "doc_id long, quality int"), "benchmark": spark.createDataFrame([(7, item)], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    want = plain_run([r[:4] for r in rows], [(7, item)], quality.Model({}, 0.0, 1.0, 9.0))
    assert as_rows(corpus_pipeline.run(spark, str(tmp_path))) == want
    assert sorted(r[0] for r in want) == [1, 1, 5]  # the emptied copy of 1 stands for all empty texts
    for name, df in tables.items():
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
