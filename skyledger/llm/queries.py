"""Registered queries of the pipeline operators, each over its whole table with production parameters."""

from __future__ import annotations

from skyledger.llm import anchors, bpe, bytenet, forest, html, lines, phrases, quality, sharding, simhash, tiling, warc, whitening
from skyledger.llm.common import table

#: Where the public vocabulary files lie, on the driver.
TOKENIZERS = "/opt/tokenizers"


def op1_html_text(spark, sf_dir):
    return html.page_rows(table(spark, sf_dir, "pages"))


def op2_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), bpe.load_automaton(f"{TOKENIZERS}/word_bpe_49k.json"))


def op3_warc_index(spark, sf_dir):
    return warc.capture_rows(table(spark, sf_dir, "pages"))


def op4_ring_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark, sf_dir):
    return simhash.component_rows(table(spark, sf_dir, "documents"))


def op7_forest(spark, sf_dir):
    return forest.hundredth_queries(table(spark, sf_dir, "embeddings"))


def op8_line_runs(spark, sf_dir):
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op9_tiling(spark, sf_dir):
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_anchor_dedup(spark, sf_dir):
    return anchors.dedup_digests(table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_bytenet(spark, sf_dir):
    return bytenet.language_rows(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text, op2_bpe, op3_warc_index, op4_ring_shards, op5_quality, op6_simhash, op7_forest,
        op8_line_runs, op9_tiling, op10_anchor_dedup, op11_whitening, op12_collocations, op13_bytenet,
    )
}
ORACLES = {"op3_warc_index": warc.CAPTURE_SQL, "op8_line_runs": lines.LINE_SQL, "op12_collocations": phrases.COLLOCATION_SQL}
