"""A training corpus from `documents`, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next stage's documents. All but the last keep the columns of
documents:

1. quality: documents the classifier rejects (score below 0.3) go;
2. lines: later copies of repeated runs of lines are deleted from the texts; a document
   that loses all of them stays, with an empty text, for the next stage to group;
3. near_duplicates: one document of each component of near copies stays, that of the smallest id; near copies
   have a similarity of five-word shingles of 0.8 or more;
4. decontamination: documents that hold half of a benchmark item or more go;
5. tokens: ids of each text, their digest, and the digest of the text decoded from them.

NULL texts are scored, grouped and encoded as empty ones. Columns that documents has
besides its own pass through the first four stages. Rows that share an id are each
dealt with by their own text. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, jaccard, lines, quality, tiling
from skyledger.llm.common import free_name, shared_dir, table
from skyledger.llm.queries import TOKENIZERS

LEAST_SCORE = 0.3
LEAST_COVERAGE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return quality.score(docs, model, name=name).filter(F.col(name) >= LEAST_SCORE).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs, report=False).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, size=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "hits")
    found = tiling.tiled(docs, table(spark, sf_dir, "benchmark"), hits=name)
    leaks = F.exists(name, lambda h: h["covered"] / h["words"] >= LEAST_COVERAGE)
    return found.filter(~leaks).drop(name)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    automaton = bpe.load_automaton(f"{TOKENIZERS}/word_bpe_49k.json")
    return bpe.token_digests(docs, automaton, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The fitted classifier can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
