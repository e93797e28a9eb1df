"""Traffic-feed documents and the wake dimension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAKE_CATEGORIES = ("L", "M", "H", "J")
ENTRY_SCHEMA = "doc_id string, snapshot_ts timestamp, pos int, entry variant"


def read_feed_documents(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per landed file: ``doc_id`` (its path) and the whole text ``value``."""
    if streaming:
        docs = spark.readStream.format("text").option("wholetext", True).load(path)
    else:
        docs = spark.read.text(path, wholetext=True)
    return docs.select(F.col("_metadata.file_path").alias("doc_id"), "value")


def feed_entries(docs: DataFrame) -> DataFrame:
    """Explode documents ``(doc_id, value)`` into one row per element of ``pilots``.

    A document that does not parse, has no object at its root or no list under
    ``pilots`` contributes no rows; a bad element never affects its neighbours.
    """
    parsed = docs.select("doc_id", F.try_parse_json("value").alias("v"))
    return parsed.select(
        "doc_id",
        F.try_variant_get("v", "$.general.update_timestamp", "string").try_cast("timestamp").alias("snapshot_ts"),
        F.posexplode(F.try_variant_get("v", "$.pilots", "array<variant>")).alias("pos", "entry"),
    )


def bad_documents(docs: DataFrame) -> DataFrame:
    """Documents that are not a JSON object, with the reason."""
    v = F.try_parse_json("value")
    return (
        docs.select("doc_id", v.alias("v"))
        .withColumn(
            "reason",
            F.when(F.col("v").isNull(), "not valid JSON").when(
                ~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "root is not an object"
            ),
        )
        .where(F.col("reason").isNotNull())
        .select("doc_id", "reason")
    )


def read_feed(
    spark: SparkSession, path: str, streaming: bool = False, delay: str = "10 minutes"
) -> tuple[DataFrame, DataFrame]:
    """Snapshot files -> (one row per feed entry, rejected documents).

    As a stream, entries carry a watermark on ``snapshot_ts``, ``delay`` behind the
    newest ``update_timestamp``; the two frames are then streams of their own, each
    with its own read. ``ingest_feed`` serves both from one.
    """
    docs = read_feed_documents(spark, path, streaming)
    entries = feed_entries(docs)
    return (entries.withWatermark("snapshot_ts", delay) if streaming else entries), bad_documents(docs)


def ingest_feed(spark: SparkSession, path: str, target: str, files_per_batch: int = 1000):
    """A stream query over landed files that reads each once and fills two tables below ``target``.

    ``entries`` and ``rejected`` get one folder per batch, written over if the batch
    is repeated, so every file counts once. Documents are held for the two writes of their
    batch only.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), "value")

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows = feed_entries(batch).withColumn("entry", F.to_json("entry"))
        rows.write.mode("overwrite").parquet(f"{target}/entries/batch={batch_id}")
        bad_documents(batch).write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(land).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()


def ingested_entries(spark: SparkSession, target: str, streaming: bool = False, delay: str = "10 minutes") -> DataFrame:
    """What ``ingest_feed`` landed, as ``feed_entries`` gives it; a stream has a watermark on the event time."""
    schema = "doc_id string, snapshot_ts timestamp, pos int, entry string, batch bigint"
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schema).parquet(f"{target}/entries").withColumn("entry", F.parse_json("entry")).drop("batch")
    return rows.withWatermark("snapshot_ts", delay) if streaming else rows


def rejected_documents(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/rejected").drop("batch")


def wake_dimension(docs: DataFrame) -> DataFrame:
    """``(type_code, wake)`` from documents with a ``types`` object."""
    entries = docs.select(F.from_json("value", "struct<types:map<string,string>>").alias("d")).select(
        F.posexplode(F.map_entries("d.types")).alias("pos", "e")
    )
    return (
        entries.where(F.col("e.value").isin(*WAKE_CATEGORIES))
        .select(F.upper(F.trim("e.key")).alias("type_code"), F.col("e.value").alias("wake"), "pos")
        .groupBy("type_code")
        .agg(F.max_by("wake", "pos").alias("wake"))
    )


def read_wake(spark: SparkSession, path: str) -> DataFrame:
    """The wake dimension; a missing or unreadable file gives an empty one."""
    try:
        return wake_dimension(spark.read.text(path, wholetext=True))
    except AnalysisException:
        return spark.createDataFrame([], "type_code string, wake string")
