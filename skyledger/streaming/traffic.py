"""Streaming twins of the feed operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; it also keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def with_event_time(df: DataFrame, delay: str = "10 minutes", column: str = "snapshot_ts") -> DataFrame:
    """Event time for a feed stream: rows later than ``delay`` may be dropped."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def dedupe_snapshots(df: DataFrame) -> DataFrame:
    """Drop entries of a snapshot that arrived before, with state bounded by the watermark."""
    return df.dropDuplicatesWithinWatermark(["snapshot_ts", "pos"])


def windowed_counts(df: DataFrame, width: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Aircraft per time window and wake category; the same plan for batch and stream."""
    window = F.window("snapshot_ts", width, slide) if slide else F.window("snapshot_ts", width)
    return (
        df.groupBy(window.alias("w"), "wake")
        .agg(F.count("*").alias("n_aircraft"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "wake", "n_aircraft")
    )


def presence_processor(period_s: float, grace_s: float) -> StatefulProcessor:
    """Reports a callsign as lost when the snapshot after its last one has come and gone.

    A key is a bucket of callsigns, which share one state value, their names and last
    times, and one timer, that of the earliest of them. Built as a local class, so that
    it travels to workers that do not have this package.
    """

    period_ms, grace_ms = int(period_s * 1000), int(grace_s * 1000)

    class Presence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last_seen", "callsigns array<string>, ms array<bigint>")
            self.timer = handle.getValueState("timer", "at bigint")

        def known(self) -> pd.DataFrame:
            callsigns, ms = self.last.get() if self.last.exists() else ([], [])
            return pd.DataFrame({"callsign": pd.Series(list(callsigns), dtype=object), "ms": pd.Series(list(ms), dtype="int64")})

        def keep(self, last: pd.DataFrame) -> None:
            due = int(last["ms"].min()) + period_ms + grace_ms if len(last) else None
            set_ = self.timer.get()[0] if self.timer.exists() else None
            if set_ != due:
                if set_ is not None:
                    self.handle.deleteTimer(set_)
                    self.timer.clear()
                if due is not None:
                    self.handle.registerTimer(due)
                    self.timer.update((due,))
            if len(last):
                self.last.update((last["callsign"].tolist(), last["ms"].tolist()))
            else:
                self.last.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = self.known()
            seen = pd.concat([pdf[["callsign", "ms"]].drop_duplicates() for pdf in rows])
            # snapshot times, not rows; none that the last known one has passed
            after = seen.merge(known.rename(columns={"ms": "since"}), on="callsign", how="left")
            new = after.loc[~(after["ms"] <= after["since"]), ["callsign", "ms"]]
            chain = pd.concat([known, new]).astype({"ms": "int64"}).drop_duplicates().sort_values("ms", kind="stable")
            following = chain.groupby("callsign", dropna=False)["ms"].shift(-1)
            self.keep(chain[following.isna()])
            gaps = chain[following - chain["ms"] > period_ms]
            return iter([gaps] if len(gaps) else ())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            known = self.known()
            self.timer.clear()  # it is gone with its expiry
            over = known["ms"] + period_ms + grace_ms <= timerValues.getCurrentWatermarkInMs()
            self.keep(known[~over])
            return iter([known[over]])

        def close(self) -> None:
            pass

    return Presence()


def presence_stream(pilots: DataFrame, period_s: float, grace_s: float, buckets: int = 1024) -> DataFrame:
    """Stream of (callsign, last_seen, snapshot_ts = first snapshot it missed).

    ``pilots`` needs a watermark on ``snapshot_ts``. The next snapshot is taken
    to be due ``period_s`` after the last one; ``grace_s`` allows for delay. Times count
    to the millisecond; rows without one are left out. Callsigns share timers and
    state in ``buckets``; more suit more callsigns than some 100 million.
    """
    use_rocksdb(pilots.sparkSession)
    rows = pilots.where("snapshot_ts IS NOT NULL").select(
        F.pmod(F.xxhash64("callsign"), F.lit(buckets)).alias("bucket"), "callsign", F.unix_millis("snapshot_ts").alias("ms"), "snapshot_ts"
    )
    found = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=presence_processor(period_s, grace_s),
        outputStructType="callsign string, ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    missed = F.timestamp_millis(F.col("ms") + int(period_s * 1000))
    return found.select("callsign", F.timestamp_millis("ms").alias("last_seen"), missed.alias("snapshot_ts"))


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the complete versions under ``target``, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def _drop_version(spark: SparkSession, target: str, number: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/version={number}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_current(target: str):
    """``foreachBatch`` function that keeps the newest snapshot at ``target``.

    A batch whose newest snapshot is no newer than the stored one changes nothing,
    unless it repeats the batch that stored it. Otherwise its rows become the next
    version; of the earlier ones only the last stays, for readers that are still at it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max("snapshot_ts")).first()[0]
        earlier = [v for v in _versions(spark, target) if v < batch_id]
        if newest is None:
            return
        if earlier:
            held = spark.read.parquet(f"{target}/version={earlier[-1]}").agg(F.max("snapshot_ts")).first()[0]
            if held is not None and held >= newest:
                return
        batch.where(F.col("snapshot_ts") == F.lit(newest)).write.mode("overwrite").parquet(f"{target}/version={batch_id}")
        for number in earlier[:-1]:
            _drop_version(spark, target, number)

    return write


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{target}/version={_versions(spark, target)[-1]}")
