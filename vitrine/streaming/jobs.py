"""Incremental jobs. Each runs over what has arrived and stops (``availableNow``) unless told otherwise.

Positions live in the checkpoint: a restarted job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.operators.filters import validate_items
from vitrine.operators.throttle import fixed_window_throttle, window_state
from vitrine.sources.readers import CORRUPT
from vitrine.sources.sinks import STAGING_BUCKETS, upsert_staging

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Groups of keys whose daily uses are kept together.
QUOTA_BUCKETS = 256
NO_KEY = -1


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, glob: str | None = None, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has arrived, batch by batch."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Append results to a Parquet folder; the file sink writes every batch exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_ingest(spark: SparkSession, landing: str, schema: str, normalize: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, rejects: str | None = None, glob: str | None = None) -> None:
    """Normalize newly landed JSON lines into ``out``; unreadable lines go to ``rejects`` and stop nothing.

    A batch that runs again after a failure overwrites its own folder.
    """
    tagged = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = read_stream(spark, landing, "value string", glob, fmt="text")
    parsed = lines.filter(F.trim("value") != "").withColumn("v", F.from_json("value", tagged, options))

    def each(batch: DataFrame, batch_id: int) -> None:
        broken = F.col(f"v.{CORRUPT}").isNotNull()
        good = batch.filter(~broken).select("v.*").drop(CORRUPT)
        validate_items(normalize(good)).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/batch={batch_id}")
        if rejects:
            batch.filter(broken).select("value").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{rejects}/batch={batch_id}")

    run(parsed, checkpoint, each)


def stream_upsert(stream: DataFrame, table: str, checkpoint: str, buckets: int = STAGING_BUCKETS, newest: bool = False) -> None:
    """Upsert every batch into a staging table; repeating a batch changes nothing."""
    run(stream, checkpoint, lambda batch, _: upsert_staging(batch, table, buckets, newest))


def stream_dedupe(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row per key while repeats arrive within ``delay``; state older than that is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_daily_quota(stream: DataFrame, key: str, ts: str, cap: int, delay: str = "1 day") -> DataFrame:
    """Uses, and uses beyond the cap, per key and UTC day."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), F.col(key)).agg(F.count(F.lit(1)).alias("used"))
    return counted.select(
        key, F.to_date("window.start").alias("day"), "used", F.greatest(F.col("used") - cap, F.lit(0)).alias("refused")
    )


class DailyQuota(StatefulProcessor):
    """Per bucket of keys: the uses of each key on each UTC day that can still get events, and a timer that forgets the day.

    State is asked for by bucket and day, so the number of calls does not grow with keys or events.
    """

    DAY_MS = 86_400_000

    def __init__(self, cap: int, key_type: str):
        self.cap, self.key_type = cap, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day bigint", f"ids array<{self.key_type}>, n array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one bucket in one trigger, whose size maxFilesPerTrigger bounds
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["event_ms", "event_tie"])
        pdf["day"] = pdf["event_ms"] // self.DAY_MS
        pdf["used"] = pdf.groupby(["event_key", "day"], dropna=False, sort=False).cumcount() + 1
        for day, mine in pdf.groupby("day"):
            day = int(day)
            # rows without a key have a bucket of their own
            ids = [None] * len(mine) if key[0] == NO_KEY else mine["event_key"].tolist()
            used = mine["used"].to_numpy()
            known = self.used.containsKey((day,))
            before = dict(zip(*self.used.getValue((day,)))) if known else {}
            if before:
                used = used + [before.get(k, 0) for k in ids]
                pdf.loc[mine.index, "used"] = used
            # a key's rows rise, so its last one stays
            totals = before | dict(zip(ids, used.tolist()))
            self.used.updateValue((day,), (list(totals), list(totals.values())))
            if not known:
                self.handle.registerTimer((day + 1) * self.DAY_MS)
        yield pd.DataFrame(
            {"key": pdf["event_key"], "tie": pdf["event_tie"], "day_ms": pdf["day"] * self.DAY_MS, "used": pdf["used"],
             "allowed": pdf["used"] <= self.cap}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = (expiredTimerInfo.getExpiryTimeInMs() // self.DAY_MS - 1,)
        if self.used.containsKey(day):
            self.used.removeKey(day)
        return iter([])

    def close(self) -> None:
        pass


def stream_quota_verdicts(stream: DataFrame, key: str, ts: str, tie: str, cap: int, delay: str = "1 day", buckets: int = QUOTA_BUCKETS) -> DataFrame:
    """A verdict for every event as it arrives: key, tie, day, used (uses of the UTC day so far) and allowed.

    Append mode: an event is judged once, by the events of its day that came before it; within a trigger they are taken by
    time and tie. Events up to ``delay`` late count into their own day, later ones are dropped by the watermark and get no
    verdict. The state of a day goes when the watermark has passed its end. Needs the RocksDB state store. Keys are dealt over
    ``buckets``, which is fixed for a checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    key_type = stream.schema[key].dataType.simpleString()
    tie_type = stream.schema[tie].dataType.simpleString()
    at = F.col(ts).cast("timestamp")
    ms = F.floor(F.unix_micros(at) / 1000).cast("bigint")
    bucket = F.when(F.col(key).isNull(), F.lit(NO_KEY)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    timed = stream.select(
        bucket.alias("bucket"), F.col(key).alias("event_key"), at.alias("event_at"), ms.alias("event_ms"), F.col(tie).alias("event_tie")
    )
    judged = timed.withWatermark("event_at", delay).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=DailyQuota(cap, key_type),
        outputStructType=f"key {key_type}, tie {tie_type}, day_ms bigint, used bigint, allowed boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("day_ms") / DailyQuota.DAY_MS).cast("int"))
    return judged.select("key", "tie", day.alias("day"), "used", "allowed")


class WindowThrottle(StatefulProcessor):
    """Per key: end of the running window and uses in it."""

    def __init__(self, ts: str, tie: str, max_uses: int, window_ms: int):
        self.ts, self.tie, self.max_uses, self.window_ms = ts, tie, max_uses, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "end bigint, used bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one key in one trigger, whose size maxFilesPerTrigger bounds
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.tie])
        end, used = self.window.get() if self.window.exists() else (None, 0)
        starts, counts = [], []
        for now in pdf[self.ts]:
            if end is None or end < now:
                end, used = int(now) + self.window_ms, 1
            else:
                used += 1
            starts.append(end - self.window_ms)
            counts.append(used)
        self.window.update((end, used))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(end + 1)
        yield pd.DataFrame(
            {"key": key[0], "tie": pdf[self.tie].to_numpy(), "window_start": starts, "used": counts, "allowed": [c <= self.max_uses for c in counts]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a window that has run out means the same as no window
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_throttle(stream: DataFrame, key: str, ts: str, tie: str, max_uses: int = 12, window_ms: int = 600_000, delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``fixed_window_throttle`` with keyed state: key, tie, window_start, used, allowed.

    For keys whose rows of one trigger fit a task; ``stream_throttle_batches`` has no such limit.
    Needs the RocksDB state store. Events that arrive behind the watermark are judged by the
    state kept, like any late event. The state of a key goes when its window has run out.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    key_type = stream.schema[key].dataType.simpleString()
    tie_type = stream.schema[tie].dataType.simpleString()
    # names without a leading underscore, which row tuples on the Python side would rename
    ms = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("bigint")
    timed = stream.select(F.col(key), F.col(ts).cast("timestamp").alias("event_at"), ms.alias("event_ms"), F.col(tie).alias("event_tie"))
    return timed.withWatermark("event_at", delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=WindowThrottle("event_ms", "event_tie", max_uses, window_ms),
        outputStructType=f"key {key_type}, tie {tie_type}, window_start bigint, used bigint, allowed boolean",
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_throttle_batches(
    stream: DataFrame, key: str, ts: str, tie: str, path: str, checkpoint: str, max_uses: int = 12, window_ms: int = 600_000
) -> None:
    """Throttle batch by batch with the split plan, so that a hot key spreads over the cluster.

    Judged events go to ``path/judged``, the windows that run after each batch to ``path/state``.
    A batch that runs again reads the state before it and overwrites its own folders.
    """

    def replace(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(name)
        return df.sparkSession.read.schema(df.schema).parquet(name)

    def each(batch: DataFrame, batch_id: int) -> None:
        state = batch.sparkSession.read.parquet(f"{path}/state/batch={batch_id - 1}") if batch_id > 0 else None
        judged = replace(fixed_window_throttle(batch, key, ts, tie, max_uses, window_ms, state), f"{path}/judged/batch={batch_id}")
        replace(window_state(judged, key, state), f"{path}/state/batch={batch_id}")

    run(stream, checkpoint, each)


def harvest_window(ts: Column, peak_start: str, peak_end: str) -> Column:
    """Name of the harvest window of a record: hours inside the peak, one window before and one after."""
    at = ts.cast("timestamp")
    return (
        F.when(at < F.lit(peak_start).cast("timestamp"), F.lit("before"))
        .when(at >= F.lit(peak_end).cast("timestamp"), F.lit("after"))
        .otherwise(F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd'T'HH"))
    )


def windowed_harvest(records: DataFrame, ts: str, peak_start: str, peak_end: str, path: str | None = None) -> DataFrame:
    """Split records by datestamp window; with ``path`` each window becomes a folder of its own."""
    split = records.withColumn("harvest_window", harvest_window(F.col(ts), peak_start, peak_end))
    if path is None:
        return split
    # a window with most of the records, even at one single time, is written by many tasks
    split.repartitionByRange("harvest_window", ts, F.xxhash64(*records.columns)).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("harvest_window").parquet(path)
    return records.sparkSession.read.parquet(path)
