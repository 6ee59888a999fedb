"""The catalogue as streams: sources are directories of parquet files, sinks are parquet or foreachBatch."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from mediaframe.operators.dedup import domain_revision
from mediaframe.operators.fence import current
from mediaframe.plans.lineage import cut_lineage
from mediaframe.sources.buckets import BucketStore, Staged


def latest_revisions(base: DataFrame, batch: DataFrame) -> DataFrame:
    """base with a batch folded in: of each media the highest revision, so a late older one loses."""
    w = Window.partitionBy("media_id").orderBy(F.col("content_revision").desc(), F.col("access_epoch").desc())
    return base.unionByName(batch).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps with its checkpoint; one begun with a fresh checkpoint is another stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def stream_ingest(stream: DataFrame, store: BucketStore, checkpoint: str, trigger: dict | None = None):
    """Keeps a stored catalogue up to date; each micro-batch rewrites the buckets that it touches.

    A batch that runs again after its commit is known by its stream and number and changes nothing; one that failed
    before leaves a folder behind that nobody reads. A stream with a fresh checkpoint numbers its
    batches anew and is another writer, so its rows are folded in, where the highest revision wins.
    """
    def fold(batch: DataFrame, number: int) -> None:
        store.fold(batch, latest_revisions, stream_id(batch.sparkSession, checkpoint), number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bursts(stream: DataFrame, at: str = "ts", gap: str = "250 milliseconds", delay: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bursts of events no further apart than the gap: (keys, started, ended, events); `ended` is the gap after the last event.

    A stream needs a key, such as the volume, whose events form bursts of their own. A table does not: its
    instants are dealt by range, bursts are found inside each part, and those at a part's edges are joined
    over the small frame of edges. Rows without an instant count nowhere.
    """
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if not stream.isStreaming:
        return _bursts_of_table(timed.where("_at is not null"), gap, keys)
    s = timed.withWatermark("_at", delay).groupBy(*keys, F.session_window("_at", gap).alias("s")).agg(F.count("*").alias("events"))
    return s.select(*keys, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events")


def _bursts_of_table(timed: DataFrame, gap: str, keys: tuple[str, ...]) -> DataFrame:
    reach = F.expr(f"INTERVAL {gap}")
    instants = timed.groupBy(*keys, "_at").agg(F.count("*").alias("n"))
    dealt = cut_lineage(instants.repartitionByRange(*keys, "_at").withColumn("_part", F.spark_partition_id()))

    def joined(rows: DataFrame, of: list[str], first: str, last: str) -> DataFrame:
        """Rows with `_b`, the number of the run that each is in: runs begin where more than the gap lies between."""
        order = Window.partitionBy(*of).orderBy(first)
        before = F.lag(last).over(order)
        return rows.withColumn("_new", (before.isNull() | (before + reach < F.col(first))).cast("int")).withColumn("_b", F.sum("_new").over(order))

    inside = joined(dealt, ["_part", *keys], "_at", "_at").groupBy("_part", *keys, "_b").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.sum("n").alias("events"))
    ends = Window.partitionBy("_part", *keys)
    marked = cut_lineage(inside.withColumn("edge", (F.col("_b") == 1) | (F.col("_b") == F.max("_b").over(ends))).select(*keys, "first", "last", "events", "edge"))
    edges = joined(marked.where("edge"), list(keys), "first", "last").groupBy(*keys, "_b").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
    whole = edges.drop("_b").unionByName(marked.where("not edge").drop("edge"))
    return whole.select(*keys, F.col("first").alias("started"), (F.col("last") + reach).alias("ended"), "events")


def live_periods(stream: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts by UTC day; rows late within the delay still count."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_at", delay)
    w = timed.groupBy(F.window("_at", "1 day").alias("w")).agg(F.count("*").alias("items"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day_key"), "items")


def stream_dedup(stream: DataFrame, key: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else timed.dropDuplicates([key])


class _Epochs(StatefulProcessor):
    """Holds a media's rows until the watermark has passed them, then takes them in the order of `n`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "n long, available boolean, at long")
        self.last = handle.getValueState("last", "epoch long, available boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, times = timerValues.getCurrentWatermarkInMs(), set()
        for batch in rows:
            at = batch["at_ms"].astype("int64")
            self.held.appendList([(int(n), a == "AVAILABLE", int(t)) for n, a, t in zip(batch["n"], batch["availability"], at)])
            times |= {int(t) for t in at}
        for t in times:
            self.handle.registerTimer(max(t, now + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        held = sorted(self.held.get())
        epoch, available = self.last.get() if self.last.exists() else (1, True)
        for n, is_available, at in held:
            if at <= now:
                epoch += int(is_available and not available)
                available = is_available
                out.append((key[0], n, epoch))
        if out:
            self.last.update((epoch, available))
            left = [r for r in held if r[2] > now]
            if left:
                self.held.put(left)
            else:
                self.held.clear()
            yield pd.DataFrame(out, columns=["media_id", "n", "access_epoch"])

    def close(self) -> None:
        pass


def stream_epochs(stream: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """(media_id, n, access_epoch): each return to availability opens a new epoch; `n` orders a media's rows, as `at` does.

    Rows are held until the watermark, which follows the latest `at` by `delay`, has passed them, and only then
    take their epochs: a row that comes late, but within the delay, gets the epoch that the batch twin gives.
    Later ones are dropped. The session keeps the state of such streams in RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    moment = F.col(at).cast("timestamp")
    timed = stream.select("media_id", "n", "availability", moment.alias("at"), F.unix_millis(moment).alias("at_ms")).withWatermark("at", delay)
    return timed.groupBy("media_id").transformWithStateInPandas(_Epochs(), StructType.fromDDL("media_id string, n long, access_epoch long"), "Append", "EventTime")


def epochs_batch(rows: DataFrame) -> DataFrame:
    """What stream_epochs gives, from all rows at once."""
    w = Window.partitionBy("media_id").orderBy("n")
    back = (F.col("availability") == "AVAILABLE") & (F.lag("availability").over(w) != "AVAILABLE")
    return rows.withColumn("_b", F.coalesce(back, F.lit(False)).cast("long")).withColumn("access_epoch", 1 + F.sum("_b").over(w)).select("media_id", "n", "access_epoch")


DAY_MS = 86_400_000


def _retention(days: int):
    def expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, trashed = state.get
            state.remove()
            if trashed:
                yield pd.DataFrame({"media_id": [key[0]], "trashed_ms": [at]})
            return
        rows = pd.concat(list(batches))
        rows = rows.assign(other=rows["availability"] != "TRASHED").sort_values(["at_ms", "other"])
        at, trashed = int(rows["at_ms"].iloc[-1]), not rows["other"].iloc[-1]
        if state.exists and state.get[0] > at:  # all of it older than what is known
            at, trashed = state.get
        state.update((at, bool(trashed)))
        # What is not trashed is remembered until the watermark shuts older rows out.
        state.setTimeoutTimestamp(max(at + (days * DAY_MS if trashed else 1), state.getCurrentWatermarkMs() + 1))

    return expire


def stream_retention(stream: DataFrame, at: str = "ts", days: int = 30, delay: str = "1 hour") -> DataFrame:
    """(media_id, trashed_ms) of media whose trashing the watermark has outlived by the retention.

    A media's latest row counts, in whatever order rows come; of rows of one instant a restore.
    """
    moment = F.col(at).cast("timestamp")
    timed = stream.select("media_id", "availability", moment.alias("at"), F.unix_millis(moment).alias("at_ms")).withWatermark("at", delay)
    return timed.groupBy("media_id").applyInPandasWithState(_retention(days), "media_id string, trashed_ms long", "at long, trashed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def retention_batch(rows: DataFrame, now_ms: int | Column, at: str = "ts", days: int = 30) -> DataFrame:
    """What stream_retention gives once the watermark has reached `now_ms`, from all rows at once."""
    at_ms = F.unix_millis(F.col(at).cast("timestamp"))
    last = rows.groupBy("media_id").agg(F.max(F.struct(at_ms.alias("at"), (F.col("availability") != "TRASHED").alias("other"))).alias("m"))
    return last.where(~F.col("m.other") & (F.col("m.at") + days * DAY_MS < (F.lit(now_ms) if isinstance(now_ms, int) else now_ms))).select("media_id", F.col("m.at").alias("trashed_ms"))


def stream_publish(results: DataFrame, live: Callable[[], DataFrame], path: str, checkpoint: str):
    """Writes derived rows of a stream, as far as they still hold, under `path`/stream=id/batch=number.

    Each micro-batch asks `live` for the rows of its moment (such as `read_published`) and keeps to them: what was
    revised before the batch began is dropped with it. A batch that runs again writes its own folder anew.
    """
    def publish(batch: DataFrame, number: int) -> None:
        current(batch, live()).write.mode("overwrite").parquet(f"{path}/stream={stream_id(batch.sparkSession, checkpoint)}/batch={number}")

    return results.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_revision(stream: DataFrame, store: BucketStore, changes: str, columns: list[str], checkpoint: str):
    """Counts, for each micro-batch, the changes to the listed columns, under `changes`/stream=id/batch=number.

    Only the buckets that a batch touches are compared and rewritten. A batch that runs again before its
    commit writes its own count anew; after that it changes nothing.
    """
    def count(batch: DataFrame, number: int) -> None:
        fold_counting(batch, store, changes, columns, stream_id(batch.sparkSession, checkpoint), number)

    return stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_counting(batch: DataFrame, store: BucketStore, changes: str, columns: list[str], writer: str, number: int) -> bool:
    """Folds one batch of a stream into the store and notes how many rows it changed; False if it is in already."""
    def note(staged: Staged) -> None:
        domain_revision(staged.old, staged.new, store.key, columns).write.mode("overwrite").parquet(f"{changes}/stream={writer}/batch={number}")

    return store.fold(batch, latest_revisions, writer, number, note)
