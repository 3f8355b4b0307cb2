"""Streaming forms of the log operators; each gives the batch form's answer once all input is in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ledgerline.functions.subjects import matches
from ledgerline.functions.summaries import WINDOWS
from ledgerline.operators.folds import scan_marks
from ledgerline.operators.terminal import PROFILES, Screen

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """The event table as a stream; files per trigger bound a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)


def as_records(events: DataFrame) -> DataFrame:
    subject = F.concat(F.lit("/f/"), F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta"), F.lit("/pub/n-"), (F.col("user_id") % 7).cast("string"), F.lit("/s-"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    return events.select(F.col("event_id").alias("offset"), F.col("user_id").alias("producer_id"), subject.alias("subject"), F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("long").alias("v"))


def subscribe(records: DataFrame, filter_: str, start: int = 0) -> DataFrame:
    """History, then what arrives: matching records from an offset on."""
    return records.where((F.col("offset") >= start) & matches(F.col("subject"), filter_))


def tumbling(records: DataFrame, length: str, delay: str | None = None) -> DataFrame:
    """Counts and sums by aligned window; weeks start on Monday. With ``delay`` late rows are dropped and state is freed."""
    size, offset = WINDOWS[length]
    rows = records.withWatermark("at", delay) if delay else records
    return rows.groupBy(F.window("at", f"{size} milliseconds", f"{size} milliseconds", f"{offset % size} milliseconds")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def bursts(records: DataFrame, gap: str, delay: str) -> DataFrame:
    """Activity of a producer until it pauses."""
    return records.withWatermark("at", delay).groupBy(F.session_window("at", gap), "producer_id").agg(F.count(F.lit(1)).alias("n"))


class _Newest(StatefulProcessor):
    """The newest record of a subject; emits when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", StructType([StructField("offset", LongType()), StructField("body", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        before = best
        for batch in rows:
            row = batch.loc[batch["offset"].idxmax()]
            if best is None or row["offset"] > best[0]:
                best = (int(row["offset"]), row["body"])
        if best != before:
            self.state.update(best)
            yield pd.DataFrame({"subject": [key[0]], "offset": [best[0]], "body": [best[1]]})

    def close(self) -> None:
        pass


def signals(records: DataFrame) -> DataFrame:
    """The current value of each subject, conflated: only the newest of a micro-batch is told."""
    return records.groupBy("subject").transformWithStateInPandas(_Newest(), outputStructType="subject string, offset long, body string", outputMode="Update", timeMode="None")


class _Classifier(StatefulProcessor):
    """A session's marks as they come, and once it has been idle where its screen came to rest; see ``classify``."""

    def __init__(self, idle_ms: int, prompts: list[str], cols: int, rows: int):
        self.idle_ms, self.prompts, self.cols, self.rows = idle_ms, prompts, cols, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", StructType([StructField("carry", StringType()), StructField("marked", BooleanType()), StructField("screen", StringType()), StructField("hash", StringType()), StructField("changed", LongType()), StructField("last_ms", LongType()), StructField("told", BooleanType())]))

    def _load(self) -> tuple:
        carry, marked, screen, *rest = self.state.get() if self.state.exists() else ("", False, None, None, -1, None, True)
        return carry, marked, Screen.load(screen) if screen else Screen(self.cols, self.rows), *rest

    def _settled(self, session: int, screen: Screen, changed: int, marked: bool) -> list[tuple]:
        last = next((t for t in reversed(screen.text()) if t), "")
        prompt = not marked and any(last.endswith(m) for m in self.prompts)
        return [(session, changed, "Quiesced", None), *([(session, changed, "PromptReady", None)] if prompt else [])]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carry, marked, screen, hash_, changed, last_ms, told = self._load()
        batch, out = pd.concat(list(rows)).sort_values("offset"), []
        for r in batch.itertuples(index=False):
            if not told and r.at_ms - last_ms >= self.idle_ms:  # the timer would have rung between two records of one micro-batch
                out += self._settled(key[0], screen, changed, marked)
            last_ms, told = int(r.at_ms) if last_ms is None else max(last_ms, int(r.at_ms)), False
            if r.kind == "Out":
                found, carry = scan_marks(carry, r.text)
                marked = marked or bool(found)
                out += [(key[0], r.offset, kind, exit_) for kind, exit_ in found]
            screen.apply(r)
            if screen.hash() != hash_:
                hash_, changed = screen.hash(), int(r.offset)
        self.state.update((carry, marked, screen.dump(), hash_, changed, last_ms, told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(last_ms + self.idle_ms)
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        carry, marked, screen, hash_, changed, last_ms, told = self._load()
        out = [] if told else self._settled(key[0], screen, changed, marked)
        self.state.update((carry, marked, screen.dump(), hash_, changed, last_ms, True))
        yield _events(out)

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "offset", "kind", "exit"]).astype({"exit": "Int32"})


def classify(records: DataFrame, idle_ms: int, profile: str = "common", delay: str = "0 seconds", cols: int = 80, rows: int = 24) -> DataFrame:
    """(session, offset, kind, exit) of records session, offset, at (a timestamp), kind, text, cols, rows.

    Shell marks as they end, over records' borders; when a session has been idle for ``idle_ms`` by the watermark: Quiesced at the record
    that last changed its screen and, if no mark ever came, PromptReady where the last line ends like a prompt. A run of idleness is told once,
    however the records fall into micro-batches.
    """
    timed = records.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    processor = _Classifier(idle_ms, PROFILES[profile], cols, rows)
    return timed.groupBy("session").transformWithStateInPandas(processor, outputStructType="session long, offset long, kind string, exit int", outputMode="Append", timeMode="EventTime")


class _Will(StatefulProcessor):
    """The last record of a session, and a timer that ends it; see ``wills``."""

    def __init__(self, keepalive_ms: int):
        self.keepalive_ms = keepalive_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", StructType([StructField("at_ms", LongType()), StructField("offset", LongType()), StructField("over", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at_ms, offset, over = self.state.get() if self.state.exists() else (None, None, True)
        out = []
        for at, place in sorted((int(r.at_ms), int(r.offset)) for batch in rows for r in batch.itertuples(index=False)):
            if not over and at - at_ms >= self.keepalive_ms:  # it ended between two records of one micro-batch
                out.append((key[0], offset, at_ms + self.keepalive_ms))
            at_ms, offset, over = at if at_ms is None else max(at, at_ms), place, False
        self.state.update((at_ms, offset, False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(at_ms + self.keepalive_ms)
        yield pd.DataFrame(out, columns=["session", "offset", "fired_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_ms, offset, over = self.state.get()
        self.state.update((at_ms, offset, True))
        yield pd.DataFrame([] if over else [(key[0], offset, at_ms + self.keepalive_ms)], columns=["session", "offset", "fired_ms"])

    def close(self) -> None:
        pass


def wills(records: DataFrame, keepalive_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(session, offset, fired_ms) of records session, offset, at: a session that says nothing for so long has ended, and its will
    is published once, after its last record; one that speaks again is a new session."""
    timed = records.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    return timed.groupBy("session").transformWithStateInPandas(_Will(keepalive_ms), outputStructType="session long, offset long, fired_ms long", outputMode="Append", timeMode="EventTime")


def fan_out(records: DataFrame, subscribers: dict[str, tuple[str, int]], sink: str, checkpoints: str) -> dict[str, StreamingQuery]:
    """One query for each subscriber (name: filter, first offset), each with a cursor of its own: one that stops or lags holds no other up."""
    return {
        name: subscribe(records, filter_, start).writeStream.queryName(name).option("checkpointLocation", f"{checkpoints}/{name}").format("parquet").trigger(availableNow=True).start(f"{sink}/{name}")
        for name, (filter_, start) in subscribers.items()
    }


#: Folders by hash of the key that a sink's rows are dealt into.
SINK_PARTS = 64


def exactly_once(sink: str, key: list[str], query: str) -> Callable:
    """A foreachBatch function that appends records whose key the sink doesn't have yet.

    Each micro-batch has a folder of its own, named by the query and the batch; a batch that is repeated after a failure writes
    the same rows there again. Rows are dealt into folders by a hash of their key, and only those that a batch touches are looked at. The first batch
    makes the sink. One query at a time may hold a key: two that write the same key at once would both add it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(SINK_PARTS)).cast("int"))
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            touched = [r[0] for r in fresh.select("part").distinct().collect()]
            before = spark.read.parquet(sink).where(F.col("part").isin(touched))
            fresh = fresh.join(before.where(~((F.col("query") == query) & (F.col("batch") == batch_id))).select(*key), key, "left_anti")
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{sink}/query={query}/batch={batch_id}")

    return write
