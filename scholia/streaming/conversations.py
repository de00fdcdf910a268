"""Streams of chat messages: sessions, the last messages of each conversation with expiry, incremental extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def session_stream(messages: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of a stream of messages: a gap of more than `gap` starts a new session. A session is emitted
    when the watermark passes its end; messages later than `late` behind the newest are dropped by the watermark."""
    s = messages.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


MESSAGE = "conv_id long, ts timestamp, role string, content string"
HISTORY = "conv_id long, n int, first_ts timestamp, last_ts timestamp, roles string"


class LastMessages(StatefulProcessor):
    """Keeps the last `n` messages of a conversation. One that was idle for more than ttl_seconds (event time) before a
    message arrives starts empty. Emits the state after each batch of a conversation.

    Rows are taken a frame at a time, and of all seen so far only the last `n` are held: a gap before these doesn't
    matter any more, so a conversation of any length needs that much memory and state.
    """

    def __init__(self, n: int = 20, ttl_seconds: float = 3600.0):
        self.n, self.ttl = n, pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "ts timestamp, role string, content string")

    def held(self) -> list[tuple]:
        return [(pd.Timestamp(r[0]).to_pydatetime(), *r[1:]) for r in self.messages.get()] if self.messages.exists() else []

    def take(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """The messages held after rows, in order of time."""
        last = self.held()
        for frame in rows:
            new = [(pd.Timestamp(r.ts).to_pydatetime(), r.role, r.content) for r in frame.nlargest(self.n, "ts", keep="last").itertuples(index=False)]
            last = sorted([*last, *new], key=lambda m: m[0])[-self.n :]
        for i in range(len(last) - 1, 0, -1):
            if last[i][0] - last[i - 1][0] > self.ttl:
                last = last[i:]
                break
        self.messages.put(last)
        return last

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.take(rows)
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(held)], "first_ts": [held[0][0]], "last_ts": [held[-1][0]], "roles": [",".join(m[1] for m in held)]})

    def close(self) -> None:
        pass


EVICTED = "conv_id long, n int, last_ts timestamp"


class Evictions(LastMessages):
    """The same state, swept: a conversation whose newest message lies more than the TTL behind the watermark is dropped
    from the state by an event-time timer, and emitted with the number of messages it had. A message that comes later
    starts it anew. So the state holds no more than the conversations of the last TTL."""

    def due(self, held: list[tuple]) -> int:
        """Milliseconds at which a conversation is over: the first that lies more than the TTL behind."""
        return int((pd.Timestamp(held[-1][0]) + self.ttl).timestamp() * 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.held()
        if before:
            self.handle.deleteTimer(self.due(before))
        self.handle.registerTimer(self.due(self.take(rows)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.held()
        self.messages.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(held)], "last_ts": [held[-1][0]]})


def evictions_stream(messages: DataFrame, n: int = 20, ttl_seconds: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """EVICTED rows for a stream of MESSAGE rows, as the watermark (`late` behind the newest message) passes their end."""
    rows = messages.withWatermark("ts", late).groupBy("conv_id")
    return rows.transformWithStateInPandas(Evictions(n, ttl_seconds), EVICTED, "append", "eventTime")


def evicted_per_batch(evicted: DataFrame, epoch: int) -> DataFrame:
    """(epoch, conversations, messages): what one batch of evictions_stream dropped, for a foreachBatch function."""
    return evicted.agg(F.lit(epoch).cast("long").alias("epoch"), F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


def read_history(history: DataFrame, now, ttl_seconds: float = 3600.0) -> DataFrame:
    """HISTORY rows as a reader sees them at the time `now`: a conversation idle for more than the TTL reads as empty
    whether or not it was swept."""
    over = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_ts") > int(ttl_seconds * 1e6)
    empty = [F.when(~over, F.col(c)).otherwise(F.lit(0) if c == "n" else F.lit(None)).alias(c) for c in history.columns if c != "conv_id"]
    return history.select("conv_id", *empty)


def last_messages_stream(messages: DataFrame, n: int = 20, ttl_seconds: float = 3600.0) -> DataFrame:
    """HISTORY rows for a stream of MESSAGE rows; needs the RocksDB state store provider."""
    return messages.groupBy("conv_id").transformWithStateInPandas(LastMessages(n, ttl_seconds), HISTORY, "update", "none")


def last_messages(messages: DataFrame, n: int = 20, ttl_seconds: float = 3600.0) -> DataFrame:
    """The same for a finished table: the last n messages since each conversation's last gap of more than the TTL."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("ts")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > int(ttl_seconds * 1e6)
    rows = messages.withColumn("session", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w))
    back = Window.partitionBy("conv_id").orderBy(F.desc("session"), F.desc("ts"))
    rows = rows.withColumn("last_session", F.max("session").over(Window.partitionBy("conv_id"))).withColumn("back", F.row_number().over(back))
    kept = rows.where((F.col("session") == F.col("last_session")) & (F.col("back") <= n))
    return kept.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def extract_new(cache_path: str, key: Callable[[DataFrame], DataFrame], handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose content key no earlier batch had go to handle(rows, epoch), then their keys
    are cached. Of rows with the same key in a batch the least stays.

    The cache has a folder for each batch, which a batch that runs again writes anew; it looks at the folders of earlier
    batches alone, so it finds the same rows. A handle that replaces what it wrote for an epoch so gives each row once.
    A cache belongs to one checkpoint: with a new one epochs start again.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = key(batch)
        columns = fresh.columns
        try:
            known = spark.read.schema("key string, epoch long").parquet(cache_path).where(F.col("epoch") < epoch)
            fresh = fresh.join(known.select("key"), "key", "left_anti")
        except Exception as e:  # the first batch has no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        least = fresh.groupBy("key").agg(F.min(F.struct(*[c for c in columns if c != "key"])).alias("least"))
        fresh = least.select("key", "least.*").select(*columns).persist()
        handle(fresh, epoch)
        fresh.select("key").write.mode("overwrite").parquet(f"{cache_path}/epoch={epoch}")
        fresh.unpersist()

    return run
