"""Queries that run a stream over a table's files to its end, and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholia.plans.bindings import table
from scholia.plans.lineage import shared_folder
from scholia.streaming import conversations as c


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    """A table as a file stream, be it one file or a folder of files. The pattern is the name alone: a stream takes a
    single file only by a pattern, and a filter on file names would pass over the files of a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _events(spark, d):
    return _stream(spark, d, "events")


def _finish(query, seconds: int | None = None) -> None:
    """Wait for the stream's end, as long as it takes unless a limit is given."""
    try:
        if query.awaitTermination(seconds) is False:
            raise TimeoutError("the stream did not end")
    finally:
        query.stop()


def stream_sessions_live(spark, d):
    """Sessions by the stream: those that the final watermark has passed."""
    e = _events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    at = _folder(spark)
    out = c.session_stream(e, "user_id", "ts")
    _finish(out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
    rows = spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{at}/out")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), "n")


def _messages(spark, d):
    """Events as a stream of messages, with the state store that such streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _events(spark, d).select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("role"), F.col("props").alias("content"))


def stream_ttl_sweep_live(spark, d):
    """Conversations that timers have evicted by the stream's end."""
    at = _folder(spark)
    out = c.evictions_stream(_messages(spark, d), 20)
    _finish(out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
    rows = spark.read.schema(c.EVICTED).parquet(f"{at}/out")
    return rows.select("conv_id", "n", F.unix_micros("last_ts").alias("last_us"))


def stream_last_n_ttl(spark, d):
    """Last messages by user with the state store, events as messages; the final state of each."""
    e = _messages(spark, d)
    at = _folder(spark)
    out = c.last_messages_stream(e, 20)
    write = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{at}/out")
    _finish(out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
    rows = spark.read.parquet(f"{at}/out")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("n", "last_ts"), "epoch").alias("r"))
    return last.select("conv_id", F.col("r.n").alias("n"), F.unix_micros("r.last_ts").alias("last_us"))


def stream_inc_extract(spark, d):
    """Documents as a stream: each content once, by the key of its first 8192 bytes."""
    s = _stream(spark, d, "documents")
    at = _folder(spark)
    key = lambda b: b.select("doc_id", F.sha2(F.substring(F.encode("text", "UTF-8"), 1, 8192), 256).alias("key"))
    handle = lambda b, epoch: b.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
    _finish(s.writeStream.foreachBatch(c.extract_new(f"{at}/cache", key, handle)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{at}/out").select("key")


_G = """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 3600 seconds then 0 else 1 end as s from events),
  g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from e)"""
QUERIES = {
    "stream_sessions_live": (
        stream_sessions_live,
        f"{_G} select user_id, epoch_us(min(ts)) as start_us, count(*) as n from g group by user_id, k having max(ts) + interval 3600 seconds <= (select max(ts) - interval 10 minutes from events)",
    ),
    "stream_last_n_ttl": (
        stream_last_n_ttl,
        f"{_G} select user_id as conv_id, least(20, count(*))::int as n, epoch_us(max(ts)) as last_us from g join (select user_id, max(k) as k from g group by 1) using (user_id, k) group by 1",
    ),
    "stream_ttl_sweep_live": (
        stream_ttl_sweep_live,
        f"{_G} select user_id as conv_id, least(20, count(*))::int as n, epoch_us(max(ts)) as last_us from g join (select user_id, max(k) as k from g group by 1) using (user_id, k) group by 1 having epoch_ms(max(ts)) + 3600000 < (select epoch_ms(max(ts)) - 600000 from events)",
    ),
    "stream_inc_extract": (stream_inc_extract, "select distinct sha256(case when strlen(text) > 8192 then encode(text)[1:8192] else encode(text) end) as key from documents"),
}
