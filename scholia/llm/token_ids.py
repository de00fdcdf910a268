"""Token-id files of directly addressable codes: any token is reached without decoding a block.

An id is split into chunks of `CHUNK` bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go on,
and level 1 holds the next chunk of those only, and so on. A rank directory over each bitmap (ones before every block of
512 bits) turns a place on one level into the place on the next, so `token_at` touches one chunk and one block a level.

A shard is a range of doc_id, written by one task; it consists of segments of at least `segment_tokens` ids that end
where a document ends. Segments are rows of a Parquet folder, so Spark's commit protocol covers retries and lost tasks,
and any store that Spark writes will do.

Defined cases: null text counts as empty (the end id alone); null doc_id sorts first and stays null; rows with the same
doc_id are kept as documents of their own, ordered by a hash of their text; an empty table gives an empty folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_memo import memo

CHUNK, LEVELS, RANK_BITS = 8, 4, 512
SEGMENT = (
    "shard int, segment int, n_tokens long, doc_ids array<bigint>, doc_starts array<bigint>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(chunks, bitmaps, rank directories), a byte string for each level."""
    chunks, bitmaps, ranks, left = [], [], [], ids.astype(np.uint32)
    for level in range(LEVELS):
        more = left >> np.uint32(CHUNK)
        on = more > 0 if level < LEVELS - 1 else np.zeros(len(left), bool)
        chunks.append((left & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(on, bitorder="little").tobytes())
        blocks = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS)) if len(on) else np.zeros(0, int)
        ranks.append(np.concatenate(([0], np.cumsum(blocks)))[: max(len(blocks), 1)].astype("<u4").tobytes())
        left = more[on]
        if not len(left):
            break
    return chunks, bitmaps, ranks


def decode_levels(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out: np.ndarray | None = None
    for chunk, bitmap in zip(reversed(chunks), reversed(bitmaps), strict=True):
        own = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        if out is not None:
            on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(own), bitorder="little").astype(bool)
            own[on] |= out << np.uint32(CHUNK)
        out = own
    return out if out is not None else np.zeros(0, np.uint32)


def token_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place i of a segment, by rank alone."""
    value = 0
    for level, (chunk, bitmap) in enumerate(zip(chunks, bitmaps, strict=True)):
        value |= chunk[i] << (CHUNK * level)
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        ones = int.from_bytes(ranks[level][4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], "little")
        i = ones + (bits & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()
    return value


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, segment_tokens: int = 1 << 19) -> None:
    """Encode text of docs (doc_id, text) and write its ids, in ascending doc_id order, as segments under path.

    One range shuffle by doc_id; a task streams through its sorted rows and holds one segment at a time.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number = TaskContext.get().partitionId(), 0
        ids, doc_ids, starts, held = [], [], [], 0

        def segment() -> pd.DataFrame:
            chunks, bitmaps, ranks = encode_levels(np.frombuffer(b"".join(ids), "<u4"))
            return pd.DataFrame({"shard": [shard], "segment": [number], "n_tokens": [held], "doc_ids": [doc_ids], "doc_starts": [starts], "chunks": [chunks], "bitmaps": [bitmaps], "ranks": [ranks]})

        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            for doc_id, own in zip(pdf["doc_id"], memo(tokenizer).encode(pdf["text"].tolist()), strict=True):
                ids.append(own + end)
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                starts.append(held)
                held += len(ids[-1]) // 4
                if held >= segment_tokens:
                    yield segment()
                    number += 1
                    ids, doc_ids, starts, held = [], [], [], 0
        if doc_ids:
            yield segment()

    rows.mapInPandas(segments, SEGMENT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(shard, segment, base): ids of all segments before. Sums by shard first, so the one-task window sees a row a shard."""
    own = segments.select("shard", "segment", "n_tokens")
    in_shard = Window.partitionBy("shard").orderBy("segment")
    by_shard = own.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = by_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    inner = own.withColumn("inner", F.sum("n_tokens").over(in_shard) - F.col("n_tokens"))
    return inner.join(F.broadcast(shards), "shard").select("shard", "segment", (F.col("inner") + F.col("shard_base")).alias("base"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, segment) of every document, decoded from the files under path."""
    segments = read(spark, path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                data = decode_levels(list(r.chunks), list(r.bitmaps)).astype("<u4")
                cuts = [*map(int, r.doc_starts), len(data)]
                spans = list(zip(cuts, cuts[1:], strict=False))
                yield pd.DataFrame({"shard": r.shard, "segment": r.segment, "doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "local": cuts[:-1], "n_tokens": [b - a for a, b in spans], "ids_crc32": [zlib.crc32(data[a:b].tobytes()) for a, b in spans]})

    rows = segments.select("shard", "segment", "doc_ids", "doc_starts", "chunks", "bitmaps").mapInPandas(decode, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    starts = common.small_or_shuffled(common.materialise(segment_starts(segments), "starts"))
    return rows.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for each global place of places(place): random access, one rank walk a place, no block decoded."""
    segments = read(spark, path)
    starts = common.materialise(segment_starts(segments).join(segments.select("shard", "segment", "n_tokens"), ["shard", "segment"]), "starts")
    bucket = F.explode(F.sequence(F.shiftright("base", 19), F.shiftright(F.col("base") + F.col("n_tokens") - 1, 19)))
    spans = starts.where("n_tokens > 0").withColumn("bucket", bucket)
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("bucket", F.shiftright("place", 19))
    found = asked.hint("merge").join(spans, "bucket").where("place >= base and place < base + n_tokens")
    found = found.select("place", F.struct("shard", "segment", "base").alias("at"))
    found = found.groupBy("at.shard", "at.segment", "at.base").agg(F.collect_set("place").alias("places"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                levels = [list(x) for x in (r.chunks, r.bitmaps, r.ranks)]
                yield pd.DataFrame({"place": list(r.places), "id": [token_at(*levels, int(p) - r.base) for p in r.places]})

    joined = segments.hint("merge").join(found, ["shard", "segment"]).select("base", "places", "chunks", "bitmaps", "ranks")
    return joined.mapInPandas(look, "place long, id long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.prepare(spark)
    path = common.scratch_path(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return documents(spark, path)
