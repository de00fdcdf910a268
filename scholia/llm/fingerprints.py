"""Winnowed document fingerprints: rolling k-gram hashes, the minimum of each window, rightmost on ties, with places.

Two texts that share a run of at least `window + k - 1` code points share a selected (hash) entry; runs shorter than k
never match. A text shorter than k gives one hash over all of it, one with fewer than `window` k-grams the minimum of
those it has, and an empty or null text none. The fingerprint is a function of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, WINDOW = 25, 48
_PLACE_BITS = 24


def rolling(text: str, k: int = K) -> np.ndarray:
    """64-bit hash of each run of k code points (of the whole text, if it is shorter)."""
    c = common.codes(text)
    if not len(c):
        return np.zeros(0, np.uint64)
    k = min(k, len(c))
    p, q = common.powers(len(c) + 1)
    h = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[: len(c)], out=h[1:])
    return common.mix((h[k:] - h[:-k]) * q[: len(c) - k + 1])


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) that winnowing selects, by place. Hashes have 40 bits."""
    h = rolling(text, k) >> np.uint64(_PLACE_BITS)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    w = min(window, n)
    # the key falls with the place, so among equal hashes the rightmost is the least
    limit = (1 << _PLACE_BITS) - 1
    if n > limit:  # places wrap: blocks of windows, each with places of its own
        cuts = [winnow_keys(h[i : i + limit], w) + i for i in range(0, n - w + 1, limit - w + 1)]
        at = np.unique(np.concatenate(cuts))
    else:
        at = winnow_keys(h, w)
    return at, h[at]


def winnow_keys(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the windows' minima, each once, ascending. Minima come from prefix and suffix minima of blocks of w."""
    n = len(h)
    limit = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h << np.uint64(_PLACE_BITS)) | (limit - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (limit - (chosen & limit)).astype(np.int64)


def to_string(places: np.ndarray, hashes: np.ndarray) -> str:
    """`place:hash` in hexadecimal, comma-separated."""
    return ",".join(f"{p:x}:{h:x}" for p, h in zip(places.tolist(), hashes.tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two fingerprints' hash sets; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_chars, fingerprint)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["n_chars"], "fingerprint": [to_string(*winnow(t, k, window)) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text), next by descending doc_id; the last row's next is the first.

    doc_id is cut into ranges of like size at approximate quantiles. The first row of each range is also sent to the
    range before it, so each range finds all its neighbours itself: one shuffle of the texts, no window over all rows.
    Ties of doc_id are ordered by hash and text; null doc_id comes last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(cuts or ()))
    # ranges count downwards, as doc_id does
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(bucket).cast("int"))
    first = F.min_by(F.struct("doc_id", "text"), F.struct(-F.col("doc_id"), F.xxhash64("text"), "text")).alias("head")
    heads = rows.groupBy("bucket").agg(first)  # a row a range
    w = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.withColumn("bucket", before.cast("int")).select("head.doc_id", "head.text", "bucket", F.lit(1).alias("ahead"))
    both = rows.withColumn("ahead", F.lit(0)).unionByName(heads).repartition(n, "bucket")
    both = both.sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc(), F.xxhash64("text"), "text")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if held is not None and held.bucket == r.bucket:
                    out.append((None if pd.isna(held.doc_id) else int(held.doc_id), held.text, r.text))
                held = None if r.ahead else r
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "text", "next_text"]).astype({"doc_id": "Int64"})

    return both.mapInPandas(pair, "doc_id long, text string, next_text string")


def compare_edited(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text against its edited text (second half from the next document) and against the next document."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own, edited, behind = (winnow(t, k, window) for t in (r.text, r.edited, r.next_text))
                out.append((to_string(*own), to_string(*edited), likeness(own[1], edited[1]), likeness(own[1], behind[1])))
            more = pd.DataFrame(out, columns=["fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield pd.concat([pdf[["doc_id", "n_chars", "edited_sha256"]].reset_index(drop=True), more], axis=1).astype({"doc_id": "Int64"})

    return rows.select("doc_id", "n_chars", "edited_sha256", "text", "edited", "next_text").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
