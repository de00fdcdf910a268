"""Near-duplicate texts: Order MinHash over five-word shingles, candidates verified by banded alignment.

A text is a sequence of shingles (runs of `SHINGLE` lower-cased words), each labelled with how often it occurred before.
For each of `SKETCHES` hash functions the `PICK` least labelled shingles are kept in text order and hashed together: two
texts share such a sketch with a probability that grows with their edit similarity, not only with their common shingles.

The similarity of two texts is L / (n + m - L), L the longest common subsequence of their n and m shingles, 1 for equal
word sequences; 0.8 or more is a link. Two texts that reach it have L within a diagonal band, so the alignment looks at
that band alone (bit-parallel, exact).

Equal texts are one class from the start. Texts that share a sketch form a bucket, and two texts are candidates if they
share `SHARED` sketches and their shingles can reach the similarity: of each text the parities of its labelled shingles
dealt to `PARITY` * 64 places are kept; places that differ are at most the shingles that only one of the two has, and
those are at most (n + m) (1 - t) / (1 + t) for a similarity of t. So this second test loses nothing. `common.bucket_links` verifies all candidates, but for those in large buckets whose texts are
in one class already; it splits very large buckets by second and third shared sketches. So the classes are those that all
candidates would give, and no group is gathered.

Defined cases: null text is in no class but its own and never a copy; texts without a word are copies only of equal
texts; rows with the same doc_id count as one document (the text of least SHA-256); null doc_id gets no row in classes; an empty
table gives no rows. Only doc_id and text are read, other columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD, SKETCHES, PICK, BUCKET, SHARED = 5, 0.8, 16, 2, 24, 3
PARITY = 16
#: 14 bits of each sketch in lanes of 16 bits, four a long: candidates are compared by these, buckets made by the sketches.
LANES = SKETCHES // 4
_LANE, _CARRY = 0x3FFF3FFF3FFF3FFF, 0x4000400040004000
_SEEDS = [(0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(64)]


def occurrences(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones stand before it in its text."""
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = h ^ common.mix(doc)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(h) else np.zeros(0, bool)
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.zeros(len(h), np.uint64)
    out[order] = run
    return out


def sketches(texts: list[str], m: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """m sketches of each text, these in lanes, the parities of its shingles, their number; zeros for texts without a word."""
    h, n = common.shingles(*common.word_hashes(texts), SHINGLE)
    lanes = -(-m // 4)
    out = np.zeros((len(texts), m + lanes + PARITY + 1), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    labelled = common.mix(h + occurrences(h, n) * np.uint64(0xD6E8FEB86659FD93))
    starts = (np.cumsum(n) - n)[full]
    sizes = n[full]
    width = PARITY * 64
    place = np.repeat(np.arange(len(texts)), n) * width + (labelled >> np.uint64(32)).astype(np.int64) % width
    odd = (np.bincount(place, minlength=len(texts) * width) & 1).astype(np.uint8).reshape(len(texts), width)
    out[:, m + lanes : -1] = np.packbits(odd, axis=1).view(np.int64)
    out[:, -1] = n
    for i in range(m):
        x = common.mix(labelled ^ np.uint64(_SEEDS[i]))
        places, values = [], []
        for _ in range(pick):
            least = np.minimum.reduceat(x, starts)
            at = np.flatnonzero(x == np.repeat(least, sizes))
            owner = np.searchsorted(starts, at, side="right") - 1
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            places.append(at[first])
            values.append(least)
            x[at[first]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        order = np.argsort(np.array(places), axis=0, kind="stable")
        ordered = np.take_along_axis(np.array(values), order, axis=0)
        total = np.zeros(len(full), np.uint64)
        for row in ordered:
            total = common.mix(total * np.uint64(0x9E3779B97F4A7C15) + row)
        out[full, i] = total.view(np.int64)
        out[full, m + i // 4] |= (total >> np.uint64(50)).astype(np.int64) << (i % 4 * 16)
    return out


def aligned(a: list[int], b: list[int], threshold: float = THRESHOLD) -> float:
    """L / (n + m - L), or 0 where it stays below the threshold. L comes from a band around the diagonal.

    To reach the threshold t, L must be at least t (n + m) / (1 + t); then at most n + m - 2 L shingles are left out, and
    no aligned pair lies further than that from the diagonal.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    band = int((n + m) * (1 - 2 * threshold / (1 + threshold)) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, window = (1 << len(a)) - 1, (1 << (2 * band + 1)) - 1
    v = full
    for j, x in enumerate(b):
        hit = where.get(x)
        if hit:
            hit &= window << (j - band) if j >= band else window >> (band - j)
            u = v & hit
            if u:
                v = ((v + u) | (v - u)) & full
    common_part = head + tail + len(a) - v.bit_count()
    s = common_part / (n + m - common_part)
    return s if s >= threshold else 0.0


def shingle_lists(texts: list[str]) -> list[list[int]]:
    h, n = common.shingles(*common.word_hashes(texts), SHINGLE)
    return [x.tolist() for x in np.split(h, np.cumsum(n)[:-1])] if len(texts) else []


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s) of every row with a doc_id and a text; s: its sketches."""
    rows = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("text_hash", F.sha2(F.encode("text", "UTF-8"), 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "s": list(sketches(pdf["text"].tolist()))})

    return rows.mapInPandas(run, "doc_id long, text_hash string, s array<long>")


def share_enough(threshold: float) -> Callable[[Column, Column], Column]:
    """Whether two texts share sketches enough, and differ in no more parities than the threshold allows. Kept short:
    beyond 8,000 bytes of code the JVM doesn't compile a join's loop."""
    allowed = (1 - threshold) / (1 + threshold)

    def close(s: Column, t: Column) -> Column:
        lanes, parities = (range(SKETCHES, SKETCHES + LANES), range(SKETCHES + LANES, SKETCHES + LANES + PARITY))
        differ = lambda i: F.get(s, i).bitwiseXOR(F.get(t, i))
        other = reduce(add, [F.bit_count((differ(i) + F.lit(_LANE)).bitwiseAND(F.lit(_CARRY))) for i in lanes])
        odd = reduce(add, [F.bit_count(differ(i)) for i in parities])
        n = F.get(s, SKETCHES + LANES + PARITY) + F.get(t, SKETCHES + LANES + PARITY)
        return (other <= SKETCHES - SHARED) & (odd <= n * allowed + 1e-9)

    return close


def by_sketch() -> Column:
    """Buckets by one sketch more, of those behind the last one taken (state): candidates share `SHARED` of them."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda i: i >= F.col("state")), lambda i: F.struct(F.xxhash64("key", i, F.get("s", i)).alias("key"), (i + 1).cast("long").alias("state")))


def shared_before(s: Column, t: Column, state: Column) -> Column:
    """How many sketches two texts share before the one that made their bucket."""
    head = lambda x: F.slice(x, F.lit(1), state.cast("int") - 1)
    return F.size(F.filter(F.zip_with(head(s), head(t), lambda u, v: u == v), lambda same: same))


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the pairs (a, b) of doc_ids whose texts are aligned to the threshold."""
    needed = common.materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    texts = texts.join(common.small_or_shuffled(needed), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.sha2(F.encode("text", "UTF-8"), 256)).alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, n = common.shingles(*common.word_hashes(pdf["text"].tolist()), SHINGLE)
            yield pd.DataFrame({"node": pdf["doc_id"], "h": [x.tobytes() for x in np.split(h.astype(np.uint32), np.cumsum(n)[:-1])]})

    packed = common.materialise(texts.mapInPandas(pack, "node long, h binary"), "shingles")
    both = common.join_ends(pairs, packed, "a", "b", "h", "ha")
    both = common.join_ends(both, packed, "b", "a", "h", "hb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [aligned(np.frombuffer(x, np.uint32).tolist(), np.frombuffer(y, np.uint32).tolist(), threshold) for x, y in zip(pdf["ha"], pdf["hb"], strict=True)]
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": got})
            yield out[out["similarity"] > 0]

    return common.materialise(both.select("a", "b", "ha", "hb").mapInPandas(verify, "a long, b long, similarity double"), "links")


def links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of verified links between different texts, by node, and (node, component)."""
    found = nodes.where("s[0] <> 0")  # texts with a word
    return common.bucket_links(found, [by_sketch] * SHARED, share_enough(threshold), lambda pairs: verified(docs, pairs, threshold), BUCKET, rare=True, first=shared_before)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): class_id is the least doc_id of the class. One row a document with a doc_id and a text."""
    every = common.materialise(signatures(docs), "signatures")
    least = common.materialise(every.groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most"), "repeated-ids")
    every = every.join(common.small_or_shuffled(least.select("doc_id", "least")), "doc_id", "left").where("least is null or least = text_hash")
    nodes = common.materialise(every.groupBy("text_hash").agg(F.min("doc_id").alias("node"), F.first("s").alias("s")), "nodes")
    _, groups = links(docs, nodes.select("node", "s"), threshold)
    by_text = nodes.select("text_hash", "node").join(common.small_or_shuffled(groups), "node", "left")
    by_text = common.materialise(by_text.select("text_hash", F.coalesce("component", "node").alias("class_id")), "classes")
    # a text may have very many copies: rows of the same text are dealt out by their number
    copies = common.materialise(every.groupBy("text_hash").agg(F.count("*").alias("n")).join(by_text.hint("merge"), "text_hash"), "copies")
    return common.join_hot(every.select("doc_id", "text_hash"), copies, "text_hash", "class_id", "n").select("doc_id", "class_id").dropDuplicates(["doc_id"])


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one whose doc_id is the class. Null text or doc_id stays."""
    gone = common.materialise(classes(docs, threshold).where("doc_id <> class_id").select("doc_id"), "gone")
    return docs.join(common.small_or_shuffled(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return keep_one(docs)
