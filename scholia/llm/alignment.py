"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often, by external counting.

Each text, with a space before it, is encoded by a byte-level BPE (A) and a SentencePiece model (B). Byte offsets at
which tokens of both end cut the text into groups; a link is a pair of an A and a B token that overlap. For each pair of
ids its links are counted over the corpus, and each document gets back how many of its links are of the pair most
frequent for their B id, and the sum of its links' counts.

Counting is external. A task encodes documents and holds (pair, document, links) records; when it has `HELD` of them it
sorts them B-major, deals them to `BUCKETS` parts by the low bits of the B id and writes each part as a zstd run, with a
shorter run of the pairs alone. The runs of pairs are merged through a heap, block by block, at most about `FAN` of them
in a task and in as many rounds as that takes; the last gives each pair's count, and as it is B-major, each B id's
greatest. Then the runs of records are read again beside the counts of their part, and give each document its share. So
nothing but blocks of runs is held, a frequent B id is split by its runs, and lost tasks read written tables anew.

No token of A or B goes over a space that follows a non-space: the byte-level pattern starts a token there, and no piece
of B has a space behind another character (checked at loading). So a text is aligned unit by unit, each from one such
space to the next, and units seen before are remembered.

Defined cases: null and empty texts, and those whose A or B bytes don't give back the space and the text (a text with
U+2581, say), have zeros and ''; null doc_id stays null; rows with the same doc_id stay rows of their own and count each;
an empty table gives no rows. Only doc_id and text are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_memo import space_pieces

BUCKETS, HELD, FAN, UNITS, BLOCK = 32, 2_000_000, 32, 400_000, 1 << 16
#: Bits of an id and of a document's place in its run; a record's key is (B id, A id, place) in 64 bits.
ID_BITS, PLACE_BITS = 20, 24
_UNPROVEN = re.compile(r"\s ")
_NONE = (b"", b"", -1)


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def align(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """(groups, links) of two encodings of the same bytes: one walk along the ends of both."""
    groups, links, own_a, own_b = [], [], [], []
    i = j = 0
    at_a, at_b = a_size[a[0]], b_size[b[0]]
    while True:
        links.append((a[i], b[j]))
        if at_a < at_b:
            own_a.append(a[i])
            i += 1
            at_a += a_size[a[i]]
        elif at_b < at_a:
            own_b.append(b[j])
            j += 1
            at_b += b_size[b[j]]
        else:
            groups.append(([*own_a, a[i]], [*own_b, b[j]]))
            own_a, own_b = [], []
            i += 1
            j += 1
            if i == len(a):
                return groups, links
            at_a += a_size[a[i]]
            at_b += b_size[b[j]]


class Aligner:
    """units -> (groups as text, keys of links, n_a + n_b << 32), remembered; n is -1 where bytes differ."""

    def __init__(self, a_file: str, b_file: str, most: int = UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(letters[c] for c in vocabulary.get(i, "") if c in letters) for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file, num_threads=1)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space behind another character: texts can't be cut there")
        if max(len(self.a_bytes), len(pieces)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.space = self.b.encode("x ")[-1:]
        self.known: dict[str, tuple[bytes, bytes, int]] = {}
        self.most = most

    def learn(self, units: list[str]) -> None:
        """units stand without the space before them, which B adds itself."""
        for u, ea, b in zip(units, self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False), self.b.encode(units, num_threads=1), strict=True):
            a, b, want = ea.ids, b if u else self.space, (" " + u).encode()
            if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
                self.known[u] = _NONE
                continue
            groups, links = align(a, b, self.a_size, self.b_size)
            text = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
            keys = np.array([y << ID_BITS | x for x, y in links], np.uint64)
            self.known[u] = (text.encode(), keys.tobytes(), len(a) | len(b) << 32)

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, np.ndarray] | None]:
        """(n_a, n_b, groups, keys of links) of each text, None for those without tokens."""
        if len(self.known) > self.most:
            self.known.clear()
        cut = [None if not t else t.split(" ") if t[0] != " " and not _UNPROVEN.search(t) else [x[1:] for x in space_pieces(" " + t)] for t in texts]
        new = {u for units in cut if units for u in units if u not in self.known}
        if new:
            self.learn(list(new))
        for units in cut:
            rows = [self.known[u] for u in units] if units else [_NONE]
            strings, keys, sizes = zip(*rows, strict=True)
            if -1 in sizes:
                yield None
                continue
            total = sum(sizes)
            yield total & 0xFFFFFFFF, total >> 32, b";".join(strings), np.frombuffer(b"".join(keys), np.uint64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    key = (a_file, b_file)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_file, b_file)
    return _ALIGNERS[key]


# ---------------------------------------------------------------- runs: sorted keys with numbers, as zstd blocks


def pack(keys: np.ndarray, *numbers: np.ndarray) -> bytes:
    """A run in blocks of `BLOCK` rows: differences of sorted keys and the numbers, byte by byte place."""
    out = []
    for i in range(0, len(keys), BLOCK):
        part = keys[i : i + BLOCK]
        columns = [np.diff(part, prepend=np.uint64(0)), *[x[i : i + BLOCK].astype(np.uint64) for x in numbers]]
        planes = np.ascontiguousarray(np.stack(columns).view(np.uint8).reshape(len(columns), len(part), 8).transpose(0, 2, 1))
        data = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
        out.append(len(part).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
    return b"".join(out)


def blocks(run: bytes) -> Iterator[list[np.ndarray]]:
    """The blocks of a run: [keys, numbers, ...]. One is unpacked at a time."""
    at, undo = 0, zstandard.ZstdDecompressor()
    while at < len(run):
        rows, size = (int.from_bytes(run[at + i : at + i + 4], "little") for i in (0, 4))
        planes = np.frombuffer(undo.decompress(run[at + 8 : at + 8 + size]), np.uint8).reshape(-1, 8, rows)
        columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(len(planes), -1).view(np.uint64)
        yield [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]
        at += 8 + size


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of sorted ones, and their numbers' sums."""
    if not len(keys):
        return keys, numbers
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(numbers, first)


def merge(runs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge: (keys, sums) in key order. The heap holds a block of each run by its last key; all that is not above
    the least of these can be summed, as no run has such keys behind its block."""
    heap = []
    for i, run in enumerate(runs):
        rest = blocks(run)
        if (block := next(rest, None)) is not None:
            heap.append((int(block[0][-1]), i, block, rest))
    heapq.heapify(heap)
    while heap:
        most = np.uint64(heap[0][0])
        taken, left = [], []
        for last, i, (keys, n), rest in heap:
            k = int(np.searchsorted(keys, most, side="right"))
            if k:
                taken.append((keys[:k], n[:k]))
            if k < len(keys):
                left.append((last, i, [keys[k:], n[k:]], rest))
            elif (block := next(rest, None)) is not None:
                left.append((int(block[0][-1]), i, block, rest))
        heap = left
        heapq.heapify(heap)
        keys, n = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(keys, kind="stable")
        yield summed(keys[order], n[order])


# ---------------------------------------------------------------- Spark jobs

_DOCUMENT = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RUN = "bucket int, run long, records binary, pairs binary"


def encoded(docs: DataFrame, a_file: str, b_file: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two kinds, written together so that a task's documents and runs always belong together: documents (row,
    doc_id, counts) and runs (bucket, run, records, pairs). row: the run's number and the document's place in it."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in f"{_DOCUMENT}, {_RUN}".split(", "))])

    def batch(rows: list[tuple], first: int) -> pa.RecordBatch:
        """rows with the columns from `first` on; the other columns are null."""
        own = dict(zip(schema.names[first:], zip(*rows, strict=True), strict=False)) if rows else {}
        return pa.RecordBatch.from_arrays([pa.array(own.get(x.name, [None] * len(rows)), x.type) for x in schema], schema=schema)

    def runs_of(number: int, held: list[np.ndarray]) -> pa.RecordBatch:
        links = np.concatenate(held) if held else np.zeros(0, np.uint64)
        links.sort()
        keys, n = summed(links, np.ones(len(links), np.uint64))
        part = (keys >> np.uint64(PLACE_BITS + ID_BITS)) % np.uint64(buckets)
        out = []
        for bucket in np.unique(part).tolist():
            own = part == bucket
            pairs = summed(keys[own] >> np.uint64(PLACE_BITS), n[own])
            out.append((int(bucket), number, pack(keys[own], n[own]), pack(*pairs)))
        return batch(out, 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, place, size, held = aligner(a_file, b_file), TaskContext.get().partitionId() << 20, 0, 0, []
        for read in batches:
            out = []
            for doc_id, got in zip(read.column(0).to_pylist(), both.texts(read.column(1).to_pylist()), strict=True):
                row = number << PLACE_BITS | place
                if got is None:
                    out.append((row, doc_id, 0, 0, 0, 0, ""))
                else:
                    n_a, n_b, groups, keys = got
                    out.append((row, doc_id, n_a, n_b, groups.count(b";") + 1, len(keys), hashlib.sha256(groups).hexdigest()))
                    held.append(keys << np.uint64(PLACE_BITS) | np.uint64(place))
                    size += len(keys)
                place += 1
                if size >= HELD or place + 1 >= 1 << PLACE_BITS:
                    yield runs_of(number, held)
                    number, place, size, held = number + 1, 0, 0, []
            yield batch(out, 0)
        if held:
            yield runs_of(number, held)

    return common.materialise(rows.mapInArrow(run, f"{_DOCUMENT}, {_RUN}"), "encoded")


def counts(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(bucket, counts) of runs (bucket, run, pairs): for each bucket one run of (pair, count, greatest of its B id).
    Rounds of merges until a bucket has one run."""
    rows = runs.select("bucket", F.col("run").alias("part"), F.col("pairs").alias("run"))

    def joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = zip(*merge(pdf["run"]), strict=True)
        return pd.DataFrame({"bucket": [key[0]], "part": [key[1]], "run": [pack(np.concatenate(keys), np.concatenate(n))]})

    while True:
        most = rows.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        parts = -(-most // fan)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(parts, 1))))
        rows = common.materialise(rows.groupBy("bucket", "part").applyInPandas(joined, "bucket int, part long, run binary"), "merged-runs")
        if parts <= 1:
            break

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for run in pdf["run"]:
                keys, n = map(np.concatenate, zip(*blocks(run), strict=True))
                b = keys >> np.uint64(ID_BITS)
                first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                greatest = np.repeat(np.maximum.reduceat(n, first), np.diff([*first, len(b)]))
                out.append(pack(keys, n, n == greatest))
            yield pd.DataFrame({"bucket": pdf["bucket"], "counts": out})

    return common.materialise(rows.select("bucket", "run").mapInPandas(best, "bucket int, counts binary"), "pair-counts")


def contributions(runs: DataFrame, totals: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, n_best, count_sum): what each run of records gives to its documents. The runs of a bucket are dealt out, a
    copy of its counts beside every `fan` of them or so."""
    most = runs.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = max(1, -(-most // fan))
    records = runs.select("bucket", F.pmod(F.xxhash64("run"), F.lit(slices)).alias("slice"), "run", "records")
    totals = totals.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), "counts")

    def give(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(left):
            pairs, count, best = map(np.concatenate, zip(*blocks(right["counts"].iloc[0]), strict=True))
            for run, records in zip(left["run"], left["records"], strict=True):
                keys, n = map(np.concatenate, zip(*blocks(records), strict=True))
                at = np.searchsorted(pairs, keys >> np.uint64(PLACE_BITS))
                place, own = np.unique((keys & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), return_inverse=True)
                sums = np.zeros((2, len(place)), np.int64)
                np.add.at(sums[0], own, (n * best[at]).astype(np.int64))
                np.add.at(sums[1], own, (n * count[at]).astype(np.int64))
                out.append((place | int(run) << PLACE_BITS, *sums))
        return pd.DataFrame(dict(zip(("row", "n_best", "count_sum"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    both = records.groupBy("bucket", "slice").cogroup(totals.groupBy("bucket", "slice"))
    return both.applyInPandas(give, "row long, n_best long, count_sum long")


def alignments(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a row of docs."""
    rows = encoded(docs, a_file, b_file)
    runs = rows.where("bucket is not null").select("bucket", "run", "records", "pairs")
    totals = counts(runs)
    shares = contributions(runs, totals).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = rows.where("bucket is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = texts.hint("merge").join(shares, "row", "left")
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(doc_id, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
