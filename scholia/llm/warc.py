"""WARC archives: written by Spark's text writer, read back by verifying the chain of record boundaries.

Writing: a row is one record's head and payload; the line separator is the CRLF CRLF that ends a WARC record, so each
part file is a valid WARC 1.1 file, on any store and under Spark's commit protocol. Of equal payloads of at least
`least` bytes, the one with the smallest page_id is a `response`; the others are `revisit` records without a block.

Reading: Spark splits the files at the magic `WARC/1.1` CRLF, which may also stand inside a payload. Every piece so cut
is a candidate record, and tasks emit for each where its successor must begin (offset + head + Content-Length + 4).
Inside a split the chain from each candidate is followed in memory to where it leaves the split. What remains, a pointer
a candidate, is solved over all splits by pointer jumping from offset 0 of each file. Candidates that the chain does not
reach are payload. A second scan follows the verified chain and joins payloads that magic had cut; only those that cross
a split are brought together by a shuffle.

Defined cases: null html is an empty payload; null url becomes an empty target; null page_id is written as `-` and read
as null, and never is what others refer to unless all copies are null; repeated page_ids give a record each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(hex_digest):
    """Base32 of a SHA-1 given in hexadecimal: five digits are twenty bits, four letters."""
    letters = F.lit(ALPHABET)
    part = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substring(letters, (F.shiftright(part(i), 15 - 5 * j).bitwiseAND(31) + 1), F.lit(1)) for i in range(8) for j in range(4)])


def with_record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type, refers_to.

    Copies are found on digests alone, and only digests that several rows share are joined back.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = common.materialise(groups.where("n > 1"), "copies")
    rows = common.join_hot(rows, groups, "sha1", "first_id", "n")
    first = F.col("first_id")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return rows.select(
        "page_id", "url", "html", "payload_bytes", base32_sha1(F.col("sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, first).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write one record a row of pages (page_id, url, html) as WARC files under path."""
    rows = with_record_types(pages, least)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, "").otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, piece): what stands between occurrences of the magic, in order within a split."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


_LENGTH = re.compile(rb"(?:^|\r\n)content-length: *(\d+)", re.I)


def _successor(piece: bytes) -> int | None:
    """How far behind the start of this piece's magic its record ends, or None if it has no whole head."""
    head, sep, _ = piece.partition(b"\r\n\r\n")
    m = _LENGTH.search(head) if sep else None
    return len(MAGIC) + len(head) + 4 + int(m[1]) + 4 if m else None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, goes, size): places in the split. goes: where the chain from `at` leaves the split, or null if
    it breaks. A row with null `at` gives the split's size. Places become offsets once the splits' sizes are known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at, nexts = None, 0, []

        def solved() -> pd.DataFrame:
            leaves: dict[int, int | None] = {}
            for a, b in reversed(nexts):
                leaves[a] = b if b is None or b >= at else leaves.get(b)
            file, split = key
            own = list(leaves.items())
            return pd.DataFrame({"file": file, "split": split, "at": pd.array([None, *[a for a, _ in own]], "Int64"), "goes": pd.array([None, *[b for _, b in own]], "Int64"), "size": at})

        for pdf in batches:
            for file, split, n, goes in zip(pdf["file"], pdf["split"], pdf["n"], pdf["goes"], strict=True):
                if key != (file, split):
                    if key is not None:
                        yield solved()
                    key, at, nexts = (file, split), 0, []
                    if split == 0:  # the first piece of a file is what stands before its first magic
                        at = int(n)
                        continue
                nexts.append((at, None if pd.isna(goes) else at + int(goes)))
                at += len(MAGIC) + int(n)
        if key is not None:
            yield solved()

    rows = _pieces(spark, path)
    text = F.col("piece").cast("string")
    head = F.substring_index(text, END, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length: *(\d+)", 1)
    whole = (F.octet_length(head) < F.octet_length(text)) & (length != "")
    goes = F.when(whole, F.lit(len(MAGIC) + 8) + F.octet_length(head) + length.try_cast("long"))
    rows = rows.select("file", "split", F.octet_length("piece").cast("long").alias("n"), goes.alias("goes"))
    return rows.mapInPandas(run, "file string, split long, at long, goes long, size long")


def verified_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, base, entry, behind): for each split the offset of its first byte that Spark hands out and the
    offset of its first verified record (null: none begins there); behind: the first verified offset after the split."""
    found = common.materialise(candidates(spark, path), "boundaries")
    w = Window.partitionBy("file").orderBy("split")
    splits = found.where("at is null").select("file", "split", "size", (F.sum("size").over(w) - F.col("size")).alias("base"))
    splits = common.materialise(splits, "splits")
    small = common.small_or_shuffled(splits.select("file", "split", "base"))
    links = found.where("at is not null").join(small, ["file", "split"])
    links = links.select("file", "split", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("goes")).alias("goes"))
    # only candidates that some chain enters, and each file's start, can be entries
    entered = links.select("file", F.col("goes").alias("at")).where("at is not null").distinct()
    heads = links.groupBy("file").agg(F.min("at").alias("at")).where("at = 0")
    jump = links.join(entered.union(heads).distinct().hint("merge"), ["file", "at"], "left_semi").select("file", "at", "goes").distinct()
    starts = links.select("file", F.col("at").alias("goes")).distinct().hint("merge")
    jump = common.materialise(jump.hint("merge").join(starts, ["file", "goes"], "left_semi"), "jumps")
    reached, n = common.materialise(heads, "heads"), 0
    if jump.isEmpty():  # every file is one split
        n = None
    while n is not None:  # reached doubles in each round: what it reaches now, and what the pointers' own targets reach
        step = reached.hint("merge").join(jump, ["file", "at"]).where("goes is not null").select("file", F.col("goes").alias("at"))
        reached = reached.union(step).distinct().checkpoint()
        now = reached.count()
        if now == n:
            break
        n = now
        ahead = jump.select("file", F.col("at").alias("goes"), F.col("goes").alias("further"))
        jump = jump.hint("merge").join(ahead, ["file", "goes"], "left").select("file", "at", F.col("further").alias("goes")).where("goes is not null").checkpoint()
    entries = links.join(reached.hint("merge"), ["file", "at"], "left_semi").groupBy("file", "split").agg(F.min("at").alias("entry"))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    rows = splits.join(entries.hint("merge"), ["file", "split"], "left")
    end = F.max(F.col("base") + F.col("size")).over(Window.partitionBy("file"))
    rows = rows.withColumn("behind", F.coalesce(F.first("entry", ignorenulls=True).over(ahead), end))
    return common.materialise(rows.select("file", "split", "base", "entry", "behind"), "entries")


RECORD = "file string, offset long, record_type string, page_id long, refers_to long, url string, payload_length long, payload_digest string, payload binary"
PART = ", target long, place long, part binary"


def _parse(file: str, offset: int, data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
    page = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, ""))) else None
    payload = rest[: int(fields["content-length"])]
    return (file, offset, fields.get("warc-type"), page("warc-record-id"), page("warc-refers-to"), fields.get("warc-target-uri"), int(fields.get("warc-payload-length", len(payload))), fields.get("warc-payload-digest", "").removeprefix("sha1:"), payload)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in (RECORD + PART).split(", ")]
    longs = ("offset", "page_id", "refers_to", "payload_length", "target", "place")
    return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(longs, "Int64"))


def _nothing(file: str) -> tuple:
    return (file, *[None] * 8)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All verified records under path (RECORD)."""
    entries = verified_entries(spark, path)
    n = entries.count()
    if n <= common.BROADCAST_ROWS:  # the scan's order survives
        rows = _pieces(spark, path).join(F.broadcast(entries), ["file", "split"])
    else:
        rows = _pieces(spark, path).withColumn("nth", F.monotonically_increasing_id()).hint("merge").join(entries, ["file", "split"])
        rows = rows.repartition("file", "split").sortWithinPartitions("file", "split", "nth").drop("nth")
    magic = MAGIC.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records that lie in one split, and the parts of others: (file, target, place, part), target their end."""
        key, at, begin, stop, held, behind = None, 0, None, None, [], None
        for pdf in batches:
            out = []
            for file, split, base, entry, then, piece in zip(pdf["file"], pdf["split"], pdf["base"], pdf["entry"], pdf["behind"], pdf["piece"], strict=True):
                if key != (file, split):
                    if held:
                        out.append((*_nothing(key[0]), behind, begin, b"".join(held)))
                    key, at, begin, stop, held, behind = (file, split), int(base), None, None, [], int(then)
                    if split == 0:
                        at += len(piece)
                        continue
                data = magic + piece
                if pd.isna(entry) or at < entry:  # payload of a record that an earlier split began
                    out.append((*_nothing(file), behind if pd.isna(entry) else int(entry), at, data))
                elif held or (length := _successor(piece)) is not None:  # behind a broken head nothing is verified
                    if not held:
                        begin, stop = at, at + length
                    held.append(data)
                    if at + len(data) >= stop:
                        out.append((*_parse(file, begin, b"".join(held)), None, None, None))
                        held = []
                at += len(data)
            yield _frame(out)
        if held:
            yield _frame([(*_nothing(key[0]), behind, begin, b"".join(held))])

    found = rows.mapInPandas(run, RECORD + PART)
    names = [x.split()[0] for x in RECORD.split(", ")]
    whole = found.where("target is null").select(*names)
    if entries.where("entry is null or entry > base").isEmpty():
        return whole

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        data = b"".join(pdf["part"])
        length = _successor(data[len(magic) :])
        ok = length is not None and len(data) >= length
        return _frame([(*_parse(pdf["file"].iloc[0], int(pdf["place"].iloc[0]), data), None, None, None)] if ok else [])[names]

    return whole.unionByName(found.where("target is not null").groupBy("file", "target").applyInPandas(assemble, RECORD))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back: types, sizes and digests from the verified records."""
    common.prepare(spark)
    path = common.scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = read(spark, path)
    stored = F.col("record_type") == "response"
    digest = base32_sha1(F.sha1("payload"))
    return rows.select(
        "page_id",
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, digest).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
        F.when(stored, digest == F.col("payload_digest")).alias("digest_verified"),
    )
