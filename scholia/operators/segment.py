"""Paragraphs and overlapping chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs(docs: DataFrame, key: str, least: int = 80) -> DataFrame:
    """(key, index, text, char_start, char_end) of docs (key, text).

    Split at blank lines, or at line ends if that gives fewer than five pieces; pieces are trimmed, those below `least`
    characters are skipped, the others numbered. char_start is where the piece is first found from a running offset on;
    the offset moves behind a found piece, and by its length and two for a skipped one. One pass over each document's
    array of pieces, carrying the offset; no shuffle.
    """
    blank = F.split("text", r"\n\s*\n")
    pieces = F.when(F.size(blank) < 5, F.split("text", "\n")).otherwise(blank)
    cut = F.transform(pieces, lambda p: F.struct(F.regexp_replace(p, r"^\s+|\s+$", "").alias("own"), F.length(p).alias("raw")))
    item = "array<struct<index: int, text: string, char_start: int, char_end: int>>"
    start = F.struct(F.lit(0).alias("offset"), F.array().cast(item).alias("done"))

    def step(acc, piece):
        p, n = piece["own"], F.length(piece["own"])
        found = F.call_function("locate", p, F.col("text"), acc["offset"] + 1) - 1
        at = F.when(found < 0, acc["offset"]).otherwise(found)
        row = F.struct(F.size(acc["done"]).alias("index"), p.alias("text"), at.cast("int").alias("char_start"), (at + n).cast("int").alias("char_end"))
        skip = n < least
        return F.struct(F.when(skip, acc["offset"] + piece["raw"] + 2).otherwise(at + n).cast("int").alias("offset"), F.when(skip, acc["done"]).otherwise(F.array_append(acc["done"], row)).alias("done"))

    rows = F.aggregate(cut, start, step, lambda acc: acc["done"])
    return docs.where("text is not null").select(key, F.inline(rows))


def screen(segments: DataFrame, flag, length: int = 300) -> DataFrame:
    """Flagged paragraphs with a preview."""
    from scholia.functions.text import preview

    return segments.where(flag).withColumn("preview", preview(F.col("text"), length))


def _cut(text: str, size: int, overlap: int, least: int) -> list[tuple[int, str]]:
    """(start, stripped text) of each chunk."""
    if len(text) <= size:
        return [(0, text)] if text.strip() else []
    out, start = [], 0
    while start + size < len(text):
        end = start + size
        look = end - int(size * 0.2)
        for mark, after in (("\n\n", 2), (". ", 1)):
            at = text.rfind(mark, look, end + overlap)
            if at > start + size * 0.5:
                end = at + after
                break
        own = text[start:end].strip()
        if len(own) > least:
            out.append((start, own))
        start = max(start, end - overlap)
    last = text[start:].strip()
    return [*out, (start, last)] if last else out


def chunks(docs: DataFrame, key: str, size: int = 12_000, overlap: int = 1_000, least: int = 200) -> DataFrame:
    """(key, chunk, start, text): windows of about `size` characters that end at a paragraph or sentence end if one lies
    in the last fifth, each beginning `overlap` characters before the end of the one before. A row's cuts depend on each
    other, so they are found in Python, a row at a time: Arrow batches would hold up to 10,000 texts and all their chunks."""
    cuts = F.udf(lambda text: list(_cut(text, size, overlap, least)), "array<struct<start: int, text: string>>", useArrow=False)
    rows = docs.where("text is not null").select(key, F.posexplode(cuts("text")).alias("chunk", "c"))
    return rows.select(key, "chunk", "c.start", "c.text")
