"""Token counts: huge texts are encoded as overlapping chunks whose encodings are spliced where both agree.

A text of more than `chunk_chars` is cut into chunks that overlap. Each chunk is encoded alone, with offsets. Two
neighbours are spliced at a place inside their overlap that (1) is a token boundary in both encodings and (2) is proven
stable (`stable`): the byte-level pattern always parts there, so what stands elsewhere can't move it. Where an overlap
holds no such place, it is widened to the last one on its left; a stretch without any is encoded once, as a whole.

Chunks are rows: one huge text is spread over many tasks, and only their numbers of tokens meet again.

Defined cases: null and empty texts have 0 bytes and 0 tokens; null doc_id and repeated rows stay rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_memo import load, memo

#: Marks that are no letters in any version of Unicode and begin or end no special token.
_MARKS = frozenset(" \t\n\r!\"#$%&()*+,-./:;=?@[\\]^_`{}~，。、；：？！（）《》「」『』")

#: Letters that every version of Unicode in use has: Latin, Greek, Cyrillic, Chinese, Japanese, Korean.
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-Ωα-ωЀ-ҁ一-龥ぁ-んァ-ヶ가-힣]")


def stable(text: str, i: int) -> bool:
    """Whether a token boundary before text[i] holds whatever surrounds it: before a space behind a non-space, before a
    mark behind a letter, and before a letter of ASCII or a mark behind a digit. The pattern's tokens never go on there:
    in all of its alternatives a space comes first, and a letter or digit is followed by its like alone."""
    if not 0 < i < len(text):
        return False
    left, right = text[i - 1], text[i]
    if right == " ":
        return not left.isspace()
    if right in _MARKS:
        return "0" <= left <= "9" or _LETTER.match(left) is not None
    return "0" <= left <= "9" and ("a" <= right <= "z" or "A" <= right <= "Z")


def last_stable(text: str) -> int | None:
    """The last stable place of text."""
    return next((i for i in range(len(text) - 1, 0, -1) if stable(text, i)), None)


def seam(left: list[int], right: list[int], text: str) -> int | None:
    """The first place of text that is stable and a boundary of both encodings (given by their tokens' starts)."""
    for i in sorted(set(left).intersection(right)):
        if stable(text, i):
            return i
    return None


def _starts(tokenizer, text: str) -> list[int]:
    return [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]


def spliced_count(pieces: list[str], overlap: int, tokenizer) -> int:
    """Tokens of a text whose pieces overlap by `overlap` characters each. An overlap without a seam is widened to the last
    stable place on its left; where there is none, the left part grows by the piece, not encoded yet. So each character
    is encoded twice at most."""
    total, held, at = 0, [pieces[0]], last_stable(pieces[0])
    for piece in pieces[1:]:
        fresh = piece[overlap:]
        if at is not None:
            text = "".join(held)
            starts = _starts(tokenizer, text)
            # the right encoding begins at the seam; the left one must have it as well
            if at in starts:
                total += sum(s < at for s in starts)
                held, at = [text[at:]], None
        # a stable place may lie between what is held and what is new
        near = (held[-1][-1:] if held[-1] else "") + fresh
        size = sum(map(len, held))
        place = last_stable(near)
        held.append(fresh)
        if place is not None:
            at = size + place - (len(near) - len(fresh))
    return total + len(_starts(tokenizer, "".join(held)))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks) of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").alias("n_chars"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": [len(x) // 4 for x in memo(tokenizer).encode(pdf["text"].tolist())], "n_chunks": 1})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                starts = range(0, len(r.text), chunk_chars)
                yield pd.DataFrame({"row": r.row, "doc_id": r.doc_id, "n_bytes": r.n_bytes, "chunk": range(len(starts)), "base": [max(0, i - overlap) for i in starts], "piece": [r.text[max(0, i - overlap) : i + chunk_chars + overlap] for i in starts]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load(tokenizer)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                starts = _starts(t, r.piece)
                cuts = [(s + r.base, i) for i, s in enumerate(starts) if stable(r.piece, s)]
                middle = r.chunk * chunk_chars
                left = [x for x in cuts if r.chunk and abs(x[0] - middle) < overlap]
                right = [x for x in cuts if abs(x[0] - middle - chunk_chars) < overlap]
                out.append((r.row, r.doc_id, r.n_bytes, r.chunk, len(starts), [x[0] for x in left], [x[1] for x in left], [x[0] for x in right], [x[1] for x in right]))
            yield pd.DataFrame(out, columns=["row", "doc_id", "n_bytes", "chunk", "n", "left_at", "left_n", "right_at", "right_n"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # long texts are read twice below by the numbers they have here, so these are written once
    long = common.materialise(rows.where(F.col("n_chars") > chunk_chars), "long-texts")
    pieces = long.mapInPandas(cut, f"row long, doc_id {kind}, n_bytes long, chunk long, base long, piece string")
    chunks = pieces.repartition(n_parts, "row", "chunk").mapInPandas(encode, f"row long, doc_id {kind}, n_bytes long, chunk long, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")
    w = Window.partitionBy("row").orderBy("chunk")
    # the seam with the chunk behind: the first place that both encodings have
    chunks = chunks.withColumn("next_at", F.lead("left_at").over(w)).withColumn("next_n", F.lead("left_n").over(w))
    chunks = chunks.withColumn("seam", F.get(F.filter("right_at", lambda x: F.array_contains("next_at", x)), F.lit(0)))
    stop = F.when(F.col("next_at").isNull(), F.col("n")).otherwise(F.element_at("right_n", F.array_position("right_at", F.col("seam")).cast("int")))
    begin = F.element_at("next_n", F.array_position("next_at", F.col("seam")).cast("int"))
    chunks = chunks.withColumn("stop", stop).withColumn("skip", F.lag(begin, 1).over(w))
    chunks = chunks.withColumn("own", F.col("stop") - F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("skip")))
    sums = chunks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("own").alias("n_tokens"), F.count("*").alias("n_chunks"), F.max(F.col("own").isNull()).alias("failed"))
    sums = common.materialise(sums, "chunk-counts")
    parts = [rows.where(F.col("n_chars") <= chunk_chars).select("doc_id", "n_bytes", "text").mapInPandas(whole, f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks long"), sums.where("not failed").select("doc_id", "n_bytes", "n_tokens", "n_chunks")]

    failed = sums.where("failed").select("row")
    n_failed = failed.count()
    if n_failed:  # an overlap without a seam: splice these texts with ever wider overlaps
        def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = load(tokenizer)
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    cuts = [r.text[max(0, i - overlap) : i + chunk_chars] for i in range(0, len(r.text), chunk_chars)]
                    yield pd.DataFrame({"doc_id": [r.doc_id], "n_bytes": [r.n_bytes], "n_tokens": [spliced_count(cuts, overlap, t)], "n_chunks": [len(cuts)]})

        again = long.join(common.small_or_shuffled(failed, n_failed), "row", "left_semi")
        parts.append(again.select("doc_id", "n_bytes", "text").mapInPandas(widen, f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks long"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.prepare(spark)
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
