"""Benchmark decontamination: approximate search for test items by pigeonhole pieces and Myers' bit-parallel distance.

Texts and items are normalised to lower-case words separated by single spaces. An item of n characters may differ by
`budget(n)` edits. Cut into one piece more than that, at least one piece of any such occurrence is free of edits, so the
search for exact piece hits misses none. Around each hit, Myers' algorithm computes the least edit distance between the
whole item and any stretch of text there.

Items are the query set. They are searched in blocks of at most `block` items, each one automaton over its pieces, so
what a task holds is bounded whatever the number of items or documents.

Defined cases: null, empty and word-free texts match nothing; items shorter than `least_chars` after normalisation are
matched exactly (no budget), as whole words, and word-free items not at all; equal items give the same spans, each under its own id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ERROR_RATE, LEAST_CHARS, BLOCK = 0.05, 24, 5_000
_NO_WORD = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _NO_WORD.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> int:
    return 0 if n < least_chars else int(n * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of like length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best stretch of text within k edits of the pattern with these masks; the first on ties."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for i, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # row 0 is free: a stretch may begin anywhere
        pv = ((mh << 1) & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


class Searcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, where = [], {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            k = budget(len(text), rate)
            masks: dict[str, int] = {}
            for i, ch in enumerate(text):
                masks[ch] = masks.get(ch, 0) | 1 << i
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text), the best occurrence of each item in the text."""
        if not len(self.automaton):
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, owners) in self.automaton.iter(text):
            for j, at in owners:
                _, item, k, _ = self.items[j]
                begin = end + 1 - n - at
                if not k and (text[begin - 1 : begin] not in ("", " ") or text[end + 1 : end + 2] not in ("", " ")):
                    continue  # an exact item stands as words of its own
                windows.setdefault(j, []).append((max(0, begin - k), begin + len(item) + k))
        found = []
        for j, spans in windows.items():
            item_id, item, k, masks = self.items[j]
            best = None
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            for a, b in merged:
                got = myers(masks, len(item), text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
            if best:
                found.append((item_id, *best))
        return found


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, end) for each document and item within its budget, once a pair."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").where("text is not null")
    items = items.select("item_id", "text").where("text is not null and item_id is not null")
    out = None
    for number in range(max(1, -(-items.count() // block))):
        # a block of items is bounded by a parameter; only that many are in memory anywhere
        own = items.orderBy("item_id", "text").offset(number * block).limit(block).collect()
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own])

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            searcher = Searcher(held.value, rate)
            length = {i: len(t) for i, t, _, _ in searcher.items}
            for pdf in batches:
                found = [(d, i, e, length[i], end) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, e, end in searcher.search(normalise(t))]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "item_chars", "end"])

        part = rows.mapInPandas(run, f"doc_id {kind}, item_id long, distance int, item_chars int, end long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """docs without the documents that hold an item. Documents with a null doc_id can't be named by a match and stay."""
    hit = common.materialise(matches(docs, items, rate).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return docs.join(common.small_or_shuffled(hit), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
