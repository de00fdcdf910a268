"""Spelling variants: words within one inserted, deleted or replaced code point, found over a relational trie.

The words of a corpus form two tries, of the words and of the words reversed. A trie is an edge table: nodes where words
part or end, edges labelled with the code points from one such node to the next. A frontier of states (word, position,
node, edits) walks it by joins, level by level, until no state is left; a state that has used its one edit and ends
where its word and a word of the trie end makes these two neighbours.

Two words one edit apart agree up to their first difference and from their last one on, and these two stretches have
together at least a code point less than the word. So one of them reaches the word's middle: each word starts from the
nodes of its own second half, in either trie, where its edit can only be right there, and never fans out from the root.
Nodes are known by a 64-bit hash of what leads to them; nodes that share a hash could only add neighbours, and every pair
is compared at the end.

A word's form is its neighbour of largest count (ties: least in code-point order) if that is at least `FACTOR` times the
word's; its root is the last word that forms lead to, found by pointer jumping. Counts grow along forms, so they end.

Defined cases: null and empty texts have no word; a null doc_id counts as the empty string where words are changed; rows
with the same doc_id are texts of their own; an empty table gives no rows. Only doc_id and text are read. Words may be
of any length: their number of levels is that of the places where words part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_CHARS, LEAST_COUNT, FACTOR, EVERY = 6, 5, 5, 199
#: Words held by a task before they are given on; texts are read in slices of so many characters.
HELD, SLICE = 300_000, 1 << 20
_RUN, _GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_MASK = (1 << 64) - 1


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters of text with A-Z in lower case, a list for each slice."""
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def changed(doc_id: str, counts: Counter, every: int = EVERY) -> Iterator[tuple[str, int]]:
    """(word, n) of a document: a run goes without one code point if its checksum with the doc_id says so."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences. Counted where texts are read."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        flush = lambda: pd.DataFrame({"word": list(held), "n": list(held.values())})
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own: Counter = Counter()
                for words in runs(text):
                    own.update(words)
                for word, n in changed(doc_id, own):
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    words = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return common.materialise(words.where(F.col("n") >= least_count), "words")


def paths(words: DataFrame) -> DataFrame:
    """(word, side, text, pos, node, next, own) of both tries. text is the word (side 1) or its reverse (2); node stands for its first pos
    code points, next is the code point behind ('' at the end). own: whether the word itself starts there; the places
    before are for words one code point shorter."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["word", "side", "text", "pos", "node", "next", "own"]
        out = []
        for pdf in batches:
            for word in pdf["word"]:
                n = len(word)
                for side, text, first, start in ((1, word, (n - 1) // 2, n // 2), (2, word[::-1], n // 2, n - n // 2)):
                    node = side
                    for i in range(n + 1):
                        if i >= first:
                            x = (node ^ node >> 31) * 0xBF58476D1CE4E5B9 & _MASK
                            x = (x ^ x >> 29) * 0x94D049BB133111EB & _MASK
                            x ^= x >> 32
                            out.append((word, side, text, i, x - (x >> 63 << 64), text[i : i + 1], i >= start))
                            if len(out) >= 50_000:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
                        if i < n:
                            node = (node * 0x9E3779B97F4A7C15 + ord(text[i]) + 1) & _MASK
        yield pd.DataFrame(out, columns=columns)

    return words.select("word").mapInPandas(walk, "word string, side int, text string, pos int, node long, next string, own boolean")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, starts). edges: (node, label, child, ends), ends the words that end at child. An edge with the label ''
    leads a node to itself, for the words that end there. starts: (word, text, pos, node) in the word's second half."""
    rows = common.materialise(paths(words), "paths")
    stops = rows.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.count("*").alias("n"))
    stops = common.materialise(stops.where("lo <> hi or lo = ''").select("node", "n"), "stops")
    own = common.join_hot(rows, stops, "node", "n", "n").where("n is not null")
    at = F.struct("pos", "node", "own")
    own = common.materialise(own.groupBy("word", "side", "text").agg(F.sort_array(F.collect_list(at)).alias("stops")), "own-stops")
    first, last = F.slice("stops", 1, F.size("stops") - 1), F.slice("stops", 2, F.size("stops") - 1)
    steps = own.select("word", "text", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("x"))
    steps = steps.select(F.col("x.a.node").alias("node"), F.substring("text", F.col("x.a.pos") + 1, F.col("x.b.pos") - F.col("x.a.pos")).alias("label"), F.col("x.b.node").alias("child"), F.when(F.col("x.b.pos") == F.length("text"), F.col("word")).alias("end"))
    here = own.select(F.col("stops")[F.size("stops") - 1]["node"].alias("node"), F.lit("").alias("label"), F.col("stops")[F.size("stops") - 1]["node"].alias("child"), F.col("word").alias("end"))
    edges = steps.union(here).groupBy("node", "label", "child").agg(F.collect_set("end").alias("ends"))
    starts = own.select("word", "text", F.inline("stops")).where("own").select("word", "text", "pos", "node")
    return common.materialise(edges, "edges"), common.materialise(starts, "starts")


def follow(states: DataFrame, edges: DataFrame, few: bool, on) -> DataFrame:
    """States with the edges of their nodes for which `on` holds. Nodes that hold over a thousandth of the states are
    fewer than a thousand, and a node has no more edges than the alphabet has letters: these edges are broadcast."""
    same = F.col("s.node") == F.col("e.node")
    if few:
        return states.alias("s").join(F.broadcast(edges.alias("e")), same & on)
    counts = states.groupBy("node").agg(F.count("*").alias("n"))
    total = states.count()
    hot = common.materialise(counts.where(F.col("n") > total / 1000).select("node"), "hot-nodes")
    theirs = common.materialise(edges.join(F.broadcast(hot), "node", "left_semi"), "hot-edges")
    small = (theirs.agg(F.sum(F.octet_length("label") + 64)).first()[0] or 0) <= common.BROADCAST_BYTES
    if not small:
        return states.alias("s").hint("merge").join(edges.alias("e"), same & on)
    columns = [*[F.col(f"s.{c}") for c in states.columns], *[F.col(f"e.{c}").alias(f"to_{c}") for c in edges.columns]]
    rest = states.join(F.broadcast(hot), "node", "left_anti").select(*states.columns)
    a = states.alias("s").join(F.broadcast(theirs.alias("e")), same & on).select(*columns)
    b = rest.alias("s").hint("merge").join(edges.alias("e"), same & on).select(*columns)
    both = a.union(b)
    return both.select(F.struct(*states.columns).alias("s"), F.struct(*[F.col(f"to_{c}").alias(c) for c in edges.columns]).alias("e"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of the words (word) that are one edit apart."""
    edges, states = trie(words)
    few = edges.count() <= common.BROADCAST_ROWS and (edges.agg(F.sum(F.octet_length("label"))).first()[0] or 0) <= common.BROADCAST_BYTES
    k, pos = F.length("e.label"), F.col("s.pos")
    part = lambda start, size: F.substring("s.text", start + 1, size)
    behind = F.substring("e.label", F.lit(2), k)
    left = F.length("s.text") - pos
    other = (k > 0) & (F.substring("e.label", F.lit(1), F.lit(1)) != part(pos, F.lit(1)))
    edits = [
        (other & (left > 0) & (behind == part(pos + 1, k - 1)), pos + k),  # replaced
        (other & (behind == part(pos, k - 1)), pos + k - 1),  # one more in the other word
        (other & (left > 0) & (F.col("e.label") == part(pos + 1, k)), pos + 1 + k),  # one more in this word
        ((k == 0) & (left == 1), pos + 1),
    ]
    first = edits[0][0] | edits[1][0] | edits[2][0] | edits[3][0]
    places = F.filter(F.array(*[F.when(c, p) for c, p in edits]), lambda x: x.isNotNull())
    level, near = 0, []
    while True:
        on, to = (first, F.explode(places)) if not level else ((k > 0) & (F.col("e.label") == part(pos, k)), pos + k)
        found = follow(states, edges, few, on).select("s.word", "s.text", to.alias("pos"), F.col("e.child").alias("node"), F.col("e.ends").alias("ends"))
        found = common.materialise(found.distinct(), f"frontier-{level}")
        near.append(found.where("pos = length(text)").select("word", F.explode("ends").alias("near")))
        states = found.where("pos < length(text)").select("word", "text", "pos", "node")
        if states.isEmpty():
            break
        level += 1
    out = near[0]
    for x in near[1:]:
        out = out.union(x)
    return common.materialise(out.distinct().where(F.levenshtein("word", "near", 1) == 1), "neighbours")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): where they lead in the end. Each round doubles the steps taken."""
    step = common.materialise(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rows = step.hint("merge").join(ahead, "root", "left")
        rows = common.materialise(rows.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "jumped")
        step = rows.select("word", "root")
        if rows.where("moved").isEmpty():
            return step


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    near = neighbours(words)
    counted = near.hint("merge").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    rows = words.hint("merge").join(best, "word", "left")
    strong = -F.col("best.n") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"))
    rows = common.materialise(rows, "forms")
    ends = roots(rows.where("form is not null"))
    out = rows.hint("merge").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: CRC-32 as a fold over bytes; neighbours by joins on words without one code point.
OP12_SQL = """
    with recursive runs as (
      select coalesce(doc_id::varchar, '') doc_id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[A-Za-zÀ-ÿ]+')) word
      from documents
    ),
    counts as (select doc_id, word, count(*) n from runs group by all),
    lut as (
      select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) x
      from (select unnest(range(256))::bigint i)
    ),
    hashed as (
      select word, n, xor(list_reduce(
          list_transform(range(0, strlen(doc_id || ':' || word)), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || word)), (2 * i + 1)::bigint, 2))::bigint),
          lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) h
      from counts, lut
    ),
    words as (
      select case when h % 199 = 0 then substr(word, 1, (h % length(word))::bigint) || substr(word, (h % length(word))::bigint + 2) else word end word, sum(n)::bigint n
      from hashed group by 1 having length(word) >= 6 and sum(n) >= 5
    ),
    cut as (
      select word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest
      from (select word, unnest(range(1, length(word) + 1)) i from words)
    ),
    near as (
      select a.word, b.word near from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
      union
      select a.word, b.word from cut a join words b on a.rest = b.word
      union
      select b.word, a.word from cut a join words b on a.rest = b.word
    ),
    best as (
      select r.word, count(*) n_near, arg_min(w.word, (-w.n, encode(w.word))) form, max(w.n) form_n
      from near r join words w on w.word = r.near group by 1
    ),
    forms as (
      select w.word, w.n, coalesce(n_near, 0) n_near,
        case when form_n >= 5 * w.n then form end form, case when form_n >= 5 * w.n then form_n end form_n
      from words w left join best b on w.word = b.word
    ),
    walk as (
      select word, word root, 0 step from forms
      union all
      select w.word, f.form, w.step + 1 from walk w join forms f on f.word = w.root where f.form is not null
    ),
    ends as (select word, arg_max(root, step) root from walk group by word)
    select word, form, root, n, n_near, form_n from forms join ends using (word)"""
