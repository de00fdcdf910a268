"""Keyword retrieval for a batch of queries: postings, scores, ranks, and the text blocks built from what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.plans.lineage import cut

#: Query tables of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: Pairs of a query and a document that a partition of documents may give.
PART_PAIRS = 400_000


def small(df: DataFrame) -> bool:
    """Whether df may be broadcast: its rows are counted."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small, else with a merge hint."""
    return F.broadcast(df) if small(df) else df.hint("merge")


def postings(docs: DataFrame, fields: Sequence[str], longer_than: int, key: str = "ord") -> DataFrame:
    """(word, key, tf): how often each word of the fields occurs in each document."""
    words = docs.select(key, F.explode(tx.tokens(F.concat_ws(" ", *fields), longer_than)).alias("word"))
    return words.groupBy("word", key).agg(F.count("*").alias("tf"))


def query_words(queries: DataFrame, longer_than: int) -> DataFrame:
    """(qid, word, qtf, qpos): the words of each query, how often and where first."""
    words = queries.select("qid", F.posexplode(tx.tokens(F.col("text"), longer_than)).alias("pos", "word"))
    return words.groupBy("qid", "word").agg(F.count("*").alias("qtf"), F.min("pos").alias("qpos"))


def parts(docs: DataFrame, queries: DataFrame) -> int:
    """Into how many partitions documents are dealt out, so that each gives at most about `PART_PAIRS` pairs with the
    queries. Their words are counted and scored where they are then: what one task holds doesn't grow with the tables."""
    each = max(500, PART_PAIRS // max(1, queries.count()))
    return max(1, -(-docs.count() // each))


def wanted_postings(q: DataFrame, docs: DataFrame, fields: Sequence[str], longer_than: int, key: str = "ord") -> DataFrame:
    """postings of those words alone that some query has: they are joined before anything is counted."""
    wanted = sized(q.select("word").distinct())
    words = docs.select(key, F.explode(tx.tokens(F.concat_ws(" ", *fields), longer_than)).alias("word"))
    return words.join(wanted, "word", "left_semi").groupBy("word", key).agg(F.count("*").alias("tf"))


def keyword_scores(q: DataFrame, tf: DataFrame, key: str = "ord") -> DataFrame:
    """(qid, key, score, qpos): the sum over query words of their counts on both sides."""
    hit = tf.join(sized(q), "word")
    return hit.groupBy("qid", key).agg(F.sum(F.col("qtf") * F.col("tf")).alias("score"), F.min("qpos").alias("qpos"))


def top_k(scored: DataFrame, k: int, order: Sequence[Column], by: str = "qid") -> DataFrame:
    """The first k rows of each query, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, fields: Sequence[str], longer_than: int = 3, k: int = 10) -> DataFrame:
    """(qid, ord, score, rank): ties go to the document that an earlier query word touched, then to the earlier one."""
    q = query_words(queries, longer_than)
    docs = docs.select("ord", *fields).repartition(parts(docs, queries), "ord")
    scored = keyword_scores(q, wanted_postings(q, docs, fields, longer_than))
    return top_k(scored, k, [F.desc("score"), F.col("qpos"), F.col("ord")]).select("qid", "ord", "score", "rank")


def containing(queries: DataFrame, docs: DataFrame, tf: DataFrame, whole: Sequence[str], longer_than: int, n: int = 1) -> DataFrame:
    """(qid, ord, fields): how many of the `whole` fields contain the query's lower-cased text, where any does.

    A text that contains a query has the query's inner words (those with another character on both sides) as words of its
    own. So only documents with the rarest of these are looked at; tf: postings of the query's words in those fields.
    Queries without such a word (one or two words) are held against all documents; an empty query is in none. n: into how
    many partitions these documents are dealt out, if their pairs with queries can't be broadcast.
    """
    q = queries.select("qid", F.lower("text").alias("q")).where("q <> ''")
    inner = tx.tokens(F.regexp_replace("q", f"^{tx.WORD}|{tx.WORD}$", ""), longer_than)
    words = q.select("qid", F.explode(F.array_distinct(inner)).alias("word"))
    often = sized(tf.groupBy("word").agg(F.count("*").alias("n")))
    rarest = words.join(often, "word", "left").groupBy("qid").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    rarest = cut(rarest)
    pairs = tf.select("word", "ord").join(sized(rarest), "word").select("qid", "ord")
    low = docs.select("ord", *[F.lower(F.col(c)).alias(c) for c in whole])
    some = low.join(F.broadcast(pairs), "ord") if small(pairs) else low.repartition(n, "ord").join(pairs.repartition(n, "ord").hint("merge"), "ord")
    some = some.join(sized(q), "qid")
    rest = low.join(sized(q.join(sized(rarest.select("qid")), "qid", "left_anti")), F.greatest(*[F.contains(F.col(c), F.col("q")) for c in whole], F.lit(False)))
    fields = sum((F.contains(F.col(c), F.col("q")).cast("int") for c in whole), F.lit(0)).alias("fields")
    return some.select("qid", "ord", fields).union(rest.select("qid", "ord", fields)).where("fields > 0")


def search_literature(queries: DataFrame, docs: DataFrame, fields: Sequence[str], whole: Sequence[str], title: str, k: int = 10) -> DataFrame:
    """search over words of more than two characters, plus 5 for each of the `whole` fields (which are among `fields`)
    that contains the query. Documents with a blank title are left out."""
    docs = docs.where(F.trim(F.col(title)) != "").select("ord", *dict.fromkeys((*fields, *whole)))
    n = parts(docs, queries)
    q = query_words(queries, 2)
    tf = cut(wanted_postings(q, docs.repartition(n, "ord"), fields, 2))
    contained = containing(queries, docs, tf, whole, 2, n).select("qid", "ord", (F.col("fields") * 5).cast("long").alias("score"))
    both = keyword_scores(q, tf).select("qid", "ord", "score").union(contained).repartition(n, "ord").groupBy("qid", "ord").agg(F.sum("score").alias("score"))
    return top_k(both, k, [F.desc("score"), F.col("ord")]).select("qid", "ord", "score", "rank")


def first_rows(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(by, ord): the first k rows of each value of a column."""
    return top_k(rows.where(F.col(by).isNotNull()).select(by, "ord"), k, [F.col("ord")], by).drop("rank")


def search_substring(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, name, rank): rows whose name contains the query; in the order in which their names first occur. An empty
    query is in every name.

    Equal queries are looked up once. A query's first k rows are among the first k rows of its first k names, so no more
    of them are joined, however often a name occurs.
    """
    from .containment import contained

    low = rows.select("ord", F.lower("name").alias("low"))
    few = cut(first_rows(low, "low", k))
    first = cut(few.groupBy("low").agg(F.min("ord").alias("name_ord")))
    q = cut(queries.select("qid", F.lower("text").alias("needle")))
    asked = cut(q.where("needle is not null").select("needle").distinct())
    hit = contained(asked.select(F.col("needle").alias("n"), "needle"), first.select(F.col("name_ord").alias("t"), F.col("low").alias("text")))
    hit = top_k(hit.select(F.col("n").alias("needle"), F.col("t").alias("name_ord")), k, [F.col("name_ord")], by="needle").drop("rank")
    blank = asked.where("needle = ''").crossJoin(F.broadcast(first.select("name_ord").orderBy("name_ord").limit(k)))
    hit = hit.union(blank).hint("merge").join(first, "name_ord").hint("merge").join(few, "low")
    best = cut(top_k(hit.select("needle", "name_ord", "ord"), k, [F.col("name_ord"), F.col("ord")], by="needle"))
    best = cut(best.select("needle", "ord", "rank").hint("merge").join(rows.select("ord", "id", "name"), "ord"))
    return q.join(sized(best), "needle").select("qid", "id", "name", "rank")


def either_way(queries: DataFrame, names: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, id): queries (qid, text) and names (id, name) of which one contains the other. Empty ones are in none. k: the
    k smallest ids of a query alone, from each way."""
    from .containment import contained

    q, n = cut(queries.select("qid", "text")), cut(names.select("id", "name"))
    ahead = contained(q.select(F.col("qid").alias("n"), F.col("text").alias("needle")), n.select(F.col("id").alias("t"), F.col("name").alias("text")))
    back = contained(n.select(F.col("id").alias("n"), F.col("name").alias("needle")), q.select(F.col("qid").alias("t"), "text"))
    both = [ahead.select(F.col("n").alias("qid"), F.col("t").alias("id")), back.select(F.col("t").alias("qid"), F.col("n").alias("id"))]
    if k:
        both = [top_k(x, k, [F.col("id")]).drop("rank") for x in both]
    return both[0].union(both[1]).distinct()


def best_overlap(queries: DataFrame, names: DataFrame, shorter: bool = False) -> DataFrame:
    """(qid, id): of the names (ord, id, name) that contain the query (qid, text) or that it contains, the one with the
    largest overlap (the shorter length), then the shorter name if `shorter` says so, then the earliest. Empty ones are in
    none. A query keeps the earliest name of each length, while pairs are found: their table is never written or shuffled."""
    from .containment import contained

    q, n = cut(queries.select("qid", "text")), cut(names.select("ord", "id", "name"))
    named = n.select(F.struct(F.length("name").alias("size"), "ord").alias("at"), "name")
    ahead = contained(q.select(F.col("qid").alias("n"), F.col("text").alias("needle")), named.select(F.col("at").alias("t"), F.col("name").alias("text")))
    back = contained(named.select(F.col("at").alias("n"), F.col("name").alias("needle")), q.select(F.col("qid").alias("t"), "text"))
    both = ahead.select(F.col("n").alias("qid"), "t.*").union(back.select(F.col("t").alias("qid"), "n.*"))
    first = both.groupBy("qid", "size").agg(F.min("ord").alias("ord")).hint("merge").join(q, "qid")
    order = F.struct((-F.least("size", F.length("text"))).alias("overlap"), (F.col("size") if shorter else F.lit(0)).alias("size"), "ord")
    best = cut(first.groupBy("qid").agg(F.min(order).alias("r")).select("qid", "r.ord"))
    return n.join(sized(best), "ord").select("qid", "id")


def tier_search(queries: DataFrame, rows: DataFrame, words: Sequence[str] = (), k: int = 10) -> DataFrame:
    """(qid, name, score, rank): the first tier that finds a name counts: equal 100, substring either way 50, class word
    40, shared token 10. rows (ord, name, cls); words: class names.

    Equal queries are looked up once, and each tier gives no more than its first k rows: those that come before the last
    of them in the tier are all ranked before it, so a query's k best are among these. In the same way a name, a class and
    a token give no more than their first k rows.
    """
    queries = cut(queries.select("qid", F.lower(F.trim("text")).alias("q")).where("q <> ''"))
    q = cut(queries.select("q").distinct())
    low = rows.select("ord", "cls", F.lower("name").alias("low"))
    few = cut(first_rows(low, "low", k))
    first = cut(few.groupBy("low").agg(F.min("ord").alias("name_ord")))
    tier = lambda found, score, n: top_k(found.select("q", "ord").distinct(), k, [F.col("ord")], by="q").select("q", "ord", F.lit(score).alias("score"), F.lit(n).alias("tier"))
    equal = few.hint("merge").join(q, F.col("low") == F.col("q"))
    part = either_way(q.select(F.col("q").alias("qid"), F.col("q").alias("text")), first.select(F.col("name_ord").alias("id"), F.col("low").alias("name")), k)
    part = top_k(part, k, [F.col("id")]).select(F.col("qid").alias("q"), F.col("id").alias("name_ord"))
    part = part.hint("merge").join(first, "name_ord").select("q", "low").hint("merge").join(few, "low")
    named = cut(q.select("q", F.explode(F.array_distinct(tx.tokens(F.col("q")))).alias("word")))
    of_class = first_rows(low.select("ord", F.lower("cls").alias("word")).join(sized(named.select("word").distinct()), "word", "left_semi"), "word", k)
    of_class = named.hint("merge").join(of_class, "word")
    qt = cut(q.select("q", F.explode(F.array_distinct(tx.alpha_tokens(F.col("q")))).alias("word")))
    nt = low.select("ord", F.explode(F.array_distinct(tx.alpha_tokens(F.col("low")))).alias("word")).join(sized(qt.select("word").distinct()), "word", "left_semi")
    token = qt.hint("merge").join(first_rows(nt, "word", k), "word")
    found = tier(equal, 100, 1).union(tier(part, 50, 2)).union(tier(of_class, 40, 3)).union(tier(token, 10, 4))
    found = found.groupBy("q", "ord").agg(F.min_by("score", "tier").alias("score"), F.min("tier").alias("tier"))
    best = top_k(found, k, [F.desc("score"), F.col("tier"), F.col("ord")], by="q")
    best = cut(best.hint("merge").join(rows.select("ord", "name"), "ord").select("q", "name", "score", "rank"))
    return queries.join(sized(best), "q").select("qid", "name", "score", "rank")


def retrieve(queries: DataFrame, names: DataFrame, docs: DataFrame, fields: Sequence[str], entries: DataFrame, entry_fields: Sequence[str], types: DataFrame, info: Column, k: int = 5) -> DataFrame:
    """(qid, kind, id, rank): all that a query's context is made of.

    compound: names (ord, id, name) that contain one of its words of more than three characters (the first two a word, in
    order of words), then those that contain the whole query; each once, k in all, names that are alike but for case
    being one. paper: the k best docs. entry: the k best of entries. type: types (id, name) whose name stands in the
    query. info: one row where the column info of queries holds, which asks for general information.
    """
    from .containment import contained

    q = cut(queries)
    words = q.select("qid", F.posexplode(tx.tokens(F.col("text"), 3)).alias("pos", "needle")).groupBy("qid", "needle").agg(F.min("pos").alias("pos"))
    whole = q.select("qid", F.lower("text").alias("needle"), F.lit(2**31 - 1).alias("pos"))
    asked = cut(words.select("qid", "pos", "needle").union(whole.select("qid", "pos", "needle")))
    first = cut(names.groupBy(F.lower("name").alias("text")).agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("t")))
    # a word that many queries have is looked up once
    hit = contained(asked.select(F.col("needle").alias("n"), "needle").distinct(), first.select("t", "text"))
    hit = cut(top_k(hit, k, [F.col("t")], by="n")).withColumnRenamed("n", "needle")
    hit = asked.hint("merge").join(hit, "needle").where((F.col("pos") == 2**31 - 1) | (F.col("rank") <= 2))
    hit = hit.groupBy("qid", "t").agg(F.min("pos").alias("pos"))
    compound = top_k(hit, k, [F.col("pos"), F.col("t")]).hint("merge").join(first.select("t", "id"), "t")
    named = contained(types.select(F.col("id").alias("n"), F.lower("name").alias("needle")), q.select(F.col("qid").alias("t"), F.lower("text").alias("text")))
    named = named.select(F.col("t").alias("qid"), F.col("n").alias("id")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    rows = lambda kind, df: df.select("qid", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col("rank").cast("int").alias("rank"))
    found = [rows("compound", compound), rows("type", named), rows("info", q.where(info).select("qid", F.lit(None).alias("id"), F.lit(1).alias("rank")))]
    for kind, table, columns, longer in (("paper", docs, fields, 3), ("entry", entries, entry_fields, 2)):
        found.append(rows(kind, search(q, table, columns, longer, k).withColumnRenamed("ord", "id")))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def context(queries: DataFrame, found: DataFrame, docs: DataFrame, n: int = 3, length: int = 200) -> DataFrame:
    """(qid, context): for each query its best documents, one numbered block each, in order of rank."""
    rows = found.where(F.col("rank") <= n).hint("merge").join(docs.select("ord", "title", "body", "journal"), "ord")
    block = F.format_string("%d. %s (%s)\n%s", F.col("rank"), F.col("title"), F.col("journal"), tx.preview(F.col("body"), length))
    blocks = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    blocks = blocks.select("qid", F.concat(F.lit("### Papers\n"), text).alias("context"))
    return queries.select("qid").join(blocks, "qid", "left").select("qid", F.coalesce("context", F.lit("No matching records.")).alias("context"))


def lines(first: Column, *fields: tuple[str, Column]) -> Column:
    """first, and below it a line `  - label: value` for each field that is neither null nor empty."""
    return F.concat_ws("\n", first, *[F.when(value != "", F.concat(F.lit(f"  - {label}: "), value)) for label, value in fields])


def entry_block(c: dict[str, Column], with_structures: Column) -> Column:
    """One line of a record: name | electrophile (type), leaving group | nucleophile (type), type | base (class), then its
    structures where asked for. `None` stands for a missing value in some fields."""
    some = lambda v: (v != "") & v.isNotNull()
    named = lambda v: some(v) & (v != "None")
    part = lambda test, before, v, behind="": F.when(test, F.concat(F.lit(before), v, F.lit(behind))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("- **"), F.coalesce(c["name"], F.lit("N/A")), F.lit("**"), part(some(c["e_major"]), " | Electrophile: ", c["e_major"]), part(some(c["e_type"]), " (", c["e_type"], ")"), part(named(c["e_lvg"]), ", LVG: ", c["e_lvg"]),
        part(some(c["nu_major"]), " | Nucleophile: ", c["nu_major"]), part(some(c["nu_type"]), " (", c["nu_type"], ")"), part(named(c["nu_lvg"]), ", Type: ", c["nu_lvg"]),
        part(named(c["base"]), " | Base: ", c["base"]), part(named(c["base_class"]), " (", c["base_class"], ")"),
    )
    structure = lambda label, v: F.when(with_structures & named(v), F.concat(F.lit(f"  - {label} SMILES: `"), v, F.lit("`")))
    return F.concat_ws("\n", head, structure("Electrophile", c["r1"]), structure("Nucleophile", c["r2"]))


def full_context(queries: DataFrame, found: DataFrame, parts: Sequence[tuple[str, str, DataFrame, Column]], info: str, most: int = 5) -> DataFrame:
    """(qid, context) of found (qid, kind, id, rank), as `retrieve` gives it: the general information where it was asked
    for, then a section for each of parts (kind, header, records with an id, block), at most `most` blocks in order of
    rank, one line after the other; empty where nothing was found. block may use the rank."""
    found = cut(found)
    rows = found.where("kind = 'info'").select("qid", F.lit(0).alias("section"), F.lit(1).alias("rank"), F.lit(info).alias("block"))
    for i, (kind, _, records, block) in enumerate(parts):
        own = found.where((F.col("kind") == kind) & (F.col("rank") <= most)).select("qid", "rank", "id")
        rows = rows.union(own.hint("merge").join(records, "id").select("qid", F.lit(i + 1), "rank", block))
    blocks = rows.groupBy("qid", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    header = F.element_at(F.array(F.lit(""), *[F.lit(f"\n### {h}\n") for _, h, _, _ in parts]), F.col("section") + 1)
    blocks = blocks.select("qid", "section", F.concat(header, F.array_join(F.transform("b", lambda x: x["block"]), "\n")).alias("text"))
    whole = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("s"))
    whole = whole.select("qid", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("context"))
    return queries.select("qid").hint("merge").join(whole, "qid", "left").select("qid", F.coalesce("context", F.lit("")).alias("context"))


def prompt_messages(history: DataFrame, system: str) -> DataFrame:
    """(conv_id, messages): the system message, then user and assistant turns in order, as role: content."""
    said = history.where(F.col("role").isin("user", "assistant"))
    said = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    rest = F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return said.select("conv_id", F.concat(first, rest).alias("messages"))
