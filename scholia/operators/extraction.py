"""Cleaning, deduplication, merging and completion of nested extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.plans.lineage import cut

from .retrieval import sized

ENTITY = "array<struct<name: string, smiles: string, general_form: string>>"


def clean_pseudo(entities: Column, *, keep_form: bool = True) -> Column:
    """Entities (name, smiles, general_form) whose structure is a placeholder lose it, to general_form if that is kept."""
    def one(e: Column) -> Column:
        pseudo = (e["smiles"] != "") & tx.smiles_is_pseudo(e["smiles"])
        e = e.withField("general_form", F.when(pseudo, e["smiles"]).otherwise(e["general_form"])) if keep_form else e
        return e.withField("smiles", F.when(pseudo, F.lit(None).cast("string")).otherwise(e["smiles"]))

    return F.transform(entities, one)


def dedup_compounds(rows: DataFrame, key: str = "doc", order: str = "ord") -> DataFrame:
    """The first compound of each document per lower-cased name, or structure if it has no name; with neither it goes."""
    label = F.lower(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("smiles"), F.lit(""))))
    w = Window.partitionBy(key, "_label").orderBy(order)
    rows = rows.withColumn("_label", label).where("_label is not null")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_label")


#: Groups of at most so many sets are compared in one row each.
SMALL = 64


def jaccard_pairs(sets: DataFrame, threshold: float = 0.8, group: str = "doc", order: str = "ord") -> DataFrame:
    """(group, a, b, similarity): pairs (earlier, later) of sets (group, ord, items) of one group above the threshold.

    The sets of a group of at most `SMALL` are collected and compared in place; larger groups, of any size, are joined by
    `prefix_pairs`. Null items are none, empty sets never are compared.
    """
    sets = sets.select(group, order, F.array_compact(F.array_distinct("items")).alias("items")).where((F.size("items") > 0) & F.col(group).isNotNull())
    large = cut(sets.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(group))
    rest = not large.isEmpty()
    small = sets.join(sized(large), group, "left_anti") if rest else sets
    lists = small.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "items"))).alias("l"))
    pair = lambda x, y: F.struct(x["at"].alias("a"), y["at"].alias("b"), F.size(F.array_intersect(x["items"], y["items"])).alias("both"), (F.size(x["items"]) + F.size(y["items"])).alias("of"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: pair(x, y))))
    similarity = lambda p: p["both"] / (p["of"] - p["both"])
    near = F.filter(pairs, lambda p: (p["a"] < p["b"]) & (similarity(p) > threshold))
    found = lists.select(group, F.explode(near).alias("p")).select(group, "p.a", "p.b", similarity(F.col("p")).alias("similarity"))
    return found.union(prefix_pairs(sets.join(sized(large), group, "left_semi"), threshold, group, order)) if rest else found


def prefix_pairs(sets: DataFrame, threshold: float, group: str, order: str) -> DataFrame:
    """jaccard_pairs for groups of any size.

    Prefix filter: with items ordered by how rare they are in the group, two such sets share one of their first
    n - ceil(t n) + 1 items. Only pairs that share one are compared; empty sets never are.
    """
    items = sets.where(F.size("items") > 0).select(group, order, F.explode(F.array_distinct("items")).alias("item"))
    df = items.groupBy(group, "item").agg(F.count("*").alias("df"))
    ranked = items.hint("merge").join(df, [group, "item"]).groupBy(group, order).agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("r"))
    n = F.size("r")
    prefix = ranked.withColumn("items", F.transform("r", lambda x: x["item"])).select(group, order, "items", F.slice("r", F.lit(1), (n - F.ceil(threshold * n) + 1).cast("int")).alias("p"))
    keys = prefix.select(group, order, F.explode(F.transform("p", lambda x: x["item"])).alias("item"))
    a, b = keys.select(group, "item", F.col(order).alias("a")), keys.select(group, "item", F.col(order).alias("b"))
    pairs = a.hint("merge").join(b, [group, "item"]).where("a < b").select(group, "a", "b").distinct()
    body = prefix.select(group, F.col(order), "items")
    both = pairs.hint("merge").join(body.select(group, F.col(order).alias("a"), F.col("items").alias("x")), [group, "a"]).hint("merge").join(body.select(group, F.col(order).alias("b"), F.col("items").alias("y")), [group, "b"])
    s = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return both.select(group, "a", "b", s.alias("similarity")).where(F.col("similarity") > threshold)


def greedy_keep(nodes: DataFrame, pairs: DataFrame, group: str = "doc", order: str = "ord") -> DataFrame:
    """nodes (group, ord) that a pass in order keeps: a node goes if a kept earlier one is paired with it.

    Rounds decide all nodes whose earlier partners are decided; each round is two joins over the pairs still open.
    """
    open_ = nodes.select(group, order)
    before = cut(pairs.select(group, F.col("b").alias(order), F.col("a").alias("earlier")))
    kept = None
    while True:
        waiting = before.groupBy(group, order).agg(F.count("*").alias("n"))
        sure = cut(open_.join(waiting, [group, order], "left_anti"))
        kept = sure if kept is None else kept.union(sure)
        if before.isEmpty():
            return kept
        gone = before.join(sure.select(group, F.col(order).alias("earlier")), [group, "earlier"], "left_semi").select(group, order).distinct()
        gone = cut(gone)
        open_ = cut(open_.join(sure, [group, order], "left_anti").join(gone, [group, order], "left_anti"))
        before = cut(before.join(gone, [group, order], "left_anti").join(gone.select(group, F.col(order).alias("earlier")), [group, "earlier"], "left_anti"))


def normalize_reactions(rows: DataFrame) -> DataFrame:
    """yield hoisted from outcomes, entry_id from entry, conditions in order of their keys, missing lists empty."""
    empty = F.array().cast(ENTITY)
    return rows.select(
        "doc", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("reactants", empty).alias("reactants"), F.coalesce("products", empty).alias("products"),
        F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string, string>"))))).alias("conditions"),
        F.coalesce("yield", F.col("outcomes")["yield"]).alias("yield"), F.coalesce("entry_id", "entry").alias("entry_id"),
    )


def normalize_compounds(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    return rows.select("doc", "ord", blank("name"), blank("smiles"), F.coalesce("role", F.lit("unknown")).alias("role"))


def merge_figures(schemes: DataFrame, compounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reactions, new compounds) from figure schemes (doc, source, page, pos, name, smiles): reactions numbered
    source_page_n over the document; names that compounds (doc, name) lack, each once."""
    w = Window.partitionBy("doc").orderBy("page", "pos")
    reactions = schemes.withColumn("id", F.concat_ws("_", "source", F.col("page").cast("string"), F.row_number().over(w).cast("string")))
    fresh = schemes.where(F.trim("name") != "").withColumn("low", F.lower("name"))
    fresh = fresh.join(compounds.select("doc", F.lower("name").alias("low")), ["doc", "low"], "left_anti")
    first = fresh.groupBy("doc", "low").agg(F.min_by(F.struct("name", "smiles"), F.struct("page", "pos")).alias("r"))
    return reactions, first.select("doc", "r.name", "r.smiles")


def overwrite_by_source(results: DataFrame, priority: tuple[str, ...] = ("text", "vision")) -> DataFrame:
    """Of each document's results (doc, source, data) that of the first source with any data."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    full = results.where((F.coalesce(F.length("data"), F.lit(0)) > 0) & (rank > 0))
    return full.groupBy("doc").agg(F.min_by(F.struct("source", "data"), rank).alias("r")).select("doc", "r.source", "r.data")


def rgroup_long(tables: DataFrame, key: str = "doc", column: str = "rgroups") -> DataFrame:
    """(doc, rgroup, entry, fragment) of maps rgroup -> entry -> fragment."""
    rows = tables.select(key, F.explode(column).alias("rgroup", "entries"))
    return rows.select(key, "rgroup", F.explode("entries").alias("entry", "fragment"))


def filled(scaffold: Column, parts: Column) -> Column:
    """The scaffold with parts (rgroup, fragment) put in, longest tags first.

    `[Rn]` becomes `[*:n]` and `[*]` `[*:1]`; empty, H and NONE fragments delete the tag; null if nothing is left.
    """
    normal = F.regexp_replace(F.regexp_replace(F.trim(scaffold), r"\[R(\d+)\]", "[*:$1]"), r"\[\*\]", "[*:1]")

    def tagged(p: Column) -> Column:
        tag = F.concat(F.lit("[*:"), F.regexp_replace(p["rgroup"], "^R+", ""), F.lit("]"))
        fragment = F.trim(F.coalesce(p["fragment"], F.lit("")))
        return F.struct(-F.length(tag), tag.alias("tag"), F.when(F.upper(fragment).isin("NONE", "H", ""), "").otherwise(fragment).alias("fragment"))

    whole = F.aggregate(F.array_sort(F.transform(parts, tagged)), normal, lambda acc, p: F.replace(acc, p["tag"], p["fragment"]))
    whole = F.replace(whole, F.lit("[*]"), F.lit(""))
    return F.when(F.trim(whole) != "", whole)


def assemble(scaffolds: DataFrame, long: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, entry, smiles): each entry's fragments put into the document's scaffold, see `filled`."""
    parts = long.groupBy(key, "entry").agg(F.collect_list(F.struct("rgroup", "fragment")).alias("parts"))
    rows = scaffolds.select(key, "scaffold").hint("merge").join(parts, key)
    return rows.select(key, "entry", filled(F.col("scaffold"), F.col("parts")).alias("smiles"))


def totals(rows: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Items of each list and in all, and whether there is nothing."""
    sizes = {c: F.coalesce(F.size(c), F.lit(0)) for c in lists}
    every = sum(sizes.values(), F.lit(0))
    return rows.select("doc", *[n.alias(f"n_{c}") for c, n in sizes.items()], every.alias("total"), (every == 0).alias("empty"))
