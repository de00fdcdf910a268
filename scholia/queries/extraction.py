"""Queries of extraction-result cleaning. A reaction is an order; its lines are its compounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import extraction as x
from scholia.plans.bindings import extraction_items, papers, table, with_views


def clean_pseudo(spark, d):
    rows = extraction_items(spark, d)
    smiles = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("R"), F.col("ord").cast("string"), F.lit("-I"))).otherwise(F.col("smiles"))
    e = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "name", smiles.alias("smiles")))).alias("l"))
    e = e.select("doc", F.transform("l", lambda v: F.struct(v["name"].alias("name"), v["smiles"].alias("smiles"), F.lit(None).cast("string").alias("general_form"))).alias("l"))
    return e.select("doc", F.posexplode(x.clean_pseudo(F.col("l"))).alias("pos", "e")).select("doc", "pos", "e.name", "e.smiles", "e.general_form")


def dedup_compounds(spark, d):
    return x.dedup_compounds(extraction_items(spark, d)).select("doc", "ord", "name")


def _line_sets(spark, d):
    """Each order's lines as sets of the digits of part and supplier."""
    rows = extraction_items(spark, d)
    item = F.array(F.concat(F.lit("n"), "name"), F.concat(F.lit("p"), (F.col("partner") % 3).cast("string")), F.concat(F.lit("s"), (F.col("partner") % 2).cast("string")), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f"), F.lit("g"), F.lit("h"), F.lit("i"))
    return rows.select("doc", "ord", item.alias("items"))


def jaccard_pairs(spark, d):
    return x.jaccard_pairs(_line_sets(spark, d)).select("doc", "a", "b", F.round("similarity", 6).alias("similarity"))


def dedup_reactions(spark, d):
    sets = _line_sets(spark, d)
    return x.greedy_keep(sets.select("doc", "ord"), x.jaccard_pairs(sets))


def normalize_reactions(spark, d):
    o = table(spark, d, "orders")
    conditions = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    rows = o.select(
        F.col("o_orderkey").alias("doc"), F.lit(None).cast("string").alias("id"), F.lit(None).cast(x.ENTITY).alias("reactants"), F.lit(None).cast(x.ENTITY).alias("products"), conditions.alias("conditions"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("yield"), F.create_map(F.lit("yield"), F.lit("alt")).alias("outcomes"), F.lit(None).cast("string").alias("entry_id"), F.concat(F.lit("e"), "o_custkey").alias("entry"),
    )
    out = x.normalize_reactions(rows)
    return out.select("doc", "id", F.array_join(F.map_keys("conditions"), ",").alias("keys"), "yield", "entry_id", F.size("reactants").alias("n"))


def normalize_compounds(spark, d):
    rows = extraction_items(spark, d).select("doc", "ord", F.when(F.col("ord") % 4 != 0, F.concat(F.lit(" "), "name")).alias("name"), "smiles", F.when(F.col("ord") == 1, "main").alias("role"))
    return x.normalize_compounds(rows)


def _schemes(spark, d):
    rows = extraction_items(spark, d)
    return rows.select("doc", F.lit("fig").alias("source"), "page", F.col("ord").alias("pos"), "name", "smiles")


def merge_figure_reactions(spark, d):
    return x.merge_figures(_schemes(spark, d), _known(spark, d))[0].select("doc", "id", "name")


def _known(spark, d):
    return extraction_items(spark, d).where("ord = 1").select("doc", F.upper("name").alias("name"))


def merge_figure_compounds(spark, d):
    return x.merge_figures(_schemes(spark, d), _known(spark, d))[1]


def overwrite_by_source(spark, d):
    p = papers(spark, d)
    text = p.select(F.col("id").alias("doc"), F.lit("text").alias("source"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title")).alias("data"))
    vision = p.select(F.col("id").alias("doc"), F.lit("vision").alias("source"), F.when(F.col("id") % 6 != 0, F.col("journal")).alias("data"))
    return x.overwrite_by_source(vision.unionByName(text))


def rgroup_long(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    inner = li.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("R"), "l_linenumber").alias("r"), F.create_map(F.lit("a"), F.col("p").cast("string"), F.lit("b"), F.lit("H")).alias("m"))
    maps = inner.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("r", "m"))).alias("rgroups"))
    return x.rgroup_long(maps)


def rgroup_assemble(spark, d):
    scaffolds = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("C[R1](N[R2])[R10][*:7]").alias("scaffold"))
    long = rgroup_long(spark, d).withColumn("rgroup", F.when(F.col("rgroup") == "R3", "R10").otherwise(F.col("rgroup")))
    return x.assemble(scaffolds, long)


def summary_totals(spark, d):
    rows = extraction_items(spark, d).groupBy("doc").agg(F.collect_list("name").alias("names"), F.collect_set("partner").alias("partners"))
    return x.totals(rows, ("names", "partners"))


_I = with_views("items")
_SETS = f"{_I}, s as (select doc, ord, list_distinct(['n' || name, 'p' || (partner % 3), 's' || (partner % 2), 'c', 'd', 'e', 'f', 'g', 'h', 'i']) as v from items), j as (select a.doc, a.ord as a, b.ord as b, len(list_intersect(a.v, b.v)) / len(list_distinct(a.v || b.v)) as similarity from s a join s b on a.doc = b.doc and a.ord < b.ord)"
QUERIES = {
    "clean_pseudo": (clean_pseudo, f"{_I} select doc, (ord - 1)::int as pos, name, case when ord % 3 <> 0 then smiles end as smiles, case when ord % 3 = 0 then 'R' || ord || '-I' end as general_form from items"),
    "dedup_compounds": (dedup_compounds, f"{_I} select doc, min(ord) as ord, name from items group by doc, name"),
    "jaccard_pairs": (jaccard_pairs, f"{_SETS} select doc, a, b, round(similarity, 6) as similarity from j where similarity > 0.8"),
    "dedup_reactions": (dedup_reactions, None),
    "normalize_reactions": (normalize_reactions, "select o_orderkey as doc, '' as id, 'priority,status' as keys, case when o_orderkey % 2 = 0 then o_orderstatus else 'alt' end as yield, 'e' || o_custkey as entry_id, 0 as n from orders"),
    "normalize_compounds": (normalize_compounds, f"{_I} select doc, ord, case when ord % 4 <> 0 then name else '' end as name, smiles, case when ord = 1 then 'main' else 'unknown' end as role from items"),
    "merge_figure_reactions": (merge_figure_reactions, f"{_I} select doc, 'fig_' || page || '_' || ord as id, name from items"),
    "merge_figure_compounds": (merge_figure_compounds, f"{_I} select doc, name, arg_min(smiles, ord) as smiles from items i where name <> (select name from items k where k.doc = i.doc and k.ord = 1) group by doc, name"),
    "overwrite_by_source": (overwrite_by_source, with_views("papers") + "select id as doc, case when id % 3 <> 0 and title <> '' then 'text' else 'vision' end as source, case when id % 3 <> 0 and title <> '' then title else journal end as data from papers where (id % 3 <> 0 and title <> '') or id % 6 <> 0"),
    "rgroup_long": (rgroup_long, "with g as (select l_orderkey as doc, l_linenumber as n, min(l_partkey) as p from lineitem group by all) select doc, 'R' || n as rgroup, 'a' as entry, p::varchar as fragment from g union all select doc, 'R' || n, 'b', 'H' from g"),
    "rgroup_assemble": (
        rgroup_assemble,
        """with g as (select l_orderkey as doc, l_linenumber as n, min(l_partkey)::varchar as p from lineitem group by all),
        w as (select doc, max(p) filter (n = 1) as r1, max(p) filter (n = 2) as r2, max(p) filter (n = 3) as r10, max(p) filter (n = 7) as r7 from g group by 1)
        select doc, 'a' as entry, 'C' || coalesce(r1, '[*:1]') || '(N' || coalesce(r2, '[*:2]') || ')' || coalesce(r10, '[*:10]') || coalesce(r7, '[*:7]') as smiles from w
        union all select doc, 'b', 'C' || case when r1 is null then '[*:1]' else '' end || '(N' || case when r2 is null then '[*:2]' else '' end || ')' || case when r10 is null then '[*:10]' else '' end || case when r7 is null then '[*:7]' else '' end from w""",
    ),
    "summary_totals": (summary_totals, f"{_I} select doc, count(*) as n_names, count(distinct partner) as n_partners, count(*) + count(distinct partner) as total, false as empty from items group by 1"),
}
