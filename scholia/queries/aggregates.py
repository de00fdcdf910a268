"""Queries of aggregates, windows, lookups and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.operators import aggregates as a
from scholia.operators import relations as rel
from scholia.operators import retrieval as r
from scholia.plans.bindings import DIMS, compounds, extraction_items, ligands, papers, refs, table, with_views


def agg_stats_counts(spark, d):
    return rel.counts({n: table(spark, d, n) for n in ("documents", "part", "nation", "embeddings")})


def agg_literature_stats(spark, d):
    p = papers(spark, d)
    curated = F.trim("title") != ""
    return p.agg(F.count("*").alias("total"), F.count_if(curated).alias("curated"), F.count_if(~curated).alias("doi_only"), F.countDistinct("type").alias("classes"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("class_names"))


def agg_class_summary(spark, d):
    s = a.class_summary(ligands(spark, d), "cls", "name", "ord", DIMS[:4])
    return s.withColumn("names", F.array_join("names", ","))


def agg_class_compare(spark, d):
    return a.class_compare(ligands(spark, d), "cls", DIMS)


def agg_cluster_summary(spark, d):
    rows = ligands(spark, d).withColumn("cluster", F.col("ord") % 7)
    s = a.cluster_summary(rows, "cluster", "cls", DIMS)
    entries = F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("cluster", "n", F.array_join(entries, ",").alias("classes"), *[F.round(c, 6).alias(c) for c in DIMS])


def agg_tf_postings(spark, d):
    return r.postings(papers(spark, d), ["title", "body", "type", "journal"], 3)


def agg_extraction_stats(spark, d):
    from scholia.operators.segment import paragraphs

    seg = paragraphs(papers(spark, d).select("id", F.col("body").alias("text")), "id")
    return seg.agg(F.count("*").alias("paragraphs"), F.count_if(F.lower("text").contains("tion")).alias("with_reactions"), F.countDistinct("id").alias("documents"))


def agg_merge_pages(spark, d):
    rows = extraction_items(spark, d)
    names = a.distinct_in_order(rows, "doc", "name", ["page", "ord"])
    return names.select("doc", F.array_join("values", ";").alias("names"))


def agg_merge_conditions(spark, d):
    rows = extraction_items(spark, d).select("doc", "page", "ord", F.concat(F.lit("k"), (F.col("ord") % 3).cast("string")).alias("name"), F.col("smiles").alias("value"))
    out = a.first_non_empty(rows, "doc", "name", "value", ["page", "ord"])
    return out.select("doc", F.array_join(F.transform(F.map_entries("conditions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("conditions"))


def agg_merge_chunks(spark, d):
    """Items of all chunks of a document in order, numbered anew."""
    rows = extraction_items(spark, d).where("smiles <> ''")
    w = Window.partitionBy("doc").orderBy("page", "ord")
    numbered = rows.withColumn("id", F.concat(F.lit("reaction_"), F.row_number().over(w).cast("string")))
    return numbered.select("doc", "id", "name", "smiles")


def win_renumber(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount >= 0.05")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(w).alias("number"))


def win_last_n(spark, d):
    return a.last_n(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "from_end")


def win_cum_variance(spark, d):
    v = ligands(spark, d).agg(*[F.var_samp(c).alias(c) for c in DIMS])
    rows = v.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, DIMS)), F.array(*DIMS))).alias("name", "value"))
    return a.shares(rows, "value", "name", 4)


def lk_compound_by_id(spark, d):
    c = compounds(spark, d)
    e, n = c.where("category = 'electrophile'"), c.withColumn("category", F.lit("nucleophile"))
    return rel.prioritised([e, n], "id").select("id", "name", "category")


def lk_paper_by_id(spark, d):
    return refs(spark, d).where("id % 50 = 0").select("id", F.size("refs").alias("reference_count"))


def lk_ligand_by_name(spark, d):
    p = table(spark, d, "part").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("ord"), "p_brand", "p_retailprice")
    return rel.last_by_key(p, "name", "ord")


def lk_literature_by_doi(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return rel.last_by_key(e, "user_id", "event_id")


def flt_by_class(spark, d):
    return papers(spark, d).where("type = 'de' and trim(title) <> ''").select("id", "journal")


def flt_post_limit(spark, d):
    return rel.limited_then_filtered(compounds(spark, d), ["ord"], 80, "category = 'nucleophile'").select("id", "name")


def lst_reaction_types(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def enrich_fill_empty(spark, d):
    left = papers(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("journal")).alias("journal"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("type")).alias("type"))
    e = table(spark, d, "events")
    right = e.select((F.col("user_id") * 4).alias("id"), "event_id", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("journal"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("type"))
    return rel.fill_empty(left, right, "id", ["journal", "type"], "event_id")


def enrich_upsert(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name"))
    return rel.upsert(c, o, "id", ["name"])


def union_compounds(spark, d):
    c = compounds(spark, d)
    return c.where("category = 'electrophile'").unionByName(c.where("category = 'nucleophile'")).select("id", "name", "category")


def set_dedup_first(spark, d):
    return rel.first_by_key(extraction_items(spark, d).select("doc", "ord", "page", F.nullif("smiles", F.lit("")).alias("smiles")), "smiles", ["doc", "ord"]).select("smiles", "doc", "ord")


def inc_content_cache(spark, d):
    """Documents whose first 8192 bytes aren't in the cache: that of documents with even ids no older than a day."""
    key = F.sha2(F.substring(F.encode("text", "UTF-8"), 1, 8192), 256)
    docs = table(spark, d, "documents").select("doc_id", key.alias("key"))
    cached = docs.where("doc_id % 2 = 0").withColumn("age_hours", F.col("doc_id") % 50).where("age_hours <= 24")
    return docs.join(cached.select("key"), "key", "left_anti").select("doc_id", "key")


def stream_sessions(spark, d):
    s = a.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


def stream_ttl_sweep(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now"))
    gone = last.join(F.broadcast(now)).where(F.col("now") - F.col("last") > F.expr("interval 3600 seconds"))
    return gone.agg(F.count("*").alias("evicted"))


_W = r"[\p{L}\p{N}_]+"
_D = ", ".join
QUERIES = {
    "agg_stats_counts": (agg_stats_counts, " union all ".join(f"select '{n}' as entity, count(*) as n from {n}" for n in ("documents", "part", "nation", "embeddings"))),
    "agg_literature_stats": (agg_literature_stats, with_views("papers") + "select count(*) as total, count(*) filter (trim(title) <> '') as curated, count(*) filter (trim(title) = '') as doi_only, count(distinct type) as classes, array_to_string(list_sort(list(distinct type)), ',') as class_names from papers"),
    "agg_class_summary": (agg_class_summary, with_views("ligands") + "select cls, count(*) as n, string_agg(name, ',' order by ord) as names, " + _D(f"min({c}) as min_{c}, max({c}) as max_{c}" for c in DIMS[:4]) + " from ligands group by 1"),
    "agg_class_compare": (
        agg_class_compare,
        with_views("ligands") + ", m as (select cls, count(*) as n, " + _D(f"round(avg({c}), 3) as {c}" for c in DIMS) + " from ligands group by 1) select a.cls as class_a, b.cls as class_b, a.n as n_a, b.n as n_b, "
        + _D(f"a.{c} as {c}_a, b.{c} as {c}_b, round(a.{c} - b.{c}, 3) as {c}_diff" for c in DIMS) + " from m a join m b on a.cls < b.cls",
    ),
    "agg_cluster_summary": (
        agg_cluster_summary,
        with_views("ligands") + ", h as (select ord % 7 as cluster, cls, count(*) as k from ligands group by all), t as (select cluster, string_agg(cls || '=' || k, ',' order by cls::varchar) as classes from h group by 1), "
        "c as (select ord % 7 as cluster, count(*) as n, " + _D(f"round(avg({c}), 6) as {c}" for c in DIMS) + " from ligands group by 1) select * from c join t using (cluster)",
    ),
    "agg_tf_postings": (agg_tf_postings, with_views("papers") + f"select word, ord, count(*) as tf from (select ord, unnest(list_filter(regexp_extract_all(lower(concat_ws(' ', title, body, type, journal)), '{_W}'), lambda w: length(w) > 3)) as word from papers) group by all"),
    "agg_extraction_stats": (
        agg_extraction_stats,
        "with p as (select doc_id as id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as t from documents) select count(*) as paragraphs, count(*) filter (contains(lower(t), 'tion')) as with_reactions, count(distinct id) as documents from p where length(t) >= 80",
    ),
    "agg_merge_pages": (agg_merge_pages, with_views("items") + ", f as (select doc, name, min(ord) as o from items group by all) select doc, string_agg(name, ';' order by o) as names from f group by 1"),
    "agg_merge_conditions": (agg_merge_conditions, with_views("items") + ", f as (select doc, 'k' || (ord % 3) as name, arg_min(smiles, ord) as v from items where smiles <> '' group by all) select doc, string_agg(name || '=' || v, ';' order by name) as conditions from f group by 1"),
    "agg_merge_chunks": (agg_merge_chunks, with_views("items") + "select doc, 'reaction_' || row_number() over (partition by doc order by page, ord) as id, name, smiles from items where smiles <> ''"),
    "win_renumber": (win_renumber, "select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as number from lineitem where l_discount >= 0.05"),
    "win_last_n": (win_last_n, "with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as from_end from conversations) select * from r where from_end <= 3"),
    "win_cum_variance": (
        win_cum_variance,
        with_views("ligands") + ", v as (" + " union all ".join(f"select '{c}' as name, var_samp({c}) as value from ligands" for c in DIMS) + ") select name, round(100 * value / sum(value) over (), 4) as share, round(100 * sum(value) over (order by value desc, name rows unbounded preceding) / sum(value) over (), 4) as cumulative from v",
    ),
    "lk_compound_by_id": (lk_compound_by_id, with_views("compounds") + "select id, name, category from compounds"),
    "lk_paper_by_id": (lk_paper_by_id, with_views("refs") + "select id, len(refs) as reference_count from refs where id % 50 = 0"),
    "lk_ligand_by_name": (lk_ligand_by_name, "select lower(p_name) as name, max(p_partkey) as ord, arg_max(p_brand, p_partkey) as p_brand, arg_max(p_retailprice, p_partkey) as p_retailprice from part group by 1"),
    "lk_literature_by_doi": (lk_literature_by_doi, "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1"),
    "flt_by_class": (flt_by_class, with_views("papers") + "select id, journal from papers where type = 'de' and trim(title) <> ''"),
    "flt_post_limit": (flt_post_limit, with_views("compounds") + "select id, name from (select * from compounds order by ord limit 50) where category = 'nucleophile'"),
    "lst_reaction_types": (lst_reaction_types, "select n_nationkey as id, n_name as name from nation"),
    "enrich_fill_empty": (
        enrich_fill_empty,
        """with l as (select doc_id as id, case when doc_id % 3 = 0 then null else source end as journal, case when doc_id % 2 = 0 then null else lang end as type from documents),
        r as (select user_id * 4 as id, event_id, case when event_id % 4 <> 0 then event_type end as journal, 't' || (event_id % 5) as type from events),
        b as (select id, arg_min(journal, event_id) filter (journal is not null) as journal, arg_min(type, event_id) as type from r group by 1)
        select l.id, coalesce(l.journal, b.journal, '') as journal, coalesce(l.type, b.type, '') as type from l left join b using (id)""",
    ),
    "enrich_upsert": (
        enrich_upsert,
        """with c as (select c_custkey as id, case when c_custkey % 3 = 0 then '' else c_name end as name from customer where c_custkey % 2 = 0), o as (select o_custkey as id, max(o_orderpriority) as name from orders group by 1)
        select coalesce(c.id, o.id) as id, coalesce(nullif(trim(c.name), ''), nullif(trim(o.name), ''), '') as name, case when c.id is null then 'added' when o.id is null then 'kept' else 'merged' end as origin from c full join o on c.id = o.id""",
    ),
    "union_compounds": (union_compounds, with_views("compounds") + "select id, name, category from compounds"),
    "set_dedup_first": (set_dedup_first, with_views("items") + "select smiles, doc, ord from (select *, row_number() over (partition by smiles order by doc, ord) as k from items where smiles <> '') where k = 1"),
    "inc_content_cache": (
        inc_content_cache,
        "with d as (select doc_id, sha256(case when strlen(text) > 8192 then encode(text)[1:8192] else encode(text) end) as key from documents) select doc_id, key from d where key not in (select key from d where doc_id % 2 = 0 and doc_id % 50 <= 24)",
    ),
    "stream_sessions": (
        stream_sessions,
        """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 3600 seconds then 0 else 1 end as s from events),
        g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from e)
        select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*) as n from g group by user_id, k""",
    ),
    "stream_ttl_sweep": (stream_ttl_sweep, "select count(*) as evicted from (select user_id, max(ts) as last from events group by 1) where (select max(ts) from events) - last > interval 3600 seconds"),
}
