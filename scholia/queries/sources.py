"""Queries of sources. JSON inputs are built from the driver tables, then read by the same functions as files are."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholia.plans.bindings import graph_edges, refs, table
from scholia.plans.lineage import shared_folder
from scholia.sources import records as s


def src_json_map(spark, d):
    """Part records as `{key: [name, type]}` objects, every seventh one too short."""
    p = table(spark, d, "part")
    parts = F.when(F.col("p_partkey") % 7 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_type"))
    return s.json_map(p.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), parts)).alias("value")))


def src_event_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string, int>")).alias("key", "v"))


def src_code_lookup(spark, d):
    one = lambda t, k, v: table(spark, d, t).select(F.to_json(F.create_map(F.col(k).cast("string"), F.col(v))).alias("value"))
    return s.code_lookup(one("region", "r_regionkey", "r_name"), one("nation", "n_nationkey", "n_name"))


def src_paper_refs(spark, d):
    """Orders as papers whose reference list has an empty entry after each part."""
    r = refs(spark, d)
    lists = F.flatten(F.transform("refs", lambda x: F.array(F.array(x.cast("string"), F.lit("x")), F.array().cast("array<string>"))))
    docs = r.select(F.to_json(F.create_map(F.col("id").cast("string"), F.struct(F.concat(F.lit("t"), "id").alias("title"), lists.alias("references")))).alias("value"))
    return s.paper_refs(docs).select("doi", "title", "published_date", F.array_join("references", ",").alias("references"))


def src_reaction_records(spark, d):
    """Customer records with a null in every third and a missing key in every fourth."""
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_name"))
    full = F.create_map(F.lit("R1"), F.col("c_mktsegment"), F.lit("R2"), name, F.lit("Base"), F.col("c_custkey").cast("string"))
    less = F.create_map(F.lit("R2"), name, F.lit("Base"), F.col("c_custkey").cast("string"))
    docs = c.select(F.to_json(F.array(F.when(F.col("c_custkey") % 4 == 0, less).otherwise(full)), {"ignoreNullFields": "false"}).alias("value"))
    return s.text_records(docs, ("R1", "R2", "Base")).drop("ord")


def src_ligand_records(spark, d):
    p = table(spark, d, "supplier")
    rec = F.create_map(F.lit("Name"), F.concat(F.lit(" "), "s_name"), F.lit("HOMO (eV)"), F.col("s_acctbal").cast("string"))
    none = F.create_map(F.lit("Name"), F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_name")))
    docs = p.select(F.to_json(F.array(F.when(F.col("s_suppkey") % 2 == 0, rec).otherwise(none))).alias("value"))
    return s.numeric_records(docs, {"name": "Name"}, {"homo": "HOMO (eV)", "lumo": "LUMO (eV)"}, "name").drop("ord")


def src_literature_records(spark, d):
    o = table(spark, d, "orders")
    doi = F.when(F.col("o_orderkey") % 5 == 0, "NaN").otherwise(F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string")))
    docs = o.select(F.to_json(F.array(F.struct(doi.alias("DOI"), F.col("o_orderpriority").alias("Title"), F.col("o_orderstatus").alias("Reaction")))).alias("value"))
    return s.literature_records(docs).select("doi", "title", "coupling_partner", "ligand_knowledge")


def src_crossref_flatten(spark, d):
    """Orders as work records: a date for most, customers as authors, lines as references."""
    r = refs(spark, d).join(table(spark, d, "orders"), F.col("id") == F.col("o_orderkey"))
    date = F.struct(F.array(F.array(F.year("o_orderdate"), F.month("o_orderdate"))).alias("date-parts"))
    author = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.lit("A").alias("family"), F.lit(None).cast("string").alias("name")), F.struct(F.concat(F.lit("c"), "o_custkey").alias("family"), F.lit(None).cast("string").alias("name")))).when(
        F.col("id") % 3 == 1, F.array(F.struct(F.lit(None).cast("string").alias("family"), F.lit("Group").alias("name")))
    )
    reference = F.transform("refs", lambda x: F.struct(F.when(x % 2 == 0, x.cast("string")).alias("DOI")))
    docs = r.select(F.to_json(F.struct(F.col("id").cast("string").alias("DOI"), F.when(F.col("id") % 4 != 0, F.array("o_orderpriority")).alias("title"), F.when(F.col("id") % 5 != 0, date).alias("published-online"), author.alias("author"), reference.alias("reference"))).alias("value"))
    return s.flatten_work(docs).withColumn("references", F.array_join("references", ","))


def src_openalex_flatten(spark, d):
    """Regions as cited papers, customers of each nation as a page of citing works; pages are read until 200 works of a
    region are reached."""
    c = table(spark, d, "customer")
    who = F.when(F.col("c_custkey") % 3 != 0, F.array(F.struct(F.struct(F.col("c_name").alias("display_name")).alias("author"))))
    work = F.struct(F.concat(F.lit("W"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), (F.col("c_custkey") % 50).alias("cited_by_count"), F.lit(2020).alias("publication_year"), who.alias("authorships"))
    pages = c.groupBy(F.col("c_nationkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", work.alias("w")))).alias("r"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_regionkey").alias("cited"))
    pages = pages.join(nations.hint("merge"), "page").select("cited", "page", F.to_json(F.struct(F.transform("r", lambda x: x["w"]).alias("results"))).alias("value"))
    return s.flatten_citing(pages, 200).select("cited", "page", "id", "title", "author", "citations", "year")


def kg_flatten(spark, d):
    """Edges of graph objects: one a part, to the parts that follow it."""
    e = graph_edges(spark, d)
    edge = F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.lit("next").alias("label"))
    docs = e.groupBy("src").agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"))).alias("value"))
    return s.knowledge_graph(docs, "src", "value")[1]


def _model_output(spark, d):
    """Event properties as model output: plain, fenced, with text around, cut off, hopeless, and between other objects."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 8
    more = F.concat(F.rtrim("props", F.lit("}")), F.lit(', "j": [1, 2]}'))
    shapes = [
        F.col("props"), F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\n")), F.concat(F.lit("So "), "props", F.lit(" it is.")), F.rtrim("props", F.lit("}")),
        F.concat(F.lit('x {"k": -1} y '), more), F.concat(more, F.lit(' then {"k": -1} and {not json at all}')), F.concat(F.lit('a {"k": -1} b '), "props"),
    ]
    text = F.lit("none")
    for i, shape in enumerate(shapes):
        text = F.when(k == i, shape).otherwise(text)
    return e.select("event_id", text.alias("text"))


def json_repair_parse(spark, d):
    return _model_output(spark, d).select("event_id", s.json_repair(F.col("text"), "k int")["k"].alias("k"))


def json_repair_list(spark, d):
    """The same where the longest value counts and may be a list."""
    rows = _model_output(spark, d)
    rows = rows.withColumn("text", F.when(F.col("event_id") % 8 == 2, F.concat(F.lit('so {"k": 1} or [10, '), F.col("event_id").cast("string"), F.lit(", 30, 40]"))).otherwise(F.col("text")))
    return rows.select("event_id", s.json_repair_any(F.col("text")).alias("json"))


def _written(df, name):
    """df as CSV files with a header in the shared folder; the folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("escape", '"').csv(path, header=True)
    return path


def src_doi_list(spark, d):
    """A sheet of identifiers, some missing, with other columns behind."""
    o = table(spark, d, "orders")
    sheet = o.select(F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string"))).alias("Main DOI"), "o_orderpriority", "o_orderstatus")
    return s.first_column(spark, _written(sheet, "doi-list"))


def src_citation_csv(spark, d):
    """A node file whose titles hold quotes, commas and line ends."""
    c = table(spark, d, "customer")
    title = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lit(',\n"part" two')).otherwise(F.lit("")))
    nodes = c.select(F.col("c_custkey").alias("id"), title.alias("title"), F.col("c_nationkey").alias("cluster"))
    return s.citation_csv(spark, _written(nodes, "nodes"))


QUERIES = {
    "src_doi_list": (src_doi_list, "select '10.1000/' || o_orderkey as doi from orders where o_orderkey % 6 <> 0"),
    "src_citation_csv": (src_citation_csv, "select c_custkey::varchar as id, c_mktsegment || case when c_custkey % 3 = 0 then ',' || chr(10) || '\"part\" two' else '' end as title, c_nationkey::varchar as cluster from customer"),
    "src_json_map": (src_json_map, "select p_partkey::varchar as id, p_name as name, p_type as leaving_group from part where p_partkey % 7 <> 0"),
    "src_event_props": (src_event_props, "select event_id, 'k' as key, (props->>'k')::int as v from events"),
    "src_code_lookup": (src_code_lookup, "select r_regionkey::varchar as id, r_name as label, 'electrophile' as side from region union all select n_nationkey::varchar, n_name, 'nucleophile' from nation"),
    "src_paper_refs": (src_paper_refs, "select l_orderkey::varchar as doi, 't' || l_orderkey as title, '' as published_date, string_agg(distinct l_partkey::varchar, ',' order by l_partkey) as references from (select distinct l_orderkey, l_partkey from lineitem) group by l_orderkey".replace("string_agg(distinct l_partkey::varchar, ',' order by l_partkey)", "string_agg(l_partkey::varchar, ',' order by l_partkey)").replace(" as references", ' as "references"')),
    "src_reaction_records": (src_reaction_records, "select case when c_custkey % 4 = 0 then '' else c_mktsegment end as \"R1\", case when c_custkey % 3 = 0 then 'None' else c_name end as \"R2\", c_custkey::varchar as \"Base\" from customer"),
    "src_ligand_records": (src_ligand_records, "select s_name as name, case when s_suppkey % 2 = 0 then s_acctbal else 0.0 end as homo, 0.0::double as lumo from supplier where s_suppkey % 2 = 0 or s_suppkey % 5 <> 0"),
    "src_literature_records": (src_literature_records, "select '10.1000/' || o_orderkey as doi, o_orderpriority as title, o_orderstatus as coupling_partner, '' as ligand_knowledge from orders where o_orderkey % 5 <> 0"),
    "src_crossref_flatten": (
        src_crossref_flatten,
        """with r as (select l_orderkey as id, string_agg(distinct l_partkey::varchar, ',') filter (l_partkey % 2 = 0) as x, list_sort(list_distinct(list(l_partkey) filter (l_partkey % 2 = 0))) as l from lineitem group by 1)
        select id::varchar as doi, case when id % 4 <> 0 then o_orderpriority else 'No Title' end as title, case id % 3 when 0 then 'c' || o_custkey when 1 then 'Group' else 'Unknown' end as author,
          case when id % 5 <> 0 then year(o_orderdate) end as year, 0 as citations, coalesce(array_to_string(l, ','), '') as "references" from r join orders on o_orderkey = id""",
    ),
    "src_openalex_flatten": (
        src_openalex_flatten,
        """with n as (select n_regionkey as cited, c_nationkey, sum(count(*)) over (partition by n_regionkey order by c_nationkey) - count(*) as before from customer join nation on c_nationkey = n_nationkey group by 1, 2)
        select cited, c_nationkey as page, 'W' || c_custkey as id, c_mktsegment as title, case when c_custkey % 3 <> 0 then c_name else 'Unknown' end as author, (c_custkey % 50)::int as citations, 2020 as year from customer join n using (c_nationkey) where before < 200""",
    ),
    "kg_flatten": (kg_flatten, "with e as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where src <> dst) select src, src::varchar as source, dst::varchar as target, 'next' as label from e"),
    "json_repair_parse": (json_repair_parse, "select event_id, case event_id % 8 when 7 then null when 6 then -1 else (props->>'k')::int end as k from events"),
    "json_repair_list": (
        json_repair_list,
        """select event_id, case event_id % 8 when 7 then null when 2 then '[10,' || event_id || ',30,40]' when 6 then case when length((props->>'k')) > 2 then '{"k":' || (props->>'k') || '}' else '{"k":-1}' end
          when 4 then '{"j":[1,2],"k":' || (props->>'k') || '}' when 5 then '{"j":[1,2],"k":' || (props->>'k') || '}' else '{"k":' || (props->>'k') || '}' end as json from events""",
    ),
}
