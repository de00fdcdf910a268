"""The library's logical views over the driver tables, for Spark and as SQL text for the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, title (first line), body, type, journal."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.col("lang").alias("type"), F.col("source").alias("journal"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 0, "electrophile").otherwise("nucleophile").alias("category"))


DIMS = tuple(f"d{i}" for i in range(1, 9))


def ligands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.col("label").alias("cls"), *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst), src <> dst: each part to the next part of its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("src <> dst").distinct()


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, gcite, year of every part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("gcite"), F.max(F.year("l_shipdate")).alias("year"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return p.join(lines, p.id == lines.l_partkey, "left").select("id", "title", F.coalesce("gcite", F.lit(0.0)).alias("gcite"), "year")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))


def extraction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc (order), page (line number), ord (place in the order), name, smiles (empty for every fifth part), role."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.withColumn("ord", F.row_number().over(w))
    smiles = F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("C"), F.col("l_partkey").cast("string")))
    return lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("name"), smiles.alias("smiles"), F.col("l_suppkey").alias("partner"))


#: The same views as DuckDB common table expressions.
SQL = {
    "papers": "papers as (select doc_id as ord, doc_id as id, split_part(text, chr(10), 1) as title, text as body, lang as type, source as journal from documents)",
    "queries": "queries as (select item_id as qid, text from benchmark)",
    "compounds": "compounds as (select p_partkey as ord, p_partkey as id, p_name as name, case when p_partkey % 4 <> 0 then 'electrophile' else 'nucleophile' end as category from part)",
    "ligands": "ligands as (select vec_id as ord, 'v' || vec_id as name, label as cls, " + ", ".join(f"embedding[{i}]::double as {d}" for i, d in enumerate(DIMS, 1)) + " from embeddings)",
    "edges": "edges as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where src <> dst)",
    "nodes": "nodes as (select p_partkey as id, p_name as title, coalesce(sum(l_quantity), 0.0) as gcite, max(year(l_shipdate)) as year from part left join lineitem on l_partkey = p_partkey group by all)",
    "refs": "refs as (select l_orderkey as id, list_sort(list_distinct(list(l_partkey))) as refs from lineitem group by 1)",
    "items": "items as (select l_orderkey as doc, l_linenumber as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord, 'part ' || (l_partkey % 50) as name, case when l_partkey % 5 = 0 then '' else 'C' || l_partkey end as smiles, l_suppkey as partner from lineitem)",
}


def with_views(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names) + " "
