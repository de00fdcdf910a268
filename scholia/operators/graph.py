"""Citation graphs for a table of seeds at once: networks, degrees, pinned top-n, suggestions, message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.plans.lineage import cut

from .retrieval import sized

#: Lists of at most so many members give all their pairs.
PAIRS_OF = 64


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with local_citations: edges that end there."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("local_citations"))
    return nodes.join(n, "id", "left").withColumn("local_citations", F.coalesce("local_citations", F.lit(0)))


def neighbourhood(seeds: DataFrame, edges: DataFrame, forward: bool) -> DataFrame:
    """(seed, id): those that cite the seed (forward) or that it cites; never the seed itself."""
    near, far = ("dst", "src") if forward else ("src", "dst")
    return edges.join(seeds.select(F.col("seed").alias(near)), near).where("src <> dst").select(F.col(near).alias("seed"), F.col(far).alias("id")).distinct()


def cross_references(members: DataFrame, edges: DataFrame, first_n: int, *, self_loops: bool = False) -> DataFrame:
    """(seed, src, dst): edges among a seed's members whose source is one of its first n (members has ord)."""
    w = Window.partitionBy("seed").orderBy("ord")
    sources = members.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= first_n).select("seed", F.col("id").alias("src"))
    e = edges if self_loops else edges.where("src <> dst").distinct()
    out = e.join(sources, "src")
    return out.join(members.select("seed", F.col("id").alias("dst")), ["seed", "dst"], "left_semi").select("seed", "src", "dst")


def top_n_pinned(members: DataFrame, n: int = 30) -> DataFrame:
    """Of members (seed, id, gcite, ord, is_main) the n most cited of each seed; a main paper that isn't among them
    takes the place of the last and comes first (the last goes even if there are fewer than n)."""
    w = Window.partitionBy("seed").orderBy(F.desc("gcite"), "ord")
    ranked = members.withColumn("nth", F.row_number().over(w))
    kept = ranked.where(F.col("nth") <= n)
    stats = kept.groupBy("seed").agg(F.max(F.col("is_main").cast("int")).alias("has_main"), F.max("nth").alias("last"))
    kept = kept.join(stats, "seed").where((F.col("has_main") == 1) | (F.col("nth") < F.col("last")))
    pinned = ranked.where("is_main").where(F.col("nth") > n).withColumn("nth", F.lit(0))
    return kept.drop("has_main", "last").unionByName(pinned).drop("nth")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges (seed, src, dst) with both ends among the kept (seed, id)."""
    k = kept.select("seed", "id")
    out = edges.join(k.withColumnRenamed("id", "src"), ["seed", "src"], "left_semi")
    return out.join(k.withColumnRenamed("id", "dst"), ["seed", "dst"], "left_semi").select("seed", "src", "dst")


def suggest(members: DataFrame, score: str, k: int = 5) -> DataFrame:
    """(seed, id, rank): the k best of each seed by score, ties by id."""
    w = Window.partitionBy("seed").orderBy(F.desc(score), "id")
    return members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("seed", "id", "rank")


def network(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, forward: bool, first_n: int, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each seed's citation network: the seed and its neighbours, the edges between them and to the
    seed, in-degrees over the whole network, cut to the pinned top-n and its induced edges."""
    near = neighbourhood(seeds, edges, forward).join(nodes, "id").withColumn("is_main", F.lit(False)).withColumn("ord", F.col("id"))
    main = seeds.select("seed", F.col("seed").alias("id")).join(nodes, "id").withColumn("is_main", F.lit(True)).withColumn("ord", F.lit(-1).cast("long"))
    members = near.unionByName(main)
    star = near.select("seed", F.col("id").alias("src"), F.col("seed").alias("dst")) if forward else near.select("seed", F.col("seed").alias("src"), F.col("id").alias("dst"))
    every = star.union(cross_references(near, edges, first_n)).distinct()
    degree = every.groupBy("seed", F.col("dst").alias("id")).agg(F.count("*").alias("local_citations"))
    members = members.join(degree, ["seed", "id"], "left").withColumn("local_citations", F.coalesce("local_citations", F.lit(0)))
    kept = top_n_pinned(members, top)
    return kept, induced(every, kept)


def cross_network(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, src, dst): citations among the members of each list (doc, id), without self-citations.

    A list of up to `PAIRS_OF` members gives its pairs, which are looked up among the edges; the edges of all members would
    be many more, most of which lead out of the list. Longer lists are joined with the edges of their members.
    """
    e = edges.where("src <> dst")
    lists = lists.where("doc is not null and id is not null").select("doc", "id")
    long = cut(lists.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_OF).select("doc"))
    short = lists.join(sized(long), "doc", "left_anti").groupBy("doc").agg(F.collect_list("id").alias("ids"))
    pairs = short.select("doc", "ids", F.explode("ids").alias("src")).select("doc", "src", F.explode(F.array_distinct("ids")).alias("dst"))
    out = pairs.where("src <> dst").hint("merge").join(e, ["src", "dst"]).select("doc", "src", "dst")
    if long.isEmpty():
        return out
    rest = lists.join(sized(long), "doc", "left_semi")
    found = e.hint("merge").join(rest.select("doc", F.col("id").alias("src")), "src")
    found = found.hint("merge").join(rest.select("doc", F.col("id").alias("dst")), ["doc", "dst"], "left_semi")
    return out.union(found.select("doc", "src", "dst"))


def related(seeds: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """(seed, id, rank): papers that the seed cites or that cite it, by id."""
    both = neighbourhood(seeds, edges, True).union(neighbourhood(seeds, edges, False)).distinct()
    w = Window.partitionBy("seed").orderBy("id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(limit, 20))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(id, neighbours): both directions, repeats kept, sorted."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).union(edges.select("dst", "src"))
    return both.groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))


def mean_message(nodes: DataFrame, edges: DataFrame, feature: str, rounds: int = 1) -> DataFrame:
    """(id, feature): the mean over neighbours, 0 for none; all nodes at once, from the round before."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).union(edges.select("dst", "src"))
    now = nodes.select("id", feature)
    for i in range(rounds):
        mean = both.join(now.select(F.col("id").alias("n"), feature), "n").groupBy("id").agg(F.avg(feature).alias("m"))
        now = now.select("id").join(mean, "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias(feature))
        if i + 1 < rounds:
            now = cut(now)
    return now


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, json): nodes with is_main as "True" or "False", edges and counts of each network of two nodes or more."""
    n = nodes.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("is_main"), "True").otherwise("False").alias("is_main")))).alias("nodes"))
    e = edges.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target")))).alias("edges"))
    rows = n.join(e, "seed", "left").where(F.size("nodes") >= 2)
    edge_list = F.coalesce("edges", F.array().cast(e.schema["edges"].dataType))
    stats = F.struct(F.size("nodes").alias("nodes"), F.size(edge_list).alias("edges"))
    return rows.select("seed", F.to_json(F.struct("nodes", edge_list.alias("edges"), stats.alias("stats"))).alias("json"))
