"""Queries of citation graphs. Seeds are the parts with a key below 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import graph as g
from scholia.operators import relations as rel
from scholia.plans.bindings import graph_edges, graph_nodes, refs, table, with_views


def _seeds(spark, d):
    return table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("seed"))


def agg_degree(spark, d):
    return g.in_degree(graph_nodes(spark, d).select("id"), graph_edges(spark, d))


def related_papers(spark, d):
    return g.related(_seeds(spark, d), graph_edges(spark, d))


def _members(spark, d, forward):
    near = g.neighbourhood(_seeds(spark, d), graph_edges(spark, d), forward)
    return near.join(graph_nodes(spark, d), "id")


def edge_cross_refs(spark, d):
    members = _members(spark, d, True).withColumn("ord", F.col("id"))
    return g.cross_references(members, graph_edges(spark, d), 100)


def forward_network(spark, d):
    return g.network(_seeds(spark, d), graph_nodes(spark, d), graph_edges(spark, d), True, 100)[0].select("seed", "id", "is_main", "local_citations")


def forward_network_edges(spark, d):
    return g.network(_seeds(spark, d), graph_nodes(spark, d), graph_edges(spark, d), True, 100)[1]


def backward_network(spark, d):
    return g.network(_seeds(spark, d), graph_nodes(spark, d), graph_edges(spark, d), False, 20)[0].select("seed", "id", "is_main", "local_citations")


def snk_graph_json(spark, d):
    nodes, edges = g.network(_seeds(spark, d), graph_nodes(spark, d), graph_edges(spark, d), True, 100, top=5)
    return g.graph_json(nodes, edges)


def suggest_recent(spark, d):
    year = 2000
    return g.suggest(_members(spark, d, True).where(F.col("year").between(year - 5, year)), "gcite")


def suggest_global(spark, d):
    return g.suggest(_members(spark, d, False), "gcite")


def suggest_local(spark, d):
    members = _members(spark, d, False)
    first = suggest_global(spark, d)
    rest = members.join(first.select("seed", "id"), ["seed", "id"], "left_anti")
    degree = g.in_degree(graph_nodes(spark, d).select("id"), graph_edges(spark, d))
    return g.suggest(rest.join(degree, "id"), "local_citations")


def set_exclusion(spark, d):
    """Papers that cite one of the seeds and that no seed cites."""
    citing = g.neighbourhood(_seeds(spark, d), graph_edges(spark, d), True).select("id").distinct()
    cited = g.neighbourhood(_seeds(spark, d), graph_edges(spark, d), False).select("id").distinct()
    return rel.without(citing, cited, "id")


def cross_network(spark, d):
    lists = refs(spark, d).select(F.col("id").alias("doc"), F.explode("refs").alias("id"))
    return g.cross_network(lists, graph_edges(spark, d)).groupBy("doc").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("citing"), F.countDistinct("dst").alias("cited"))


def adjacency_cross(spark, d):
    lists = refs(spark, d).select(F.col("id").alias("doc"), F.explode("refs").alias("id"))
    return g.cross_network(lists, graph_edges(spark, d))


def graph_neighbors(spark, d):
    return g.neighbour_lists(graph_edges(spark, d)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


def graph_mean_message(spark, d):
    return g.mean_message(graph_nodes(spark, d), graph_edges(spark, d), "gcite").select("id", F.round("gcite", 3).alias("gcite"))


def rank_number_nodes(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("seed").orderBy("id")
    return g.neighbourhood(_seeds(spark, d), graph_edges(spark, d), True).withColumn("number", F.row_number().over(w) + 1)


_V = with_views("edges", "nodes")
_FWD = "fwd as (select distinct dst as seed, src as id from edges where dst % 50 = 0)"
_BWD = "bwd as (select distinct src as seed, dst as id from edges where src % 50 = 0)"


def _top(members: str, order: str, where: str = "true") -> str:
    return f"select seed, id, rank from (select seed, id, row_number() over (partition by seed order by {order}, id) as rank from {members} join nodes using (id) where {where}) where rank <= 5"


def _network(near: str, forward: bool, first_n: int, top: int = 30) -> str:
    star = "select seed, id as src, seed as dst from near" if forward else "select seed, seed as src, id as dst from near"
    return f"""{_V}, {near} , near as (select * from {"fwd" if forward else "bwd"}),
      seeds as (select p_partkey as seed from part where p_partkey % 50 = 0),
      srcs as (select seed, id from (select *, row_number() over (partition by seed order by id) as k from near) where k <= {first_n}),
      ev as ({star} union select s.seed, e.src, e.dst from edges e join srcs s on s.id = e.src join near n on n.seed = s.seed and n.id = e.dst),
      deg as (select seed, dst as id, count(*) as c from ev group by all),
      mem as (select seed, id, gcite, id as ord, false as is_main from near join nodes using (id)
        union all select seed, seed, gcite, -1, true from seeds join nodes on id = seed),
      rk as (select *, row_number() over (partition by seed order by gcite desc, ord) as nth, count(*) over (partition by seed) as n from mem),
      st as (select seed, bool_or(is_main and nth <= {top}) as has_main, least({top}, max(n)) as last from rk group by 1),
      kept as (select seed, id, is_main from rk join st using (seed) where (nth <= {top} and (has_main or nth < last)) or (is_main and nth > {top}))
    """


QUERIES = {
    "agg_degree": (agg_degree, f"{_V} select id, (select count(*) from edges where dst = id) as local_citations from nodes"),
    "related_papers": (related_papers, f"{_V}, {_FWD}, {_BWD}, u as (select * from fwd union select * from bwd), r as (select seed, id, row_number() over (partition by seed order by id) as rank from u) select * from r where rank <= 5"),
    "edge_cross_refs": (edge_cross_refs, f"{_V}, {_FWD}, s as (select seed, id from (select *, row_number() over (partition by seed order by id) as k from fwd) where k <= 100) select s.seed, src, dst from edges join s on s.id = src join fwd f on f.seed = s.seed and f.id = dst"),
    "forward_network": (forward_network, _network(_FWD, True, 100) + "select seed, id, is_main, coalesce(c, 0) as local_citations from kept left join deg using (seed, id)"),
    "forward_network_edges": (forward_network_edges, _network(_FWD, True, 100) + "select ev.seed, src, dst from ev join kept a on a.seed = ev.seed and a.id = src join kept b on b.seed = ev.seed and b.id = dst"),
    "backward_network": (backward_network, _network(_BWD, False, 20) + "select seed, id, is_main, coalesce(c, 0) as local_citations from kept left join deg using (seed, id)"),
    "snk_graph_json": (
        snk_graph_json,
        _network(_FWD, True, 100, 5) + """,
        ke as (select ev.seed, src::varchar as s, dst::varchar as d from ev join kept a on a.seed = ev.seed and a.id = src join kept b on b.seed = ev.seed and b.id = dst),
        n as (select seed, count(*) as k, string_agg('{"id":"' || id || '","is_main":"' || case when is_main then 'True' else 'False' end || '"}', ',' order by id::varchar) as t from kept group by 1),
        e as (select seed, count(*) as k, string_agg('{"source":"' || s || '","target":"' || d || '"}', ',' order by s, d) as t from ke group by 1)
        select n.seed, '{"nodes":[' || n.t || '],"edges":[' || coalesce(e.t, '') || '],"stats":{"nodes":' || n.k || ',"edges":' || coalesce(e.k, 0) || '}}' as json from n left join e using (seed) where n.k >= 2""",
    ),
    "suggest_recent": (suggest_recent, f"{_V}, {_FWD} " + _top("fwd", "gcite desc", "year between 1995 and 2000")),
    "suggest_global": (suggest_global, f"{_V}, {_BWD} " + _top("bwd", "gcite desc")),
    "suggest_local": (
        suggest_local,
        f"{_V}, {_BWD}, g as ({_top('bwd', 'gcite desc')}), deg as (select dst as id, count(*) as c from edges group by 1), rest as (select * from bwd anti join g using (seed, id)) "
        "select seed, id, rank from (select seed, rest.id, row_number() over (partition by seed order by coalesce(c, 0) desc, rest.id) as rank from rest left join deg on deg.id = rest.id) where rank <= 5",
    ),
    "set_exclusion": (set_exclusion, f"{_V}, {_FWD}, {_BWD} select distinct id from fwd where id not in (select id from bwd)"),
    "cross_network": (cross_network, with_views("edges", "refs") + ", l as (select id as doc, unnest(refs) as id from refs) select a.doc, count(*) as edges, count(distinct src) as citing, count(distinct dst) as cited from edges join l a on a.id = src join l b on b.doc = a.doc and b.id = dst group by 1"),
    "adjacency_cross": (adjacency_cross, with_views("edges", "refs") + ", l as (select id as doc, unnest(refs) as id from refs) select a.doc, src, dst from edges join l a on a.id = src join l b on b.doc = a.doc and b.id = dst"),
    "graph_neighbors": (graph_neighbors, with_views("edges") + "select id, string_agg(n::varchar, ',' order by n) as neighbours from (select src as id, dst as n from edges union all select dst, src from edges) group by 1"),
    "graph_mean_message": (graph_mean_message, f"{_V}, b as (select src as id, dst as n from edges union all select dst, src from edges), m as (select b.id, avg(gcite) as m from b join nodes on nodes.id = b.n group by 1) select nodes.id, round(coalesce(m, 0.0), 3) as gcite from nodes left join m on m.id = nodes.id"),
    "rank_number_nodes": (rank_number_nodes, f"{_V}, {_FWD} select seed, id, row_number() over (partition by seed order by id) + 1 as number from fwd"),
}
