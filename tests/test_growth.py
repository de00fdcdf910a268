"""Steps whose rows grow no faster than the tables: rows are counted where they are ranked."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import retrieval


@pytest.fixture
def ranked(monkeypatch):
    """Row counts of everything that top_k is given."""
    sizes, plain = [], retrieval.top_k

    def counted(scored, *a, **k):
        sizes.append(scored.count())
        return plain(scored, *a, **k)

    monkeypatch.setattr(retrieval, "top_k", counted)
    return sizes


def _names(spark, n):
    return spark.range(n).select(F.col("id").alias("ord"), F.col("id"), F.when(F.col("id") % 3 == 0, "Red ring").when(F.col("id") % 3 == 1, "old ring").otherwise("bolt").alias("name"), F.lit("ring").alias("cls"))


def test_substring_search_of_copies(spark, ranked):
    """Equal queries and copies of names: no query meets all copies, and the first k rows are the same."""
    queries = spark.range(100).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, "RING").when(F.col("id") == 1, "").otherwise("bolt").alias("text"))
    got = {}
    for r in retrieval.search_substring(queries, _names(spark, 300), 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    want = {"ring": [0, 3, 6, 9], "bolt": [2, 5, 8, 11]}
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: want["ring" if q % 2 == 0 or q == 1 else "bolt"] for q in range(100)}
    assert max(ranked) <= 300


def test_tier_search_of_copies(spark, ranked):
    """Each tier gives k rows a query, copies or not."""
    queries = spark.createDataFrame([(i, ["red ring ", "Ring", "bolt x", "ring old"][i % 4]) for i in range(80)], "qid long, text string")
    got = {}
    for r in retrieval.tier_search(queries, _names(spark, 300), k=3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["name"], r["score"]))
    want = [[(i, "Red ring", 100) for i in (1, 2, 3)], [(1, "Red ring", 50), (2, "old ring", 50), (3, "Red ring", 50)], [(i, "bolt", 50) for i in (1, 2, 3)], [(1, "Red ring", 40), (2, "old ring", 40), (3, "bolt", 40)]]
    assert {q: sorted(v) for q, v in got.items()} == {q: want[q % 4] for q in range(80)}
    assert max(ranked) <= 600


def test_combined_search_of_copies(spark, ranked):
    """The query joins no more than its names' first rows either."""
    from scholia.queries import rules

    assert rules.search_combined(spark, "/root/testdata/sf0.001").count() > 0
    assert max(ranked) <= 2 * spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_json_repair_measures_a_span_once(spark):
    """The expression of each step stands in the plan once, not once for every use of what it gives; results with brackets
    that don't match, scalars, and text around are the same."""
    from scholia.sources import records

    cases = {'x {"a": 1} {"b": [1, 2]} [3': '{"b":[1,2]}', "say [1, {2}, 3] or [4]": "[4]", "12": "12", " true ": "true", "12 13": None, '"a" b': None, "{]": None, '} {"k": 1}': None, '[{"k": 1': '[{"k":1}]', None: None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", records.json_repair_any(F.col("t")).alias("json"))
    assert df._jdf.queryExecution().analyzed().toString().count("parse_json") < 60
    got = {r["t"]: r["json"] for r in df.collect()}
    assert {k: got[k] for k in cases} == cases


def test_small_groups_are_compared_in_place(spark, monkeypatch):
    """Groups below and above the bound give brute force's pairs; the small ones need one shuffle and no join."""
    import random

    from scholia.operators import extraction

    random.seed(7)
    rows = [(d, i, random.sample("abcdefgh", random.randint(0, 8)) + random.choice([[], ["a"], [None]])) for d in range(6) for i in range(5 + 4 * d)]
    sets = spark.createDataFrame([*rows, (None, 1, ["a"]), (None, 2, ["a"])], "doc long, ord long, items array<string>")
    assert "Join" not in extraction.jaccard_pairs(sets, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    own = [(d, i, {x for x in items if x}) for d, i, items in rows]
    want = sorted((d, a, b, len(x & y) / len(x | y)) for d, a, x in own for e, b, y in own if d == e and a < b and x and y and len(x & y) / len(x | y) > 0.6)
    for bound in (64, 12, 0):
        monkeypatch.setattr(extraction, "SMALL", bound)
        assert sorted(map(tuple, extraction.jaccard_pairs(sets, 0.6).collect())) == want


def test_results_are_parsed_once(spark):
    """The parser stands once in the plan of each merged part, not once for every field."""
    from scholia.operators import merging

    results = spark.createDataFrame([(1, 1, 1, "s", '{"reactants": ["a"], "products": []}'), (1, 2, 1, "s", "[1]"), (2, 1, 1, "s", None), (2, 2, 1, "s", "{")], "doc long, ord long, page int, source string, data string")
    known = spark.createDataFrame([(2, "x")], "doc long, name string")
    merged = merging.merge_results(results, known, spark.createDataFrame([(1, 4)], "doc long, n int"))
    for part in merged:
        assert part._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") <= 1
    assert [r["id"] for r in merged.reactions.collect()] == ["vision_page1_5"]
    assert [(r["doc"], r["ord"]) for r in merged.figures.collect()] == [(1, 1)]
