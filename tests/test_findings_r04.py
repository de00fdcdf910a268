"""Findings of round 4: steps that must not grow faster than their input."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from scholia.operators import containment, merging, parsing, retrieval, rules


def test_f2_equal_queries_make_no_pairs_of_their_own(spark, monkeypatch):
    """200 equal queries that stand in each of 100 names: 100 pairs a lookup, not 20,000; the same for resolve_names."""
    pairs, contained = [], containment.contained

    def spy(needles, texts, *more):
        found = contained(needles, texts, *more)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(containment, "contained", spy)
    names = spark.createDataFrame([(i, 1000 + i, f"(a) {900 + i}", "p") for i in range(100)], "ord long, id long, name string, cls string")
    q = spark.createDataFrame([(i, "(A) 9") for i in range(200)] + [(200, "no"), (201, None)], "qid long, text string")
    classes = spark.createDataFrame([(200, "p"), (201, "p"), (202, "p")], "qid long, cls string")
    got = {r["qid"]: (r["id"], r["strategy"]) for r in parsing.resolve_reference(q, names, classes).collect()}
    assert got == {**{i: (1000, "contained") for i in range(200)}, **{i: (1000, "class") for i in (200, 201, 202)}}
    assert sum(pairs) <= 200
    pairs.clear()
    assert {(r["qid"], r["id"]) for r in rules.resolve_names(q, names).collect()} == {(i, 1000) for i in range(200)} and sum(pairs) <= 100


def test_f2_best_overlap_by_all_pairs(spark):
    random.seed(51)
    word = lambda n: "".join(random.choices("abé", k=n))
    queries = [(i, word(random.randint(0, 7))) for i in range(60)] + [(90, None), (91, "")]
    names = [(i, 100 - i, word(random.randint(0, 7))) for i in range(60)] + [(90, 0, None), (91, 1, "")]
    q, n = spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(names, "ord long, id long, name string")
    for shorter in (False, True):
        want = {}
        for i, x in queries:
            found = [(-min(len(x), len(y)), len(y) if shorter else 0, j, k) for j, k, y in names if x and y and (x in y or y in x)]
            if found:
                want[i] = min(found)[3]
        assert {r["qid"]: r["id"] for r in retrieval.best_overlap(q, n, shorter).collect()} == want and len(want) > 40


def test_f3_pages_are_grouped_once(spark):
    """One grouping by document and no join of two, whatever is merged."""
    rows = spark.createDataFrame([(1, 0, 1, "p", '{"reactants": ["a"]}')], "doc long, ord long, page long, source string, data string")
    plan = merging.merge_pages(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_f3_merged_items_by_plain_rules(spark):
    """Strings that look like other values, and values of all kinds, stay apart; pages come in no order."""
    random.seed(52)
    kinds = ["a", "true", True, False, "5", 5, 0, "0", -3, 2.5, "2.5", "null", None, "", '"', '"a"', "{}", {}, [], "[]", [1], {"x": "y"}, "é\n", "Infinity", 10**30, {"name": "a"}, {"name": 5}, {"name": "5"}, {"name": ""}, {"smiles": "C"}]
    dump = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    some = lambda: random.choices(kinds, k=random.randint(0, 5))
    rows, docs = [], {}
    for doc in range(25):
        for place in random.sample(range(4), 4):
            data = {f: some() for f in random.sample(merging.LISTS, 3)}
            data |= {"reaction_schemes": [{"reactants": some(), "products": some()} for _ in range(random.randint(0, 2))], "conditions": {k: random.choice(kinds) for k in random.sample("xyz", 2)}, "selectivity": random.choice(kinds)}
            rows.append((doc, place, place + 5, "p", json.dumps(data)))
            docs.setdefault(doc, {})[place] = data
    out = merging.merge_pages(spark.createDataFrame(rows, "doc long, ord long, page long, source string, data string"))
    columns = (*merging.LISTS, "conditions")
    got = {r["doc"]: r for r in out.select("doc", "selectivity", *[F.to_json(F.to_variant_object(F.col(c))).alias(c) for c in columns]).collect()}
    empty = (None, "", False, [], {})
    full = lambda v: not any(v is e or (type(v) is type(e) and v == e) for e in empty) and not (type(v) is int and v == 0)
    for doc, pages in docs.items():
        for f in merging.LISTS:
            every = []
            for _, data in sorted(pages.items()):
                every += data.get(f, [])
                if f in ("reactants", "products"):
                    every += [e["name"] if isinstance(e, dict) else e for s in data["reaction_schemes"] for e in s[f] if not isinstance(e, dict) or "name" in e]
            want = list(dict.fromkeys(dump(v) for v in every if f == "yields" or full(v)))
            assert [dump(v) for v in json.loads(got[doc][f])] == want, (doc, f)
        first = {}
        for _, data in sorted(pages.items()):
            for k, v in data["conditions"].items():
                if full(v):
                    first.setdefault(k, v)
        assert json.loads(got[doc]["conditions"]) == first
        told = [data["selectivity"] for _, data in sorted(pages.items()) if full(data["selectivity"])]
        assert (got[doc]["selectivity"] is None) == (not told) and (not told or not isinstance(told[0], str) or got[doc]["selectivity"] == told[0])
