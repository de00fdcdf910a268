"""Merged results and completed reactions, against plain restatements of the rules."""

import json
import random

from pyspark.sql import functions as F

from scholia.operators import merging

REACTION = "doc long, pos long, entry_id string, entry string, assembled_smiles string, reactants array<struct<name: string, smiles: string, assembled: boolean>>"
TABLE = "doc long, scaffold string, label string, rgroups map<string, map<string, string>>, partners map<string, map<string, string>>"


def _results():
    figure = {"figure_type": "scheme", "notes": "n", "scaffold_smiles": "C[R1]", "reaction_schemes": [{"reactionType": None, "reactants": [{"name": "A", "smiles": "CA"}, "b"], "products": [{"name": "c"}], "entry_id": "1a"}, {"products": [{"name": "a", "smiles": "late"}]}], "compounds": [{"name": "D", "formula": "H2"}, {"name": "B", "role": "base"}, {"name": ""}]}
    flat = {"reactants": ["e", {"name": "f", "smiles": "CF"}], "catalysts": ["Pd", "Ni"], "scaffold_smiles": "not this"}
    page = {"reaction_schemes": [{"reactants": ["g"], "entry_id": "lost"}], "table_data": [{"x": 1}], "table_columns": ["x"], "compounds": [{"name": "unseen"}]}
    late = {"scaffold_smiles": "second", "rgroup_table": {"rgroups": {}}, "table_data": []}
    one = [(1, 0, 3, "embedded", figure), (1, 1, 4, "embedded", flat), (1, 2, 5, "vision", page), (1, 3, 6, "crop", late)]
    return [(*r[:4], json.dumps(r[4])) for r in one] + [(2, 0, 1, "embedded", None), (2, 1, 1, "embedded", "{broken"), (2, 2, 1, "embedded", "[1]"), (2, 3, 1, "embedded", '{"reactants": "text"}'), (3, 0, 1, None, '{"reaction_schemes": [{}]}')]


def test_merged_results(spark):
    results = spark.createDataFrame(_results(), "doc long, ord long, page long, source string, data string")
    known = spark.createDataFrame([(1, "C"), (1, None), (9, "a")], "doc long, name string")
    before = spark.createDataFrame([(1, 2)], "doc long, n long")
    m = merging.merge_results(results, known, before)
    rows = m.reactions.withColumn("entry_id", F.try_variant_get("entry_id", "$", "string")).withColumn("catalyst", F.try_variant_get("catalyst", "$", "string"))
    got = {r["id"]: r for r in rows.select("doc", "id", "type", "entry_id", "catalyst", F.to_json(F.get("reactants", F.lit(0))).alias("first"), F.size("products").alias("n")).where("doc = 1").collect()}
    assert set(got) == {"embedded_page3_3", "embedded_page3_4", "vision_page4_5", "vision_page5_6"}
    assert got["embedded_page3_3"]["type"] is None and got["embedded_page3_4"]["type"] == "unknown"
    assert got["embedded_page3_3"]["entry_id"] == "1a" and got["vision_page5_6"]["entry_id"] is None
    assert got["vision_page4_5"]["catalyst"] == "Pd" and json.loads(got["vision_page4_5"]["first"]) == {"name": "e", "smiles": None}
    assert [r["id"] for r in m.reactions.where("doc = 3").collect()] == ["_page1_1"] and m.reactions.where("doc = 2").count() == 0
    names = [(r["name"], r["smiles"], r["formula"], r["role"], r["source"]) for r in m.compounds.orderBy("doc", "ord", "nth").collect()]
    assert names == [("A", "CA", None, "reactant", "embedded"), ("b", None, None, "reactant", "embedded"), ("D", None, "H2", "unknown", "embedded"), ("e", None, None, "reactant", "vision"), ("f", "CF", None, "reactant", "vision"), ("g", None, None, "reactant", "vision")]
    tables = m.tables.select("page", "source", F.to_json("data").alias("data"), F.size("columns").alias("n")).collect()
    assert [tuple(r) for r in tables] == [(5, "vision", '[{"x":1}]', 1)]
    figures = [(r["doc"], r["type"], r["source"], r["notes"]) for r in m.figures.orderBy("doc", "ord").collect()]
    assert figures == [(1, "scheme", "embedded", "n"), (1, "vision_analysis", None, ""), (1, "vision_analysis", None, ""), (1, "unknown", "crop", ""), (2, "vision_analysis", None, ""), (3, "unknown", None, "")]
    scaffolds = m.scaffolds.select("doc", F.to_json("scaffold_smiles").alias("s"), F.to_json("rgroup_table").alias("t")).collect()
    assert [tuple(r) for r in scaffolds] == [(1, '"C[R1]"', '{"rgroups":{}}')]
    nothing = merging.merge_results(results.limit(0), known)
    assert all(p.count() == 0 for p in nothing)


def test_merged_pages(spark):
    one = {"reactants": ["a", {"name": "b"}, "a", "", None], "yields": [90, 0, 90], "conditions": {"t": "", "s": "dry"}, "selectivity": "", "solvents": "text", "image_description": "", "description": "seen"}
    two = {"reactants": ["c"], "reaction_schemes": [{"reactants": [{"name": "a"}, "d"], "products": [{"smiles": "C"}]}], "conditions": {"t": 25, "s": "wet"}, "selectivity": "high", "image_description": "shown", "compounds": [{"name": "x"}, {}], "table_data": [[1, 2], {"k": 1}]}
    rows = [(1, 1, 8, "p", json.dumps(one)), (1, 0, 7, None, "{}"), (1, 2, 9, "q", json.dumps(two)), (2, 0, 1, "p", None), (2, 1, 1, "p", "[1]")]
    out = merging.merge_pages(spark.createDataFrame(rows, "doc long, ord long, page long, source string, data string"))
    plain = [F.to_json(F.to_variant_object(F.col(c))).alias(c) for c in out.columns if c not in ("doc", "reactionType", "selectivity")]
    got = {r["doc"]: r for r in out.select("doc", "reactionType", "selectivity", *plain).collect()}
    value = lambda c, doc=1: json.loads(got[doc][c])
    assert value("reactants") == ["a", {"name": "b"}, "c", "d"]
    assert value("yields") == [90, 0] and value("solvents") == [] and value("products") == []
    assert value("conditions") == {"s": "dry", "t": 25} and got[1]["selectivity"] == "high" and got[1]["reactionType"] is None
    assert [(i["page"], i["description"], i.get("source")) for i in value("image_descriptions")] == [(8, "seen", "p"), (9, "shown", None)]
    assert value("pages_with_data") == [8, 9]
    assert value("compounds") == [{"page": 9, "source": "q", "data": {"name": "x"}}] and len(value("reaction_schemes")) == 1
    assert [t["data"] for t in value("table_data")] == [{"values": [1, 2]}, {"k": 1}]
    assert value("reactants", 2) == [] and value("conditions", 2) == {} and value("pages_with_data", 2) == []


def _fill(scaffold, parts):
    for rgroup, fragment in sorted(parts.items(), key=lambda p: -len(p[0])):
        scaffold = scaffold.replace(f"[{rgroup}]", "" if (fragment or "H").strip().upper() in ("H", "NONE", "") else fragment)
    # what isn't filled keeps the other notation of an open place
    for n in range(1, 5):
        scaffold = scaffold.replace(f"[R{n}]", f"[*:{n}]")
    return scaffold or None


def _complete(r, table):
    _, _, entry_id, entry, own, reactants = r
    if table is None or not table[1] or not (table[3] or table[4]):
        return reactants, False
    _, scaffold, label, rgroups, partners = table
    rgroups, partners, label = rgroups or {}, partners or {}, label or ""
    known = {e for g in rgroups.values() for e in g}
    names = [(n or "").strip() for n, _, _ in reactants or []]
    at = entry_id or entry or next((n for n in names if n and n in known), "")
    parts = {g: es[at] for g, es in rgroups.items() if at in es}
    for n in names:
        parts |= {g: es[n] for g, es in partners.items() if n in es}
    if own and "[*" not in own:
        new = own
    elif at and parts:
        new = _fill(scaffold, parts)
    else:
        new = None
    if new is None:
        return reactants, False
    if not reactants:
        return [(f"{label or 'scaffold'} ({entry_id or label or 'scaffold'})", new, True)], True
    hit = lambda n, s: not s or s == scaffold or (label and n == label) or (n or "").strip() in known
    return [(n, new, True) if hit(n, s) else (n, s, a) for n, s, a in reactants], True


def test_completed_reactions(spark):
    random.seed(4)
    scaffold = "C[R1](N[R2])[R3]"
    tables = [
        (0, scaffold, "S", {"R1": {"a": "Br", "b": "H"}, "R2": {"a": "none", "c": "F"}}, {"R3": {"p": "I"}, "R1": {"q": "Cl"}}),
        (1, scaffold, None, {"R1": {"a": "Br"}}, None),
        (2, scaffold, "", None, {"R3": {"p": "I", "q": None}}),
        (3, None, "S", {"R1": {"a": "Br"}}, None),
        (4, scaffold, "S", None, None),
        (5, "[R1]", "", {"R1": {"a": "H", "b": " "}}, {}),
    ]
    rows = []
    for i in range(700):
        pick = [(random.choice([None, "", "S", " a ", "b", "p", "q", "other"]), random.choice([None, "", scaffold, "CC"]), None) for _ in range(random.randrange(4))]
        rows.append((i % 7, i, random.choice([None, "", "a", "b", "z"]), random.choice([None, "", "c", "a"]), random.choice([None, "", "", "CCO", "C[*:1]", "C[*]"]), random.choice([pick, pick, pick, None])))
    own = {t[0]: t for t in tables}
    got = merging.complete_reactions(spark.createDataFrame(rows, REACTION), spark.createDataFrame(tables, TABLE)).collect()
    assert len(got) == len(rows) and sum(r["assembled_from_rgroup"] for r in got) > 150
    for r in got:
        reactants, done = _complete(rows[r["pos"]], own.get(r["doc"]))
        assert r["assembled_from_rgroup"] == done, rows[r["pos"]]
        assert (None if r["reactants"] is None else [tuple(x) for x in r["reactants"]]) == reactants, rows[r["pos"]]
