import pytest
from pyspark.sql import functions as F

from scholia.operators import parsing


@pytest.mark.parametrize("text,want", [
    ("2,2'-bipyridine [bpy] for coupling", [("2,2'-bipyridine", "bpy", "for coupling")]),
    ("indeno[1,2-d]oxazole, [Box]; phen", [("indeno[1,2-d]oxazole", "Box", ""), ("phen", "", "")]),
    ("x [NiCl2] y", [("x", "NiCl2", "y")]),
    ("L1 (pyridine hint), rest", [("L1", "", "pyridine hint; rest")]),
    ("bathophenanthroline (bphen) used as ligand (nickel)", [("bathophenanthroline", "bphen", "used as ligand (nickel)")]),
    ("compound (1,2-d) (abc)", [("compound (1,2-d)", "abc", "")]),
    ("a long name, with a note", [("a long name", "", "with a note")]),
    ("no ligand + dmap", [("dmap", "", "")]),
    ("", []),
])
def test_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(parsing.references(F.col("t"))).first()[0]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("text,want", [
    ("2,2'-bipyridine (bipy) [4,4'-tBu-bpy] for x", [("2,2'-bipyridine", "4,4'-tBu-bpy", "")]),
    ("bis(4-phenyl-oxazoline) complex; L3 (box ligand)", [("bis(4-phenyl-oxazoline)", "", ""), ("L3", "", "box ligand")]),
    ("indeno[1,2-d]oxazole", [("indeno[1,2-d]oxazole", "", "")]),
])
def test_clean_segments(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert [tuple(r) for r in df.select(parsing.clean_segments(F.col("t"))).first()[0]] == want


def test_detect_and_combine(spark):
    q = spark.createDataFrame([(1, "use ligand [dtb-bpy] or Phen"), (2, "oxazoline and [zz]"), (3, "nothing"), (4, None)], "qid long, text string")
    d = spark.createDataFrame([("bpy", "Bpy"), ("zz", "Zed")], "key string, cls string")
    got = {r["qid"]: r["classes"] for r in parsing.detect_classes(q, d, ["Phen", "Bpy"], [("(?i)oxazol", "Box", 4)], []).collect()}
    assert got == {1: ["Bpy", "Phen"], 2: ["Zed", "Box"], 3: [], 4: []}
    members = spark.createDataFrame([(i, f"{c}{i}", c) for c in ("Bpy", "Phen") for i in range(4)], "ord long, name string, cls string")
    found = spark.createDataFrame([(1, f"Bpy{i}", "Bpy", i) for i in range(3)] + [(3, "q", "x", 1)], "qid long, name string, cls string, rank int")
    detected = spark.createDataFrame([(1, ["Bpy", "Phen"]), (3, [])], "qid long, classes array<string>")
    rows = parsing.search_combined(q, detected, members, found, 4).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["name"]) for r in rows] == [(1, "Bpy0"), (1, "Bpy1"), (1, "Phen0"), (1, "Phen1"), (3, "q")]
