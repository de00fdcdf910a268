from scholia.plans import ligand_pack


def test_pack(spark):
    rows = spark.createDataFrame([
        (1, "4,4'-di-tert-butyl-2,2'-bipyridine [dtbbpy]"), (2, "1,10-phenanthroline"), (3, "bis(oxazoline) ligand; bathocuproine"),
        (4, "[phox]"), (5, "water"), (6, "pyridine-imidazoline"), (7, "DMAP"), (8, "pyridine pybox ligand"),
        (9, "L3 (box ligand)"), (10, "a ligand [phox]"),
    ], "id long, t string")
    got = {r["id"]: (r["primary"], r["all_classes"]) for r in ligand_pack.classify(rows, "id", "t").collect()}
    assert got == {
        1: ("Bpy", ["Bpy"]), 2: ("Phen", ["Phen"]), 3: ("BiOX", ["BiOX", "Phen"]), 4: ("unknown", []),
        5: ("unknown", []), 6: ("PyrIm", ["PyrIm"]), 7: ("Bpy", ["Bpy"]), 8: ("Bpy", ["Bpy"]),
        9: ("BiOX", ["BiOX"]), 10: ("PyrOx", ["PyrOx"]),  # a segment without a name (4) is none
    }
    assert ligand_pack.dictionary(spark).count() > 75


def test_detect(spark):
    q = spark.createDataFrame([(1, "compare PyrOx with bipyridine [bphen]"), (2, "hello")], "qid long, text string")
    got = {r["qid"]: r["classes"] for r in ligand_pack.detect(q).collect()}
    assert got == {1: ["Phen", "PyrOx", "Bpy"], 2: []}
