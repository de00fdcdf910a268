"""The classification cascade, ordered learning, contains-joins, name resolution, JSON repair and timers against brute force."""

import datetime as dt
import json
import random
import re

from pyspark.sql import functions as F

from scholia.operators import parsing, retrieval, rules
from scholia.operators.containment import contained
from scholia.plans import ligand_pack as lp
from scholia.queries.rules import LIGANDS
from scholia.sources import records
from scholia.streaming import conversations as c


def _py(pattern):
    return re.compile(pattern.replace("(?iU)", "(?i)"))


SCAFFOLDS, INLINE = [[(_py(p), cls, n) for p, cls, n in pack] for pack in (lp.SCAFFOLDS, lp.INLINE)]
CODE = re.compile(r"\b(" + "|".join(lp.CODES) + r")\b", re.I)


def _first(text):
    return next(((cls, n) for p, cls, n in SCAFFOLDS if p.search(text)), None)


def _inline(text):
    best = None
    for p, cls, n in INLINE:
        if p.search(text) and (best is None or n > best[1]):
            best = (cls, n)
    return best


def _code(text):
    m = CODE.search(text)
    return next((x for x in lp.CODES if m and x.lower() == m[1].lower()), None)


def _part(text, index):
    for part in re.split(r"[-,/\s]+", re.sub(r"\([^)]*\)", "", text)):
        if len(part) >= 2:
            cls = index.get(part.lower()) or _code(part)
            if cls:
                return cls
    return None


def test_learning_one_by_one(spark):
    """References resolved in file order, each with what those before it taught, chains included."""
    random.seed(41)
    texts = [random.choice(LIGANDS) if random.random() < 0.6 else "; ".join(random.choices(LIGANDS, k=2)) for _ in range(60)]
    texts += ["bipyridine thing [aa]", "x [aa-1]", "y [bb aa-1]", "z [bb]", "named LIGAND [cc]", "q [cc]", "q [cc]"] + [f"w [c{i + 1} c{i}]" for i in range(8)] + ["phen base [c0]"] + [f"w [c{i + 1} c{i}]" for i in range(8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    names = spark.createDataFrame([("named ligand", "PyCam"), ("other", "nothing")], "name string, cls string")
    words, segments = lp.learn(rows, names)
    index = {}
    for r in lp.dictionary(spark).orderBy("ord").collect():
        index.setdefault(r["key"], r["cls"])
    refs = parsing.references_of(rows, "ord").orderBy("ord", "pos").collect()
    raw = {}
    for r in refs:
        a, full = r["abbreviation"], r["full_name"]
        cls = None
        if a:
            cls = index.get(a.lower()) or _code(a) or _part(a, index) or (_first(a) or (None,))[0]
        cls = cls or {"named ligand": "PyCam"}.get(full.lower()) or (_first(full) or (None,))[0]
        if cls:
            raw[r["segment"]] = cls
            if a:
                index.setdefault(a.lower(), cls)
    got = dict(map(tuple, words.collect()))
    assert set(got.items()) ^ set(index.items()) == set() and {"aa-1", "bb aa-1", "nl1-me"} <= set(index)
    assert dict(map(tuple, segments.collect())) == raw


def test_cascade_by_steps(spark):
    texts = [*LIGANDS, "L3 (box ligand)", "L9 (xx; phenanthroline/zz)", "L9 (nothing at all)", "BiOX thing", "Bpy and pyridine [phen]", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    known = spark.createDataFrame([("water", "Bpy"), ("DMAP", "no class")], "segment string, cls string")
    got = {r["id"]: tuple(r)[1:] for r in lp.classify(rows, "id", "t", known).collect()}
    brackets = spark.createDataFrame([(i, b) for i, b in enumerate(["dtbbpy", "new-lig", "nl1", "nl1-Me", "phen", "Pent(3,3)-Bis(IndOx)"])], "k long, b string")
    of = {r["k"]: (r["cls"], r["confidence"]) for r in parsing.bracket_class(brackets, "k", "b", lp.dictionary(spark), lp.CODES, lp.SCAFFOLDS).collect()}
    of = {b: of.get(i) for i, b in enumerate(["dtbbpy", "new-lig", "nl1", "nl1-Me", "phen", "Pent(3,3)-Bis(IndOx)"])}
    segs = {r["id"]: r["s"] for r in rows.select("id", parsing.clean_segments(F.coalesce("t", F.lit(""))).alias("s")).collect()}
    for i, t in enumerate(texts):
        found = []
        for s in segs[i]:
            m = of.get(s["bracket"]) if s["bracket"] else None
            m = m or next(((x, 5) for x in lp.CODES if re.search(rf"\b{x}\b", s["name"], re.I)), None) or _first(s["name"])
            if m is None and s["hint"]:
                m = _first(s["hint"]) or _inline(s["hint"])
                if m is None:
                    m = next((_first(x.strip()) for x in re.split("[/;,]", s["hint"]) if len(x.strip()) >= 3 and _first(x.strip())), None)
            m = m or _inline(s["name"])
            if m:
                found.append(m)
        want = ("unknown", 0, []) if not found else (max(found, key=lambda m: (m[1], -found.index(m)))[0], max(m[1] for m in found), list(dict.fromkeys(m[0] for m in found)))
        want = ("Bpy", 5, ["Bpy"]) if t == "water" else want
        assert (got[i][0], got[i][2], got[i][3]) == want, t
    assert got[1][0] == "BiOX"


def test_contained_by_all_pairs(spark):
    random.seed(42)
    word = lambda n: "".join(random.choices("abé🙂", k=n))
    needles = [(i, word(random.randint(0, 5))) for i in range(80)] + [(90, ""), (91, "abcabc"), (92, "a\nb")]
    texts = [(i, word(random.randint(0, 12))) for i in range(80)] + [(90, ""), (91, None), (92, "xa\nby"), (93, "ab" * 5000)]
    got = contained(spark.createDataFrame(needles, "n long, needle string"), spark.createDataFrame(texts, "t long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n, x in needles for t, y in texts if x and y and x in y)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert contained(spark.createDataFrame([(1, "")], "n long, needle string"), spark.createDataFrame(texts, "t long, text string")).count() == 0


def test_names_and_references(spark):
    names = spark.createDataFrame([(0, 1, "azzb", "p"), (1, 2, "azzbcd", "q"), (2, 3, "xtbu-bpy", "q"), (3, 4, "foo bar", "r"), (4, 5, "Longer (name) here", "r")], "ord long, id long, name string, cls string")
    q = spark.createDataFrame([(1, "zz"), (2, "foo [tbu]"), (3, "FOO  bar"), (4, "nger name he"), (5, "azzbcdef"), (6, "?"), (7, None), (8, "")], "qid long, text string")
    got = {r["qid"]: (r["id"], r["strategy"]) for r in rules.resolve_names(q, names).collect()}
    assert got == {1: (1, "contained"), 2: (3, "bracket"), 3: (4, "exact"), 4: (5, "tokens"), 5: (2, "contained")}
    classes = spark.createDataFrame([(6, "q"), (7, "none")], "qid long, cls string")
    got = {r["qid"]: (r["id"], r["strategy"]) for r in parsing.resolve_reference(q, names, classes).collect()}
    assert got == {1: (1, "contained"), 2: (3, "bracket"), 3: (4, "exact"), 4: (5, "tokens"), 5: (2, "contained"), 6: (2, "class")}


def test_substring_search_of_an_empty_query(spark):
    rows = spark.createDataFrame([(0, 7, "B"), (1, 8, "a"), (2, 9, "b")], "ord long, id long, name string")
    q = spark.createDataFrame([(1, ""), (2, "B"), (3, "z")], "qid long, text string")
    assert sorted(map(tuple, retrieval.search_substring(q, rows, 2).collect())) == [(1, 7, "B", 1), (1, 9, "b", 2), (2, 7, "B", 1), (2, 9, "b", 2)]


def _largest(text, opening, closing, size):
    depth, start, best = 0, -1, None
    for i, ch in enumerate(text):
        if ch == opening:
            if depth == 0:
                start = i
            depth += 1
        elif ch == closing:
            depth -= 1
            if depth == 0 and start >= 0:
                try:
                    x = json.loads(text[start : i + 1])
                except ValueError:
                    continue
                if best is None or size(x) > size(best):
                    best = x
    return best


def test_json_repair_by_scanning(spark):
    random.seed(43)
    parts = ['{"k": 1}', '{"k": 2, "j": 3}', '{"k": {"m": [1]}}', "{bad}", "}", "{", " text ", "[1, 2]", "[[3], {}]", "é", "]", '{"k": 5, "a": "{"}']
    texts = ["x " + "".join(random.choices(parts, k=random.randint(1, 6))) for _ in range(300)] + ['x {"k": 1} y {"k": 2, "j": 3}', "", None, "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r for r in rows.select("id", records.largest_balanced(F.col("t"), "{}", lambda s: F.size(F.json_object_keys(s))).alias("o"), records.largest_balanced(F.col("t"), "[]", F.length).alias("a"), records.json_repair(F.col("t"), "k int")["k"].alias("k")).collect()}
    for i, t in enumerate(texts):
        want = _largest(t or "", "{", "}", len)
        assert (None if got[i]["o"] is None else json.loads(got[i]["o"])) == want, t
        assert (got[i]["a"] is None) == (_largest(t or "", "[", "]", lambda x: len(str(x))) is None), t
    assert got[300]["k"] == 2


def test_timers_and_bounded_history(spark, tmp_path):
    """Batches of a stream: what timers evict, a conversation that starts anew, one with very many messages."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    batches = [
        [(1, at(0), "u", "a"), (1, at(10), "u", "b"), (2, at(5), "u", "c"), *[(3, at(i % 900), "u", str(i)) for i in range(30_000)]],
        [(2, at(3000), "u", "d"), (4, at(5400), "u", "e")],
        [(1, at(5500), "u", "again"), (4, at(20_000), "u", "f")],
        [(5, at(20_001), "u", "g")],
    ]
    rows = lambda b: spark.createDataFrame(b, c.MESSAGE).coalesce(1)
    for i, b in enumerate(batches):
        rows(b).write.parquet(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("part-*"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
    stream = lambda: spark.readStream.schema(c.MESSAGE).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*.parquet")
    counts = []

    def write(batch, epoch):
        batch.write.mode("append").parquet(f"{tmp_path}/evicted")
        counts.append(tuple(c.evicted_per_batch(batch, epoch).first()))

    q = c.evictions_stream(stream(), 20).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    got = sorted((r["conv_id"], r["n"], int((r["last_ts"] - t0).total_seconds())) for r in spark.read.schema(c.EVICTED).parquet(f"{tmp_path}/evicted").collect())
    assert got[0][0] == 1 and {g[0] for g in got} >= {1, 2, 3} and (3, 20, 899) in got and (2, 2, 3000) in got
    assert (1, 1, 5500) in got and 5 not in {g[0] for g in got}
    assert sum(n for _, n, _ in counts) == len(got)

    out = c.last_messages_stream(stream(), 20)
    q = out.writeStream.foreachBatch(lambda b, e: b.withColumn("e", F.lit(e)).write.mode("append").parquet(f"{tmp_path}/last")).outputMode("update").option("checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    last = spark.read.parquet(f"{tmp_path}/last").groupBy("conv_id").agg(F.max_by("n", "e").alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in last} == {1: 1, 2: 2, 3: 20, 4: 1, 5: 1}
    history = spark.createDataFrame([(1, 3, at(0), at(100), "u"), (2, 1, at(9000), at(9000), "u")], c.HISTORY)
    assert {r["conv_id"]: (r["n"], r["roles"]) for r in c.read_history(history, at(9100)).collect()} == {1: (0, None), 2: (1, "u")}
