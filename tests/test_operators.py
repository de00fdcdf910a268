"""Operators whose order of work matters, against small brute-force versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.operators import extraction, graph, retrieval, rules, segment, vectors
from scholia.sources import records


def test_greedy_keep(spark):
    random.seed(1)
    nodes = [(d, i) for d in range(5) for i in range(12)]
    pairs = sorted({(d, *sorted(random.sample(range(12), 2))) for d in range(5) for _ in range(14)})
    kept = set()
    for d, i in nodes:
        if not any((d, a, i) in pairs and (d, a) in kept for a in range(i)):
            kept.add((d, i))
    n = spark.createDataFrame(nodes, "doc long, ord long")
    p = spark.createDataFrame(pairs, "doc long, a long, b long")
    assert {tuple(r) for r in extraction.greedy_keep(n, p).collect()} == kept


def test_learn_in_file_order(spark):
    rows = spark.createDataFrame([(0, "aa", "x known"), (1, "bb", "aa"), (2, "aa", "other"), (3, "cc", "dd"), (4, "dd", "bb")], "ord long, key string, text string")
    known = spark.createDataFrame([("known", "K"), ("other", "O")], "key string, cls string")
    got = dict(rules.learn_from_rows(rows, known, []).collect())
    assert got == {"known": "K", "other": "O", "aa": "K", "bb": "K", "dd": "K"}


def test_learn_along_a_chain(spark):
    """Each row needs what the one before it taught."""
    rows = spark.createDataFrame([(i, f"k{i}", f"k{i - 1}" if i else "known") for i in range(9)], "ord long, key string, text string")
    known = spark.createDataFrame([("known", "K")], "key string, cls string")
    assert len(rules.learn_from_rows(rows, known, []).collect()) == 10


def test_paragraph_offsets(spark):
    text = "\n\n".join([" short", "a" * 90 + " ", "b" * 80, "c" * 79, "a" * 90, "d" * 100])
    got = segment.paragraphs(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").collect()
    assert [r["index"] for r in got] == [0, 1, 2, 3]
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in got)
    assert got[2]["char_start"] > got[1]["char_start"]


def test_chunks_cover(spark):
    random.seed(2)
    text = "".join(random.choice(["word ", "end. ", "x", "\n\n"]) for _ in range(9000))
    got = segment.chunks(spark.createDataFrame([(1, text), (2, "tiny"), (3, "  ")], "id long, text string"), "id", 2000, 200).collect()
    own = [r for r in got if r["id"] == 1]
    assert [r["text"] for r in got if r["id"] == 2] == ["tiny"] and not [r for r in got if r["id"] == 3]
    for a, b in zip(own, own[1:], strict=False):
        assert b["start"] <= a["start"] + len(a["text"]) + 4


def _count_chunks(text):
    """Windows of 12,000 characters, 1,000 of overlap, at least 201; marks are looked for place by place."""
    if len(text) <= 12_000:
        return int(text.strip() != "")
    n, start = 0, 0
    while len(text) - start > 12_000:
        end = start + 12_000
        for mark in ("\n\n", ". "):
            places = [i for i in range(end - 2400, end + 1000 - len(mark) + 1) if text[i : i + len(mark)] == mark and i > start + 6000]
            if places:
                end = places[-1] + (2 if mark == "\n\n" else 1)
                break
        n += len(text[start:end].strip()) > 200
        start = max(start, end - 1000)
    return n + (text[start:].strip() != "")


def test_chunk_counts_of_long_documents(spark, tmp_path):
    from scholia.queries import QUERIES

    random.seed(12)
    texts = {i: "".join(random.choices(["word ", "end. ", "x", "\n\n"], [50, w, 50, w / 3], k=random.randint(10, 25_000))) for i, w in enumerate([0, 0.01, 0.1, 1, 10] * 4)}
    texts |= {100: " " * 40_000, 101: "tiny", 102: "", 103: "z" * 12_000, 104: "z" * 12_001}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["n"] for r in QUERIES["chunk_counts_all"](spark, str(tmp_path)).collect()}
    assert got == {i: n for i, t in texts.items() if (n := _count_chunks(t))} and max(got.values()) > 5


def test_split_outside(spark):
    df = spark.createDataFrame([("a; b+c (d;e) [f+g]; ) ; h",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.split_outside(F.col("t"))).collect()]
    assert got == [["a", "b", "c (d;e) [f+g]", ")", "h"], [], None]


def test_classify_segments(spark):
    rows = spark.createDataFrame([(1, "foo [bpy]; phen"), (2, "nothing"), (3, None), (4, "thing [dtb-bpy]"), (5, "dtb-bpy thing")], "id long, t string")
    words = spark.createDataFrame([("bpy", "Bpy")], "key string, cls string")
    got = {r["id"]: (r["primary"], r["all_classes"]) for r in rules.classify(rows, "id", "t", words, ["Phen"], []).collect()}
    assert got == {1: ("Bpy", ["Bpy", "Phen"]), 2: ("unknown", []), 3: ("unknown", []), 4: ("Bpy", ["Bpy"]), 5: ("unknown", [])}


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    components, shares = vectors.pca_fit(df, ("a", "b", "c"), 0.999)
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(shares, (values / values.sum())[: len(shares)])
    scores = np.array(vectors.pca_project(df, ("a", "b", "c"), components).select("pc1", "pc2").collect())
    assert np.allclose(scores, z @ components[:2].T)


def test_message_rounds(spark):
    nodes = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, 9.0)], "id long, f double")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert dict(graph.mean_message(nodes, edges, "f").collect()) == {1: 2.0, 2: 2.5, 3: 2.0, 4: 0.0}
    assert dict(graph.mean_message(nodes, edges, "f", 2).collect()) == {1: 2.5, 2: 2.0, 3: 2.5, 4: 0.0}


@pytest.mark.parametrize("text,k", [('{"k": 1}', 1), ('x\n```json\n{"k": 2}\n```', 2), ('see {"k": 3} ok', 3), ('{"k": 4', 4), ("none", None), ("", None)])
def test_json_repair(spark, text, k):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(records.json_repair(F.col("t"), "k int")["k"]).first()[0] == k


def test_text_records_missing_and_null(spark):
    df = spark.createDataFrame([('[{"a": "x", "b": null}, {"b": "y"}]',)], "value string")
    assert [tuple(r)[1:] for r in records.text_records(df, ("a", "b")).collect()] == [("x", "None"), ("", "y")]


def test_rgroup_assembly(spark):
    s = spark.createDataFrame([(1, " C[R1][R10][*] ")], "doc long, scaffold string")
    long = spark.createDataFrame([(1, "R1", "a", "Br"), (1, "R10", "a", "none"), (1, "R1", "b", "H"), (1, "R10", "b", "F")], "doc long, rgroup string, entry string, fragment string")
    assert {r["entry"]: r["smiles"] for r in extraction.assemble(s, long).collect()} == {"a": "CBrBr", "b": "CF"}


def test_stream_equals_batch(spark):
    from scholia.queries import streams
    from scholia.streaming import conversations as c

    live = {r["conv_id"]: (r["n"], r["last_us"]) for r in streams.stream_last_n_ttl(spark, "/root/testdata/sf0.001").collect()}
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"))
    batch = {r["conv_id"]: (r["n"], r["us"]) for r in c.last_messages(e).select("conv_id", "n", F.unix_micros("last_ts").alias("us")).collect()}
    assert live == batch


def test_new_content_once_when_a_batch_is_repeated(spark, tmp_path):
    from scholia.streaming import conversations as c

    out = {}
    handle = lambda rows, epoch: out.__setitem__(epoch, sorted(map(tuple, rows.collect())))
    run = c.extract_new(f"{tmp_path}/cache", lambda b: b, handle)
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, key string")
    run(batch((2, "a"), (1, "a"), (3, "b")), 0)
    run(batch((2, "a"), (1, "a"), (3, "b")), 0)
    run(batch((4, "b"), (5, "c")), 1)
    run(batch((4, "b"), (5, "c")), 1)
    assert out == {0: [(1, "a"), (3, "b")], 1: [(5, "c")]}


def test_literature_contains_whole_query(spark):
    """Against all documents for all queries; one- and two-word queries, marks, and words that stand in no document."""
    random.seed(5)
    word = lambda: random.choice(["Alpha", "beta", "of", "gamma", "Straße", "x_1", "delta", "ab"])
    text = lambda n: "".join(word() + random.choice([" ", " ", ", ", "-", "."]) for _ in range(n))
    docs = [(i, text(2) if i % 9 else " ", text(30), random.choice(["J of beta", "alpha"])) for i in range(60)]
    queries = [(i, docs[i][2][i % 7 : i % 7 + 6 + i]) for i in range(40)] + [(50, "beta"), (51, "lpha"), (52, ""), (53, "beta nowhere gamma"), (54, None), (55, "(of"), (56, "ab of ab")]
    d = spark.createDataFrame(docs, "ord long, title string, body string, journal string")
    q = spark.createDataFrame(queries, "qid long, text string")
    fields = ["title", "body", "journal"]
    got = {(r["qid"], r["ord"]): r["score"] for r in retrieval.search_literature(q, d, fields, fields, "title", 100).collect()}
    want = {}
    for qid, t in queries:
        own = [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 2]
        for i, *texts in docs:
            low = [x.lower() for x in texts]
            words = re.findall(r"\w+", " ".join(low))
            score = sum(words.count(w) for w in own) + 5 * sum(bool(t) and t.lower() in x for x in low)
            if score and texts[0].strip():
                want[qid, i] = score
    assert got == want


def test_neighbours_in_blocks(spark, monkeypatch):
    """Seeds beyond a block give the same rows, without a cartesian product."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=2)), [float(x) for x in rng.normal(size=3)]) for i in range(120)], "ord long, a double, b double, v array<double>")
    kinds = (lambda: vectors.neighbours(rows, rows, ("a", "b"), 3), lambda: vectors.array_neighbours(rows, rows, "v", 3), lambda: vectors.cosine(rows, rows, ("a", "b")))
    whole = [sorted(map(tuple, f().collect())) for f in kinds]
    monkeypatch.setattr(vectors, "BLOCK", 25)
    for f, want in zip(kinds, whole, strict=True):
        got = f()
        assert sorted(map(tuple, got.collect())) == want
        assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
