"""Alignment, spelling variants and mixing against brute force."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scholia.llm import alignment, mixing, spelling

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = 20_000


# ---------------------------------------------------------------- alignment


def _aligned(rows):
    """By definition: tokens with byte spans from each library, overlaps by comparing spans."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = alignment.byte_letters()
    out, links = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            want = (" " + text).encode()
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            bytes_a = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(tb.id_to_piece(i)[1:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
                a = b = []
        spans = []
        for ids, data in ((a, a and bytes_a), (b, b and bytes_b)):
            ends = np.cumsum([len(x) for x in data]) if ids else np.zeros(0, int)
            spans.append(list(zip(ids, ends - [len(x) for x in data] if ids else [], ends, strict=True)))
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [([], []) for _ in ends]
        for k, side in enumerate(spans):
            for i, _, e in side:
                groups[bisect.bisect_left(ends, e)][k].append(i)
        own, j = [], 0
        for x, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    own.append((x, spans[1][j][0]))
                j += 1
        links.update(own)
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), own, digest))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((d, n_a, n_b, n_g, len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), digest) for d, n_a, n_b, n_g, own, digest in out), key=str)


@pytest.mark.parametrize("held", [alignment.HELD, 500])
def test_alignment_by_definition(spark, documents, monkeypatch, held):
    """With one run a task and with many, which are merged in several rounds."""
    random.seed(21)
    odd = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "naïve café", "x\n y\n\n z", "日本語のテキスト", "a▁b", "<s> </s> <|endoftext|>x <0x41>", "\t\t", "é́ ", "🙂🙂 🙂", "\x1c x", "don't we'll", "0123456789 12,345.67"]
    words = ["alignment", "tokenizer", "naïve", "the", "überraschung", "x1", "pre-tokenised", "…", "foo_bar", "日本"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(60)]
    rows += [(None, "the same row"), (7, "the same row"), (7, "the same row"), (200, "long " * LONG), (2**60 + 1, "wide id")]
    monkeypatch.setattr(alignment, "HELD", held)
    monkeypatch.setattr(alignment, "BLOCK", 1000)
    if held == 500:
        rows = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    docs = documents(rows).repartition(5)
    runs = alignment.encoded(docs, A, B, 4)
    got = {r["bucket"]: r["n"] for r in runs.where("bucket is not null").groupBy("bucket").count().withColumnRenamed("count", "n").collect()}
    assert len(got) == 4 and (held != 500 or max(got.values()) > 4)
    if held == 500:  # merges of three runs at most: several rounds
        one = alignment.counts(runs.where("bucket is not null").select("bucket", "run", "pairs"), 3).collect()
        two = alignment.counts(runs.where("bucket is not null").select("bucket", "run", "pairs"), 1000).collect()
        unpack = lambda r: [x.tolist() for x in map(np.concatenate, zip(*alignment.blocks(bytes(r["counts"])), strict=True))]
        assert {r["bucket"]: unpack(r) for r in one} == {r["bucket"]: unpack(r) for r in two}
    assert sorted(map(tuple, alignment.alignments(docs, A, B).collect()), key=str) == _aligned(rows)


def test_alignment_of_nothing(spark, documents):
    assert alignment.alignments(documents([]), A, B).collect() == []
    assert [tuple(r) for r in alignment.alignments(documents([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_runs():
    """A run comes back as it went in, and a merge sums what it holds."""
    rng = np.random.default_rng(3)
    keys = [np.unique(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) >> np.uint64(s)) for s in (0, 40, 45, 46)]
    runs = [alignment.pack(k, np.arange(len(k), dtype=np.uint64)) for k in keys]
    for k, run in zip(keys, runs, strict=True):
        back, n = map(np.concatenate, zip(*alignment.blocks(run), strict=True))
        assert (back == k).all() and (n == np.arange(len(k))).all()
    want = Counter()
    for k in keys:
        want.update(dict(zip(k.tolist(), range(len(k)), strict=True)))
    merged, n = map(np.concatenate, zip(*alignment.merge(runs), strict=True))
    assert merged.tolist() == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


# ---------------------------------------------------------------- spelling variants


def _near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def _variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and _near(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_variants_by_all_pairs(spark):
    """Random words of a small alphabet, so that all kinds of edits and runs of letters occur, prefixes of each other, and
    very long words."""
    random.seed(22)
    words = {"".join(random.choices("abé", k=random.randint(6, 9))) for _ in range(900)}
    long = "".join(random.choices("xyz", k=3000))
    words |= {long, long[:-1], long[1:], long[:1500] + long[1501:], long[:700] + "q" + long[701:], long + "x", "z" * 40, "z" * 41, "z" * 42}
    words |= {"prefix" + "s" * i for i in range(12)}
    n = {w: random.choice([5, 6, 30, 200, 1000]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == _variants(n)


def test_variants_shuffled(spark, monkeypatch):
    """The same where nothing is small: hot nodes apart, the rest joined by shuffle."""
    random.seed(23)
    monkeypatch.setattr(spelling.common, "BROADCAST_ROWS", 10)
    n = {"common" + "".join(random.choices("abc", k=random.randint(1, 4))): random.choice([5, 40]) for _ in range(150)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=str) == _variants(n)


def test_vocabulary_by_definition(spark, documents, monkeypatch):
    random.seed(24)
    words = ["Straße", "École", "variant", "variants", "Variantes", "tiny", "×÷×÷×÷", "ÀÉÎÕÜ", "naïveté", "don't"]
    rows = [(i, " ".join(random.choices(words, k=200)) + random.choice(["", "1", " – ", "字"])) for i in range(80)]
    rows += [(None, "variant " * 9), (5, None), (6, ""), (7, "variant variants"), (7, "variant variants"), (8, "x" * 5000 + " " + "variant," * 40_000)]
    monkeypatch.setattr(spelling, "SLICE", 1000)
    monkeypatch.setattr(spelling, "HELD", 5)
    want = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = {r["word"]: r["n"] for r in spelling.vocabulary(documents(rows)).collect()}
    assert got == want and len(want) > 6


def test_variants_of_nothing(spark, documents):
    assert spelling.variants(spelling.vocabulary(documents([]))).collect() == []
    assert spelling.variants(spelling.vocabulary(documents([(1, None), (2, "word")]))).collect() == []


# ---------------------------------------------------------------- mixing


def _mix_by_sql(df):
    table = df.toArrow()  # noqa: F841  duckdb reads it by name
    c = duckdb.connect()
    c.register("documents", table)
    return sorted(c.sql(mixing.OP13_SQL).select("doc_id, size, source_size, target, taken, source").fetchall(), key=str)


def test_mixing_by_sorting(spark, tmp_path):
    """Against SQL that sorts: sources that stop, an empty one, a null one, repeated rows, one long text."""
    random.seed(25)
    rows = [(i, " ".join(["w"] * random.randint(0, 40)), random.choice(["a", "b", "c", "é", "日", "Z", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "empty"), (502, None, "empty"), (503, "x y \t z\x0b\n", "b"), (None, "no id", "c"), (None, "no id", "c")]
    rows += [(600, "seven words that come again and again", "copies")] * 90 + [(601, "one " * 20_000, "huge"), (602, "tiny", "huge")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(df)
    again = mixing.mix(df.repartition(3))
    want = _mix_by_sql(df)
    for x in (got, again):
        out = sorted(map(tuple, x.select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=str)
        assert out == want
    by = {}
    for d, size, source_size, target, taken, source in want:
        assert taken <= 3 * size and target <= 3 * source_size
        by.setdefault(source, [target, 0, 0])
        by[source][1] += taken
        by[source][2] = max(by[source][2], size)
    assert abs(sum(t for t, *_ in by.values()) - sum(r[1] for r in want)) < 1e-6
    assert all(abs(t - n) <= most / 2 for t, n, most in by.values())


def test_mixing_of_nothing(spark, documents):
    assert mixing.mix(documents([])).collect() == []
    got = mixing.mix(documents([(1, None), (2, " ")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0, "s"), (2, 0, 0, 0.0, 0, "s")]


def test_nested_thresholds(spark, documents):
    """A larger target takes all that a smaller one takes."""
    docs = spark.createDataFrame([(i, "w " * (i % 13), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    low, high = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, (w, 5)).collect()} for w in (2, 4))
    assert all(low[i] <= high[i] for i in range(0, 300, 2)) and low != high
