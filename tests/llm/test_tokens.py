import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import token_counts, token_ids, token_memo

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\t", "a", "the", "'s", "é", "日本", "<|endoftext|>", "!!", "1", ".", ",", "\x85", "​", "𝒳"]


@pytest.fixture(scope="module")
def tokenizer():
    return token_memo.load(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_memo_is_the_library(text):
    want = token_memo.load(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_memo.memo(PATH).encode([text])[0], "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=1500))
def test_codes_round_trip(ids):
    chunks, bitmaps, ranks = token_ids.encode_levels(np.array(ids, np.uint32))
    assert token_ids.decode_levels(chunks, bitmaps).tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1}:
        assert token_ids.token_at(chunks, bitmaps, ranks, i) == ids[i]


def test_files(spark, documents, tokenizer, tmp_path):
    random.seed(1)
    rows = [(i, "".join(random.choice(BITS) for _ in range(random.randint(0, 60)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "same"), (92, "same"), (None, "no id"), (93, "long " * 4000)]
    path = str(tmp_path / "ids")
    token_ids.write(documents(rows), path, PATH, segment_tokens=500)
    got = sorted(token_ids.documents(spark, path).collect(), key=lambda r: r["start"])
    start, stream = 0, []
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream += ids.tolist()
    places = random.sample(range(len(stream)), 60)
    df = spark.createDataFrame([(p,) for p in places], "place long")
    assert {r["place"]: r["id"] for r in token_ids.tokens_at(spark, path, df).collect()} == {p: stream[p] for p in places}


def test_empty_table(spark, documents, tmp_path):
    token_ids.write(documents([]), str(tmp_path / "e"), PATH)
    assert token_ids.documents(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 10), (100, 3), (64, 64)])
def test_spliced_counts(spark, documents, tokenizer, chunk, overlap):
    """Texts without a stable place in an overlap too: they are widened."""
    random.seed(chunk)
    rows = [(i, "".join(random.choice(BITS + ["word", " more", "x" * 30]) for _ in range(random.randint(0, 90)))) for i in range(60)]
    rows += [(70, "日" * 500), (71, " " * 300), (72, None), (73, ""), (74, "aé" * 400), (74, "aé" * 400), (None, "b c " * 100)]
    got = token_counts.count_tokens(documents(rows), PATH, 20, chunk, overlap).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in got)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*BITS, "x", "Ω", "字，", "ひ。", "12", "3a", "'", "-", "<", "|", "s", "\r\n", "~"]), max_size=12).map("".join))
def test_stable_places_are_boundaries(text):
    """A stable place of any text is a boundary of the library's tokens, and counts add up over it."""
    t = token_memo.load(PATH)
    ids = t.encode(text, add_special_tokens=False)
    for i in range(1, len(text)):
        if token_counts.stable(text, i):
            parts = [t.encode(x, add_special_tokens=False).ids for x in (text[:i], text[i:])]
            assert parts[0] + parts[1] == ids.ids, (text, i)


@pytest.mark.parametrize("unit", ["日本語的文章没有空格", "日本語的文章，有标点。", "12345678901234567890\n", "日本", "é"])
def test_long_texts_without_spaces(tokenizer, unit):
    """Counts of the library, each character encoded twice at most."""
    text = unit * (300_000 // len(unit))
    size, overlap, asked = 32_768, 512, []

    class Counting:
        def encode(self, x, **kw):
            asked.append(len(x))
            return tokenizer.encode(x, **kw)

    cuts = [text[max(0, i - overlap) : i + size] for i in range(0, len(text), size)]
    assert token_counts.spliced_count(cuts, overlap, Counting()) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert sum(asked) <= 2 * len(text)
