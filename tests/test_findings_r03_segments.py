"""Findings of round 3 on the check's limits: segmentation (op9, pipeline) and token ids (op1)."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from scholia.llm import pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_memory_of_words_is_bounded(model):
    """half a million different words leave no more than two halves of the memory (they all stayed before)."""
    v = pieces.Vocabulary(model)
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=7), 500_000)]
    for i in range(0, len(words), 5000):
        v.encode(" ".join(words[i : i + 5000]))
    assert sum(len(x) for x in vars(v).values() if isinstance(x, dict)) < 350_000


def test_words_solved_together(model):
    """As the lattice of each word gives it, also with a memory that is always full; uncovered characters are left out."""
    v = pieces.Vocabulary(model, 10)
    random.seed(11)
    words = {"".join(random.choice(["▁", "th", "e", "ing", "tion", "é", ".", "a", "\n", "日", "\U00012345"]) for _ in range(random.randint(1, 12)))[:32] for _ in range(3000)}
    got = v.solve_all(list(words))
    for x in words:
        ids, score, gap = v.viterbi(x)
        if x in got:
            assert (np.frombuffer(got[x][0], "<u4").tolist(), *got[x][1:]) == (ids, score, gap)
        else:
            assert any(p < 0 for _, _, p, _ in v.edges(x))
    assert len(got) > 500 and v.solve_all(["\U00012345"]) == {}
    texts = [" ".join(random.choices(sorted(words), k=20)) for _ in range(200)]
    assert list(v.encode_all(texts, 4)) == [pieces.Vocabulary.encode(pieces.vocabulary(model), t, 4) for t in texts]


def test_words_at_once_are_bounded(model, monkeypatch):
    """A text of new words alone is solved in parts, to the same."""
    v, sizes = pieces.Vocabulary(model), []
    solve_all = v.solve_all
    v.solve_all = lambda words: (sizes.append(len(words)), solve_all(words))[1]
    text = " ".join(["".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=6), 1000)])
    monkeypatch.setattr(pieces, "AT_ONCE", 300)
    assert v.encode(text) == pieces.vocabulary(model).encode(text) and max(sizes) == 300 and sum(sizes) == 1000
