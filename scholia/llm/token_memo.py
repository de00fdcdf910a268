"""Whole-text encoding with the tokenizers library, remembering the ids of pieces between proven boundaries."""

from __future__ import annotations

import os
import re

import numpy as np

_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer file's library object, loaded once per process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def space_pieces(text: str) -> list[str]:
    """Cut text before each space that follows a non-space.

    The byte-level pattern lets a space start a token and never lets one follow other characters inside a token, and it
    looks only to the right of where it stands. So each such place is a token boundary whatever surrounds it, and the
    pieces' ids in a row are the ids of the whole.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    if "" not in parts and not any(x[-1].isspace() for x in parts):
        return [parts[0], *[" " + x for x in parts[1:]]]
    out, held = [], parts[0]
    for x in parts[1:]:
        if held and not held[-1].isspace():
            out.append(held)
            held = " " + x
        else:
            held += " " + x
    return [*out, held]


MARKS = (".", ",", ";", ":", "!", "?")
_UNPROVEN = re.compile(r"\s ")


class Memo:
    """ids as little-endian uint32 bytes. The memory is emptied when it holds `most` pieces; results don't depend on it.

    Pieces not met before are encoded many at a time, in lines: a line break between two pieces is a token of its own,
    at which their ids are taken apart again. Pieces that hold a line break are encoded alone.
    """

    def __init__(self, path: str, most: int = 1_100_000):
        self.tokenizer, self.most, self.known = load(path), most, {}
        self.line_break = self._alone(["\n"])[0]
        self.marks = {x: np.array(e, "<u4").tobytes() for x, e in zip(MARKS, self._alone(list(MARKS)), strict=True)}

    def _alone(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """new: pieces without their leading space. A letter and a mark that ends a piece are never in one token, so a
        piece such as `word,` has the ids of `word` and of the mark."""
        marked = [x for x in new if x[-1:] in MARKS and x[-2:-1].isalpha()]
        new = list(set(new).difference(marked).union(c for x in marked if (c := x[:-1]) not in self.known))
        self._encode(new)
        self.known.update({x: self.known[x[:-1]] + self.marks[x[-1]] for x in marked})

    def _encode(self, new: list[str]) -> None:
        simple = [x for x in new if "\n" not in x and x and not x[-1].isspace()] if len(self.line_break) == 1 else []
        for i in range(0, len(simple), 1000):
            own = simple[i : i + 1000]
            ids = np.array(self._alone(["\n".join([" " + x for x in own])])[0], "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.line_break[0]).tolist(), len(ids)]
            if len(cuts) != len(own) + 1:
                simple = simple[:i]
                break
            data = ids.tobytes()
            self.known.update({x: data[4 * a + 4 : 4 * b] for x, a, b in zip(own, cuts, cuts[1:], strict=False)})
        rest = [x for x in new if x not in self.known]
        self.known.update({x: np.array(e, "<u4").tobytes() for x, e in zip(rest, self._alone([" " + x for x in rest]), strict=True)})

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        rows, heads, new = [], [], set()
        for t in texts:
            parts = t.split(" ") if not _UNPROVEN.search(t) and t[:1] != " " else None
            if parts is None:
                own = space_pieces(t)
                parts = ["", *[x[1:] for x in own]] if own[0][:1] == " " else [own[0], *[x[1:] for x in own[1:]]]
            heads.append(parts[0])
            parts = parts[1:]
            got = list(map(self.known.get, parts))
            lost = [i for i, x in enumerate(got) if x is None] if None in got else []
            new.update(parts[i] for i in lost)
            rows.append((got, [(i, parts[i]) for i in lost]))
        self._learn(list(new))
        out = []
        for (got, lost), head in zip(rows, self._alone(heads), strict=True):
            for i, x in lost:
                got[i] = self.known[x]
            out.append(np.array(head, "<u4").tobytes() + b"".join(got))
        return out


_MEMOS: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]
