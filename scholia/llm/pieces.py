"""SentencePiece encoding and decoding with N-best segmentation: Viterbi forward, exact A* backward.

The lattice of a text has a node at each character and an edge for each vocabulary piece; a character that no piece
covers is an edge to its UTF-8 byte pieces, `UNKNOWN` below the least score. A segmentation's score is the sum of its
pieces' scores as the model file gives them. Forward Viterbi gives each node's best score; these are exact heuristics for
an A* search from the end, which so meets complete segmentations in the order of their scores.

No vocabulary piece has the space mark behind another character (checked when the model is loaded), so every
segmentation of a text is one of each of its words, and the text's N best follow from those words alone whose second best
lies closest to their best: A* runs over these words. A vocabulary without that property is searched text by text.

Defined cases: null text counts as empty and gives no piece and one segmentation, the empty one; equal scores come in
the order of the search, the Viterbi path first, which depends on the text alone; a text may have fewer than N segmentations; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE, UNKNOWN, N_BEST = "▁", 10.0, 4
_LOW = float("-inf")


#: Words of up to so many characters are solved many at a time, so many words at most (some 700 bytes each); texts are
#: taken together up to so many characters.
SHORT, AT_ONCE, TOGETHER = 32, 50_000, 1_000_000


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Table:
    """The nodes of a trie as arrays, to go down from many nodes at once: (node, character) is looked up by hash, with as
    many probes as the fullest place needs."""

    def __init__(self, trie: dict):
        keys, nodes, waiting = [], [], [(0, trie)]
        characters: dict[str, int] = {}
        pieces, scores = [-1], [0.0]
        while waiting:
            above, below = waiting.pop()
            for ch, (piece, score, rest) in below.items():
                keys.append(above << 21 | characters.setdefault(ch, len(characters) + 1))
                nodes.append(len(pieces))
                if rest:
                    waiting.append((len(pieces), rest))
                pieces.append(-1 if piece is None else piece)
                scores.append(score)
        self.pieces, self.scores = np.array(pieces, np.int32), np.array(scores)
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(ch) for ch in characters]] = list(characters.values())
        self.bits = max(len(keys), 1).bit_length() + 2
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, new, self.probes = np.array(keys, np.int64), np.array(nodes, np.int32), 0
        while len(left):
            at = self._place(left, self.probes)
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.nodes[at[free]] = left[free], new[free]
            left, new = np.delete(left, free), np.delete(new, free)
            self.probes += 1

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        first = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (first.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def below(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node below each node by a character's code; 0 if there is none."""
        keys = nodes.astype(np.int64) << 21 | codes
        at = self._place(keys, 0)
        held = self.keys[at]
        out = np.where(held == keys, self.nodes[at], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._place(keys[open_], probe)
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.nodes[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Vocabulary:
    """The pieces of a model file. What was found for words is remembered, in two halves of at most `most` words: when the
    newer one is full it becomes the older, and words that are met again move over. Results don't depend on it."""

    def __init__(self, model_file: str, most: int = 150_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file, num_threads=1)
        size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(size) if self.model.is_byte(i)}
        self.byte_ids = {i: b for b, i in self.bytes.items()}
        #: pieces from their last character to their first: character -> (piece id or None, score, the same below or None)
        self.ends: dict = {}
        least = 0.0
        for i in range(size):
            if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i):
                continue
            score = self.model.get_score(i)
            least = min(least, score) if score > -1e8 else least
            below = self.ends
            for ch in self.pieces[i][:0:-1]:
                own = below.get(ch, (None, 0.0, None))
                if own[2] is None:
                    own = below[ch] = (own[0], own[1], {})
                below = own[2]
            ch = self.pieces[i][0]
            below[ch] = (i, score, below[ch][2] if ch in below else None)
        self.unknown = least - UNKNOWN
        self.table = _Table(self.ends)
        self.text = [bytes([self.byte_ids[i]]) if i in self.byte_ids else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        #: word -> its n best, as n_best gives them; the words that differ in a text's n best are often the same ones
        self.alternatives: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.most = most

    def edges(self, word: str) -> list[tuple[int, int, int, float]]:
        """(begin, end, piece id or -1 for an uncovered character, score), by begin."""
        out = []
        for j in range(1, len(word) + 1):
            i, node = j - 1, self.ends.get(word[j - 1])
            if node is None or node[0] is None:
                out.append((i, j, -1, self.unknown))
            while node is not None:
                if node[0] is not None:
                    out.append((i, j, node[0], node[1]))
                i -= 1
                node = node[2].get(word[i]) if i >= 0 and node[2] else None
        return sorted(out, key=lambda e: e[:2])

    def ids_of(self, word: str, begin: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.bytes[b] for b in word[begin].encode()]

    def viterbi(self, word: str) -> tuple[list[int], float, float]:
        """(ids, score, how far the second best lies below; inf if there is none). The edges are those of `edges`, looked
        at end by end, so that both scores of an end stay in local names; of equal ones the longest piece counts."""
        ends, unknown = self.ends, self.unknown
        best, second, back, j = [0.0], [_LOW], [(0, -1)], 0
        for ch in word:
            i, node, first, next_best, begin, piece_at = j, ends.get(ch), _LOW, _LOW, j, -1
            if node is None or node[0] is None:
                first, next_best = best[j] + unknown, second[j] + unknown
            while node is not None:
                piece, score, below = node
                if piece is not None:
                    a = best[i] + score
                    if a >= first:
                        b = second[i] + score
                        next_best = first if first > b else b
                        first, begin, piece_at = a, i, piece
                    elif a > next_best:
                        next_best = a
                if below is None or not i:
                    break
                i -= 1
                node = below.get(word[i])
            best.append(first)
            second.append(next_best)
            back.append((begin, piece_at))
            j += 1
        ids = []
        while j:
            begin, piece = back[j]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += reversed(self.ids_of(word, begin, piece))
            j = begin
        ids.reverse()
        return ids, best[-1], best[-1] - second[-1]

    def solve(self, word: str) -> tuple[bytes, float, float]:
        """viterbi of a word, with ids as uint32 bytes, remembered."""
        known = self.known.get(word) or self.older.get(word)
        if known is None:
            ids, score, gap = self.viterbi(word)
            known = (_packed(ids), score, gap)
        self.known[word] = known
        return known

    def solve_all(self, words: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """What solve gives for each of words, which have 1 to `SHORT` characters; those with a character that no piece
        covers are left out. All words go a step at once: first down the trie from every place, then from end to end."""
        words = sorted(words, key=len)
        size = np.array([len(w) for w in words])
        codes = self.table.code[common.codes("".join(words))]
        word = np.repeat(np.arange(len(words)), size)
        end = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size) + 1
        at, node, length, edges = np.arange(len(codes)), np.zeros(len(codes), np.int32), 0, []
        bare = np.zeros(len(words), bool)
        while len(at):
            node = self.table.below(node, codes[at - length])
            length += 1
            piece = self.table.pieces[node]
            if length == 1:
                bare[word[piece < 0]] = True
            on = np.flatnonzero(piece >= 0)
            edges.append((at[on], np.full(len(on), length, np.int8), node[on]))
            on = np.flatnonzero((node > 0) & (end[at] > length))
            at, node = at[on], node[on]
        places, lengths, nodes = (np.concatenate(x) for x in zip(*edges, strict=True))
        # edges by end, then from the shortest piece on, as viterbi looks at them
        group = end[places] * 256 + lengths
        order = np.argsort(group, kind="stable")
        places, nodes, group = places[order], nodes[order], group[order]
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
        best, second = np.full((2, int(size.max()) + 1, len(words)), _LOW)
        best[0] = 0.0
        by_end, by_piece = np.zeros(best.shape, np.int8), np.zeros(best.shape, np.int32)
        for a, b in zip(cuts, cuts[1:], strict=False):
            j, n = divmod(int(group[a]), 256)
            w, x = word[places[a:b]], nodes[a:b]
            score = self.table.scores[x]
            one, two = best[j - n, w] + score, second[j - n, w] + score
            had, next_best = best[j, w], second[j, w]
            wins = one >= had
            second[j, w] = np.where(wins, np.maximum(had, two), np.maximum(next_best, one))
            best[j, w] = np.where(wins, one, had)
            w, x = w[wins], x[wins]
            by_end[j, w], by_piece[j, w] = n, self.table.pieces[x]
        # back from the ends; a word's ids are put from its place backwards
        w, j, used, steps = np.flatnonzero(~bare), size[~bare], np.zeros(len(words), np.int64), []
        while len(w):
            steps.append((w, by_piece[j, w]))
            used[w] += 1
            j = j - by_end[j, w]
            w, j = w[j > 0], j[j > 0]
        stop = np.cumsum(used)
        ids = np.zeros(int(stop[-1]), "<u4")
        for k, (w, piece) in enumerate(steps):
            ids[stop[w] - 1 - k] = piece
        data, cut = ids.tobytes(), [0, *(4 * stop).tolist()]
        score = best[size, np.arange(len(words))]
        with np.errstate(invalid="ignore"):  # words that are left out have neither
            gap = score - second[size, np.arange(len(words))]
        rows = zip(words, cut, cut[1:], score.tolist(), gap.tolist(), bare.tolist(), strict=False)
        return {x: (data[a:b], s, g) for x, a, b, s, g, no in rows if not no}

    def learn(self, texts: list[list[str]]) -> None:
        """Solve what isn't remembered of the words of texts."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        new = {x for words in texts for x in words if x not in self.known}
        again = new.intersection(self.older)
        self.known.update({x: self.older[x] for x in again})
        new = [x for x in new - again if len(x) <= SHORT]
        for i in range(0, len(new), AT_ONCE):
            self.known.update(self.solve_all(new[i : i + AT_ONCE]))

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word by A* from its end, with the forward scores as heuristics."""
        size = len(word)
        best, into = [_LOW] * (size + 1), [[] for _ in range(size + 1)]
        best[0] = 0.0
        for i, j, piece, score in self.edges(word):
            best[j] = max(best[j], best[i] + score)
            into[j].append((i, piece, score))
        # among equal scores the latest goes first: ties are followed to their end, not all side by side
        heap, found, count = [(-best[size], 0, size, 0.0, None)], [], 0
        while heap and len(found) < n:
            _, _, j, behind, path = heapq.heappop(heap)
            if not j:
                ids = []
                while path is not None:
                    ids += self.ids_of(word, path[0], path[1])
                    path = path[2]
                found.append((behind, ids))
                continue
            for i, piece, score in into[j]:
                count -= 1
                heapq.heappush(heap, (-(best[i] + score + behind), count, i, score + behind, (i, piece, path)))
        return found

    def alternative(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """n_best of a word, with ids as uint32 bytes, remembered."""
        out = self.alternatives.get((word, n))
        if out is None:
            if len(self.alternatives) > self.most // 8:
                self.alternatives.clear()
            out = self.alternatives[word, n] = [(score, _packed(ids)) for score, ids in self.n_best(word, n)]
        return out

    def words(self, text: str) -> list[str]:
        """The normalised text, cut before each space mark that follows another character."""
        normal = self.model.normalize(text)
        if not normal:
            return []
        if not self.by_word:
            return [normal]
        parts = normal.split(SPACE)
        head, rest = parts[0], parts[1:]
        if "" not in rest:
            return [*([head] if head else []), *[SPACE + x for x in rest]]
        out, held = ([head] if head else []), SPACE + rest[0]
        for x in rest[1:]:
            if held[-1] != SPACE:
                out.append(held)
                held = ""
            held += SPACE + x
        return [*out, held]

    def encode_all(self, texts: list[str], n: int = N_BEST) -> Iterator[tuple[bytes, list[tuple[float, bytes, list[tuple[int, int, bytes]]]]]]:
        """encode of each of texts; words are solved for up to `TOGETHER` characters of them at once."""
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                size += len(texts[end])
                end += 1
            words = [self.words(t) for t in texts[begin:end]]
            self.learn(words)
            for own in words:
                yield self.encode_words(own, n)
            begin = end

    def encode(self, text: str, n: int = N_BEST) -> tuple[bytes, list[tuple[float, bytes, list[tuple[int, int, bytes]]]]]:
        """(ids of the best segmentation as uint32 bytes, (score, ids, changes) of the n best, the first of them that
        one). changes: (place, how many ids of the best go, ids that come), from the last place to the first."""
        return next(self.encode_all([text], n))

    def encode_words(self, words: list[str], n: int) -> tuple[bytes, list[tuple[float, bytes, list[tuple[int, int, bytes]]]]]:
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.solve(words[k])
        parts = [x[0] for x in got]
        ids = b"".join(parts)
        score = sum([x[1] for x in got])
        # only the n - 1 words with the closest second best can differ in one of the n best
        gaps = [x[2] for x in got]
        closest = [k for k in np.argsort(np.array(gaps), kind="stable")[: n - 1].tolist() if gaps[k] < float("inf")]
        totals: list[tuple[float, dict[int, bytes]]] = [(score, {})]
        for k in closest:
            own, base = got[k][0], got[k][1]
            # equal scores: the segmentation that stands in ids comes first
            options = [(o, x) for o, x in self.alternative(words[k], n) if x != own]
            options = [(base, None), *options][:n]
            totals = heapq.nlargest(n, [(s + o - base, c if x is None else {**c, k: x}) for s, c in totals for o, x in options], key=lambda t: t[0])
        best = [(score, ids, [])]
        places = {k: sum(map(len, parts[:k])) for k in closest} if len(totals) > 1 else {}
        for s, c in totals[1:]:
            changes, whole, end = [], [], len(ids)
            for k in sorted(c, reverse=True):
                begin, size = places[k], len(parts[k])
                changes.append((begin // 4, size // 4, c[k]))
                whole += [ids[begin + size : end], c[k]]
                end = begin
            best.append((s, b"".join([ids[:end], *reversed(whole)]), changes))
        return ids, best

    def decode(self, ids: list[int]) -> str:
        """The normalised text of ids, with spaces for marks and without the space that encoding puts in front."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def same_text(self, ids: np.ndarray, changes: list[tuple[int, int, bytes]]) -> bool:
        """Whether the ids that come stand for the same bytes as those that go."""
        spell = lambda x: b"".join([self.text[i] for i in x.tolist()])
        return all(spell(ids[at : at + n]) == spell(np.frombuffer(new, "<u4")) for at, n, new in changes)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    if model_file not in _VOCABULARIES:
        _VOCABULARIES[model_file] = Vocabulary(model_file)
    return _VOCABULARIES[model_file]


_BEST = "array<struct<score: double, n_pieces: int, ids_crc32: long, changes: array<struct<place: int, n: int, ids: array<int>>>>>"


def encode(docs: DataFrame, model_file: str, n: int = N_BEST, prefix: str = "") -> DataFrame:
    """docs with piece_ids, n_pieces, ids_crc32, score, n_best and round_trip: whether the ids of each give the text back.

    n_best has score, n_pieces, ids_crc32 and changes of each of the n best. Its segmentations share most of their ids
    with the first one, so each is kept as what changes in piece_ids; `segmentation` gives all ids of one.
    Columns of docs that are named like one of these are replaced.
    """

    @F.pandas_udf(f"piece_ids array<int>, n_pieces long, ids_crc32 long, score double, n_best {_BEST}, round_trip boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(model_file)
        out = []
        texts = [t or "" for t in texts]
        for t, (data, best) in zip(texts, v.encode_all(texts, n), strict=True):
            ids = np.frombuffer(data, "<u4").astype(np.int32)
            same = v.decode(ids.tolist()) == t.replace(SPACE, " ") and all(v.same_text(ids, c) for _, _, c in best)
            rows = [{"score": s, "n_pieces": len(x) // 4, "ids_crc32": zlib.crc32(x), "changes": [{"place": at, "n": k, "ids": np.frombuffer(new, "<u4").tolist()} for at, k, new in c]} for s, x, c in best]
            out.append((ids, len(ids), rows[0]["ids_crc32"], best[0][0], rows, same))
        return pd.DataFrame(out, columns=["piece_ids", "n_pieces", "ids_crc32", "score", "n_best", "round_trip"])

    own = ("piece_ids", "n_pieces", "ids_crc32", "score", "n_best", "round_trip")
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {prefix + x for x in own}]
    result = common.free_name(docs.columns, "pieces")
    return docs.select(*names, run("text").alias(result)).select(*names, *[F.col(f"{result}.{c}").alias(prefix + c) for c in own])


def segmentation(piece_ids: Column, changes: Column) -> Column:
    """All ids of one of the n best: piece_ids with its changes made (they come from the last place to the first)."""

    def change(ids: Column, c: Column) -> Column:
        return F.concat(F.slice(ids, F.lit(1), c["place"]), c["ids"], F.slice(ids, c["place"] + c["n"] + 1, F.size(ids)))

    return F.aggregate(changes, piece_ids, change)


def decode(rows: DataFrame, model_file: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """rows with the text that the piece ids in the column ids stand for; null ids give null."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        v = vocabulary(model_file)
        return pd.Series([None if x is None else v.decode(list(x)) for x in lists], dtype=object)

    return rows.withColumn(into, run(F.col(ids)))


def op9_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # ids are given as digests
    return rows.select("doc_id", "n_pieces", "ids_crc32", "score", F.transform("n_best", lambda b: b.dropFields("changes")).alias("n_best"), "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its text, ids and N best segmentations."""
    import public_tokenizers

    common.prepare(spark)
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), prefix="sp_")
