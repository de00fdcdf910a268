"""Language id by nearest centroid: TF-IDF character n-grams, several clustered centroids a language, cosine, rejection.

A text's letters are lower-cased; other characters become word edges. Two- and three-letter runs (edges included) are
hashed to `DIMS` places; a place's weight is log(1 + count) times its IDF, and the vector has length 1. Each language has
`CENTROIDS` centroids from spherical k-means. A text gets the language of the nearest one; its score is that cosine. A
text that is much further from all centroids than labelled texts of its length are is `rejected`: every fourth sampled
row is kept from the centroids, it and its beginnings are scored, and a length's floor is `SLACK` times the `QUANTILE` of
those scores. Lengths (in powers of two n-grams) with few scores get floors from their neighbours.

Learning uses at most `fit_rows` labelled rows (a hash sample, even over languages); prediction reads whole texts only.

Defined cases: null text or one without a letter is `und`, score 0, rejected; if nothing can be learned, all are `und`;
rows with a null lang aren't learned from; nearest ties go to the alphabetically first language; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS, CENTROIDS, FIT_ROWS = 4096, 4, 2400
#: Floors: share of the quantile, the quantile of scores of texts kept from the centroids, scores that a length needs.
SLACK, QUANTILE, ENOUGH = 0.7, 0.01, 20
#: Beginnings of calibration texts that are scored besides the whole text, in characters.
_PREFIXES = (6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800)
#: The struct that holds a prediction until it is unpacked.
RESULT = "__scholia_prediction"
#: Characters looked at in one step; a longer text is counted in slices, to the same counts.
_SLICE = 1 << 17
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _count(texts: list[str]) -> np.ndarray:
    lowered = [t.lower() for t in texts]
    c = common.codes("\n" + "\n".join(lowered) + "\n")
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = _letters()[c]
    c = np.where(letter, c, 0).astype(np.uint64)
    keep = letter | np.concatenate(([True], letter[:-1]))
    c, letter, doc = c[keep], letter[keep], np.concatenate((doc[:1], doc))[keep] if len(doc) else doc
    two = (c[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:] + np.uint64(0x7F4A7C15))
    on2 = letter[:-1] | letter[1:]
    own2 = np.where(letter[1:], doc[1:], doc[:-1])
    three = common.mix(two[:-1]) ^ (c[2:] * np.uint64(0xD6E8FEB86659FD93))
    on3, own3 = letter[1:-1], doc[1:-1]
    places = [own2[on2] * DIMS + (common.mix(two[on2]) % np.uint64(DIMS)).astype(np.int64), own3[on3] * DIMS + (common.mix(three[on3]) % np.uint64(DIMS)).astype(np.int64)]
    return np.bincount(np.concatenate(places), minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts by text, a row each."""
    out = np.zeros((len(texts), DIMS), np.int64)
    group, size = [], 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > _SLICE):
            out[group] = _count([texts[j] for j in group])
            group, size = [], 0
        if t is not None and len(t) > _SLICE:
            low = t.lower()
            for a in range(0, len(low), _SLICE):
                # slices overlap by two characters, whose own n-grams, false edges included, were counted twice
                b = a + _SLICE
                out[i] += _count([low[a : b + 2]])[0] - _count([low[b : b + 2]])[0]
        elif t is not None:
            group.append(i)
            size += len(t)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by the mean and then the rows furthest from all seeds."""
    seeds = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin(np.max(x @ np.array(seeds).T, axis=1))])
    centres = np.array(seeds)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.array([_unit(x[own == j].mean(axis=0, keepdims=True))[0] if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


@dataclass
class Model:
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        return _unit((np.log1p(grams) * self.idf).astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, rejected)."""
        grams = counts(texts)
        n = grams.sum(axis=1)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(grams) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.where(n > 0, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
        floor = self.floors[np.log2(np.maximum(n, 1)).astype(int).clip(0, len(self.floors) - 1)]
        return [self.languages[self.owner[b]] if m else "und" for b, m in zip(best, n, strict=True)], score, (n == 0) | (score < floor)


def fit(train: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Learn from train (text, lang). slack: a text is rejected below this share of a low quantile of its length's scores."""
    train = train.where("lang is not null and text is not null").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model(np.ones(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), [], np.zeros(1))
    each = max(1, fit_rows // len(languages))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / sizes[lang]))])
    sample = train.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    # a text repeated any number of times counts once, and the same rows are taken in every run
    sample = sample.dropDuplicates(["text", "lang"]).withColumn("h", F.xxhash64("text", "lang"))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "lang": pdf["lang"], "grams": [x.astype(np.int32).tobytes() for x in counts(pdf["text"].tolist())]})

    kept_out = F.pmod(F.xxhash64("text", F.lit(8)), F.lit(4)) == 0
    learn = sample.where(~kept_out)
    rows = learn.mapInPandas(featurise, "h long, lang string, grams binary").orderBy("h").limit(2 * fit_rows).toPandas()
    if not len(rows):
        rows = sample.mapInPandas(featurise, "h long, lang string, grams binary").orderBy("h").limit(2 * fit_rows).toPandas()
    rows = rows.sort_values(["lang", "grams"], ignore_index=True)
    if not len(rows):
        return Model(np.ones(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), [], np.zeros(1))
    grams = np.array([np.frombuffer(x, np.int32) for x in rows["grams"]])
    idf = np.log((1 + len(grams)) / (1 + (grams > 0).sum(axis=0))) + 1
    model = Model(idf.astype(np.float32), np.zeros((0, DIMS)), np.zeros(0, int), languages, np.zeros(40))
    x = model.vectors(grams)
    x[grams.sum(axis=1) == 0] = 0
    parts = [_k_means(x[(rows["lang"] == lang).to_numpy()], centroids) if (rows["lang"] == lang).any() else np.zeros((0, DIMS)) for lang in languages]
    model.centres = np.concatenate(parts).astype(np.float32)
    model.owner = np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, t in zip(pdf["h"], pdf["text"], strict=True):
                parts = [t, *[t[:k] for k in _PREFIXES if k < len(t)]]
                _, score, _ = model.predict(parts)
                yield pd.DataFrame({"h": h, "n": counts(parts).sum(axis=1), "score": score})

    measured = sample.where(kept_out).mapInPandas(calibrate, "h long, n long, score double").where("n > 0").orderBy("h", "n").limit(2 * fit_rows * (1 + len(_PREFIXES))).toPandas()[["n", "score"]]
    if len(measured) < ENOUGH:  # too few rows: those that were learned from stand in
        own = pd.DataFrame({"n": grams.sum(axis=1), "score": np.max(x @ model.centres.T, axis=1)})
        measured = pd.concat([measured, own[own["n"] > 0]])
    model.floors = floors(measured["n"].to_numpy(), measured["score"].to_numpy(), slack, len(model.floors))
    return model


def floors(n: np.ndarray, score: np.ndarray, slack: float, size: int) -> np.ndarray:
    """The floor of each length bin; bins with few scores lie between their neighbours, the longest have the last floor."""
    bits = np.log2(np.maximum(n, 1)).astype(int)
    at, low = [0], [0.0]
    for b in range(1, size):
        own = score[bits == b]
        if len(own) >= ENOUGH:
            at.append(b)
            low.append(slack * float(np.quantile(own, QUANTILE)))
    return np.interp(np.arange(size), at, low)


def predict(docs: DataFrame, model: Model, *keep: str | Column, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected, next to the kept columns. Only text is looked at."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # DIMS x centroids x languages floats: set by parameters, not by the data

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = held.value.predict([t or "" for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    names = docs.select(*keep).columns
    result = common.free_name(names, RESULT)
    rows = docs.select(*keep, run("text").alias(result))
    return rows.select(*[F.col(f"`{n}`") for n in names], *[F.col(f"{result}.{n}").alias(f"{prefix}{n}") for n in ("lang_pred", "score", "rejected")])


def held_out() -> Column:
    """Whether a document is kept out of learning (null doc_id: it isn't)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model, "doc_id", held_out().alias("held_out"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language id rejects; the other columns stay as they are."""
    common.prepare(spark)
    model = fit(docs.where(~held_out()))
    prefix = common.free_name([c[: -len(end)] for c in docs.columns for end in ("_lang_pred", "_score", "_rejected") if c.lower().endswith(end)], RESULT)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return predict(docs, model, *own, prefix=f"{prefix}_").where(f"not {prefix}_rejected").select(*own)
