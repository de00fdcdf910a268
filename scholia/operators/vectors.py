"""Descriptor vectors: moments, scaling, neighbours, PCA and clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.plans.lineage import cut

#: Seeds that are broadcast at once.
BLOCK = 50_000
#: Rows and seeds of a group of the neighbour search, and pairs whose distances are held at once in it.
ROW_BLOCK, SEED_BLOCK, STEP = 20_000, 10_000, 1 << 21


def moments(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: mean_ and std_ (population; 0 becomes 1) of each feature."""
    m = rows.agg(*[f(c).alias(f"{label}_{c}") for c in features for f, label in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    return m.select(*[F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)).alias(c) if c.startswith("std_") else F.col(c) for c in m.columns])


def standardize(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each feature minus its mean, over its population deviation. The moments are one row, so they are broadcast."""
    m = F.broadcast(moments(rows, features))
    return rows.crossJoin(m).select(*[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) if c in features else F.col(c) for c in rows.columns])


def ranges(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: lo_ and hi_ of each feature; hi is lo + 1 where they are equal."""
    r = rows.agg(*[f(c).alias(f"{label}_{c}") for c in features for f, label in ((F.min, "lo"), (F.max, "hi"))])
    return r.select(*[F.when(F.col(c) == F.col("lo" + c[2:]), F.col(c) + 1).otherwise(F.col(c)).alias(c) if c.startswith("hi_") else F.col(c) for c in r.columns])


def scale(rows: DataFrame, features: Sequence[str], span: DataFrame | None = None) -> DataFrame:
    span = F.broadcast(ranges(rows, features) if span is None else span)
    return rows.crossJoin(span).select(*[((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c) if c in features else F.col(c) for c in rows.columns])


def total(columns: Sequence[Column]) -> Column:
    """Left-to-right sum."""
    return reduce(lambda a, b: a + b, columns)


def by_block(seeds: DataFrame, run: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """The union of run(part) over parts of seeds (seed, ...) of about `block` rows, each broadcast. The seeds are a query
    set against all rows; with more of them there are more passes, never a larger broadcast or a cartesian product."""
    block = block or BLOCK
    n = seeds.count()
    if n <= block:
        return run(F.broadcast(seeds))
    seeds = cut(seeds)
    parts = -(-5 * n // (4 * block))  # a fifth of room, as rows are dealt out by a hash
    out = None
    for i in range(parts):
        found = run(F.broadcast(seeds.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == i)))
        out = found if out is None else out.union(found)
    return out


def _distances(row: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one seed, summed from the first place on as the column expressions do."""
    own = np.zeros(len(row))
    for j in range(row.shape[1]):
        d = row[:, j] - seed[j]
        own += d * d
    return np.sqrt(own)


def _matrix(vectors: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, whole): vectors of n places; those that are null or of another length are zeros and not whole."""
    whole = np.array([v is not None and len(v) == n for v in vectors], bool)
    out = np.zeros((len(vectors), n))
    if whole.any():
        out[whole] = np.stack([np.asarray(v, float) for v, w in zip(vectors, whole, strict=True) if w])
    return out, whole


def _nearest(rows: pd.DataFrame, seeds: pd.DataFrame, k: int, keep_self: bool) -> pd.DataFrame:
    """The k nearest rows (id, v) of each seed (seed, v) of one block; NaN comes after all numbers, null after NaN.

    A product of matrices finds each seed's candidates, with room for its rounding; their distances are then taken exactly.
    """
    ids, out = rows["id"].to_numpy(), []
    if not len(rows):
        seeds = seeds.iloc[:0]
    for n, part in seeds.groupby(seeds["v"].map(lambda v: -1 if v is None else len(v))):
        n = max(int(n), 0)
        r, r_whole = _matrix(rows["v"], n)
        s, s_whole = _matrix(part["v"], n)
        odd = ~(r_whole & np.isfinite(r).all(axis=1))
        plain = np.where(odd[:, None], 0.0, r)
        norm = (plain * plain).sum(axis=1)
        most = min(len(rows), k + 1) - 1
        step = max(1, STEP // max(1, len(rows)))
        for a in range(0, len(part), step):
            own = s[a : a + step]
            with np.errstate(all="ignore"):
                about = norm - 2 * (own @ plain.T) + (own * own).sum(axis=1)[:, None]
            about[:, odd] = np.inf
            # k rows besides the seed itself
            bound = np.partition(about, most, axis=1)[:, most] + 1e-9 * ((own * own).sum(axis=1) + norm.max(initial=0.0))
            for i, (seed, whole) in enumerate(zip(part["seed"].iloc[a : a + step], s_whole[a : a + step], strict=True)):
                near = np.flatnonzero(~(about[i] > bound[i]) | odd)
                if not keep_self:
                    near = near[ids[near] != seed]
                known = r_whole[near] & whole
                with np.errstate(all="ignore"):
                    d = np.where(known, _distances(r[near], own[i]), np.nan)
                best = np.lexsort((ids[near], d, np.isnan(d), ~known))[:k]
                out.append(pd.DataFrame({"seed": seed, "id": ids[near][best], "distance": d[best], "known": known[best]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["seed", "id", "distance", "known"])


def nearest(seeds: DataFrame, rows: DataFrame, k: int, *, keep_self: bool = False, same: bool = False) -> DataFrame:
    """(seed, id, distance, rank): the k nearest rows (id, v) of each seed (seed, v), exactly; equal distances by id.

    Both sides are dealt out to blocks of at most about `ROW_BLOCK` rows and `SEED_BLOCK` seeds, and each pair of blocks is
    one group that gives k rows a seed: no pair of a seed and a row is ever a row of a table. same: both have a column g in
    which they must agree.
    """
    keys = ["g"] if same else []
    row_parts, seed_parts = (max(1, -(-df.count() // size)) for df, size in ((rows, ROW_BLOCK), (seeds, SEED_BLOCK)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")).alias("v")
    r = rows.select("id", whole, *keys, deal("id", row_parts).alias("a"), every(seed_parts).alias("b"))
    s = seeds.select("seed", whole, *keys, every(row_parts).alias("a"), deal("seed", seed_parts).alias("b"))
    for c in keys:
        r, s = r.where(F.col(c).isNotNull()), s.where(F.col(c).isNotNull())
    schema = f"seed {seeds.schema['seed'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double, known boolean"
    found = r.groupBy(*keys, "a", "b").cogroup(s.groupBy(*keys, "a", "b")).applyInPandas(lambda x, y: _nearest(x, y, k, keep_self), schema)
    w = Window.partitionBy("seed").orderBy(F.desc("known"), "distance", "id")
    found = found.withColumn("distance", F.when(F.col("known"), F.coalesce("distance", F.lit(float("nan")))))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("seed", "id", "distance", "rank")


def neighbours(seeds: DataFrame, rows: DataFrame, features: Sequence[str], k: int, *, same: str | None = None, keep_self: bool = False) -> DataFrame:
    """nearest of seeds and rows (ord, features). same: a column in which both must agree."""
    v = F.array(*[F.col(c).cast("double") for c in features]).alias("v")
    g = [F.col(same).alias("g")] if same else []
    return nearest(seeds.select(F.col("ord").alias("seed"), v, *g), rows.select(F.col("ord").alias("id"), v, *g), k, keep_self=keep_self, same=bool(same))


def array_neighbours(seeds: DataFrame, rows: DataFrame, vector: str, k: int) -> DataFrame:
    """neighbours on an array column."""
    v = F.col(vector).cast("array<double>").alias("v")
    return nearest(seeds.select(F.col("ord").alias("seed"), v), rows.select(F.col("ord").alias("id"), v), k)


def similarity(distance: Column, n: int) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - distance / np.sqrt(n)), 3)


def cosine(seeds: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(seed, id, cosine); a zero norm counts as 1."""
    s = seeds.select(F.col("ord").alias("seed"), *[F.col(c).alias(f"s_{c}") for c in features])
    norm = lambda p: F.when((n := F.sqrt(total([F.col(p + c) * F.col(p + c) for c in features]))) == 0, 1.0).otherwise(n)
    dot = total([F.col(c) * F.col(f"s_{c}") for c in features])
    return by_block(s, lambda part: rows.join(part, F.col("ord") != F.col("seed")).select("seed", F.col("ord").alias("id"), (dot / (norm("") * norm("s_"))).alias("cosine")))


def recommend(found: DataFrame, classes: DataFrame, cls: Column, k: int) -> DataFrame:
    """The first k of a class among the 3 k nearest: fewer if those hold fewer."""
    near = found.where(F.col("rank") <= 3 * k).join(classes, "id").where(cls)
    w = Window.partitionBy("seed").orderBy("rank")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def covariance(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, cov): sample covariances of all pairs a <= b, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = rows.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs])
    return one.select(F.inline(items))


def pca_fit(rows: DataFrame, features: Sequence[str], share: float = 0.9, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(components, shares) of standardised features: those up to `share` of the variance and one more, at least `least`.

    The covariance matrix is one aggregate; only that matrix (features squared) comes to the driver. Signs are such that
    each component's largest loading is positive.
    """
    n = len(features)
    m = np.zeros((n, n))
    for r in covariance(standardize(rows, features), features).collect():
        i, j = features.index(r["a"]), features.index(r["b"])
        m[i, j] = m[j, i] = r["cov"]
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order].T
    vectors *= np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])[:, None]
    shares = values / values.sum()
    keep = min(n, max(least, int(np.searchsorted(np.cumsum(shares), share)) + 1))
    return vectors[:keep], shares[:keep]


def pca_project(rows: DataFrame, features: Sequence[str], components: np.ndarray) -> DataFrame:
    """rows, standardised, with pc1, pc2, ..."""
    z = standardize(rows, features)
    return z.select("*", *[total([F.col(c) * float(w) for c, w in zip(features, v, strict=True)]).alias(f"pc{i + 1}") for i, v in enumerate(components)])


def pca_loadings(scores: DataFrame, features: Sequence[str], n: int) -> DataFrame:
    """(component, feature, loading): correlation of each feature with each score; one aggregate."""
    pairs = [(i + 1, c) for i in range(n) for c in features]
    one = scores.agg(*[F.corr(c, f"pc{i}").alias(f"{i}|{c}") for i, c in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("component"), F.lit(c).alias("feature"), F.round(F.col(f"`{i}|{c}`"), 3).alias("loading")) for i, c in pairs])))


def pca_2d(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: eigenvalues of the population covariance of two columns in closed form, their shares, the first axis."""
    m = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    half = (F.col("vx") + F.col("vy")) / 2
    root = F.sqrt(F.greatest(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"), F.lit(0.0)))
    m = m.select("*", (half + root).alias("l1"), (half - root).alias("l2"))
    flat = F.abs("c") <= 1e-10
    ax = F.when(flat, F.when(F.col("vx") >= F.col("vy"), 1.0).otherwise(0.0)).otherwise(F.col("l1") - F.col("vy"))
    ay = F.when(flat, F.when(F.col("vx") >= F.col("vy"), 0.0).otherwise(1.0)).otherwise(F.col("c"))
    n = F.sqrt(ax * ax + ay * ay)
    sum_ = F.col("l1") + F.col("l2")
    share = lambda v: F.when(sum_ > 0, F.round(100 * F.col(v) / sum_, 1)).otherwise(0.0)
    return m.select("l1", "l2", (ax / n).alias("ax"), (ay / n).alias("ay"), share("l1").alias("share1"), share("l2").alias("share2"))


def kmeans(rows: DataFrame, features: Sequence[str], k: int | None = None, restarts: int = 10, seed: int = 42) -> DataFrame:
    """rows with cluster: the best of several seeded runs by cost. k is between 3 and 10, sqrt(n / 3), if not given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    k = k or max(3, min(10, int((rows.count() / 3) ** 0.5)))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(vectors) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(vectors).withColumnRenamed("prediction", "cluster").drop("features")
    vectors.unpersist()
    return out
