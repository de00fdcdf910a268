"""Queries of descriptor vectors. Seeds are the ligands whose number is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import vectors as v
from scholia.plans.bindings import DIMS, ligands, table, with_views


def _seeds(rows):
    return rows.where("ord % 50 = 0")


def agg_minmax_ranges(spark, d):
    return v.ranges(ligands(spark, d), DIMS)


def agg_moments(spark, d):
    m = v.moments(ligands(spark, d), DIMS)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def vec_standardize(spark, d):
    z = v.standardize(ligands(spark, d).select("ord", *DIMS), DIMS)
    return z.select("ord", *[F.round(c, 6).alias(c) for c in DIMS])


def agg_covariance(spark, d):
    z = v.standardize(ligands(spark, d), DIMS)
    return v.covariance(z, DIMS).select("a", "b", F.round("cov", 6).alias("cov"))


def sim_minmax_topk(spark, d):
    rows = v.scale(ligands(spark, d), DIMS)
    found = v.neighbours(_seeds(rows), rows, DIMS, 5)
    return found.select("seed", "id", "rank", v.similarity(F.col("distance"), 8).alias("similarity"))


def sim_minmax_same_class(spark, d):
    rows = v.scale(ligands(spark, d), DIMS)
    return v.neighbours(_seeds(rows), rows, DIMS, 5, same="cls").select("seed", "id", "rank")


def knn_embedding(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return v.array_neighbours(_seeds(e), e, "vec", 5).select("seed", "id", "rank")


def knn_by_features(spark, d):
    """A profile of the means of even classes (one a class) against all ligands, in the ligands' scaled space."""
    rows = ligands(spark, d)
    profiles = rows.where("cls % 2 = 0").groupBy(F.col("cls").cast("long").alias("ord")).agg(*[F.round(F.avg(c), 4).alias(c) for c in DIMS])
    span = v.ranges(rows, DIMS)
    return v.neighbours(v.scale(profiles, DIMS, span), v.scale(rows, DIMS, span), DIMS, 5, keep_self=True).select("seed", "id", "rank")


def cosine_std(spark, d):
    z = v.standardize(ligands(spark, d), DIMS)
    return v.cosine(_seeds(z), z, DIMS).select("seed", "id", F.round("cosine", 6).alias("cosine"))


def recommend(spark, d):
    rows = v.scale(ligands(spark, d), DIMS)
    found = v.neighbours(_seeds(rows), rows, DIMS, 30)
    classes = rows.select(F.col("ord").alias("id"), "cls")
    return v.recommend(found, classes, F.col("cls") < 3, 10).select("seed", "id", "place")


def pca_2d_closed(spark, d):
    m = v.pca_2d(ligands(spark, d), "d1", "d2")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def pca_fit(spark, d):
    """Shares of the components that are kept."""
    _, shares = v.pca_fit(ligands(spark, d), DIMS)
    return spark.createDataFrame([(i + 1, float(round(s, 6))) for i, s in enumerate(shares)], "component int, share double")


def pca_project(spark, d):
    rows = ligands(spark, d)
    components, _ = v.pca_fit(rows, DIMS)
    return v.pca_project(rows, DIMS, components).select("ord", *[F.round(f"pc{i + 1}", 6).alias(f"pc{i + 1}") for i in range(len(components))])


def pca_loadings(spark, d):
    rows = ligands(spark, d)
    components, _ = v.pca_fit(rows, DIMS)
    return v.pca_loadings(v.pca_project(rows, DIMS, components), DIMS, len(components))


def pca_3feature_map(spark, d):
    """Parts by size, price and name length: two scores, centred and scaled to their range."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.length("p_name").cast("double").alias("c"))
    features = ("a", "b", "c")
    components, _ = v.pca_fit(p, features)
    scores = v.pca_project(p, features, components[:2])
    span = scores.agg(*[f(c).alias(f"{label}_{c}") for c in ("pc1", "pc2") for f, label in ((F.min, "lo"), (F.max, "hi"))])
    place = lambda c: F.round(100 * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 0.1), 1)
    return scores.crossJoin(F.broadcast(span)).select("ord", place("pc1").alias("x"), place("pc2").alias("y"))


def kmeans_fit(spark, d):
    rows = v.kmeans(ligands(spark, d), DIMS)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in DIMS])


def embedding_points(spark, d):
    rows = ligands(spark, d)
    components, _ = v.pca_fit(rows, DIMS)
    return v.kmeans(v.pca_project(rows, DIMS, components), DIMS).select("ord", "cls", "cluster", F.round("pc1", 6).alias("x"), F.round("pc2", 6).alias("y"))


def cluster_lookup(spark, d):
    """The members of the cluster (here: class) of each seed."""
    rows = ligands(spark, d)
    return _seeds(rows).select(F.col("ord").alias("seed"), "cls").join(rows.select("cls", F.col("name").alias("member")), "cls")


def method_info(spark, d):
    rows = ligands(spark, d)
    components, shares = v.pca_fit(rows, DIMS)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("cls").alias("classes")).select("*", F.lit(len(components)).alias("components"), F.lit(float(round(shares.sum(), 4))).alias("share"), F.lit(len(DIMS)).alias("features"))


_L = with_views("ligands")
_R = f"{_L}, r as (select " + ", ".join(f"min({c}) as lo_{c}, case when max({c}) = min({c}) then min({c}) + 1 else max({c}) end as hi_{c}" for c in DIMS) + " from ligands)"
_SCALED = f"{_R}, x as (select ord, name, cls, " + ", ".join(f"({c} - lo_{c}) / (hi_{c} - lo_{c}) as {c}" for c in DIMS) + " from ligands, r)"
_M = f"{_L}, m as (select " + ", ".join(f"avg({c}) as mean_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as std_{c}" for c in DIMS) + " from ligands)"
_Z = f"{_M}, z as (select ord, cls, " + ", ".join(f"({c} - mean_{c}) / std_{c} as {c}" for c in DIMS) + " from ligands, m)"
_DIST = "sqrt(" + " + ".join(f"pow(a.{c} - s.{c}, 2)" for c in DIMS) + ")"


def _knn(where: str, k: int, seeds: str = "x") -> str:
    return f"n as (select s.ord as seed, a.ord as id, a.cls, {_DIST} as distance, row_number() over (partition by s.ord order by {_DIST}, a.ord) as rank from {seeds} s, x a where {where})"


_SEED = "s.ord % 50 = 0 and a.ord <> s.ord"
QUERIES = {
    "agg_minmax_ranges": (agg_minmax_ranges, f"{_R} select * from r"),
    "agg_moments": (agg_moments, f"{_M} select " + ", ".join(f"round(mean_{c}, 9) as mean_{c}, round(std_{c}, 9) as std_{c}" for c in DIMS) + " from m"),
    "vec_standardize": (vec_standardize, f"{_Z} select ord, " + ", ".join(f"round({c}, 6) as {c}" for c in DIMS) + " from z"),
    "agg_covariance": (agg_covariance, f"{_Z} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_samp({a}, {b}), 6) as cov from z" for i, a in enumerate(DIMS) for b in DIMS[i:])),
    "sim_minmax_topk": (sim_minmax_topk, f"{_SCALED}, {_knn(_SEED, 5)} select seed, id, rank, round(greatest(0, 1 - distance / sqrt(8)), 3) as similarity from n where rank <= 5"),
    "sim_minmax_same_class": (sim_minmax_same_class, f"{_SCALED}, {_knn(_SEED + ' and a.cls = s.cls', 5)} select seed, id, rank from n where rank <= 5"),
    "knn_embedding": (
        knn_embedding,
        "with n as (select s.vec_id as seed, a.vec_id as id, row_number() over (partition by s.vec_id order by list_distance(a.embedding::double[], s.embedding::double[]), a.vec_id) as rank from embeddings s, embeddings a where s.vec_id % 50 = 0 and a.vec_id <> s.vec_id) select * from n where rank <= 5",
    ),
    "knn_by_features": (
        knn_by_features,
        f"{_SCALED}, f as (select cls as ord, " + ", ".join(f"round(avg({c}), 4) as {c}" for c in DIMS) + " from ligands where cls % 2 = 0 group by 1), y as (select ord, "
        + ", ".join(f"({c} - lo_{c}) / (hi_{c} - lo_{c}) as {c}" for c in DIMS) + f" from f, r), {_knn('true', 5, 'y')} select seed::bigint as seed, id, rank from n where rank <= 5",
    ),
    "cosine_std": (
        cosine_std,
        f"{_Z} select s.ord as seed, a.ord as id, round((" + " + ".join(f"a.{c} * s.{c}" for c in DIMS) + ") / (coalesce(nullif(sqrt(" + " + ".join(f"a.{c} * a.{c}" for c in DIMS) + "), 0), 1) * coalesce(nullif(sqrt("
        + " + ".join(f"s.{c} * s.{c}" for c in DIMS) + "), 0), 1)), 6) as cosine from z s, z a where s.ord % 50 = 0 and a.ord <> s.ord",
    ),
    "recommend": (recommend, f"{_SCALED}, {_knn(_SEED, 30)}, p as (select seed, id, row_number() over (partition by seed order by rank) as place from n where rank <= 30 and cls < 3) select * from p where place <= 10"),
    "pca_2d_closed": (
        pca_2d_closed,
        f"""{_L}, m as (select var_pop(d1) as vx, var_pop(d2) as vy, covar_pop(d1, d2) as c from ligands),
        e as (select *, (vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + c * c) as l1, (vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + c * c) as l2 from m),
        a as (select *, l1 - vy as x, c as y from e)
        select round(l1, 6) as l1, round(l2, 6) as l2, round(x / sqrt(x * x + y * y), 6) as ax, round(y / sqrt(x * x + y * y), 6) as ay, round(100 * l1 / (l1 + l2), 1) as share1, round(100 * l2 / (l1 + l2), 1) as share2 from a""",
    ),
    "pca_fit": (pca_fit, None),
    "pca_project": (pca_project, None),
    "pca_loadings": (pca_loadings, None),
    "pca_3feature_map": (pca_3feature_map, None),
    "kmeans_fit": (kmeans_fit, None),
    "embedding_points": (embedding_points, None),
    "cluster_lookup": (cluster_lookup, f"{_L} select s.ord as seed, cls, a.name as member from ligands s join ligands a using (cls) where s.ord % 50 = 0"),
    "method_info": (method_info, None),
}
