"""Helpers the training-data operators share: scratch tables, components, vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be long, so a batch stays far below Spark's default of 10,000 rows.
ARROW_ROWS = 256
#: A side of at most so many rows of a few dozen bytes may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: The same for rows of any width, whose bytes are added up.
BROADCAST_BYTES = 1 << 25


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches (in the session: a query is executed after it was returned) and see to a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    scratch_root(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a folder of
    its own, a cluster an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/scholia/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and later joins see true sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it while columns have it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows (counted, not estimated), else with a merge hint. Its rows are a few
    numbers wide: texts and lists are never joined by this."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in an edge; component is the smallest node of its group.

    Alternating large-star and small-star steps over a shrinking edge table; each step is a grouped minimum and a
    join, so no group is ever gathered. The minima of few nodes are broadcast; of many, those of nodes with many edges
    are, and only the rest is shuffled. Ends when a round changes nothing. Self-loops and null ends are ignored.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e = e.checkpoint()
    before, n = None, e.count()

    def with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
        if 2 * n <= BROADCAST_ROWS:
            return rows.join(F.broadcast(low.drop("n")), "u")
        return join_hot(rows, materialise(low, "lowest"), "u", "m", "n").where("m is not null")

    while True:
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v is a neighbour of u
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_low(both.where("v > u"), low).select(F.col("m").alias("v"), F.col("v").alias("u"))
        large = large.where("u <> v").distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_low(large, low).select(F.col("m").alias("m"), F.explode(F.array("u", "v")).alias("u"))
        e = small.where("u <> m").select(F.col("m").alias("v"), "u").distinct().checkpoint()
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before, n = state, state[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


#: Hubs that the nodes of a large bucket are held against before all is compared.
HUBS = 4
#: Buckets of up to so many nodes are compared whole, in chunks of CHUNK nodes; larger ones are split.
DENSE, CHUNK = 4096, 256
#: From (s, key, state): the buckets (array of (key, state)) that a row of a bucket is dealt to.
Split = Callable[[], Column]


def bucket_links(nodes: DataFrame, splits: Sequence[Split], close: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], bucket: int, *, rare: bool = False, sign: Callable[[DataFrame], DataFrame] | None = None, sure: Callable[[DataFrame], DataFrame] | None = None, first: Callable[[Column, Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links among nodes (node, s) and their groups: ((a, b, ...) that verify found, (node, component)).

    Two nodes are candidates if close(s of one, s of the other), a Column. splits[0] must put any two candidates into a
    common bucket, and each further split any two of a bucket into a common smaller one. verify((a, b)) gives those
    candidates that are links. The groups are exact: the same as if every candidate had been verified.

    In a bucket of at most `bucket` nodes all candidates are verified. In a larger one each node is first held against
    `HUBS` hubs: the nodes of greatest hashes, so that buckets with many nodes in common have the same hubs. That joins
    most of a family of copies. Two nodes that are in one group by now need no look at each other, so only buckets
    with nodes of several groups go on, and only pairs of different groups become candidates there. Those of at most
    `DENSE` nodes, and all after the last split, are compared in chunks of `CHUNK` nodes, each with each; larger ones are
    split. So no group is gathered, and a family's pairs are not all made.
    first(s, t, state): how many buckets before this one (in the order of state) the two share; a candidate is given in
    its first bucket alone (of its depth: after as many as there were splits), not in all of them.
    rare: most buckets of splits[0] have one node, so s is joined to the rest after these are dropped; sign: from the
    (node) of these, (node, s) with the s that is used from there on.
    sure((a, b)): some of the links, found with little work. verify then gets those pairs alone that they leave in
    different groups, so with it not all links are given, but the groups are the same.
    """
    level = nodes.select("node", "s", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("state"))
    own, found, groups = ["node", "s"], None, None

    def look_at(pairs: DataFrame, name: str) -> None:
        pairs = materialise(pairs.distinct(), f"candidates-{name}")
        if found is not None and pairs.isEmpty():
            return
        if sure:
            join(sure(pairs), f"{name}-sure")
            for end in ("a", "b"):
                own = groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
                pairs = pairs.join(small_or_shuffled(own), end, "left")
            pairs = materialise(pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), f"open-{name}")
            if pairs.isEmpty():
                return
        join(verify(pairs), name)

    def join(links: DataFrame, name: str) -> None:
        nonlocal found, groups
        ends = links.select("a", "b")
        # a group stands for the links that made it
        known = ends if groups is None else ends.union(groups.select("component", "node"))
        found = links if found is None else found.union(links)
        groups = materialise(connected_components(known), f"groups-{name}")

    def unsettled(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.drop("label").join(small_or_shuffled(groups), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        alive = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return materialise(rows.join(small_or_shuffled(materialise(alive, f"unsettled-{name}")), "key", "left_semi"), f"large-{name}")

    for depth, split in enumerate(splits):
        level = level.select(*own, F.inline(split()))
        if rare and not depth:
            shared = level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
            level = materialise(level.select("key", "node", "state").join(small_or_shuffled(materialise(shared, "shared-keys")), "key", "left_semi"), "shared-buckets")
            level = level.hint("merge").join(sign(level.select("node").distinct()) if sign else nodes, "node").select(*own, "key", "state")
            level = materialise(level, "signed-buckets") if sign else level
        counts = [F.count("*").alias("n"), *([F.min("label").alias("lo"), F.max("label").alias("hi")] if depth else [])]
        sizes = level.groupBy("key").agg(*counts)
        many = materialise(sizes.where("lo <> hi" if depth else "true").where(F.col("n") > bucket).select("key", "n"), f"large-buckets-{depth}")
        n_many = many.count()
        few = level.join(small_or_shuffled(many.select("key"), n_many), "key", "left_anti")
        apart = (lambda x, y: F.col(f"{x}.label") != F.col(f"{y}.label")) if depth else (lambda x, y: F.lit(True))
        both = few.alias("x").hint("merge").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & apart("x", "y") & close(F.col("x.s"), F.col("y.s")))
        pairs = both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        if not n_many:
            look_at(pairs, f"{depth}")
            break
        large = materialise(level.join(small_or_shuffled(many, n_many), "key"), f"large-{depth}")
        look_at(pairs.union(_hub_pairs(large, close)), f"{depth}-hubs")
        large = unsettled(large, f"{depth}-rest")
        last = depth == len(splits) - 1
        in_first = first(F.col("x.s"), F.col("y.s"), F.col("x.state")) == depth if first else F.lit(True)
        once = lambda s, t, in_first=in_first: close(s, t) & in_first
        look_at(_chunk_pairs(large if last else large.where(F.col("n") <= DENSE), once), f"{depth}-chunks")
        level = large.where(F.col("n") > DENSE)
        if last or level.isEmpty():
            break
        own = ["node", "s", "label"]
        level = unsettled(level, f"{depth}-split").select(*own, "key", "state")
    return found, groups


def _hub_pairs(large: DataFrame, close) -> DataFrame:
    """Candidates of a node and a hub of its bucket. Buckets of over a thousandth of the rows are fewer than a thousand:
    their hubs are broadcast. Those of the rest are joined by shuffle (or broadcast, if few), where no bucket is large."""
    hub = F.struct("node", "s", *(["label"] if "label" in large.columns else []))
    chosen = F.array_distinct(F.array(*[F.max_by(hub, F.xxhash64("node", F.lit(i))) for i in range(HUBS)]))
    hubs = materialise(large.groupBy("key").agg(chosen.alias("hubs"), F.count("*").alias("n")), "hubs")
    bound = (hubs.agg(F.sum("n")).first()[0] or 0) / 1000
    hubs = hubs.select("key", "n", F.explode("hubs").alias("y")).select(F.col("key").alias("hub_key"), "n", "y.*")
    apart = F.col("x.label") != F.col("y.label") if "label" in large.columns else F.lit(True)
    match = (F.col("x.key") == F.col("y.hub_key")) & (F.col("x.node") != F.col("y.node")) & apart & close(F.col("x.s"), F.col("y.s"))

    def star(y: DataFrame) -> DataFrame:
        return large.alias("x").join(y.alias("y"), match).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    hot, rest = hubs.where(F.col("n") > bound), hubs.where(F.col("n") <= bound)
    return star(F.broadcast(hot)).union(star(small_or_shuffled(rest)))


def _chunk_pairs(large: DataFrame, close) -> DataFrame:
    """Candidates of different groups: the nodes of a bucket in chunks, each chunk held against itself and those before."""
    rows = large.withColumn("own", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)))
    left = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "own"))).alias("x")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.chunk") == F.col("y.own"))
    once = (F.col("x.own") > F.col("y.own")) | (F.col("x.node") < F.col("y.node"))
    both = left.hint("merge").join(rows.alias("y"), same & once & (F.col("x.label") != F.col("y.label")) & close(F.col("x.s"), F.col("y.s")))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def join_ends(pairs: DataFrame, right: DataFrame, end: str, other: str, value: str, into: str, most: int = 64) -> DataFrame:
    """pairs with right's value (node, value) of the node in the column end. A node in over `most` pairs is dealt out:
    its value is copied once for every `most` pairs, so that no task gets all pairs of a node."""
    counted = pairs.groupBy(end).agg(F.ceil(F.count("*") / most).alias("copies")).where("copies > 1")
    hot = small_or_shuffled(materialise(counted, "hot-ends"))
    chunk = F.when(F.col("copies").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(other), F.col("copies")))
    rows = pairs.join(hot, end, "left").withColumn("chunk", chunk).drop("copies")
    last = F.coalesce(F.col("copies"), F.lit(1).cast("long")) - 1
    values = right.select(F.col("node").alias(end), F.col(value).alias(into)).join(hot, end, "left")
    values = values.select(end, into, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return rows.hint("merge").join(values, [end, "chunk"]).drop("chunk")


def join_hot(rows: DataFrame, right: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """rows with value from right (key, value, n), null where the key isn't there. n: how many rows have the key.

    Keys that hold over a thousandth of those rows are fewer than a thousand: they are broadcast. The rest are joined by
    shuffle (or broadcast, if few), where no key is large. right must be materialised.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.where(F.col(n) > total / 1000).select(key, F.col(value).alias("hot_value"))
    rest = right.where(F.col(n) <= total / 1000).select(key, F.col(value).alias("rest_value"))
    rows = rows.join(F.broadcast(hot), key, "left").join(small_or_shuffled(rest), key, "left")
    return rows.withColumn(value, F.coalesce("hot_value", "rest_value")).drop("hot_value", "rest_value")


# ---------------------------------------------------------------- hashing of whole batches with numpy

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}
_WORD_CHAR: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", int(_MULT)), ("q", pow(int(_MULT), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_chars() -> np.ndarray:
    """For each code point: whether it is a letter or digit."""
    if not _WORD_CHAR:
        _WORD_CHAR.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _WORD_CHAR[0]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the number of words of each text.

    A word is a run of letters and digits. One polynomial prefix sum over the joined texts gives every word's hash
    without a Python step per word.
    """
    c = codes("\n".join(t.lower() for t in texts) + "\n")
    breaks = np.cumsum([len(t.lower()) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    inside = np.concatenate(([False], word_chars()[c], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    p, q = powers(len(c) + 1)
    h = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[: len(c)], dtype=np.uint64)))
    words = mix((h[end] - h[start]) * q[start])
    return words, np.diff(np.concatenate(([0], np.searchsorted(start, breaks)))).astype(np.int64)


def shingles(words: np.ndarray, n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text (all its words, if it has fewer), and their number by text."""
    ends = np.cumsum(n_words)
    first = ends - n_words
    n = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    total = int(n.sum())
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    stop = np.repeat(ends, n)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    for j in range(k):
        out = out * _MULT + np.where(at + j < stop, padded[at + j], np.uint64(0)) + np.uint64(j)
    return mix(out), n
