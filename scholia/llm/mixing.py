"""Mixing sources to target weights: hash-threshold histograms, no sorting.

A document's size is its number of words (runs of anything but space, tab, line feed, vertical tab, form feed, carriage
return). Sources stand in code-point order, null last, and weigh 5, 2, 1, repeating. All sizes together are shared by
weight; a source whose share is above `most` times its size stops there, and the excess is shared anew among the others,
until none is above. A target is taken as whole copies of its source and a rest, and the rest by a threshold over the
documents' hashes: words are summed by source and hash bucket, the bucket in which the sum passes the rest is cut into
finer buckets from its own rows alone, and so on until that bucket holds one hash. A document is taken if at least half
of it lies below the rest. So a larger rest takes all that a smaller one takes, and a source's words differ from its
target by at most half of one document's.

Hashes are of doc_id and size. Rows that are alike in both (repeated rows) are told apart by a number they get when the
sizes are written; which of them are taken doesn't show in the result, so reruns give the same rows.

Defined cases: a null text has size 0; documents of size 0 are taken with 0 words; a source of size 0 has target 0; null
doc_id stays null; a null source is a source; an empty table gives no rows. Only doc_id, text and source are read, so
other columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]++"
#: Bits of a hash, and how many of them a level looks at.
HASH_BITS, LEVEL_BITS = 60, 12


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with `number`, its rows' places in the order from 0. Each range is numbered by its own task; over all there is
    only a sum by range."""
    rows = common.materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    base = common.materialise(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), f"{name}-bases")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(F.broadcast(base), "part").withColumn("number", F.col("base") + F.col("own")).drop("part", "own", "base")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with target. Each round shares what the stopped sources leave; a round stops at least
    one more, and only sums come to the driver."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    rows = common.materialise(numbered(sizes, [F.col("source").asc_nulls_last()], "sources").withColumn("weight", weight), "weighed")
    share, before = 0.0, None
    while True:
        above = F.col("source_size") * most < F.col("weight") * F.lit(share)
        n, left, weighing = rows.agg(F.count_if(above), F.sum("source_size") - F.sum(F.when(above, F.col("source_size") * most).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == before or not weighing:
            break
        share, before = left / weighing, n
    return rows.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(share)))


def thresholds(rows: DataFrame, rests: DataFrame, by: str) -> DataFrame:
    """For rests (key, rest, before, n) and rows (key, size, by): (key, at, words, n, before), where rows with by below
    `at` are taken whole; those with by equal to `at` are n rows of `words` words together, at which the sum passes the
    rest after `before` words. n is 0 if the rest ends between two hashes. n of rests: how many rows have the key."""
    states = rests.select("key", "rest", "before", "n", F.lit(0).cast("long").alias("low"))
    active, shift, done = rows, HASH_BITS, []
    while True:
        shift -= LEVEL_BITS
        bucket = F.shiftright(by, shift)
        histogram = active.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min(by).alias("least"), F.max(by).alias("greatest"))
        sums = histogram.join(common.small_or_shuffled(states.select("key", "rest", F.col("before").alias("start"))), "key")
        sums = sums.withColumn("end", F.col("start") + F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))).withColumn("before", F.col("end") - F.col("words"))
        passed = F.struct("bucket", "least", "greatest", "words", "n", "before")
        found = sums.where("end > rest").groupBy("key").agg(F.first("rest").alias("rest"), F.min(passed).alias("b"))
        found = common.materialise(found.select("key", "rest", "b.*"), "boundaries")
        between = F.col("before") >= F.col("rest")
        settled = between | (F.col("least") == F.col("greatest")) | F.lit(shift <= 0)
        done.append(found.where(settled).select("key", F.col("least").alias("at"), "words", F.when(between, 0).otherwise(F.col("n")).alias("n"), "before"))
        states = found.where(~settled).select("key", "rest", "before", "n", F.col("bucket").alias("low"))
        if states.isEmpty():
            break
        # only the boundary buckets' rows go on
        joined = common.join_hot(active.select("key", "size", by), common.materialise(states.select("key", "low", "n"), "refined"), "key", "low", "n")
        active = common.materialise(joined.where(F.col("low") == bucket).drop("low"), "boundary-rows")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return common.materialise(out, "thresholds")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of docs (doc_id, text, source)."""
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights must be positive, and a source must be allowed whole")
    source = F.col("source").cast("string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", source.alias("source"), size.alias("size"))
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = rows.select("doc_id", "source", "size", key.alias("key"), F.conv(F.substr(name, F.lit(1), F.lit(15)), 16, 10).cast("long").alias("h"), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS).alias("row"))
    rows = common.materialise(rows, "sizes")
    totals = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(totals, weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = common.materialise(plan, "targets")
    first = thresholds(rows.select("key", "size", "h"), plan.select("key", "rest", F.lit(0).cast("long").alias("before"), "n"), "h")
    plan = plan.join(common.small_or_shuffled(first.select("key", F.col("at").alias("t"), F.col("n").alias("same"), "words", "before")), "key", "left")
    half = F.col("before") + F.col("words") / 2 <= F.col("rest")
    plan = common.materialise(plan.withColumn("t", F.col("t") + F.when((F.col("same") == 1) & half, 1).otherwise(0)), "first-thresholds")
    ties = plan.where("same > 1")
    if not ties.isEmpty():  # repeated rows across a rest: some of them are taken
        held = common.materialise(ties.select("key", "t", F.col("n")), "ties")
        alike = common.join_hot(rows.select("key", "size", "h", "row"), held, "key", "t", "n").where("t = h")
        alike = common.materialise(alike.select("key", "size", "row"), "tied-rows")
        second = thresholds(alike, ties.select("key", "rest", "before", F.col("same").alias("n")), "row")
        second = second.select("key", F.col("at").alias("t2"), F.col("n").alias("same2"), F.col("words").alias("words2"), F.col("before").alias("before2"))
        plan = plan.join(common.small_or_shuffled(second), "key", "left")
        half = F.col("before2") + F.col("words2") / 2 <= F.col("rest")
        plan = plan.withColumn("t2", F.col("t2") + F.when((F.col("same2") > 0) & half, 1).otherwise(0))
    else:
        plan = plan.withColumn("t2", F.lit(None).cast("long"))
    part = F.struct("source_size", "target", "copies", "t", "t2")
    plan = common.materialise(plan.select("key", part.alias("part"), "n"), "plan")
    out = common.join_hot(rows, plan, "key", "part", "n").select("doc_id", "source", "size", "h", "row", "part.*")
    # no threshold: the rest isn't passed, so all is taken
    below = F.col("t").isNull() | (F.col("h") < F.col("t")) | (F.col("h") == F.col("t")) & F.coalesce(F.col("row") < F.col("t2"), F.lit(False))
    taken = F.col("size") * (F.col("copies") + F.when((F.col("copies") < most) & below, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sorts where the operator sums by hash bucket.
OP13_SQL = """
    with recursive d as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size from documents
    ),
    h as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || size), 1, 15))::bigint h from d),
    s as (
      select source, sum(size)::bigint source_size,
        [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] weight
      from d group by source
    ),
    r as (
      select 0 step, 0::double share
      union all
      select step + 1, (
        select (sum(source_size) - coalesce(sum(3 * source_size) filter (3 * source_size < weight * share), 0))::double
          / (sum(weight) filter (not 3 * source_size < weight * share))::double from s)
      from r where step < 25
    ),
    t as (
      select source, source_size, least(3.0::double * source_size, weight * (select share from r where step = 25)) target,
      from s
    ),
    c as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end copies from t),
    m as (
      select h.doc_id, h.size, h.source, c.source_size, c.target, c.copies,
        sum(h.size) over (partition by h.source order by h.h, h.size rows unbounded preceding) - h.size / 2 middle
      from h join c on h.source is not distinct from c.source
    )
    select doc_id, size, source_size, target, source,
      (size * (copies + case when copies < 3 and middle <= target - copies * source_size then 1 else 0 end))::bigint taken
    from m"""
