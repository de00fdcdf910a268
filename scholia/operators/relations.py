"""Lookups, enrichment joins, set operations and ordered first-wins choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: str, order: Sequence[str], *, drop_null: bool = True) -> DataFrame:
    """The first row of each key. Unlike dropDuplicates it says which. Null keys go, or are each kept."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return kept if drop_null else kept.unionByName(rows.where(F.col(key).isNull()))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that was loaded last: one grouped maximum, no sort."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def prioritised(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all sources, and of each key only those of the first source that has it."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for s in tagged[1:]:
        rows = rows.unionByName(s)
    least = rows.groupBy(key).agg(F.min("_source").alias("_least"))
    return rows.join(least, key).where("_source = _least").drop("_source", "_least")


def fill_empty(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """left with each field that is null or blank taken from right: the earliest row of the key that has it."""
    own = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    best = right.groupBy(key).agg(*[F.min_by(own(c), F.when(own(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fields])
    rows = left.join(best, key, "left")
    return rows.select(*[F.coalesce(own(c), F.col(f"_{c}"), F.lit("")).alias(c) if c in fields else F.col(c) for c in left.columns])


def upsert(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full join on key: blank fields of left are filled, keys that only right has are added."""
    own = lambda d, c: F.nullif(F.trim(d[c]), F.lit(""))
    joined = left.join(right, left[key] == right[key], "full_outer")
    origin = F.when(left[key].isNull(), "added").when(right[key].isNull(), "kept").otherwise("merged")
    return joined.select(F.coalesce(left[key], right[key]).alias(key), *[F.coalesce(own(left, c), own(right, c), F.lit("")).alias(c) for c in fields], origin.alias("origin"))


def limited_then_filtered(rows: DataFrame, order: Sequence[str], n: int, condition: str, most: int = 50) -> DataFrame:
    """The filter looks only at the first n rows (at most `most`), so fewer can come out."""
    return rows.orderBy(*order).limit(min(n, most)).where(condition)


def without(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key), key, "left_anti")


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, n)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.union(one)
    return out
