"""Grouped statistics, ordered merges and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_summary(rows: DataFrame, cls: str, name: str, order: str, features: Sequence[str]) -> DataFrame:
    """Per class: how many, the names in load order, least and greatest of each feature."""
    return rows.groupBy(cls).agg(
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias("names"),
        *[f(c).alias(f"{label}_{c}") for c in features for f, label in ((F.min, "min"), (F.max, "max"))],
    )


def class_compare(rows: DataFrame, cls: str, features: Sequence[str], digits: int = 3) -> DataFrame:
    """For each two classes, rounded means, the difference of the rounded means, and counts; one grouped pass."""
    means = rows.groupBy(cls).agg(F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in features])
    a = means.select(F.col(cls).alias("class_a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in features])
    b = means.select(F.col(cls).alias("class_b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in features])
    both = a.join(b, F.col("class_a") < F.col("class_b"))
    return both.select("*", *[F.round(F.col(f"{c}_a") - F.col(f"{c}_b"), digits).alias(f"{c}_diff") for c in features])


def cluster_summary(rows: DataFrame, cluster: str, cls: str, features: Sequence[str]) -> DataFrame:
    """Per cluster: size, class histogram as a map, centroid."""
    histogram = rows.groupBy(cluster, cls).agg(F.count("*").alias("k"))
    histogram = histogram.groupBy(cluster).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(cls).cast("string"), "k")))).alias("classes"))
    centre = rows.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in features])
    return centre.join(histogram, cluster)


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, with their place from the end."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def shares(rows: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """Each value's share of the total and the running share, greatest first. rows: one a component, so they are few."""
    w = Window.orderBy(F.desc(value), name)
    total = Window.partitionBy()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    share = 100 * F.col(value) / F.sum(value).over(total)
    return rows.select(name, F.round(share, digits).alias("share"), F.round(100 * F.sum(value).over(running) / F.sum(value).over(total), digits).alias("cumulative"))


def distinct_in_order(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, values): each value once, by its first occurrence."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def first_non_empty(rows: DataFrame, key: str, name: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, conditions): for each name the earliest value that isn't blank, as a map in order of names."""
    filled = rows.where(F.trim(F.col(value)) != "")
    best = filled.groupBy(key, name).agg(F.min_by(value, F.struct(*order)).alias("v"))
    return best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "v")))).alias("conditions"))


def sessions(rows: DataFrame, key: str, ts: str, gap: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of rows no more than the gap apart."""
    s = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return s.select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")
