"""Which texts contain which needles, by an index of character runs: no needle is held against every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.plans.lineage import cut

from .retrieval import sized, small

#: Characters of an index entry. Shorter needles are looked up by entries of their own length.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The runs of n characters of text, one from every place: a look ahead keeps this linear in the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def contained(needles: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(n, t): each needle (n, needle) and each text (t, text) that contains it. Empty needles are in none.

    A text that contains a needle has all the needle's entries, so a needle is looked up by the one that fewest texts
    have, and compared with those texts alone. Only entries that some needle has are counted, and only those that needles
    are looked up by are joined, by shuffle beyond the bound of `sized`. The index of a text is made twice and never written. Needles longer than the longest text are in none.
    """
    longest = texts.agg(F.max(F.length("text"))).first()[0] or 0
    needles = needles.where(F.length("needle") <= longest)
    asked = cut(needles.where("needle <> ''").select("n", "needle", F.least(F.length("needle"), F.lit(gram)).alias("size")))
    sizes = [r[0] for r in asked.select("size").distinct().collect()]  # at most `gram` numbers
    if not sizes:
        return asked.join(texts.limit(0).select("t"), F.lit(False)).select("n", "t")
    own = F.when(F.col("size") < gram, F.array("needle")).otherwise(grams(F.col("needle"), gram))
    parts = asked.select("n", F.explode(F.array_distinct(own)).alias("gram"))
    wanted = cut(parts.select("gram").distinct())
    entries = F.array_distinct(F.concat(*[grams(F.col("text"), k) for k in sizes]))
    entries = F.explode(entries).alias("gram")
    often = cut(texts.select(entries).join(sized(wanted), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts")))
    if small(often):  # a needle whose first or last entry is in no text is in none: most are left out before any shuffle
        ends = [F.substring("needle", 1, gram), F.when(F.length("needle") < gram, F.col("needle")).otherwise(F.expr(f"right(needle, {gram})"))]
        for end in ends:
            asked = asked.withColumn("end", end).join(F.broadcast(often.select(F.col("gram").alias("end"))), "end", "left_semi").drop("end")
        parts = asked.select("n", F.explode(F.array_distinct(own)).alias("gram"))
    rarest = parts.join(sized(often), "gram", "left").groupBy("n").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("r"))
    rarest = cut(rarest.where("r.texts > 0").select("n", F.col("r.gram").alias("gram")).join(asked.select("n", "needle").hint("merge"), "n"))
    if small(rarest):  # a text goes along to its entries: nothing is written or shuffled
        pairs = texts.select("t", "text", entries).join(F.broadcast(rarest), "gram")
    else:
        looked = sized(rarest.select("gram").distinct())
        pairs = texts.select("t", entries).join(looked, "gram", "left_semi").hint("merge").join(rarest, "gram").select("n", "t", "needle")
        pairs = pairs.join(texts.select("t", "text").hint("merge"), "t")
    return pairs.where(F.contains("text", "needle")).select("n", "t")
