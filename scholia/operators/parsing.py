"""Parsing of free-text ligand references into name, abbreviation and explanation; class detection in queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import text as tx

from scholia.plans.lineage import cut

from .retrieval import sized
from .rules import Rule, resolve_names

# fixed values: symbols of metals and halogens that mark a formula, words that end a name, phrases for no ligand
METALS = r"(?:Ni|Pd|Cu|Fe|Co|Rh|Ir|Ru|Pt|Au|Ag|Zn|Mn|Cl|Br)"
USAGE = r"\s+(?:for|used as|alongside|as |with |complex|preformed|pre-formed)\b"
NO_LIGAND = r"no exogenous ligand|ligand-free|no ligand|no external ligand"
POSITION = r"^[\d,\-\s]+[a-z]?$"
SCAFFOLD = r"(?i)oxazol|imidazol|phenanthrol|bipyridin|pyridin|pyridyl|picolin|pyrazol|carboxamidin|amidin|amidoxim|terpyridin|bis\(oxa|bis\(imi"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _triple(name: Column, abbreviation: Column, explanation: Column) -> Column:
    name = _strip(F.regexp_replace(_strip(name), r"[,;:]+$", ""))
    explanation = _strip(F.regexp_replace(_strip(explanation), r"^[,;:]+", ""))
    return F.struct(name.alias("full_name"), _strip(abbreviation).alias("abbreviation"), explanation.alias("explanation"))


def reference(segment: Column) -> Column:
    """(full_name, abbreviation, explanation) of one segment, or null.

    The abbreviation is in the first bracket behind a space or mark and without a metal symbol, else in the first bracket;
    without brackets, `L1 (hint)` gives the hint as explanation; else it is in the last short parenthesis before words of
    use that isn't a position and isn't glued to a word. Otherwise the name ends at the first outer comma behind the
    sixth character.
    """
    s = _strip(segment)
    spaced = rf"(?:^|(?<=[ ,;:\t]))\[(?![^\]]*{METALS})([^\]]+)\]"
    before = lambda p: F.regexp_extract(s, rf"(?s)^(.*?){p}", 1)
    after = lambda p: F.regexp_extract(s, rf"(?s)^.*?{p}(.*)$", 2)
    bracket = lambda p: _triple(before(p), F.regexp_extract(s, p, 1), after(p))
    code = r"^([A-Za-z]\d\w*)\s*\(([^)]+)\)"
    rest = _strip(F.regexp_replace(_strip(F.regexp_replace(s, code, "")), r"^[,;:]+", ""))
    hint = _strip(F.regexp_extract(s, code, 2))
    coded = F.struct(F.regexp_extract(s, code, 1).alias("full_name"), F.lit("").alias("abbreviation"), F.concat(hint, F.when(rest != "", F.concat(F.lit("; "), rest)).otherwise("")).alias("explanation"))
    named = _strip(F.get(F.split(s, "(?i)" + USAGE, 2), F.lit(0)))
    paren = r"(?<![\p{L}\p{N}])\((?!\s*[\d,\-\s]+[a-z]?\s*\))(?=[^)]*[a-zA-Z])\s*([^)\s](?:[^)]{0,29}))\s*\)"
    last = F.regexp_extract(named, rf"(?s)^(.*){paren}", 1)
    short = F.regexp_extract(named, rf"(?s)^.*{paren}", 1)
    tail = F.substring(s, F.length(F.regexp_extract(named, rf"(?s)^.*{paren}", 0)) + 1, 1 << 30)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("(", "["), acc["depth"] + 1).when(ch.isin(")", "]"), acc["depth"] - 1).otherwise(acc["depth"])
        hit = (ch == ",") & (acc["depth"] == 0) & (acc["i"] > 5) & (acc["at"] < 0)
        return F.struct(depth.alias("depth"), (acc["i"] + 1).alias("i"), F.when(hit, acc["i"]).otherwise(acc["at"]).alias("at"))

    comma = F.aggregate(F.split(s, ""), state, step, lambda acc: acc["at"])
    plain = F.when(comma >= 0, F.struct(_strip(F.substring(s, F.lit(1), comma)).alias("full_name"), F.lit("").alias("abbreviation"), _strip(F.substring(s, comma + 2, F.length(s))).alias("explanation"))).otherwise(
        F.struct(s.alias("full_name"), F.lit("").alias("abbreviation"), F.lit("").alias("explanation"))
    )
    none = F.lower(s).rlike(NO_LIGAND) | (s == "")
    return (
        F.when(none, F.lit(None))
        .when(s.rlike(spaced), bracket(spaced))
        .when(s.rlike(r"\[[^\]]+\]"), bracket(r"\[([^\]]+)\]"))
        .when(s.rlike(code), coded)
        .when(short != "", _triple(last, short, tail))
        .otherwise(plain)
    )


def references(text: Column) -> Column:
    """The references of all segments, in order."""
    return F.array_compact(F.transform(tx.split_outside(tx.normalize(text)), reference))


def references_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, segment, full_name, abbreviation, explanation) of the references of rows (key, text), in order."""
    seg = rows.select(key, F.posexplode(tx.split_outside(F.coalesce("text", F.lit("")))).alias("pos", "segment"))
    seg = seg.select(key, "pos", _strip(F.col("segment")).alias("segment")).withColumn("r", reference(F.col("segment")))
    return seg.where("r is not null").select(key, "pos", "segment", "r.full_name", "r.abbreviation", "r.explanation")


def clean_segments(text: Column) -> Column:
    """(name, bracket, hint) of each `;` part: its last bracket label, an `L1 (hint)`'s hint, and the name without labels,
    without parentheses that hold no scaffold word or chemical name, cut at words of use and at complex or precatalyst."""

    def one(part: Column) -> Column:
        part = _strip(part)
        labels = F.filter(F.transform(F.regexp_extract_all(part, F.lit(r"\[([^\]]+)\]"), F.lit(1)), _strip), lambda x: ~x.rlike(POSITION))
        bracket = F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))
        hint = _strip(F.regexp_extract(part, r"^([A-Za-z]\d\w*)\s*\(([^)]+)\)", 2))
        name = F.regexp_replace(part, r"\[(?![\d,\-\s]+[a-z]?\])[^\]]+\]", "")
        keep = lambda p: _inner(p).rlike(SCAFFOLD) | ((F.length(_inner(p)) > 5) & _inner(p).rlike(r"[a-z].*\d|\d.*[a-z]"))
        out = F.filter(F.regexp_extract_all(name, F.lit(r"\s*\([^)]+\)"), F.lit(0)), lambda p: ~keep(p))
        name = F.aggregate(out, name, lambda acc, p: F.replace(acc, p, F.lit("")))
        name = _strip(F.get(F.split(name, r"(?i)\s+(?:for|used as|alongside|as|with|optimal for|identified as)\b", 2), F.lit(0)))
        name = _strip(F.get(F.split(name, r"(?i)\s+(?:complex|precatalyst|pre-catalyst|preformed)\b", 2), F.lit(0)))
        return F.struct(name.alias("name"), bracket.alias("bracket"), hint.alias("hint"))

    return F.filter(F.transform(F.split(text, r"\s*;\s*"), one), lambda x: x["name"] != "")


def _inner(paren: Column) -> Column:
    return _strip(F.regexp_replace(paren, r"^\s*\(|\)$", ""))


def bracket_class(rows: DataFrame, key: str, bracket: str, dictionary: DataFrame, codes: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(key, cls, confidence) of a bracket text: in the dictionary 5, a class code inside it 4, a part of it in the
    dictionary 4, a rule on it 3."""
    from .rules import canonical, decompose, first_rule

    known = sized(dictionary.select(F.col("key").alias("_b"), F.col("cls").alias("exact")))
    out = rows.select(key, F.lower(F.trim(bracket)).alias("_b")).join(known, "_b", "left")
    parts = decompose(out.select(key, "_b"), key, "_b", dictionary, codes).select(key, F.col("cls").alias("part"))
    out = out.join(parts.hint("merge"), key, "left")
    hit = lambda c, n: F.when(c.isNotNull(), F.struct(c.alias("cls"), F.lit(n).alias("confidence")))
    found = F.coalesce(hit(F.col("exact"), 5), hit(canonical(F.col("_b"), codes), 4), hit(F.col("part"), 4), hit(first_rule(F.col("_b"), rules)["cls"], 3))
    return out.select(key, found.alias("m")).where("m is not null").select(key, "m.cls", "m.confidence")


def detect_classes(queries: DataFrame, dictionary: DataFrame, codes: Sequence[str], rules: Sequence[Rule], inline: Sequence[Rule]) -> DataFrame:
    """(qid, classes): classes named in each query, each once, in the order bracket references, class codes, rules, inline
    patterns, bracket texts of the dictionary."""
    q = queries.select("qid", tx.normalize(F.coalesce("text", F.lit(""))).alias("q"))
    refs = q.select("qid", F.posexplode(references(F.col("q"))).alias("pos", "r")).where("r.abbreviation <> ''")
    refs = refs.select(F.struct("qid", "pos").alias("at"), "r.abbreviation")
    first = bracket_class(refs, "at", "abbreviation", dictionary, codes, rules).select("at.qid", F.lit(1).alias("phase"), F.col("at.pos").alias("pos"), "cls")
    word = lambda code: F.col("q").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_]){code}(?![\p{{L}}\p{{N}}_])")
    listed = [F.when(word(c), F.struct(F.lit(2).alias("phase"), F.lit(i).alias("pos"), F.lit(c).alias("cls"))) for i, c in enumerate(codes)]
    listed += [F.when(F.col("q").rlike(p), F.struct(F.lit(phase).alias("phase"), F.lit(i).alias("pos"), F.lit(c).alias("cls"))) for phase, pack in ((3, rules), (4, inline)) for i, (p, c, _) in enumerate(pack)]
    middle = q.select("qid", F.inline(F.array_compact(F.array(*listed).cast("array<struct<phase: int, pos: int, cls: string>>"))))
    raw = q.select("qid", F.posexplode(F.regexp_extract_all("q", F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("pos", "b"))
    raw = raw.select("qid", "pos", F.lower(F.trim("b")).alias("b")).join(sized(dictionary.select(F.col("key").alias("b"), "cls")), "b")
    every = first.union(middle).union(raw.select("qid", F.lit(5), "pos", "cls"))
    once = every.groupBy("qid", "cls").agg(F.min(F.struct("phase", "pos")).alias("at"))
    lists = once.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cls"))), lambda x: x["cls"]).alias("classes"))
    return queries.select("qid").join(lists, "qid", "left").select("qid", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


def resolve_reference(queries: DataFrame, names: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, id, strategy): the first name that equals the query but for case, else resolve_names, else the name with the
    largest overlap where one contains the other as they stand (the shorter name, then the earlier one, on ties), else the
    first member of the query's class. names (ord, id, name, cls), classes (qid, cls). Equal texts are resolved once."""
    from .retrieval import best_overlap

    own = cut(queries.select("qid", F.col("text").alias("asked")))
    q = cut(own.select("asked").distinct().where("asked is not null").select(F.monotonically_increasing_id().alias("qid"), "asked", F.lower("asked").alias("text")))
    n = cut(names.groupBy(F.lower("name").alias("name")).agg(F.min("ord").alias("ord"), F.min_by("id", "ord").alias("id")))
    equal = n.join(sized(q), F.col("text") == F.col("name")).select("qid", "id", F.lit("exact").alias("strategy"), F.lit(1).alias("order"))
    named = resolve_names(q.select("qid", F.col("asked").alias("text")), names).select("qid", "id", "strategy", F.lit(2).alias("order"))
    part = best_overlap(q, n, shorter=True).select("qid", "id", F.lit("substring").alias("strategy"), F.lit(3).alias("order"))
    every = equal.union(named).union(part).hint("merge").join(q.select("qid", "asked"), "qid")
    found = cut(every.groupBy("asked").agg(F.min_by(F.struct("id", "strategy", "order"), "order").alias("r")).select("asked", "r.*"))
    found = own.join(sized(found), "asked").select("qid", "id", "strategy", "order")
    first = cut(names.groupBy("cls").agg(F.min_by("id", "ord").alias("id")))
    by_class = classes.join(sized(first), "cls").select("qid", "id", F.lit("class").alias("strategy"), F.lit(4).alias("order"))
    return found.union(by_class).groupBy("qid").agg(F.min_by(F.struct("id", "strategy"), "order").alias("r")).select("qid", "r.id", "r.strategy")


def search_combined(queries: DataFrame, detected: DataFrame, members: DataFrame, found: DataFrame, n: int = 10) -> DataFrame:
    """(qid, name, rank): per detected class the found rows of that class, at most max(2, n / classes) each, in the order
    of the classes; a class that gave fewer than two is topped up from its members; each name once; n in all.

    detected (qid, classes), members (ord, name, cls), found (qid, name, cls, rank). Without a class: found as it is.
    """
    from pyspark.sql import Window

    c = detected.where(F.size("classes") > 0).select("qid", F.greatest(F.lit(2), F.floor(F.lit(n) / F.size("classes"))).alias("share"), F.posexplode("classes").alias("nth", "cls"))
    w = Window.partitionBy("qid", "cls").orderBy("rank")
    hit = found.join(c, ["qid", "cls"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("share"))
    hit = hit.select("qid", "nth", "cls", F.lit(0).alias("more"), F.col("k").cast("long").alias("at"), "name")
    few = c.join(hit.groupBy("qid", "cls").agg(F.count("*").alias("got")), ["qid", "cls"], "left").where(F.coalesce("got", F.lit(0)) < 2)
    mw = Window.partitionBy("cls").orderBy("ord")
    firsts = members.withColumn("k", F.row_number().over(mw)).where(F.col("k") <= n)
    more = few.join(sized(firsts), "cls").select("qid", "nth", "cls", F.lit(1).alias("more"), F.col("k").cast("long").alias("at"), "name")
    plain = found.join(detected.where(F.size("classes") > 0).select("qid"), "qid", "left_anti").select("qid", F.lit(0).alias("nth"), "cls", F.lit(0).alias("more"), F.col("rank").cast("long").alias("at"), "name")
    every = hit.union(more).union(plain).groupBy("qid", "name").agg(F.min(F.struct("more", "nth", "at")).alias("o"))
    rank = Window.partitionBy("qid").orderBy("o", "name")
    return every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n).select("qid", "name", "rank")
