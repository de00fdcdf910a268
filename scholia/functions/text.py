"""String functions, all built from native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word as Python's \w+ finds it; Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"

# fixed values: leaving groups and nucleophile types, in the order they are tried
LEAVING_GROUPS = ("triflate", "tosylate", "mesylate", "acetate", "benzoate", "phosphate", "carbamate", "pivalate")
NUCLEOPHILES = (
    ("boron", ("boronic", "boron")),
    ("grignard", ("magnesium", "grignard")),
    ("zinc", ("zinc",)),
    ("tin", ("tin", "stannane")),
    ("silicon", ("silane", "silyl")),
)


def tokens(text: Column, longer_than: int = 0, pattern: str = WORD) -> Column:
    """Words of lower-cased text, in order and with repeats, of more than so many characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: F.length(w) > longer_than) if longer_than else found


def alpha_tokens(text: Column) -> Column:
    return tokens(text, pattern="[a-z]{2,}")


def chemical_tokens(text: Column) -> Column:
    """The set of parts between spaces, commas, hyphens and brackets that have two characters and a letter."""
    parts = F.split(F.lower(text), r"[\s,\-()\[\]{}]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & w.rlike("[a-z]")))


def first_contained(text: Column, choices: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The first choice one of whose words lower-cased text contains."""
    low, out = F.lower(text), F
    for label, words in choices:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, label)
    return out.otherwise(otherwise)


def leaving_group(name: Column) -> Column:
    return first_contained(name, [(x, (x,)) for x in LEAVING_GROUPS], "other")


def nucleophile_type(name: Column) -> Column:
    return first_contained(name, NUCLEOPHILES, "other")


def normalize(text: Column) -> Column:
    """Primes and curly quotes become ', runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "′’‘", "'''"), r"\s+", " "))


#: fixed values: what is taken out of user text
INJECTIONS = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions?",
    r"(?i)system\s*:\s*",
    r"(?i)<\|.*?\|>",
    r"(?i)\[SYSTEM\]",
    r"(?i)\[INST\]",
    r"(?i)<<<.*?>>>",
)


def sanitize(text: Column, max_length: int = 16_000) -> Column:
    """Cut first, then drop injection phrases and control characters but tab and line ends, then trim."""
    out = F.substring(text, 1, max_length)
    for p in INJECTIONS:
        out = F.regexp_replace(out, p, "")
    return F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"^\s+|\s+$", "")


def doi_valid(doi: Column) -> Column:
    return F.coalesce(doi.rlike(r"^10\.\d{4,}/[^\s]+$"), F.lit(False))


def doi_extract(text: Column) -> Column:
    """The first DOI in text without trailing punctuation, or null."""
    found = F.regexp_extract(text, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.;,)]+$", ""), F.lit(""))


def preview(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def keyword_share(text: Column, groups: dict[str, Sequence[str]]) -> list[Column]:
    """For each group, how many of its keywords lower-cased text contains, as a share of all groups' (repeats count)."""
    low = F.lower(text)
    counts = {g: F.size(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(low, k))) for g, words in groups.items()}
    total = sum(counts.values(), F.lit(0))
    return [(c / F.greatest(total, F.lit(1))).alias(f"{g}_share") for g, c in counts.items()]


def split_outside(text: Column, marks: str = ";+") -> Column:
    """Split at marks where no bracket or parenthesis is open; depths never go below zero. One pass, no UDF."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("b"), F.array().cast("array<string>").alias("done"), F.lit("").alias("own"))

    def step(acc: Column, ch: Column) -> Column:
        p = F.when(ch == "(", acc["p"] + 1).when(ch == ")", F.greatest(acc["p"] - 1, F.lit(0))).otherwise(acc["p"])
        b = F.when(ch == "[", acc["b"] + 1).when(ch == "]", F.greatest(acc["b"] - 1, F.lit(0))).otherwise(acc["b"])
        cut = (acc["p"] == 0) & (acc["b"] == 0) & F.contains(F.lit(marks), ch) & (ch != "")
        done = F.when(cut, F.array_append(acc["done"], acc["own"])).otherwise(acc["done"])
        return F.struct(p.alias("p"), b.alias("b"), done.alias("done"), F.when(cut, "").otherwise(F.concat(acc["own"], ch)).alias("own"))

    parts = F.aggregate(F.split(text, ""), start, step, lambda acc: F.array_append(acc["done"], acc["own"]))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def smiles_is_pseudo(s: Column) -> Column:
    """Missing, one character, with white space, or with an unbracketed placeholder (Ar, R, X, Y, Z)."""
    return (
        s.isNull() | (F.length(s) < 2) | s.rlike(r"\s")
        | s.rlike(r"(?<![\p{L}\p{N}_])(Ar|R|X|Y|Z)(?=[A-Z0-9\[(]|$)")
        | (s.rlike(r"(?<![\p{L}\p{N}_])R(?=[A-Z][a-z]|[A-Z]\d)") & ~F.contains(s, F.lit("[R")))
        | (s.rlike(r"(?<![\p{L}\p{N}_])Ar(?=[A-Za-z])") & ~F.contains(s, F.lit("[Ar")))
    )


def entity_label(name: Column, smiles: Column) -> Column:
    """smiles where it is a real one, else the trimmed name, else null."""
    s = F.trim(smiles)
    good = (s != "") & (F.upper(s) != "NONE") & ~smiles_is_pseudo(s)
    return F.coalesce(F.when(good, s), F.nullif(F.trim(name), F.lit("")))
