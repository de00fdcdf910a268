"""Reference-data sources: JSON and CSV files to typed rows. Missing and null are told apart where it matters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file whole. For files that are one JSON value; data sets in lines go to spark.read.json."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def json_map(docs: DataFrame, value: str = "value") -> DataFrame:
    """(id, name, leaving_group) of objects `id -> [name, leaving group, ...]`; shorter lists are dropped."""
    rows = docs.select(F.explode(F.from_json(value, "map<string, array<string>>")).alias("id", "parts"))
    return rows.where(F.size("parts") >= 2).select("id", F.col("parts")[0].alias("name"), F.col("parts")[1].alias("leaving_group"))


def code_lookup(left: DataFrame, right: DataFrame, sides: tuple[str, str] = ("electrophile", "nucleophile"), value: str = "value") -> DataFrame:
    """(id, label, side) of two objects `id -> label`."""
    one = lambda d, side: d.select(F.explode(F.from_json(value, "map<string, string>")).alias("id", "label"), F.lit(side).alias("side"))
    return one(left, sides[0]).unionByName(one(right, sides[1]))


def paper_refs(docs: DataFrame, value: str = "value") -> DataFrame:
    """(doi, title, published_date, references): the first element of each reference that isn't empty."""
    kind = "map<string, struct<title: string, published_date: string, references: array<array<string>>>>"
    rows = docs.select(F.explode(F.from_json(value, kind)).alias("doi", "p"))
    full = F.filter(F.coalesce("p.references", F.array().cast("array<array<string>>")), lambda r: F.size(r) > 0)
    return rows.select("doi", F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.published_date", F.lit("")).alias("published_date"), F.transform(full, lambda r: r[0]).alias("references"))


REACTION_FIELDS = ("R1", "R2", "Base", "E_Type", "E_Major", "E_LVG", "Nu_Type", "Nu_Major", "Nu_LVG", "Base class", "Reaction name")


def text_records(docs: DataFrame, fields: Sequence[str], value: str = "value") -> DataFrame:
    """(ord, fields) of a list of records, all as strings: '' where the key is missing, 'None' where it is null."""
    rows = docs.select(F.posexplode(F.from_json(value, "array<map<string, string>>")).alias("ord", "r"))

    def field(name: str) -> Column:
        return F.when(~F.map_contains_key("r", name), "").otherwise(F.coalesce(F.col("r")[name], F.lit("None"))).alias(name)

    return rows.select("ord", *map(field, fields))


def first_source(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, or fallback if primary has no row."""
    empty = primary.limit(1).agg(F.count("*").alias("_n"))
    return primary.unionByName(fallback.crossJoin(F.broadcast(empty)).where("_n = 0").drop("_n"))


def numeric_records(docs: DataFrame, texts: Mapping[str, str], numbers: Mapping[str, str], name: str, value: str = "value") -> DataFrame:
    """A list of records with trimmed texts and numbers (0.0 where missing); rows with a blank name are dropped."""
    rows = docs.select(F.posexplode(F.from_json(value, "array<map<string, string>>")).alias("ord", "r"))
    rows = rows.select("ord", *[F.trim(F.coalesce(F.col("r")[k], F.lit(""))).alias(c) for c, k in texts.items()], *[F.coalesce(F.col("r")[k].try_cast("double"), F.lit(0.0)).alias(c) for c, k in numbers.items()])
    return rows.where(F.col(name) != "")


def literature_records(docs: DataFrame, value: str = "value") -> DataFrame:
    """(ord, doi, title, optimum_ligand, coupling_partner, ligand_knowledge) of records with a DOI; null becomes ''."""
    keys = {"doi": "DOI", "title": "Title", "optimum_ligand": "Optimum Ligand", "coupling_partner": "Reaction", "ligand_knowledge": "Ligand Knowledge"}
    rows = docs.select(F.posexplode(F.from_json(value, "array<map<string, string>>")).alias("ord", "r"))
    rows = rows.select("ord", *[F.trim(F.coalesce(F.col("r")[k], F.lit(""))).alias(c) for c, k in keys.items()])
    return rows.where(~F.lower("doi").isin("", "nan", "none"))


_DATE = "struct<`date-parts`: array<array<int>>>"
WORK = (
    f"title array<string>, DOI string, `is-referenced-by-count` int, `published-print` {_DATE}, `published-online` {_DATE}, published {_DATE}, "
    "author array<struct<family: string, given: string, name: string>>, reference array<struct<DOI: string>>"
)


def flatten_work(rows: DataFrame, value: str = "value") -> DataFrame:
    """A registry's work record (JSON) as (doi, title, author, year, citations, references). The author is the last one."""
    w = rows.select(F.from_json(value, WORK).alias("w")).select("w.*")
    year = F.coalesce(*[F.get(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)), F.lit(0)) for c in ("published-print", "published-online", "published")])
    last = F.try_element_at("author", F.lit(-1))
    cited = F.filter(F.coalesce("reference", F.array().cast("array<struct<DOI: string>>")), lambda r: r["DOI"].isNotNull())
    return w.select(
        F.col("DOI").alias("doi"), F.coalesce(F.get("title", F.lit(0)), F.lit("No Title")).alias("title"),
        F.coalesce(last["family"], last["name"], F.lit("Unknown")).alias("author"), year.alias("year"),
        F.coalesce("is-referenced-by-count", F.lit(0)).alias("citations"), F.transform(cited, lambda r: r["DOI"]).alias("references"),
    )


CITING = "results array<struct<id: string, doi: string, title: string, cited_by_count: int, publication_year: int, authorships: array<struct<author: struct<display_name: string>>>, referenced_works: array<string>>>"


def flatten_citing(pages: DataFrame, max_papers: int, cited: str = "cited", page: str = "page", value: str = "value") -> DataFrame:
    """Citing works of each cited paper's result pages (cited, page, JSON) in order, to the end of the page on which
    max_papers of that paper are reached. Pages are counted without what stands on them."""
    p = pages.select(F.col(cited).alias("cited"), F.col(page).alias("page"), F.from_json(value, CITING)["results"].alias("r"))
    before = Window.partitionBy("cited").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size(F.coalesce("r", F.array().cast(p.schema["r"].dataType)))
    read = p.select("cited", "page", n.alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_papers)
    rows = p.join(read.select("cited", "page").hint("merge"), ["cited", "page"], "left_semi").select("cited", "page", F.posexplode("r").alias("pos", "w"))
    name = F.get("w.authorships", F.lit(0))["author"]["display_name"]
    return rows.select("cited", "page", "pos", "w.id", "w.doi", "w.title", F.coalesce(name, F.lit("Unknown")).alias("author"), F.col("w.cited_by_count").alias("citations"), F.col("w.publication_year").alias("year"), F.col("w.referenced_works").alias("references"))


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a sheet (CSV with a header) without nulls, as `doi`."""
    sheet = spark.read.csv(path, header=True)
    return sheet.select(F.col(f"`{sheet.columns[0]}`").alias("doi")).na.drop()


def citation_csv(spark: SparkSession, path: str) -> DataFrame:
    """A node or edge file; quoted values may hold line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


#: What any JSON value looks like from outside: brackets or quotes at both ends, or one token. What doesn't is not parsed,
#: as each failure of the parser costs more than many successes.
_OUTSIDE = r'(?s)^[ \t\r\n]*+(?:\{.*\}|\[.*\]|".*"|[^\s{}\[\]",:]++)[ \t\r\n]*+$'


def is_json(text: Column) -> Column:
    """Whether all of text is one JSON value: the parser alone lets anything follow it."""
    return text.rlike(_OUTSIDE) & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once however often use has it: as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def largest_balanced(text: Column, brackets: str, size: Callable[[Column], Column]) -> Column:
    """The largest span of text, by size, from an opening bracket at depth 0 to the one that closes it, that is JSON; the
    first on ties; null if there is none. One fold over the text's brackets keeps depth and the best span so far;
    each span is measured once."""
    opening, closing = brackets
    cuts = F.regexp_extract_all(text, F.lit(rf"(?s)[^\{opening}\{closing}]*+[\{opening}\{closing}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("begin"), F.lit(-1).alias("size"), F.lit(None).cast("string").alias("best"))

    def step(s: Column, cut: Column) -> Column:
        opens = F.endswith(cut, F.lit(opening))
        moved = F.struct((s["at"] + F.length(cut)).alias("at"), opens.alias("opens"), (s["depth"] + F.when(opens, 1).otherwise(-1)).alias("depth"))

        def begun(m: Column) -> Column:
            begin = F.when(m["opens"] & (s["depth"] == 0), m["at"]).otherwise(s["begin"])
            span = lambda begin: F.when(~m["opens"] & (m["depth"] == 0) & (begin > 0), F.substring(text, begin, m["at"] - begin + 1))
            return once(begin, lambda begin: once(span(begin), lambda span: ended(m, begin, span)))

        def ended(m: Column, begin: Column, span: Column) -> Column:
            measured = F.coalesce(F.when(is_json(span), size(span)), F.lit(-1))
            return once(measured, lambda n: F.struct(m["at"].alias("at"), m["depth"].alias("depth"), begin.alias("begin"), F.greatest(n, s["size"]).alias("size"), F.when(n > s["size"], span).otherwise(s["best"]).alias("best")))

        return once(moved, begun)

    return F.aggregate(cuts, start, step, lambda s: s["best"])


def json_repair(text: Column, schema: str) -> Column:
    """Model output as a struct: the whole text, else a fenced block, else the object of most keys among its balanced
    spans of braces (the first on ties), else the text with missing closers added. Null where none parses. Native."""
    keys = lambda span: F.size(F.json_object_keys(span))
    read = lambda x: once(x, lambda x: F.when(is_json(x), F.from_json(x, schema)))

    def inside(t: Column) -> Column:
        return once(largest_balanced(t, "{}", keys), lambda span: F.when(F.size(F.json_object_keys(span)) > 0, F.from_json(span, schema)))

    return once(F.trim(text), lambda t: F.coalesce(read(t), read(fenced(t)), inside(t), read(closed(t))))


def fenced(text: Column) -> Column:
    """What stands in the first fenced block, empty if there is none."""
    return F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1))


def closed(text: Column) -> Column:
    """text with as many closing braces, then brackets, as are missing."""
    missing = lambda o, c: F.greatest(F.length(F.regexp_replace(text, f"[^{o}]", "")) - F.length(F.regexp_replace(text, f"[^{c}]", "")), F.lit(0))
    return F.concat(text, F.repeat(F.lit("}"), missing(r"\{", r"\}")), F.repeat(F.lit("]"), missing(r"\[", r"\]")))


def json_repair_any(text: Column) -> Column:
    """The same for output that may be an object or an array, as JSON text: the whole, else a fenced block, else the
    longest (as compact JSON) of its balanced spans of braces and of brackets, the object on ties, else the text with
    missing closers."""
    compact = lambda x: once(x, lambda x: F.when(is_json(x), F.to_json(F.try_parse_json(x))))
    length = lambda span: F.length(F.to_json(F.try_parse_json(span)))

    def best(t: Column) -> Column:
        spans = F.struct(*[compact(largest_balanced(t, b, length)).alias(c) for c, b in (("objects", "{}"), ("arrays", "[]"))])
        return once(spans, lambda s: F.when(s["objects"].isNull() | (F.length(s["arrays"]) > F.length(s["objects"])), s["arrays"]).otherwise(s["objects"]))

    return once(F.trim(text), lambda t: F.coalesce(compact(t), compact(fenced(t)), best(t), compact(closed(t))))


def knowledge_graph(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) tables of JSON objects with nodes and edges."""
    g = rows.select(key, F.from_json(value, "nodes array<struct<id: string, label: string, type: string, description: string>>, edges array<struct<source: string, target: string, label: string>>").alias("g"))
    return g.select(key, F.inline("g.nodes")), g.select(key, F.inline("g.edges"))
