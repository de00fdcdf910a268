"""Merging the analyses of figures and pages into a document's results, and completing reactions from R-group tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.extraction import filled

#: Names of results that come from whole pages.
PAGE = "vision"
REACTANTS = "array<struct<name: string, smiles: string, assembled: boolean>>"
_EXTRA = ("entry", "entry_id", "rgroup_values", "assembled_smiles")


class Merged(NamedTuple):
    reactions: DataFrame
    compounds: DataFrame
    tables: DataFrame
    figures: DataFrame
    scaffolds: DataFrame


def _get(data: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(data, f"$.{field}", kind)


def _list(data: Column, field: str) -> Column:
    """A field's items; none if it is absent or no list."""
    return F.coalesce(_get(data, field, "array<variant>"), F.array().cast("array<variant>"))


def _text(data: Column, field: str, default: str) -> Column:
    """A field as text, the default where it is absent; a JSON null stays null."""
    return F.when(_get(data, field).isNull(), default).otherwise(_get(data, field, "string"))


def _full(value: Column) -> Column:
    """Whether a value is there and not empty, zero or false."""
    return value.isNotNull() & ~F.to_json(value).isin("null", "[]", "{}", '""', "0", "false")


def _reaction(s: Column) -> Column:
    """The fields of a scheme. Schemes of pages and flat results have no fields of entries."""
    same = [_get(s, f).alias(f) for f in ("reagents", "catalyst", "ligand", "conditions", "yield", *_EXTRA)]
    return F.struct(_text(s, "reactionType", "unknown").alias("type"), _list(s, "reactants").alias("reactants"), _list(s, "products").alias("products"), _text(s, "notes", "").alias("notes"), *same)


def _flat(data: Column) -> Column:
    """A result with lists of its own instead of schemes, as one scheme; names without more become compounds."""
    none = F.lit(None).cast("variant")
    named = lambda e: F.when(F.schema_of_variant(e) == "STRING", F.to_variant_object(F.struct(F.try_variant_get(e, "$", "string").alias("name"), F.lit(None).cast("string").alias("smiles")))).otherwise(e)
    lists = [F.transform(_list(data, f), named).alias(f) for f in ("reactants", "products")]
    first = [_get(data, "reagents").alias("reagents"), _get(data, "catalysts[0]").alias("catalyst"), _get(data, "ligands[0]").alias("ligand"), _get(data, "conditions").alias("conditions"), none.alias("yield")]
    return F.struct(F.lit("unknown").alias("type"), *lists, F.lit("").alias("notes"), *first, F.parse_json(F.lit("1")).alias("entry"), *[none.alias(f) for f in _EXTRA[1:]])


def parsed_once(rows: DataFrame, kept: Callable[[Column], Column]) -> DataFrame:
    """rows with data (JSON text) as VARIANT, where kept(data). Exploded from a list of one, so that no later step puts the
    parser in place of each use of the column."""
    parsed = F.explode(F.filter(F.array(F.try_parse_json("data")), kept)).alias("data")
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "data"], parsed)


def read_results(results: DataFrame) -> DataFrame:
    """results (doc, ord, page, source, data: JSON text) with data as VARIANT, `of_page`, and `schemes`, its reactions.

    A result without schemes whose reactants or products aren't empty is flat: one scheme, and treated as a page's; it has
    none if one of the two is no list. Rows whose data is null or no JSON object are left out.
    """
    rows = parsed_once(results, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    data, listed = F.col("data"), _list(F.col("data"), "reaction_schemes")
    flat = (F.size(listed) == 0) & (_full(_get(data, "reactants")) | _full(_get(data, "products")))
    lists = [_get(data, f).isNull() | _get(data, f, "array<variant>").isNotNull() for f in ("reactants", "products")]
    none = F.filter(F.array(_flat(data)), lambda _: F.lit(False))
    schemes = F.when(~flat, F.transform(listed, _reaction)).when(lists[0] & lists[1], F.array(_flat(data))).otherwise(none)
    of_page = flat | F.coalesce(F.col("source") == PAGE, F.lit(False))
    return rows.withColumn("schemes", schemes).withColumn("of_page", of_page).withColumn("source", F.when(of_page, PAGE).otherwise(F.col("source")))


def merge_results(results: DataFrame, known: DataFrame, before: DataFrame | None = None) -> Merged:
    """Results (doc, ord, page, source, data) of figures and pages merged into their documents, in the order `ord`.

    reactions: every scheme, with id source_page<page>_<n>; n runs over the document, behind the `before` (doc, n) that it
    had. compounds: names of schemes' reactants and products and of a figure's own list that `known` (doc, name) lacks,
    by lower case, the first occurrence of each. tables: results with rows of a table. figures: one a result. scaffolds:
    each document's first scaffold, R-group table and map of attachments among its figures.
    Every part is one pass over the results and at most one shuffle by document; each reads them anew, so write them first
    if they are dear. Null documents are a document of their own for numbers; `known` never has them.
    """
    rows = read_results(results)
    numbered = rows
    if before is not None:
        numbered = rows.hint("merge").join(before.select("doc", F.col("n").alias("_before")), "doc", "left")
    at = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "nth")) + (F.coalesce("_before", F.lit(0)) if before is not None else 0)
    reactions = numbered.select("doc", "ord", "page", "source", "of_page", *(["_before"] if before is not None else []), F.posexplode("schemes").alias("nth", "r"))
    own = lambda f: F.when(~F.col("of_page"), F.col("r")[f]) if f in _EXTRA else F.col("r")[f]
    fields = ("type", "reactants", "products", "reagents", "catalyst", "ligand", "conditions", "yield", "notes", *_EXTRA)
    reactions = reactions.withColumn("n", at).select("doc", F.concat(F.coalesce("source", F.lit("")), F.lit("_page"), "page", F.lit("_"), "n").alias("id"), "source", "page", *[own(f).alias(f) for f in fields])

    tables = rows.where(_full(_get(F.col("data"), "table_data")))
    tables = tables.select("doc", "ord", "page", "source", _get(F.col("data"), "table_data").alias("data"), _list(F.col("data"), "table_columns").alias("columns"))
    kind = F.when(F.col("of_page"), "vision_analysis").otherwise(_text(F.col("data"), "figure_type", "unknown"))
    figures = rows.select("doc", "ord", "page", kind.alias("type"), F.when(~F.col("of_page"), F.col("source")).alias("source"), _text(F.col("data"), "description", "").alias("description"), _text(F.col("data"), "notes", "").alias("notes"))
    first = [F.min_by(_get(F.col("data"), f), F.when(_get(F.col("data"), f).isNotNull(), F.col("ord"))).alias(f) for f in ("scaffold_smiles", "rgroup_table", "rgroup_attachment_map")]
    scaffolds = rows.where("not of_page").groupBy("doc").agg(*first).where("scaffold_smiles is not null or rgroup_table is not null or rgroup_attachment_map is not null")
    return Merged(reactions, _compounds(rows, known), tables, figures, scaffolds)


def _compounds(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, ord, nth, name, smiles, formula, role, source) of names new to their document."""
    plain = lambda e: ~F.schema_of_variant(e).startswith("OBJECT")
    name = lambda e: F.when(plain(e), F.try_variant_get(e, "$", "string")).otherwise(_get(e, "name", "string")).alias("name")
    entity = lambda e, formula, role: F.struct(name(e), _get(e, "smiles", "string").alias("smiles"), formula.alias("formula"), role.alias("role"))
    no = F.lit(None).cast("string")
    of_scheme = F.flatten(F.transform("schemes", lambda s: F.concat(F.transform(s["reactants"], lambda e: entity(e, no, F.lit("reactant"))), F.transform(s["products"], lambda e: entity(e, no, F.lit("product"))))))
    of_figure = F.transform(_list(F.col("data"), "compounds"), lambda e: entity(e, _get(e, "formula", "string"), _text(e, "role", "unknown")))
    every = F.when(F.col("of_page"), of_scheme).otherwise(F.concat(of_scheme, of_figure))
    found = rows.select("doc", "ord", "source", F.posexplode(every).alias("nth", "e")).where("e.name <> ''").withColumn("low", F.lower("e.name"))
    # the first of each name before the join: what is shuffled is a row a name
    first = found.groupBy("doc", "low").agg(F.min_by(F.struct("ord", "nth", "e", "source"), F.struct("ord", "nth")).alias("r"))
    fresh = first.hint("merge").join(known.select("doc", F.lower("name").alias("low")), ["doc", "low"], "left_anti")
    return fresh.select("doc", "r.ord", "r.nth", "r.e.*", "r.source")


#: The lists of a page's result that are merged without repetitions.
LISTS = ("reactants", "products", "catalysts", "ligands", "solvents", "mechanisms", "yields")
#: A page's result, cut into its fields at once.
_FIELDS = ", ".join([*(f"{f}: array<variant>" for f in (*LISTS, "reaction_schemes", "compounds", "table_data")), "conditions: map<string, variant>", *(f"{f}: variant" for f in ("image_description", "description", "reactionType", "selectivity"))])
#: Items that are empty, as `_item` writes them.
_EMPTY = ("null", "[]", "{}", '"', "0", "false")


def _item(value: Column) -> Column:
    """A value as text that tells it from every other one: a string behind a quote, without a writer, anything else as
    JSON."""
    return F.when(F.schema_of_variant(value) == "STRING", F.concat(F.lit('"'), F.try_variant_get(value, "$", "string"))).otherwise(F.to_json(value))


def _value(item: Column) -> Column:
    """The VARIANT that `_item` wrote."""
    return F.when(F.startswith(item, F.lit('"')), F.substring(item, 2, 1 << 30).cast("variant")).otherwise(F.parse_json(item))


def merge_pages(results: DataFrame) -> DataFrame:
    """One row a document from the results (doc, ord, page, source, data: JSON text) of its pages, in the order `ord`.

    Each of `LISTS`: different items by first occurrence, names of schemes' reactants and products behind the page's own,
    without empty items (yields keep them). conditions: the first value of each key that isn't empty. reactionType,
    selectivity: the first that isn't empty. image_descriptions (page, description, source), pages_with_data, and
    reaction_schemes, compounds (those with a name), table_data as (page, source, data). Items are VARIANT; equal means the
    same JSON text. Null, broken and empty data is none; fields that aren't lists where a list is due count as empty.
    A page is parsed and cut into fields once; its document's row, which holds all of its pages' schemes, compounds and
    tables in any case, is made by one grouping, and items are merged there as text.
    """
    # an object with a field is what begins so, if it is JSON at all
    parsed = F.when(F.col("data").rlike(r"^\s*\{\s*[^\s}]"), F.try_parse_json("data"))
    rows = results.select("doc", "ord", "page", "source", F.explode(F.array(parsed)).alias("v"))
    schemes = F.try_variant_get("v", "$.reaction_schemes", f"array<struct<{', '.join(f'{f}: array<variant>' for f in LISTS[:2])}>>")
    rows = rows.select("doc", "ord", "page", "source", F.explode(F.array(F.struct(F.try_variant_get("v", "$", f"struct<{_FIELDS}>").alias("f"), schemes.alias("s")))).alias("d")).select("doc", "ord", "page", "source", "d.*")
    field = lambda f: F.col("f")[f]
    full = lambda value: ~_item(value).isin(*_EMPTY)
    names = lambda items: F.transform(items, lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT"), _get(e, "name")).otherwise(e))
    blank = F.array().cast("array<string>")

    def items(f: str) -> Column:
        found = F.coalesce(F.transform(field(f), _item), blank)
        if f in LISTS[:2]:
            found = F.when(F.col("s").isNull(), found).otherwise(F.concat(found, F.flatten(F.transform("s", lambda s: F.coalesce(F.transform(names(s[f]), _item), blank)))))
        return F.filter(found, lambda x: x.isNotNull() & (F.lit(f == "yields") | ~x.isin(*_EMPTY))).alias(f)

    given = F.transform(F.map_entries(field("conditions")), lambda e: F.struct(e["key"].alias("key"), F.col("ord"), F.to_json(e["value"]).alias("text")))
    given = F.coalesce(F.filter(given, lambda e: ~e["text"].isin("null", "[]", "{}", '""', "0", "false")), F.array())
    image, told = field("image_description"), field("description")
    described = F.when(full(image), F.struct(F.col("page"), F.try_variant_get(image, "$", "string").alias("description"), F.lit(None).cast("string").alias("source")))
    described = described.when(full(told), F.struct(F.col("page"), F.try_variant_get(told, "$", "string").alias("description"), F.col("source")))
    texts = lambda listed: F.coalesce(F.transform(listed, lambda v: F.to_json(v)), blank)
    named = F.filter(field("compounds"), lambda c: full(_get(c, "name")))
    # a row of a table that is no object becomes one
    cells = F.transform(field("table_data"), lambda r: F.when(F.schema_of_variant(r).startswith("OBJECT"), F.to_json(r)).otherwise(F.concat(F.lit('{"values":'), F.to_json(r), F.lit("}"))))
    said = [F.when(full(field(f)), F.try_variant_get(field(f), "$", "string")).alias(f) for f in ("reactionType", "selectivity")]
    page = F.struct("ord", "page", "source", F.col("f").isNotNull().alias("some"), described.alias("image"), texts(field("reaction_schemes")).alias("reaction_schemes"), texts(named).alias("compounds"), F.coalesce(cells, blank).alias("table_data"), given.alias("given"), *map(items, LISTS), *said)
    # exploded from a list of one, so that it is made by compiled code, not inside the aggregate
    docs = rows.select("doc", F.explode(F.array(page)).alias("page")).groupBy("doc").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    every = lambda f: F.flatten(F.transform("pages", lambda p: p[f]))
    merged = lambda f: F.transform(F.array_distinct(every(f)), _value).alias(f)
    first = lambda f: F.get(F.array_compact(F.transform("pages", lambda p: p[f])), F.lit(0)).alias(f)
    tagged = lambda f: F.flatten(F.transform("pages", lambda p: F.transform(p[f], lambda t: F.struct(p["page"].alias("page"), p["source"].alias("source"), F.parse_json(t).alias("data"))))).alias(f)
    # as the variable of a lambda the sorted list is made once; the first of a key is that behind another key
    first_of_key = lambda known: F.filter(known, lambda x, i: (i == 0) | (F.get(known, i - 1)["key"] != x["key"]))
    known = F.get(F.transform(F.array(F.sort_array(every("given"))), first_of_key), F.lit(0))
    conditions = F.map_from_entries(F.transform(known, lambda x: F.struct(x["key"].alias("key"), F.parse_json(x["text"]).alias("value"))))
    return docs.select(
        "doc", *map(merged, LISTS), conditions.alias("conditions"), first("reactionType"), first("selectivity"), F.array_compact(F.transform("pages", lambda p: p["image"])).alias("image_descriptions"),
        F.transform(F.filter("pages", lambda p: p["some"]), lambda p: p["page"]).alias("pages_with_data"), *[tagged(f) for f in ("reaction_schemes", "compounds", "table_data")],
    )


def complete_reactions(reactions: DataFrame, tables: DataFrame) -> DataFrame:
    """reactions (doc, entry_id, entry, assembled_smiles, reactants, ...) completed from tables (doc, scaffold, label,
    rgroups, partners), at most one a document; rgroups and partners are maps R-group -> entry -> fragment.

    A reaction's structure is its own assembled one if that has no open place, else the scaffold with the fragments of its
    entry (entry_id, entry, or its first reactant with an entry) and of partners among its reactants, the later of two
    for one R-group. It replaces the structure of reactants that have none, the scaffold's, the scaffold's label as their
    name, or an entry's name; a reaction without reactants gets one. `assembled_from_rgroup` tells which were completed.
    Without a table, scaffold, entry or fragment a reaction stays as it is. Null texts count as empty, null maps too.
    """
    name = "_rgroup_table"
    maps = "map<string, map<string, string>>"
    empty = F.create_map().cast(maps)
    table = F.struct(F.coalesce("scaffold", F.lit("")).alias("scaffold"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("rgroups", empty).alias("rgroups"), F.coalesce("partners", empty).alias("partners"))
    rows = reactions.hint("merge").join(tables.select("doc", table.alias(name)), "doc", "left")
    t = F.col(name)
    reactants = F.coalesce(F.col("reactants"), F.array().cast(REACTANTS))

    entries = lambda n: F.exists(F.map_values(t["rgroups"]), lambda m: F.map_contains_key(m, n))
    names = F.filter(F.transform(reactants, lambda r: F.trim(r["name"])), lambda n: n.isNotNull() & (n != ""))
    given = F.coalesce(F.nullif("entry_id", F.lit("")), F.col("entry"), F.lit(""))
    rows = rows.withColumn("_names", names).withColumn("_entry", F.when(given == "", F.coalesce(F.get(F.filter("_names", entries), F.lit(0)), F.lit(""))).otherwise(given))

    def parts(groups: Column, entry: Column) -> Column:
        having = F.filter(F.map_entries(groups), lambda g: F.map_contains_key(g["value"], entry))
        return F.transform(having, lambda g: F.struct(g["key"].alias("rgroup"), F.element_at(g["value"], entry).alias("fragment")))

    every = F.concat(parts(t["rgroups"], F.col("_entry")), F.flatten(F.transform("_names", lambda n: parts(t["partners"], n))))
    rows = rows.withColumn("_parts", every)
    later = lambda i: F.slice("_parts", i + 2, F.size("_parts"))
    last = F.filter("_parts", lambda p, i: ~F.exists(later(i), lambda q: q["rgroup"] == p["rgroup"]))
    rows = rows.withColumn("_parts", last)
    own = F.coalesce(F.col("assembled_smiles"), F.lit(""))
    closed = (own != "") & ~own.rlike(r"\[\*(:\d+)?\]")
    put = F.when((F.col("_entry") != "") & (F.size("_parts") > 0), filled(t["scaffold"], F.col("_parts")))
    usable = (t["scaffold"] != "") & ((F.size(t["rgroups"]) > 0) | (F.size(t["partners"]) > 0))
    rows = rows.withColumn("_new", F.when(usable, F.when(closed, own).otherwise(put)))

    def patch(r: Column) -> Column:
        blank = F.coalesce(r["smiles"], F.lit("")) == ""
        meant = (r["smiles"] == t["scaffold"]) | ((t["label"] != "") & (r["name"] == t["label"])) | entries(F.coalesce(F.trim(r["name"]), F.lit("")))
        return F.when(blank | F.coalesce(meant, F.lit(False)), r.withField("smiles", F.col("_new")).withField("assembled", F.lit(True))).otherwise(r)

    title = F.coalesce(F.nullif(t["label"], F.lit("")), F.lit("scaffold"))
    fresh = F.struct(F.concat(title, F.lit(" ("), F.coalesce(F.nullif("entry_id", F.lit("")), title), F.lit(")")).alias("name"), F.col("_new").alias("smiles"), F.lit(True).alias("assembled"))
    done = F.when(F.col("_new").isNull(), F.col("reactants")).when(F.size(reactants) == 0, F.array(fresh)).otherwise(F.transform(reactants, patch))
    kept = [done.alias(c) if c == "reactants" else F.col(f"`{c}`") for c in reactions.columns]
    return rows.select(*kept, F.col("_new").isNotNull().alias("assembled_from_rgroup"))
