"""Queries of merged results. An order is a document; each of its lines is the analysis of a figure or page, or a reaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import merging as m
from scholia.plans.bindings import extraction_items, with_views

#: A line's analysis as JSON, in SQL that both engines read: flat lists, schemes, a table with compounds, a page, nothing.
_DATA = """case ord % 5
  when 0 then '{"reactants": ["' || name || '"], "products": [{"name": "P' || partner || '", "smiles": "' || smiles || '"}], "catalysts": ["Pd", "Ni"], "description": "flat"}'
  when 1 then '{"figure_type": "scheme", "reaction_schemes": [{"reactionType": "coupling", "reactants": [{"name": "' || name || '", "smiles": "' || smiles || '"}], "products": ["q' || partner || '"], "entry_id": "' || ord || '"}, {"reactants": [], "products": [{"name": "' || upper(name) || '"}]}], "scaffold_smiles": "C' || ord || '[R1]"}'
  when 2 then '{"figure_type": "table", "table_data": [{"yield": ' || partner || '}], "table_columns": ["yield"], "compounds": [{"name": "' || name || '", "formula": "H2", "role": "base"}, {"name": "z"}], "scaffold_smiles": "x' || page || '"}'
  when 3 then '{"reaction_schemes": [{"reactants": [{"name": "' || name || '"}, "v' || partner || '"], "entry_id": "lost"}], "table_data": [{"page": ' || page || '}], "compounds": [{"name": "unseen"}], "scaffold_smiles": "never"}'
  else '{}' end"""


def _merged(spark, d) -> m.Merged:
    rows = extraction_items(spark, d)
    results = rows.select("doc", "ord", "page", F.when(F.col("ord") % 5 == 3, m.PAGE).otherwise("embedded").alias("source"), F.expr(_DATA).alias("data"))
    known = rows.where("ord = 4").select("doc", F.upper("name").alias("name"))
    return m.merge_results(results, known, rows.where("ord = 1").select("doc", (F.col("partner") % 3).alias("n")))


def merge_results_reactions(spark, d):
    text = lambda c: F.try_variant_get(c, "$", "string").alias(c)
    first = F.to_json(F.get("reactants", F.lit(0))).alias("reactant")
    return _merged(spark, d).reactions.select("doc", "id", "source", "page", "type", F.size("reactants").alias("n_reactants"), F.size("products").alias("n_products"), first, text("catalyst"), text("entry_id"))


def merge_results_compounds(spark, d):
    return _merged(spark, d).compounds.select("doc", "ord", "name", "smiles", "formula", "role", "source")


def merge_results_tables(spark, d):
    return _merged(spark, d).tables.select("doc", "ord", "page", "source", F.to_json("data").alias("data"), F.size("columns").alias("n_columns"))


def merge_results_figures(spark, d):
    return _merged(spark, d).figures


def merge_results_scaffolds(spark, d):
    return _merged(spark, d).scaffolds.select("doc", F.try_variant_get("scaffold_smiles", "$", "string").alias("scaffold"))


#: A page's result: flat lists, schemes, a table with compounds, nothing.
_PAGE = """case ord % 4
  when 0 then '{"reactants": ["' || name || '", "' || name || '", ""], "catalysts": ["Pd"], "yields": [' || partner || '], "conditions": {"k0": "", "k1": "v' || partner || '"}, "image_description": "img' || ord || '"}'
  when 1 then '{"reaction_schemes": [{"reactants": [{"name": "' || name || '"}, "r' || page || '"], "products": ["p"]}, {"reactants": ["own"]}], "reactants": ["own", "' || smiles || '"], "description": "d' || ord || '", "reactionType": "t' || ord || '"}'
  when 2 then '{"compounds": [{"name": "' || name || '"}, {"name": ""}], "table_data": [{"y": 1}, [2]], "products": ["' || name || '"], "yields": [' || partner || ', ' || page || ', 0], "conditions": {"k1": "late", "k0": 5}}'
  else '{}' end"""


def merge_pages(spark, d):
    rows = extraction_items(spark, d)
    out = m.merge_pages(rows.select("doc", "ord", "page", F.lit("page").alias("source"), F.expr(_PAGE).alias("data")))
    line = lambda c: F.array_join(F.transform(c, lambda v: F.to_json(v)), ",").alias(c)
    conditions = F.array_join(F.transform(F.map_entries("conditions"), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"]))), ";").alias("conditions")
    images = F.array_join(F.transform("image_descriptions", lambda i: F.concat(i["page"], F.lit(":"), i["description"], F.coalesce(i["source"], F.lit("")))), ";").alias("images")
    sizes = [F.size(c).alias(f"n_{c}") for c in ("reaction_schemes", "compounds")]
    table = F.array_join(F.transform("table_data", lambda t: F.concat(t["page"], F.lit(":"), F.to_json(t["data"]))), ";").alias("table_data")
    return out.select("doc", *[line(c) for c in ("reactants", "products", "catalysts", "yields")], conditions, F.col("reactionType").alias("reaction_type"), images, F.array_join("pages_with_data", ",").alias("pages"), *sizes, table)


def rgroup_patch(spark, d):
    rows = extraction_items(spark, d)
    ord_, has = F.col("ord"), F.col("ord") % 7 != 0
    no = F.lit(None).cast("boolean").alias("assembled")
    pair = F.array(F.struct("name", "smiles", no), F.struct(F.lit("L").alias("name"), F.lit("Cl").alias("smiles"), no))
    own = F.when(ord_ % 5 == 0, F.concat(F.lit("G"), "ord")).when(ord_ % 5 == 1, "C[*:1]")
    reactions = rows.select("doc", "ord", F.when(ord_ % 3 == 0, F.col("name")).alias("entry_id"), F.lit(None).cast("string").alias("entry"), own.alias("assembled_smiles"), F.when(has, pair).otherwise(F.array().cast(m.REACTANTS)).alias("reactants"))
    first = rows.where("ord >= 2").groupBy("doc", "name").agg(F.min_by("partner", "ord").alias("partner"), F.max(F.col("ord") % 2 == 0).alias("even"))
    listed = lambda value: F.map_from_entries(F.collect_list(F.struct("name", value)))
    even = F.map_from_entries(F.collect_list(F.when(F.col("even"), F.struct("name", F.lit("H")))))
    groups = first.groupBy("doc").agg(F.create_map(F.lit("R1"), listed(F.concat(F.lit("F"), "partner")), F.lit("R2"), even).alias("rgroups"))
    docs = rows.select("doc").distinct().hint("merge").join(groups, "doc", "left")
    partners = F.create_map(F.lit("R3"), F.create_map(F.lit("part 7"), F.lit("I")))
    tables = docs.select("doc", F.lit("C[R1](O[R2])[R3]").alias("scaffold"), F.when(F.col("doc") % 2 == 0, "L").alias("label"), "rgroups", partners.alias("partners"))
    done = m.complete_reactions(reactions, tables)
    shown = F.array_join(F.transform("reactants", lambda r: F.concat(r["name"], F.lit("="), r["smiles"])), ";").alias("reactants")
    n = F.size(F.filter("reactants", lambda r: F.coalesce(r["assembled"], F.lit(False))))
    return done.select("doc", "ord", shown, n.alias("n_assembled"), "assembled_from_rgroup")


_I = with_views("items")
_R = f"""{_I}, j as (select doc, ord, page, case when ord % 5 = 3 then 'vision' else 'embedded' end as source, ({_DATA})::json as j from items),
    f as (select *, coalesce(json_array_length(j->'$.reaction_schemes'), 0) = 0 and (coalesce(json_array_length(j->'$.reactants'), 0) > 0 or coalesce(json_array_length(j->'$.products'), 0) > 0) as flat from j),
    r as (select doc, ord, page, j, flat, flat or source = 'vision' as of_page, case when flat then 'vision' else source end as source from f),
    l as (select *, case when flat then [json_object('reactants', j->'$.reactants', 'products', j->'$.products')] else coalesce(cast(j->'$.reaction_schemes' as json[]), []) end as schemes from r)"""
_ENTITY = "case when json_type(e) = 'VARCHAR' then e->>'$' else e->>'$.name' end"
_FOUND = f"""{_R}, s as (select doc, ord, source, of_page, j, unnest(schemes) as s, unnest(range(len(schemes))) as nth from l),
    b as (select doc, ord, source, nth, 0 as side, unnest(cast(s->'$.reactants' as json[])) as e, unnest(range(json_array_length(s->'$.reactants')::bigint)) as place, 'reactant' as role from s
      union all select doc, ord, source, nth, 1, unnest(cast(s->'$.products' as json[])), unnest(range(json_array_length(s->'$.products')::bigint)), 'product' from s
      union all select doc, ord, source, 1000000, 0, c, place, coalesce(c->>'$.role', 'unknown') from (select doc, ord, source, unnest(cast(j->'$.compounds' as json[])) as c, unnest(range(json_array_length(j->'$.compounds')::bigint)) as place from r where not of_page)),
    n as (select *, {_ENTITY} as name from b)"""
_P = f"""{_I}, j as (select doc, ord, page, ({_PAGE})::json as j from items),
    s as (select doc, ord, unnest(cast(j->'$.reaction_schemes' as json[])) as s, unnest(range(json_array_length(j->'$.reaction_schemes')::bigint)) as nth from j),
    e as ({" union all ".join(f"select doc, ord, '{c}' as list, 0 as part, 0 as nth, unnest(cast(j->'$.{c}' as json[])) as e, unnest(range(json_array_length(j->'$.{c}')::bigint)) as i from j" for c in ("reactants", "products", "catalysts", "yields"))}
      union all {" union all ".join(f"select doc, ord, '{c}', 1, nth, unnest(cast(s->'$.{c}' as json[])), unnest(range(json_array_length(s->'$.{c}')::bigint)) from s" for c in ("reactants", "products"))}),
    t as (select doc, list, ord, part, nth, i, case when json_type(e) = 'OBJECT' then e->'$.name' else e end::varchar as v from e),
    u as (select doc, list, v, min((ord, part, nth, i)) as place from t where list = 'yields' or v <> '""' group by all),
    l as (select doc, {", ".join(f"string_agg(v, ',' order by place) filter (list = '{c}') as {c}" for c in ("reactants", "products", "catalysts", "yields"))} from u group by doc),
    c as (select doc, arg_min(j->'$.conditions.k0', ord) filter (coalesce(j->>'$.conditions.k0', '') <> '') as k0, arg_min(j->'$.conditions.k1', ord) filter (coalesce(j->>'$.conditions.k1', '') <> '') as k1 from j group by doc)"""
QUERIES = {
    "merge_results_reactions": (
        merge_results_reactions,
        rf"""{_R}, s as (select doc, ord, page, source, of_page, flat, j, unnest(schemes) as s, unnest(range(len(schemes))) as nth from l)
        select doc, source || '_page' || page || '_' || (row_number() over (partition by doc order by ord, nth) + (select partner % 3 from items i where i.doc = s.doc and i.ord = 1)) as id, source, page, coalesce(s->>'$.reactionType', 'unknown') as type,
        coalesce(json_array_length(s->'$.reactants'), 0)::int as n_reactants, coalesce(json_array_length(s->'$.products'), 0)::int as n_products,
        case when flat then '{{"name":' || (s->'$.reactants[0]')::varchar || ',"smiles":null}}' else (s->'$.reactants[0]')::varchar end as reactant,
        case when flat then j->>'$.catalysts[0]' end as catalyst, case when not of_page then s->>'$.entry_id' end as entry_id from s""",
    ),
    "merge_results_compounds": (
        merge_results_compounds,
        f"""{_FOUND}, k as (select *, row_number() over (partition by doc, lower(name) order by ord, nth, side, place) as first from n where name <> '')
        select doc, ord, name, case when json_type(e) = 'OBJECT' then e->>'$.smiles' end as smiles, case when nth = 1000000 then e->>'$.formula' end as formula, role, source from k
        where first = 1 and not exists (select 1 from items i where i.doc = k.doc and i.ord = 4 and lower(i.name) = lower(k.name))""",
    ),
    "merge_results_tables": (merge_results_tables, f"{_R} select doc, ord, page, source, (j->'$.table_data')::varchar as data, coalesce(json_array_length(j->'$.table_columns'), 0)::int as n_columns from r where json_array_length(j->'$.table_data') > 0"),
    "merge_results_figures": (merge_results_figures, f"{_R} select doc, ord, page, case when of_page then 'vision_analysis' else coalesce(j->>'$.figure_type', 'unknown') end as type, case when not of_page then source end as source, coalesce(j->>'$.description', '') as description, '' as notes from r"),
    "merge_results_scaffolds": (merge_results_scaffolds, f"{_R} select doc, arg_min(j->>'$.scaffold_smiles', ord) as scaffold from r where not of_page and j->>'$.scaffold_smiles' is not null group by doc"),
    "merge_pages": (
        merge_pages,
        f"""{_P} select j.doc, coalesce(any_value(reactants), '') as reactants, coalesce(any_value(products), '') as products, coalesce(any_value(catalysts), '') as catalysts, coalesce(any_value(yields), '') as yields,
        concat_ws(';', 'k0=' || any_value(k0)::varchar, 'k1=' || any_value(k1)::varchar) as conditions, arg_min(j->>'$.reactionType', ord) filter (j->>'$.reactionType' is not null) as reaction_type,
        coalesce(string_agg(page || ':' || case ord % 4 when 0 then 'img' || ord else 'd' || ord || 'page' end, ';' order by ord) filter (ord % 4 < 2), '') as images, coalesce(string_agg(page::varchar, ',' order by ord) filter (ord % 4 <> 3), '') as pages,
        (2 * count(*) filter (ord % 4 = 1))::int as n_reaction_schemes, (count(*) filter (ord % 4 = 2))::int as n_compounds,
        coalesce(string_agg(page || ':{{"y":1}};' || page || ':{{"values":[2]}}', ';' order by ord) filter (ord % 4 = 2), '') as table_data
        from j left join l using (doc) left join c using (doc) group by j.doc""",
    ),
    "rgroup_patch": (
        rgroup_patch,
        f"""{_I}, e as (select doc, name, 'F' || arg_min(partner, ord) as f, bool_or(ord % 2 = 0) as h from items where ord >= 2 group by all),
        x as (select i.*, e.f, coalesce(e.h, false) as h, i.ord % 7 <> 0 as has, i.ord % 7 <> 0 and i.name = 'part 7' as p, i.ord % 3 = 0 as given, case when i.doc % 2 = 0 then 'L' end as label from items i left join e on e.doc = i.doc and e.name = i.name),
        y as (select *, case when ord % 5 = 0 then 'G' || ord when (given or (has and f is not null)) and (f is not null or p) then 'C' || coalesce(f, '[*:1]') || '(O' || case when h then '' else '[*:2]' end || ')' || case when p then 'I' else '[*:3]' end end as new from x),
        z as (select *, new is not null and (smiles = '' or f is not null) as one, new is not null and label is not null as two from y)
        select doc, ord, case when has then name || '=' || case when one then new else smiles end || ';L=' || case when two then new else 'Cl' end when new is null then '' else coalesce(label, 'scaffold') || ' (' || case when given then name else coalesce(label, 'scaffold') end || ')=' || new end as reactants,
        (case when has then one::int + two::int else (new is not null)::int end)::int as n_assembled, new is not null as assembled_from_rgroup from z""",
    ),
}
