"""Queries of rule cascades and name resolution, with a rule pack for part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import parsing as ps
from scholia.operators import retrieval as rt
from scholia.operators import rules as r
from scholia.plans import ligand_pack as lp
from scholia.plans.bindings import table

#: (pattern, class, confidence)
RULES = ((r"(?i)small.*bolt", "fastener", 5), (r"(?i)gizmo|widget", "gadget", 3), (r"(?i)^(red|blue)", "coloured", 4), (r"(?i)plate|anvil", "metal", 2), (r"(?i)ring", "ring", 3))
CODES = ("gear", "bolt", "ring")
DICTIONARY = (("economy", "basic"), ("standard", "basic"), ("promo", "offer"), ("gizmo", "gadget"), ("anvil", "metal"))


def _parts(spark, d):
    return table(spark, d, "part")


def _dictionary(spark):
    return spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(DICTIONARY)], "ord long, key string, cls string")


def cls_first_rule(spark, d):
    m = r.first_rule(F.col("p_name"), RULES)
    return _parts(spark, d).select("p_partkey", m["cls"].alias("cls"), m["term"].alias("term"), m["confidence"].alias("confidence"))


def cls_best_rule(spark, d):
    m = r.best_rule(F.col("p_name"), RULES)
    return _parts(spark, d).select("p_partkey", m["cls"].alias("cls"), m["confidence"].alias("confidence"))


def cls_canonical(spark, d):
    return _parts(spark, d).select("p_partkey", r.canonical(F.col("p_name"), CODES).alias("code"))


def abbrev_decompose(spark, d):
    p = _parts(spark, d).select("p_partkey", F.concat("p_name", F.lit(" (gizmo) "), "p_type").alias("text"))
    return r.decompose(p, "p_partkey", "text", _dictionary(spark))


def cls_primary(spark, d):
    """Part names alone, with a bracket, as the hint of a code, and before a second segment."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat("p_name", F.lit(" ["), "p_type", F.lit("]"))).when(k == 1, F.concat(F.lit("L1 ("), "p_name", F.lit(")"))).when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("x; "), "p_name", F.lit("; the gear")))
    out = r.classify(_parts(spark, d).select("p_partkey", text.alias("text")), "p_partkey", "text", _dictionary(spark), ("gear",), RULES)
    return out.withColumn("all_classes", F.array_join("all_classes", ","))


#: Ligand texts of many shapes; a part's key and name choose among them.
LIGANDS = (
    "4,4'-di-tert-butyl-2,2'-bipyridine [dtbbpy]", "L3 (box ligand)", "1,10-phenanthroline for X; bis(oxazoline) [Pent(3,3)-Bis(IndOx)]", "L2 (amine/bis(oxazoline), other)",
    "2-(4,5-dihydrooxazol-2-yl)pyridine (PyOx), with base", "specific BiIM ligand", "[new-lig]", "water", "a bipyridine [new-lig]", "named ligand [nl1]", "x [nl1-Me]", "DMAP", "no ligand", "pyridine pybox ligand",
)


def _ligand_texts(spark, d):
    p = _parts(spark, d)
    first, second = [F.element_at(F.array(*map(F.lit, LIGANDS)), (F.pmod(F.xxhash64("p_partkey", F.lit(i)), F.lit(len(LIGANDS))) + 1).cast("int")) for i in (0, 1)]
    return p.select(F.col("p_partkey").cast("long").alias("ord"), F.when(F.col("p_size") > 25, first).otherwise(F.concat(first, F.lit("; "), second)).alias("text"))


def _ligand_names(spark):
    return spark.createDataFrame([("named ligand", "PyCam")], "name string, cls string")


def cls_primary_pack(spark, d):
    """The cascade with the ligand pack, after what the first half of the texts has taught."""
    t = _ligand_texts(spark, d)
    _, segments = lp.learn(t.where("ord % 2 = 0"), _ligand_names(spark))
    out = lp.classify(t, "ord", "text", segments)
    return out.withColumn("all_classes", F.array_join("all_classes", ","))


def dict_learn_references(spark, d):
    """The dictionary and the segments that all texts teach."""
    words, segments = lp.learn(_ligand_texts(spark, d), _ligand_names(spark))
    return words.select(F.lit("word").alias("kind"), F.col("key").alias("term"), "cls").union(segments.select(F.lit("segment"), "segment", "cls"))


def dict_learn_layer2(spark, d):
    more = _parts(spark, d).select(F.col("p_partkey").alias("ord"), F.lower("p_type").alias("key"), F.when(F.col("p_size") > 25, "big").otherwise("little").alias("cls"))
    return r.learn_first([_dictionary(spark), more], ["basic", "offer", "gadget", "metal", "big", "little"])


def dict_learn_layer3(spark, d):
    p = _parts(spark, d).select(F.col("p_partkey").cast("long").alias("ord"), F.lower("p_brand").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return r.learn_from_rows(p, _dictionary(spark), RULES[1:2])


def cls_fastpath(spark, d):
    """A part name seen before keeps the class of its first row; others go through the rules."""
    p = _parts(spark, d)
    seen = p.where("p_partkey % 50 = 0").groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("known"))
    m = r.best_rule(F.col("p_name"), RULES)
    return p.join(rt.sized(seen), "p_name", "left").select("p_partkey", F.coalesce("known", m["cls"], F.lit("unknown")).alias("cls"))


def _queries(spark, d):
    """Part names in capitals; a word of a name; a bracket with a piece of a name; a piece of a name alone."""
    p = _parts(spark, d).where("p_partkey % 50 = 0")
    k, word = F.col("p_partkey") % 200, F.element_at(F.split("p_name", " "), 2)
    text = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" "))).when(k == 50, F.concat(word, F.lit(" new"))).when(k == 100, F.concat(F.lit("zz ["), F.upper(F.substring("p_name", 3, 5)), F.lit("] "), word)).otherwise(F.concat(F.substring("p_name", 2, 3), F.lit("()"), F.substring("p_name", 5, 3)))
    return p.select(F.col("p_partkey").alias("qid"), text.alias("text"))


def resolve_name(spark, d):
    names = _parts(spark, d).select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return r.resolve_names(_queries(spark, d), names)


def parse_segment(spark, d):
    """Names with a bracket, a parenthesis, a code, or a comma."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat("p_name", F.lit(", ["), "p_brand", F.lit("] for "), "p_type")).when(k == 1, F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(") used as x"))).when(k == 2, F.concat(F.lit("L1 ("), "p_name", F.lit("), note"))).otherwise(F.concat("p_name", F.lit(" base, "), "p_brand"))
    rows = _parts(spark, d).select("p_partkey", ps.reference(text).alias("r"))
    return rows.select("p_partkey", "r.full_name", "r.abbreviation", "r.explanation")


def parse_clean_segments(spark, d):
    text = F.concat("p_name", F.lit(" (abc) ["), "p_brand", F.lit("] for x; L2 (hint) complex; "))
    rows = _parts(spark, d).select("p_partkey", F.posexplode(ps.clean_segments(text)).alias("pos", "r"))
    return rows.select("p_partkey", "pos", "r.name", "r.bracket", "r.hint")


def cls_bracket(spark, d):
    p = _parts(spark, d).select("p_partkey", F.concat_ws("-", "p_type", F.lit("x")).alias("b"))
    return ps.bracket_class(p, "p_partkey", "b", _dictionary(spark), ("gear",), RULES)


def _class_queries(spark, d):
    p = _parts(spark, d).where("p_partkey % 50 = 0")
    return p.select(F.col("p_partkey").alias("qid"), F.concat("p_name", F.lit(" ["), F.lower("p_type"), F.lit("]")).alias("text"))


def cls_detect(spark, d):
    out = ps.detect_classes(_class_queries(spark, d), _dictionary(spark), CODES, RULES, ())
    return out.select("qid", F.array_join("classes", ",").alias("classes"))


def _members(spark, d):
    return _parts(spark, d).select(F.col("p_partkey").cast("long").alias("ord"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.element_at(F.split("p_name", " "), 2).alias("cls"))


def resolve_reference(spark, d):
    """Names as they are, pieces of names with parentheses (contained without these), and texts that only have a class."""
    names = _parts(spark, d).select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("(a) "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("name"), F.element_at(F.split("p_name", " "), 2).alias("cls"))
    k = F.col("p_partkey") % 200
    text = F.when(k == 0, F.upper("p_name")).when(k == 50, F.lit("??")).when(k == 100, F.concat(F.lit("(A) "), (F.col("p_partkey") - 1).cast("string").substr(1, 1))).otherwise(F.concat(F.col("p_name"), F.lit(" x")))
    q = _parts(spark, d).where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), text.alias("text"), F.element_at(F.split("p_name", " "), 2).alias("cls"))
    return ps.resolve_reference(q.select("qid", "text"), names, q.select("qid", "cls"))


def search_combined(spark, d):
    q = _class_queries(spark, d)
    m = _members(spark, d)
    detected = ps.detect_classes(q, _dictionary(spark), CODES, (), ())
    found = rt.tier_search(q.select("qid", F.element_at(F.split("text", " "), 1).alias("text")), m, k=30).join(m.select("name", "cls"), "name")
    return ps.search_combined(q, detected, m, found, 6)


_BEST = "case " + "".join(
    f"when regexp_matches(p_name, '{p}') then '{c}' " for p, c, _ in sorted(RULES, key=lambda x: -x[2])
)
#: The rules of name resolution over q(qid, q) and part names.
_RESOLVE = """
        n as (select lower(p_name) as n, min(p_partkey) as id from part group by 1),
        b as (select qid, min(id) as id from q join n on contains(n, trim(regexp_extract(q, '\\[([^\\]]+)\\]', 1))) where regexp_matches(q, '\\[[^\\]]+\\]') group by 1),
        tokens as (select qid, q, list_distinct(list_filter(regexp_split_to_array(q, '[\\s,\\-()\\[\\]{}]+'), lambda w: length(w) > 1 and regexp_matches(w, '[a-z]'))) as qt from q),
        t as (select qid, id, len(list_intersect(qt, string_split(n, ' '))) as k, len(qt) as a, len(list_distinct(string_split(n, ' '))) as b from tokens, n),
        s as (select qid, arg_max(id, {'s': k / (a + b - k) + 0.1 * k, 'o': -id}) as id from t where k > 0 and k / (a + b - k) + 0.1 * k >= 0.15 group by 1),
        bare as (select qid, replace(replace(q, '(', ''), ')', '') as q from q),
        plain as (select replace(replace(n, '(', ''), ')', '') as n, id from n),
        c as (select qid, arg_max(id, {'s': least(length(q), length(n)), 'o': -id}) as id from bare join plain on (contains(n, q) and q <> '') or (contains(q, n) and n <> '') group by 1)"""
QUERIES = {
    "cls_first_rule": (
        cls_first_rule,
        "select p_partkey, case " + "".join(f"when regexp_matches(p_name, '{p}') then '{c}' " for p, c, _ in RULES) + "end as cls, case "
        + "".join(f"when regexp_matches(p_name, '{p}') then regexp_extract(p_name, '{p}', 0) " for p, _, _ in RULES) + "end as term, case "
        + "".join(f"when regexp_matches(p_name, '{p}') then {k} " for p, _, k in RULES) + "end as confidence from part",
    ),
    "cls_best_rule": (cls_best_rule, f"select p_partkey, {_BEST} end as cls, case " + "".join(f"when regexp_matches(p_name, '{p}') then {k} " for p, _, k in sorted(RULES, key=lambda x: -x[2])) + "end as confidence from part"),
    "cls_canonical": (cls_canonical, "select p_partkey, case when regexp_matches(p_name, '(?i)(^|[^a-z0-9_])gear($|[^a-z0-9_])') then 'gear' when regexp_matches(p_name, '(?i)(^|[^a-z0-9_])bolt($|[^a-z0-9_])') then 'bolt' when regexp_matches(p_name, '(?i)(^|[^a-z0-9_])ring($|[^a-z0-9_])') then 'ring' end as code from part"),
    "abbrev_decompose": (
        abbrev_decompose,
        "with w as (select p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) as w, unnest(range(9)) as k from part), d as (select unnest(['economy', 'standard', 'promo', 'gizmo', 'anvil']) as w, unnest(['basic', 'basic', 'offer', 'gadget', 'metal']) as cls) select p_partkey, arg_min(cls, k) as cls, arg_min(w, k) as term from w join d using (w) group by 1",
    ),
    "cls_primary": (
        cls_primary,
        f"""with t as (select p_partkey, p_name as n, lower(p_type) as b, p_partkey % 4 as k from part),
        f as (select *, case {"".join(f"when regexp_matches(n, '{p}') then '{c}' " for p, c, _ in RULES)} end as rule, case {"".join(f"when regexp_matches(n, '{p}') then {q} " for p, _, q in RULES)} else 0 end as rc,
          case when b in ('economy', 'standard') then 'basic' when b = 'promo' then 'offer' end as dict, regexp_matches(n, '(?i)\\bgear\\b') as gear from t)
        select p_partkey,
          case k when 0 then coalesce(dict, case when gear then 'gear' end, rule, 'unknown') when 1 then coalesce(rule, 'unknown') when 2 then coalesce(case when gear then 'gear' end, rule, 'unknown') else case when not gear and rc = 5 then rule else 'gear' end end as "primary",
          case k when 0 then case when dict is not null then 'bracket' when gear then 'canonical' when rule is not null then 'scaffold' else 'none' end when 1 then case when rule is not null then 'scaffold' else 'none' end
            when 2 then case when gear then 'canonical' when rule is not null then 'scaffold' else 'none' end else case when not gear and rc = 5 then 'scaffold' else 'canonical' end end as method,
          case k when 0 then case when dict is not null or gear then 5 else rc end when 1 then rc when 2 then case when gear then 5 else rc end else 5 end as confidence,
          case k when 0 then coalesce(dict, case when gear then 'gear' end, rule, '') when 1 then coalesce(rule, '') when 2 then coalesce(case when gear then 'gear' end, rule, '')
            else case when gear or rule is null then 'gear' else rule || ',gear' end end as all_classes from f""",
    ),
    "cls_primary_pack": (cls_primary_pack, None),
    "dict_learn_references": (dict_learn_references, None),
    "dict_learn_layer2": (
        dict_learn_layer2,
        "with d as (select unnest(['economy', 'standard', 'promo', 'gizmo', 'anvil']) as key, unnest(['basic', 'basic', 'offer', 'gadget', 'metal']) as cls) select * from d union all select lower(p_type), arg_min(case when p_size > 25 then 'big' else 'little' end, p_partkey) from part where lower(p_type) not in (select key from d) group by 1",
    ),
    "dict_learn_layer3": (dict_learn_layer3, None),
    "parse_segment": (
        parse_segment,
        """select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_name when 2 then 'L1' else p_name || ' base' end as full_name,
          case p_partkey % 4 when 0 then p_brand when 1 then lower(p_type) else '' end as abbreviation,
          case p_partkey % 4 when 0 then 'for ' || p_type when 1 then 'used as x' when 2 then p_name || '; note' else p_brand end as explanation from part""",
    ),
    "parse_clean_segments": (parse_clean_segments, "select p_partkey, 0 as pos, p_name as name, p_brand as bracket, '' as hint from part union all select p_partkey, 1, 'L2', '', 'hint' from part"),
    "cls_bracket": (cls_bracket, "select p_partkey, case lower(p_type) when 'promo' then 'offer' else 'basic' end as cls, 4 as confidence from part where lower(p_type) in ('economy', 'standard', 'promo')"),
    "cls_detect": (cls_detect, None),
    "resolve_reference": (
        resolve_reference,
        f"""with src as (select case when p_partkey % 3 = 0 then '(a) ' || p_partkey else p_name end as p_name, split_part(p_name, ' ', 2) as cls, p_partkey from part),
        q as (select p_partkey as qid, split_part(p_name, ' ', 2) as cls, lower(case p_partkey % 200 when 0 then upper(p_name) when 50 then '??' when 100 then '(A) ' || ((p_partkey - 1)::varchar)[1:1] else p_name || ' x' end) as q from part where p_partkey % 50 = 0),
        {_RESOLVE.replace("from part group", "from src group").replace("string_split(n, ' ')", "list_filter(string_split(n, ' '), lambda w: regexp_matches(w, '^[a-z]'))")},
        p as (select qid, arg_max(id, {{'s': least(length(q), length(n)), 'l': -length(n), 'o': -id}}) as id from q join n on contains(n, q) or contains(q, n) group by 1),
        f as (select cls, min(p_partkey) as id from src group by 1)
        select q.qid, coalesce(n.id, b.id, s.id, c.id, p.id, f.id) as id, case when n.id is not null then 'exact' when b.id is not null then 'bracket' when s.id is not null then 'tokens'
          when c.id is not null then 'contained' when p.id is not null then 'substring' else 'class' end as strategy
        from q left join n on n.n = q.q left join b using (qid) left join s using (qid) left join c using (qid) left join p using (qid) left join f using (cls) where coalesce(n.id, b.id, s.id, c.id, p.id, f.id) is not null""",
    ),
    "search_combined": (search_combined, None),
    "cls_fastpath": (cls_fastpath, f"with s as (select p_name, arg_min(p_type, p_partkey) as known from part where p_partkey % 50 = 0 group by 1) select p_partkey, coalesce(known, {_BEST} end, 'unknown') as cls from part left join s using (p_name)"),
    "resolve_name": (
        resolve_name,
        f"""with q as (select p_partkey as qid, lower(trim(case p_partkey % 200 when 0 then upper(p_name) || ' ' when 50 then split_part(p_name, ' ', 2) || ' new'
            when 100 then 'zz [' || upper(p_name[3:7]) || '] ' || split_part(p_name, ' ', 2) else p_name[2:4] || '()' || p_name[5:7] end)) as q from part where p_partkey % 50 = 0),
        {_RESOLVE}
        select q.qid, coalesce(n.id, b.id, s.id, c.id) as id, case when n.id is not null then 'exact' when b.id is not null then 'bracket' when s.id is not null then 'tokens' else 'contained' end as strategy
        from q left join n on n.n = q.q left join b using (qid) left join s using (qid) left join c using (qid) where coalesce(n.id, b.id, s.id, c.id) is not null""",
    ),
}
