"""Queries of keyword retrieval and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.operators import retrieval as r
from scholia.plans.bindings import compounds, papers, search_queries, table, with_views

W = r"[\p{L}\p{N}_]+"


def _sql_words(source: str, key: str, text: str, longer: int, pos: bool = False) -> str:
    """DuckDB: one row a word of text longer than so many characters, with its place."""
    words = f"list_filter(regexp_extract_all(lower({text}), '{W}'), lambda w: length(w) > {longer})"
    place = ", unnest(range(len(ws))) as pos" if pos else ""
    return f"(select {key}, unnest(ws) as word{place} from (select {key}, {words} as ws from {source}))"


def _scores(doc_fields: str, longer: int) -> str:
    return f"""
      qw as (select qid, word, count(*) as qtf, min(pos) as qpos from {_sql_words("queries", "qid", "text", longer, True)} group by all),
      tf as (select ord, word, count(*) as tf from {_sql_words("papers", "ord", doc_fields, longer)} group by all),
      s as (select qid, ord, sum(qtf * tf)::bigint as score, min(qpos) as qpos from qw join tf using (word) group by all)"""


def kw_search_papers(spark, d):
    return r.search(search_queries(spark, d), papers(spark, d), ["title", "body", "type", "journal"])


def kw_search_reactions(spark, d):
    return r.search(search_queries(spark, d), papers(spark, d), ["body", "journal"], longer_than=2, k=5)


def kw_search_literature(spark, d):
    p = papers(spark, d)
    return r.search_literature(search_queries(spark, d), p, ["title", "body", "journal"], ["title", "body", "journal"], "title")


def _names_as_queries(spark, d):
    """Supplier numbers and part-name words as short queries: a word of every fortieth part's name."""
    p = table(spark, d, "part").where("p_partkey % 50 = 0")
    return p.select(F.col("p_partkey").alias("qid"), F.element_at(F.split("p_name", " "), 1).alias("text"))


_NAME_QUERIES = "queries as (select p_partkey as qid, split_part(p_name, ' ', 1) as text from part where p_partkey % 50 = 0)"


def search_name_substring(spark, d):
    return r.search_substring(_names_as_queries(spark, d), compounds(spark, d), 10)


def tier_search_ligands(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("cls"))
    return r.tier_search(_names_as_queries(spark, d), rows, k=8)


def topk_per_query(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("ord"), F.col("value").alias("score"))
    return r.top_k(e, 3, [F.desc("score"), F.col("ord")]).select("qid", "ord", "rank")


def rag_format_context(spark, d):
    q, p = search_queries(spark, d), papers(spark, d)
    return r.context(q, r.search(q, p, ["title", "body", "type", "journal"]), p)


INTENTS = {"compound": ("the", "tion", "of"), "paper": ("und", "ein", "und"), "reaction": ("que", "de la", "es")}


def rag_retrieve(spark, d):
    """All that a context needs: compounds, papers, entries, named types, whether general information is asked for.
    Types are the journals' names and the first words of titles."""
    p = papers(spark, d)
    types = p.groupBy(F.lower(F.element_at(F.split("title", " "), 1)).alias("name")).agg(F.min("ord").alias("id"))
    info = tx.keyword_share(F.col("text"), INTENTS)[2] > 0.1
    return r.retrieve(search_queries(spark, d), compounds(spark, d), p, ["title", "body", "type", "journal"], p, ["body", "journal"], types, info)


def rag_full_context(spark, d):
    """The context of all five sections for what rag_retrieve finds."""
    p = papers(spark, d)
    c = compounds(spark, d)
    col, none = F.col, F.lit("")
    entry = {"name": col("title"), "e_major": col("journal"), "e_type": col("type"), "e_lvg": F.when(col("id") % 2 == 0, col("journal")).otherwise("None"), "nu_major": none, "nu_type": none, "nu_lvg": none, "base": col("type"), "base_class": F.lit("None"), "r1": F.lit("C1"), "r2": F.lit("None")}
    of_id = p.select(F.col("ord").cast("long").alias("id"), "title", "body", "type", "journal")
    types = p.groupBy(F.lower(F.element_at(F.split("title", " "), 1)).alias("name")).agg(F.min("ord").cast("long").alias("id"))
    parts = [
        ("entry", "Specific Reactions from Database:", of_id, r.entry_block(entry, col("rank") <= 3)),
        ("compound", "Relevant Compounds from Database:", c.select(col("id").cast("long").alias("id"), "name", "category"), r.lines(F.format_string("- **%s** (%s)", "name", "category"), ("Leaving Group", none), ("Type", col("category")))),
        ("paper", "Relevant Publications from Database:", of_id, r.lines(F.format_string("- **%s**", "title"), ("DOI", col("id").cast("string")), ("Journal", col("journal")), ("Abstract", tx.preview(col("body"), 300)))),
        ("type", "Mentioned Reaction Types:", types, F.format_string("- %s", "name")),
    ]
    return r.full_context(search_queries(spark, d), rag_retrieve(spark, d), parts, "General information.")


def prompt_messages(spark, d):
    return r.prompt_messages(table(spark, d, "conversations"), "You answer from the records.").select("conv_id", F.to_json("messages").alias("messages"))


def sim_trigger(spark, d):
    p = papers(spark, d)
    return p.select("id", F.lower("body").rlike("|".join(("ti", "an that", "de la"))).alias("triggered"))


def query_intent(spark, d):
    p = papers(spark, d)
    return p.select("id", *[F.round(c, 6).alias(n) for c, n in zip(tx.keyword_share(F.col("body"), INTENTS), ("compound_share", "paper_share", "reaction_share"), strict=True)])


def topic_route(spark, d):
    topics = [("german", ("ung ",)), ("french", ("eaux",)), ("spanish", ("ción",))]
    return papers(spark, d).select("id", tx.first_contained(F.col("body"), topics, "default").alias("topic"))


_PAPER_SEARCH = with_views("papers", "queries") + ", " + _scores("concat_ws(' ', title, body, type, journal)", 3)
_RANKED = "r as (select *, row_number() over (partition by qid order by score desc, qpos, ord) as rank from s)"

QUERIES = {
    "kw_search_papers": (kw_search_papers, f"{_PAPER_SEARCH}, {_RANKED} select qid, ord, score, rank from r where rank <= 10"),
    "kw_search_reactions": (kw_search_reactions, with_views("papers", "queries") + ", " + _scores("concat_ws(' ', body, journal)", 2) + f", {_RANKED} select qid, ord, score, rank from r where rank <= 5"),
    "kw_search_literature": (
        kw_search_literature,
        with_views("papers", "queries") + ", " + _scores("concat_ws(' ', title, body, journal)", 2) + """,
        c as (select qid, ord, 5 * (contains(lower(title), lower(q.text))::int + contains(lower(body), lower(q.text))::int + contains(lower(journal), lower(q.text))::int) as score
          from papers p, queries q where q.text <> ''),
        u as (select qid, ord, sum(score)::bigint as score from (select qid, ord, score from s union all select * from c where score > 0) group by all),
        r as (select u.*, row_number() over (partition by qid order by score desc, ord) as rank from u join papers using (ord) where trim(title) <> '')
        select qid, ord, score, rank from r where rank <= 10""",
    ),
    "search_name_substring": (
        search_name_substring,
        with_views("compounds") + f""", {_NAME_QUERIES},
        f as (select lower(name) as low, min(ord) as name_ord from compounds group by 1),
        r as (select qid, id, name, row_number() over (partition by qid order by name_ord, ord) as rank
          from f join queries q on contains(low, lower(q.text)) join compounds c on lower(c.name) = low)
        select * from r where rank <= 10""",
    ),
    "tier_search_ligands": (
        tier_search_ligands,
        f"""with rows as (select p_partkey as ord, p_name as name, p_brand as cls, lower(p_name) as low from part), {_NAME_QUERIES},
        q as (select qid, lower(trim(text)) as q from queries where trim(text) <> ''),
        t as (
          select qid, ord, 100 as score, 1 as tier from rows join q on low = q.q
          union all select qid, ord, 50, 2 from rows join q on contains(low, q.q) or contains(q.q, low)
          union all select qid, ord, 40, 3 from rows join (select qid, unnest(regexp_extract_all(q, '{W}')) as w from q) on w = lower(cls)
          union all select qid, ord, 10, 4 from (select ord, unnest(list_distinct(regexp_extract_all(low, '[a-z]{{2,}}'))) as w from rows)
            join (select qid, unnest(list_distinct(regexp_extract_all(q, '[a-z]{{2,}}'))) as w from q) using (w)),
        b as (select qid, ord, arg_min(score, tier) as score, min(tier) as tier from t group by all),
        r as (select qid, name, score, row_number() over (partition by qid order by score desc, tier, ord) as rank from b join rows using (ord))
        select * from r where rank <= 8""",
    ),
    "topk_per_query": (topk_per_query, "with r as (select user_id as qid, event_id as ord, row_number() over (partition by user_id order by value desc, event_id) as rank from events) select * from r where rank <= 3"),
    "rag_format_context": (
        rag_format_context,
        f"""{_PAPER_SEARCH}, {_RANKED},
        b as (select qid, string_agg(rank || '. ' || title || ' (' || journal || ')' || chr(10) || case when length(body) > 200 then body[1:200] || '...' else body end, chr(10) || chr(10) order by rank) as t
          from r join papers using (ord) where rank <= 3 group by qid)
        select qid, coalesce('### Papers' || chr(10) || t, 'No matching records.') as context from queries left join b using (qid)""",
    ),
    "rag_retrieve": (
        rag_retrieve,
        f"""{_PAPER_SEARCH}, {_RANKED},
        compounds as (select p_partkey as id, lower(p_name) as low from part),
        n as (select low, min(id) as id from compounds group by 1),
        w as (select qid, word, min(pos) as pos from {_sql_words("queries", "qid", "text", 3, True)} group by all
          union all select qid, lower(text), 2147483647 from queries where text <> ''),
        h as (select qid, pos, id, row_number() over (partition by qid, pos order by id) as k from n join w on contains(low, word)),
        g as (select qid, id, min(pos) as pos from h where k <= 2 or pos = 2147483647 group by all),
        c as (select qid, 'compound' as kind, id, row_number() over (partition by qid order by pos, id) as rank from g),
        ty as (select lower(split_part(title, ' ', 1)) as name, min(ord) as id from papers group by 1),
        m as (select qid, 'type' as kind, id, row_number() over (partition by qid order by id) as rank from queries join ty on name <> '' and contains(lower(text), name)),
        k as (select qid, contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int + contains(lower(text), 'of')::int as a,
          contains(lower(text), 'und')::int * 2 + contains(lower(text), 'ein')::int as b,
          contains(lower(text), 'que')::int + contains(lower(text), 'de la')::int + contains(lower(text), 'es')::int as c from queries),
        qw2 as (select qid, word, count(*) as qtf, min(pos) as qpos from {_sql_words("queries", "qid", "text", 2, True)} group by all),
        tf2 as (select ord, word, count(*) as tf from {_sql_words("papers", "ord", "concat_ws(' ', body, journal)", 2)} group by all),
        s2 as (select qid, ord, sum(qtf * tf)::bigint as score, min(qpos) as qpos from qw2 join tf2 using (word) group by all),
        r2 as (select *, row_number() over (partition by qid order by score desc, qpos, ord) as rank from s2)
        select qid, kind, id::bigint as id, rank::int as rank from (select * from c where rank <= 5 union all select * from m
          union all select qid, 'paper', ord, rank from r where rank <= 5 union all select qid, 'entry', ord, rank from r2 where rank <= 5)
        union all select qid, 'info', null, 1 from k where c / greatest(a + b + c, 1) > 0.1""",
    ),
    "prompt_messages": (
        prompt_messages,
        """select conv_id, '[{"role":"system","content":"You answer from the records."},' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' order by turn) || ']' as messages
        from conversations where role in ('user', 'assistant') group by 1""",
    ),
    "sim_trigger": (sim_trigger, "select doc_id as id, regexp_matches(lower(text), 'ti|an that|de la') as triggered from documents"),
    "query_intent": (
        query_intent,
        """with c as (select doc_id as id,
          contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int + contains(lower(text), 'of')::int as a,
          contains(lower(text), 'und')::int * 2 + contains(lower(text), 'ein')::int as b,
          contains(lower(text), 'que')::int + contains(lower(text), 'de la')::int + contains(lower(text), 'es')::int as c from documents)
        select id, round(a / greatest(a + b + c, 1), 6) as compound_share, round(b / greatest(a + b + c, 1), 6) as paper_share, round(c / greatest(a + b + c, 1), 6) as reaction_share from c""",
    ),
    "topic_route": (topic_route, "select doc_id as id, case when contains(lower(text), 'ung ') then 'german' when contains(lower(text), 'eaux') then 'french' when contains(lower(text), 'ción') then 'spanish' else 'default' end as topic from documents"),
}

QUERIES["rag_full_context"] = (
    rag_full_context,
    with_views("papers", "queries", "compounds") + f""", found as ({QUERIES["rag_retrieve"][1]}),
    ty as (select lower(split_part(title, ' ', 1)) as name, min(ord) as id from papers group by 1),
    b as (
      select qid, 0 as section, 1 as rank, 'General information.' as block from found where kind = 'info'
      union all select qid, 1, rank, '- **' || title || '**' || case when journal <> '' then ' | Electrophile: ' || journal else '' end || case when type <> '' then ' (' || type || ')' else '' end
        || case when ord % 2 = 0 and journal not in ('', 'None') then ', LVG: ' || journal else '' end || case when type not in ('', 'None') then ' | Base: ' || type else '' end
        || case when rank <= 3 then chr(10) || '  - Electrophile SMILES: `C1`' else '' end from found join papers on kind = 'entry' and papers.ord = found.id where rank <= 5
      union all select qid, 2, rank, '- **' || name || '** (' || category || ')' || chr(10) || '  - Type: ' || category from found join compounds c on kind = 'compound' and c.id = found.id where rank <= 5
      union all select qid, 3, rank, '- **' || title || '**' || chr(10) || '  - DOI: ' || ord || case when journal <> '' then chr(10) || '  - Journal: ' || journal else '' end
        || chr(10) || '  - Abstract: ' || case when length(body) > 300 then body[1:300] || '...' else body end from found join papers on kind = 'paper' and papers.ord = found.id where rank <= 5
      union all select qid, 4, rank, '- ' || name from found join ty on kind = 'type' and ty.id = found.id where rank <= 5),
    s as (select qid, section, case section when 0 then '' when 1 then chr(10) || '### Specific Reactions from Database:' || chr(10) when 2 then chr(10) || '### Relevant Compounds from Database:' || chr(10)
        when 3 then chr(10) || '### Relevant Publications from Database:' || chr(10) else chr(10) || '### Mentioned Reaction Types:' || chr(10) end || string_agg(block, chr(10) order by rank) as t from b group by qid, section),
    w as (select qid, string_agg(t, chr(10) order by section) as t from s group by 1)
    select qid, coalesce(t, '') as context from queries left join w using (qid)""",
)
