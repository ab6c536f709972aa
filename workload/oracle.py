"""The same results in plain SQL over the given tables, for comparison.

A query is a chain of named parts; ``ORACLES`` holds the complete statements.
"""

from __future__ import annotations

import re

from lexifold.functions import answers, versions
from lexifold.functions.text import STOPWORDS
from workload.views import (
    DOCUMENTS_SQL,
    FAULTY_FILE_SQL,
    LABEL_SPELLINGS_SQL,
    OWN_DAY_SQL,
    REQUESTS_SQL,
    VALID_FILE_SQL,
)

AS_OF_SQL = "date '2025-06-01'"
BLANKS = r"'^\s+|\s+$'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {BLANKS}, '', 'g')"


def normalized(x: str) -> str:
    return (
        rf"trim(regexp_replace(strip_accents(replace(lower(translate({x}, 'Iİ', 'ıi')), 'ı', 'i')), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
    )


def terms_of(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return (
        rf"list_transform(list_filter(string_split({normalized(x)}, ' '), lambda w: (length(w) > 1 and w not in ({stop})) "
        rf"or regexp_full_match(w, '\p{{Nd}}')), lambda w: substr(w, 1, 5))"
    )


def label_of(x: str) -> str:
    bare = trimmed(rf"regexp_replace({trimmed(x)}, '^[\[\]()]+|[\[\]()]+$', '', 'g')")
    return rf"case when regexp_full_match({bare}, '\p{{Nd}}+') then 'C' || {bare} else upper({bare}) end"


def cleaned(answer: str, quotes: str) -> str:
    """``quotes``: list of cited quotes."""
    unquoted = (
        f"list_reduce(list_concat([{answer}], list_filter({quotes}, lambda q: q <> '')), "
        "lambda a, q: replace(replace(a, '\"' || q || '\"', ''), '“' || q || '”', ''))"
    )
    marker = r"\s*(\[\s*C\d+[^\]]*\]|\(\s*C\d+(\s*,\s*C\d+)*\s*\))"
    return trimmed(rf"regexp_replace(regexp_replace({unquoted}, '{marker}', '', 'g'), '[ \t]{{2,}}', ' ', 'g')")


def verbatim(quote: str, source: str) -> str:
    fragments = (
        rf"list_filter(list_transform(regexp_split_to_array({quote}, '\.\.\.|…'), lambda f: {normalized('f')}), lambda f: f <> '')"
    )
    return f"(len({fragments}) > 0 and len(list_filter({fragments}, lambda f: not contains({normalized(source)}, f))) = 0)"


def authority(x: str) -> str:
    return f"case when {x} in ('politika', 'prosedur') then 0 when {x} = 'kilavuz' then 1 else 2 end"


PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def chunk_parts(source: str, prefix: str) -> None:
    """Sections and chunks of the bodies in ``source`` (source_id, title, body)."""
    part(f"{prefix}_lines", f"""
select source_id, title, unnest(string_split(body, chr(10))) as line,
  generate_subscripts(string_split(body, chr(10)), 1) as p from {source}""")
    part(f"{prefix}_marked", rf"""
select *, case when regexp_matches(line, '^#{{1,6}}\s.') then length(regexp_extract(line, '^(#{{1,6}})', 1)) else 0 end as lvl,
  trim(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2)) as h from {prefix}_lines""")
    positions = ", ".join(f"max(case when lvl = {k} then p end) over w as p{k}" for k in range(1, 7))
    texts = ", ".join(f"last_value(case when lvl = {k} then h end ignore nulls) over w as h{k}" for k in range(2, 7))
    part(f"{prefix}_state", f"""
select source_id, title, line, p, lvl, h, sum(case when lvl > 0 then 1 else 0 end) over w as sec, {positions}, {texts}
from {prefix}_marked
window w as (partition by source_id order by p rows between unbounded preceding and current row)""")
    alive = ", ".join(
        f"case when p{k} > greatest(0, " + ", ".join(f"coalesce(p{j}, 0)" for j in range(1, k)) + f") then h{k} end"
        for k in range(2, 7)
    )
    part(f"{prefix}_paths", f"""
select *, list_filter([{alive}], lambda x: x is not null) as above from {prefix}_state""")
    part(f"{prefix}_all_sections", f"""
select source_id, sec, max(lvl) as level, max(case when lvl > 0 then h end) as heading,
  first(case when len(above) > 0 then array_to_string(above, ' > ') else title end order by p desc) as section_path,
  {trimmed("coalesce(string_agg(case when lvl = 0 then line end, chr(10) order by p), '')")} as content
from {prefix}_paths group by source_id, sec""")
    part(f"{prefix}_sections", f"select * from {prefix}_all_sections where content <> ''")
    part(f"{prefix}_packed", rf"""
select source_id, sec, section_path, case when length(content) <= 1200 then [content] else
  list_reduce(list_transform(list_filter(list_transform(regexp_split_to_array(content, '\n[ \t]*\n'),
      lambda x: {trimmed('x')}), lambda x: x <> ''), lambda x: [x]),
    lambda a, b: case when length(a[-1]) + 2 + length(b[1]) <= 1200
      then list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || b[1]]) else list_concat(a, b) end) end as parts
from {prefix}_sections""")
    part(f"{prefix}_chunks", f"""
select source_id, row_number() over (partition by source_id order by sec, part) - 1 as chunk_order, section_path, content from (
  select source_id, sec, section_path, unnest(parts) as content, generate_subscripts(parts, 1) as part from {prefix}_packed)""")


part("kb_documents", DOCUMENTS_SQL)
part("kb_markdown", """
select * exclude (text), array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  case when (i - 1) % 8 = 0 then '## Bölüm ' || (i - 1) || chr(10) when (i - 1) % 8 = 4 then '### Alt ' || (i - 1) || ' ##' || chr(10)
       else '' end || x || chr(10)), chr(10)) as body
from kb_documents""")
chunk_parts("kb_markdown", "kb")

part("kb_valid", f"select *, {VALID_FILE_SQL} as valid_text from kb_markdown")
part("kb_faulty", f"select file_name, {FAULTY_FILE_SQL} as text from kb_valid")
part("canonical", "select file_name, replace(text, chr(13) || chr(10), chr(10)) as c from kb_faulty")
part("split", """
select file_name, c, ends > 0 as closed, case when ends > 0 then substr(c, 5, ends - 2) end as header,
  case when ends > 0 then substr(c, ends + 8) end as body
from (select *, case when starts_with(c, '---' || chr(10)) then instr(substr(c, 4), chr(10) || '---' || chr(10)) end as ends from canonical)""")


def field(key: str) -> str:
    raw = rf"trim(regexp_extract(header, '(?m)^{key}: ?(.*)$', 1))"
    plain = rf"regexp_replace({raw}, ' #.*$', '')"
    unquoted = rf"""regexp_replace({plain}, '^["''](.*)["'']$', '\1')"""
    return f"nullif(trim({unquoted}), '')"


part("fields", "select file_name, closed, body, " + ", ".join(
    f"{field(key)} as {name}" for key, name in (
        ("id", "source_id"), ("documentKey", "document_key"), ("title", "title"), ("version", "version"),
        ("effectiveDate", "raw_date"), ("status", "status"), ("supersedes", "supersedes"), ("category", "category"))
) + " from split")
part("validated_files", rf"""
select file_name, source_id, document_key, title, version, try_cast(raw_date as date) as effective_date, status, category, supersedes,
  case when closed is null then 'front_matter_missing' when not closed then 'front_matter_unclosed'
    when regexp_matches(header, '(?m)^(id|documentKey|title|version|effectiveDate|status|supersedes|category): [|>&*!\[{{]') then 'front_matter_unreadable'
    when title is null then 'field_missing:title'
    when len(list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '' and not regexp_matches(l, '^#{{1,6}}\s.'))) = 0 then 'section_missing'
    when source_id is null then 'field_missing:id' when document_key is null then 'field_missing:documentKey'
    when version is null then 'field_missing:version' when raw_date is null then 'field_missing:effectiveDate'
    when not regexp_full_match(raw_date, '\d{{4}}-\d{{2}}-\d{{2}}') or try_cast(raw_date as date) is null then 'date_invalid'
    when status is null then 'field_missing:status' when status not in ('active', 'superseded') then 'status_unknown'
    when category is null then 'field_missing:category'
    when category not in ('politika', 'prosedur', 'kilavuz', 'sss') then 'category_unknown' end as error
from (select fields.*, split.header from fields join split using (file_name))""")

# --- stored state --------------------------------------------------------------------------------

part("file_hashes", "select doc_id, source_id, file_name, upper(sha256(valid_text)) as content_hash from kb_valid")
part("reconciled", """
select case when toxic = 1 then upper(source_id) else source_id end as source_id, file_name,
  case when quality is null then 'added' when quality = 0 and reverse(content_hash) <> content_hash then 'updated' else 'unchanged' end as action,
  content_hash
from file_hashes left join labels using (doc_id)
union all select 'old-' || item_id, 'old-' || item_id || '.md', 'removed', 'old' from benchmark""")
part("changed_bodies", """
select v.source_id, v.title, v.body || chr(10) || 'Son not.' || chr(10) as body
from kb_valid v join reconciled r using (file_name) where r.action in ('added', 'updated')""")
chunk_parts("changed_bodies", "new")
part("noted_bodies", "select source_id, title, body || chr(10) || 'Son not.' || chr(10) as body from kb_valid")
chunk_parts("noted_bodies", "noted")

# --- index ---------------------------------------------------------------------------------------

part("n_vectors", "select count(*) as n from embeddings")
part("kb_vectors", f"""
select c.*, e.vec_id, e.embedding::double[] as embedding
from kb_chunks c cross join n_vectors join embeddings e
  on e.vec_id = (cast(substr(c.source_id, 5) as bigint) * 31 + c.chunk_order * 7) % n""")
part("chunk_terms", f"""
select source_id, chunk_order, {terms_of("d.title || ' ' || c.section_path || ' ' || c.content")} as terms
from kb_chunks c join kb_documents d using (source_id)""")
part("postings", """
select source_id, chunk_order, dl, term, count(*) as tf
from (select source_id, chunk_order, len(terms) as dl, unnest(terms) as term from chunk_terms) group by all""")
part("document_frequency", "select term, count(*) as df from postings group by term")
part("corpus", "select count(*) as n, greatest(1.0, sum(len(terms)) / count(*)) as avgdl, sum(len(terms)) as total from chunk_terms")
part("query_terms", f"""
select distinct query_id, term from (select item_id as query_id, unnest({terms_of('text')}) as term from benchmark)""")
part("weighted", """
select query_id, term, coalesce(df, 0) as df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) as idf
from query_terms left join document_frequency using (term) cross join corpus""")
part("totals", "select query_id, sum(idf) as total_idf from weighted group by query_id")
part("scored", """
select query_id, source_id, chunk_order, count(*) as matched_terms,
  round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 8) as score,
  round(sum(idf) / max(total_idf), 8) as coverage
from postings join weighted using (term) join totals using (query_id) cross join corpus group by query_id, source_id, chunk_order""")
part("query_vectors", """
select item_id as query_id, e.embedding::double[] as vector from benchmark cross join n_vectors join embeddings e on e.vec_id = item_id % n""")
part("dense", """
select query_id, source_id, chunk_order, round(list_cosine_similarity(vector, embedding), 6) as dense_score
from kb_vectors cross join query_vectors""")


def ranking_parts(prefix: str, scored: str, dense: str | None, per: str = "query_id", pool: int = 20) -> None:
    part(f"{prefix}_lexical_pool", f"""
select * from (select *, row_number() over (partition by {per} order by score desc, source_id, chunk_order) as rank from {scored}) where rank <= {pool}""")
    lists = f"select {per}, 0 as list_no, rank, {'' if 'source_id' in per else 'source_id,'} chunk_order from {prefix}_lexical_pool"
    if dense:
        part(f"{prefix}_dense_pool", f"""
select * from (select *, row_number() over (partition by {per} order by dense_score desc, source_id, chunk_order) as rank from {dense}) where rank <= {pool}""")
        lists += f" union all select {per}, 1, rank, {'' if 'source_id' in per else 'source_id,'} chunk_order from {prefix}_dense_pool"
    item = "chunk_order" if "source_id" in per else "source_id, chunk_order"
    part(f"{prefix}_fused", f"""
select *, row_number() over (partition by {per} order by fused_score desc, list_no, first_rank) as rank from (
  select {per}, {item}, sum(1.0::double / (60 + rank)) as fused_score, min(list_no) as list_no, arg_min(rank, list_no) as first_rank
  from ({lists}) group by {per}, {item})""")


ranking_parts("lex", "scored", None)
ranking_parts("hyb", "scored", "dense")
part("allowed", "select source_id from kb_documents where category in ('politika', 'prosedur')")
part("scored_allowed", "select * from scored semi join allowed using (source_id)")
part("dense_allowed", "select * from dense semi join allowed using (source_id)")
ranking_parts("flt", "scored_allowed", "dense_allowed")


def hits_sql(prefix: str, hybrid: bool, limit: int = 6) -> str:
    dense = "d.dense_score" if hybrid else "cast(null as double)"
    join = "left join dense d using (query_id, source_id, chunk_order)" if hybrid else ""
    return f"""
select f.query_id, f.rank, f.source_id, f.chunk_order, k.document_key, k.title, k.version, k.effective_date, k.status, k.category,
  c.section_path, c.content, round(f.fused_score, 12) as fused_score, coalesce(s.score, 0) as lexical_score,
  coalesce(s.coverage, 0) as coverage, {dense} as dense_score
from {prefix}_fused f join kb_chunks c using (source_id, chunk_order) join kb_documents k using (source_id)
  left join scored s using (query_id, source_id, chunk_order) {join}
where f.rank <= {limit}"""


part("lex_hits", hits_sql("lex", False))
part("hyb_hits", hits_sql("hyb", True))
part("flt_hits", hits_sql("flt", True))
part("stats", f"""
select item_id as query_id, 'hybrid' as mode, coalesce(max_dense, 0) as max_dense, coalesce(max_coverage, 0) as max_coverage
from benchmark left join (select query_id as item_id, max(dense_score) as max_dense from dense group by 1) using (item_id)
  left join (select query_id as item_id, max(coverage) as max_coverage from scored group by 1) using (item_id)""")
part("gated", "select query_id, max_dense >= 0.55 or max_coverage >= 0.5 as evidence from stats")

# --- versions ------------------------------------------------------------------------------------

part("version_keys", r"""
select *, case when regexp_full_match(version, '\d+(\.\d+){1,3}') then
  list_resize(list_transform(string_split(version, '.'), lambda x: cast(x as int)), 4, -1) else [0, 0, -1, -1] end as vkey
from kb_documents""")
part("currents", f"""
select document_key, source_id as current_id, version as current_version, effective_date as current_date from (
  select *, row_number() over (partition by document_key order by effective_date desc, vkey desc, file_name) as n
  from version_keys where status <> 'superseded' and effective_date <= {AS_OF_SQL}) where n = 1""")
part("families", """
select document_key, n_versions, current_id, current_version, current_date
from (select document_key, count(*) as n_versions from kb_documents group by 1) left join currents using (document_key)""")
part("candidates", hits_sql("hyb", True, 12))


def reason_sql(as_of: str = AS_OF_SQL) -> str:
    def filled(text: str, *values: str) -> str:
        quoted = text.replace("'", "''")
        for value in values:
            quoted = quoted.replace("%s", f"' || {value} || '", 1)
        return f"'{quoted}'"

    return f"""case when kept then null when effective_date > {as_of} then {filled(versions.REASON_FUTURE, "strftime(effective_date, '%Y-%m-%d')")}
    when current_id is null then {filled(versions.REASON_NO_CURRENT)}
    else {filled(versions.REASON_SUPERSEDED, "current_version", "strftime(current_date, '%Y-%m-%d')")} end"""


part("resolution", f"""
select *, multi_version and current_id is not null and not bool_or(kept) over (partition by query_id, document_key) as needs_substitution,
  {reason_sql()} as reason
from (select c.*, n_versions > 1 as multi_version, current_id, current_version, f.current_date as current_date,
    n_versions = 1 or coalesce(c.source_id = current_id, false) as kept
  from candidates c join families f using (document_key) semi join (select query_id from gated where evidence) g using (query_id))""".replace(
    "f.current_date as current_date", 'f."current_date" as "current_date"').replace("strftime(current_date,", 'strftime("current_date",'))
PARTS["currents"] = PARTS["currents"].replace("as current_date", 'as "current_date"')
PARTS["families"] = PARTS["families"].replace("current_version, current_date", 'current_version, "current_date"')
part("own_days", f"""
select c.*, {OWN_DAY_SQL} as as_of, count(*) over (partition by query_id, source_id, chunk_order) as n from candidates c
  semi join (select query_id from gated where evidence) g using (query_id)""")
part("own_currents", """
select query_id, document_key, source_id as current_id, version as current_version, effective_date as "current_date" from (
  select a.query_id, v.*, row_number() over (partition by a.query_id, document_key order by v.effective_date desc, vkey desc, file_name) as n
  from (select distinct query_id, document_key, as_of from own_days) a join version_keys v using (document_key)
  where v.status <> 'superseded' and v.effective_date <= a.as_of) where n = 1""")
part("own_resolution", f"""
select *, multi_version and current_id is not null and not bool_or(kept) over (partition by query_id, document_key) as needs_substitution,
  {reason_sql("as_of")} as reason
from (select d.*, n_versions > 1 as multi_version, o.current_id, o.current_version, o."current_date" as "current_date",
    n_versions = 1 or coalesce(d.source_id = o.current_id, false) as kept
  from own_days d join families f using (document_key) left join own_currents o using (query_id, document_key))""".replace(
    "strftime(current_date,", 'strftime("current_date",'))
part("needs", """
select query_id, document_key, current_id as source_id, min(rank) as replaced_rank from resolution where needs_substitution group by all""")
part("scored_needs", "select scored.* from scored semi join needs using (query_id, source_id)")
part("dense_needs", "select dense.* from dense semi join needs using (query_id, source_id)")
ranking_parts("sub", "scored_needs", "dense_needs", per="query_id, source_id")
part("placed", """
select query_id, source_id, chunk_order, rank as place, 0 as turn from resolution where kept
union all select query_id, source_id, chunk_order, replaced_rank, rank from sub_fused join needs using (query_id, source_id) where rank <= 2""")
part("context", """
select p.query_id, p.position, 'C' || p.position as label, p.source_id, p.chunk_order, k.document_key, k.title, k.version, k.effective_date, k.status,
  k.category, c.section_path, c.content
from (select *, row_number() over (partition by query_id order by place, turn) as position from placed) p
  join kb_chunks c using (source_id, chunk_order) join kb_documents k using (source_id) where position <= 6""")
part("prompts", f"""
select b.item_id as query_id, '{answers.PROMPT_SOURCES}' || coalesce(string_agg('[' || label || '] ' || title || '{answers.PROMPT_VERSION}' || version ||
  '{answers.PROMPT_EFFECTIVE}' || strftime(effective_date, '%Y-%m-%d') || '{answers.PROMPT_CATEGORY}' || category || chr(10) ||
  '{answers.PROMPT_SECTION}' || section_path || chr(10) || content || chr(10) || chr(10), '' order by position), '') || '{answers.PROMPT_QUESTION}' || any_value(b.text) as prompt
from benchmark b semi join (select query_id as item_id from gated where evidence) g using (item_id) left join context x on x.query_id = b.item_id
group by b.item_id""")
part("report", """
select query_id, 'selected' as kind, document_key, current_id as source_id, k.version, k.effective_date, cast(null as varchar) as reason
from (select distinct query_id, document_key, current_id from resolution where multi_version and current_id is not null) r
  join (select source_id as current_id, version, effective_date from kb_documents) k using (current_id)
union all select distinct query_id, 'discarded', document_key, source_id, version, effective_date, reason from resolution where not kept""")

# --- replies -------------------------------------------------------------------------------------

part("firsts", f"""
select query_id, query_id % 6 as manner, {label_of(LABEL_SPELLINGS_SQL)} as label,
  max(case when position = 1 then content end) as one, max(case when position = 2 then content end) as two
from context group by query_id""")
part("told", """
select query_id, position, label, coalesce(quote, '') as quote from (
  select query_id, 0 as position, label, case manner when 1 then lower(one) when 2 then 'başka ' || one else one end as quote from firsts where manner not in (3, 4)
  union all select query_id, 1, 'C9', one from firsts where manner = 1
  union all select query_id, 0, 'C9', one from firsts where manner = 3
  union all select query_id, 1, 'C2', two from firsts where manner = 5
  union all select query_id, 2, 'C1', one from firsts where manner = 5)""")
part("citations", f"""
select t.query_id, t.position, t.label, t.quote, x.document_key, x.source_id, x.section_path, {verbatim('t.quote', 'x.content')} as quote_verified
from (select query_id, label, {trimmed('quote')} as quote, min(position) as position from told group by 1, 2, 3) t
  join context x using (query_id, label)""")
part("disputes", """
select query_id, 0 as conflict_no, label as chosen, unnest(['C2', 'C1', 'C3', 'C9']) as rejected, unnest([0, 1, 2, 3]) as rejected_no
from firsts where manner in (0, 5)
union all select query_id, 2, 'C2', 'C1', 1 from firsts where manner in (0, 5)""")
part("conflicts", f"""
select d.query_id, d.conflict_no, 'konu' as topic, any_value(a.source_id) as chosen_id,
  string_agg(r.source_id || '/' || r.section_path, ',' order by d.rejected_no) as rejected, 'neden' as reason,
  bool_and(case when {authority('a.category')} <> {authority('r.category')} then {authority('a.category')} < {authority('r.category')}
    else a.effective_date >= r.effective_date end) as rule_satisfied
from disputes d join context a on a.query_id = d.query_id and a.label = d.chosen
  join context r on r.query_id = d.query_id and r.label = d.rejected
where d.rejected <> d.chosen group by d.query_id, d.conflict_no""")
part("cited_quotes", "select query_id, list(quote order by position) as quotes from citations group by query_id")
part("validated", f"""
select query_id, true as valid, refusal_reason = '' as answerable,
  case when refusal_reason = '' then {cleaned("concat('Yanıt [C1, \"x\"]: \"', one, '\"  son (C1, C2).')", "coalesce(quotes, [])")}
    else 'Bu soruyu yanıtlamak için dokümanlarda yeterli bilgi bulunamadı.' end as answer,
  case when manner = 4 then 'eksik bilgi' else '' end as missing_information, refusal_reason
from (select f.*, q.quotes, case when manner = 4 then 'ModelInsufficientContext' when q.quotes is null then 'NoValidCitations' else '' end as refusal_reason
  from firsts f left join cited_quotes q using (query_id))""")
PARTS["validated"] = PARTS["validated"].replace('\\"', '"')

_NAME = re.compile(r"[a-z_][a-z0-9_]*")


part("checked_requests", f"""
select *, case when t = '' then 'query_required' when length(t) > 500 then 'query_too_long' when k not between 1 and 20 then 'top_k_out_of_range' end as code
from (select query_id, coalesce({trimmed('text')}, '') as t, coalesce(top_k, 6) as k from ({REQUESTS_SQL}))""")
part("found_by_requests", f"""
select query_id, count(distinct (source_id, chunk_order)) as n
from (select distinct query_id, unnest({terms_of('t')}) as term from checked_requests where code is null) join postings using (term) group by query_id""")


def statement(sql: str) -> str:
    """Put the parts a query needs before it, each once."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in PARTS and name not in ordered and PARTS[name] != text:
                visit(PARTS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return "with " + ",\n".join(f"{n} as materialized ({PARTS[n]})" for n in ordered) + "\n" + sql if ordered else sql


HIT_COLUMNS = """query_id, rank, source_id, chunk_order, document_key, version, effective_date, status, category, section_path,
  md5(content) as content_md5, fused_score, lexical_score, coverage, dense_score"""
COUNTED = "select source_id, count(*) as section_count from kb_chunks group by 1"

_QUERIES = {
    "s2_front_matter": """select file_name, coalesce(closed, false) as well_delimited, md5(coalesce(header, '')) as header_md5,
  md5(coalesce(body, '')) as body_md5 from split""",
    "s4_validation": "select file_name, source_id, document_key, title, version, effective_date, status, category, supersedes, error from validated_files",
    "s5_content_hash": "select file_name, upper(sha256(c)) as content_hash from canonical",
    "s6_documents_with_chunks": """select source_id, d.title, d.version, chunk_order, section_path, md5(content) as content_md5
from kb_documents d left join kb_chunks using (source_id)""",
    "s6_stored_segments": """select source_id, d.title, d.version, chunk_order, section_path, md5(content) as content_md5
from kb_documents d left join kb_chunks using (source_id)""",
    "s9_index_stats": """select 'postings' as statistic, count(*) as value from postings union all select 'occurrences', cast(sum(tf) as bigint) from postings
union all select 'terms', count(*) from document_frequency union all select 'total_df', cast(sum(df) as bigint) from document_frequency
union all select 'chunks', count(*) from kb_chunks union all select 'documents', count(*) from kb_documents""",
    "p1_query_validation": f"""select query_id, cast(length(t) as bigint) as n_chars, cast(k as bigint) as top_k,
  cast(case when t = '' or length(t) > 500 or k not between 1 and 20 then 400 else 200 end as bigint) as status,
  case when t = '' then 'query_required' when length(t) > 500 then 'query_too_long' when k not between 1 and 20 then 'top_k_out_of_range' end as message_code
from (select query_id, coalesce({trimmed('text')}, '') as t, coalesce(top_k, 6) as k from ({REQUESTS_SQL}))""",
    "p4_pending_embeddings": "select source_id, chunk_order, 'm2' as embedding_model from kb_vectors where vec_id % 50 = 0",
    "p6_evidence_gate": "select query_id, evidence from gated",
    "p7_refusal_reason": "select query_id, answerable, refusal_reason from validated",
    "p9_duplicate_ids": """select arg_min(case when doc_id % 2 = 0 then upper(source) else source end, doc_id) as source_id, count(*) as files
from documents group by upper(source) having count(*) > 1""",
    "t1_normalize": f"select doc_id, length(t) as n_chars, md5(t) as normalized_md5 from (select doc_id, {normalized('text')} as t from documents)",
    "t2_tokens": f"""select doc_id, len(t) as n_terms, md5(array_to_string(t, ' ')) as terms_md5 from (select doc_id, {terms_of('text')} as t from documents)""",
    "t5_embedding_text": """select source_id, chunk_order,
  md5('title: ' || d.title || ' | text: ' || d.title || ' > ' || section_path || chr(10) || content) as text_md5
from kb_chunks join kb_documents d using (source_id)""",
    "t6_unit_vectors": """select vec_id, round(cast(u[1] as double), 5) as first_part, round(cast(list_max(u) as double), 5) as largest,
  round(cast(list_min(u) as double), 5) as smallest
from (select vec_id, case when norm = 0 then v else list_transform(v, lambda x: cast(x / norm as float)) end as u
  from (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: cast(x as double) * x))) as norm
    from (select vec_id, list_transform(embedding, lambda x: cast(x * (vec_id % 7) as float)) as v from embeddings)))""",
    "t7_cosine": """select a.vec_id, b.vec_id as next_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine
from embeddings a cross join n_vectors join embeddings b on b.vec_id = (a.vec_id + 1) % n""",
    "t8_labels": "select query_id, {} as label from (select item_id as query_id, replace({}, '1', cast(item_id as varchar)) as spelled from benchmark)".format(
        label_of("spelled"), LABEL_SPELLINGS_SQL.replace("query_id", "item_id")),
    "t9_clean_answer": "select item_id, {} as answer from benchmark".format(cleaned(
        """concat('  Buna göre [C1] "', text, '" [C2, "x"][C3].   Ayrıca (C1, C2)', chr(9), ' “', text, '” son (Cuma). ')""", "[text]")),
    "t10_verbatim": f"""select source_id, chunk_order, {verbatim('quote', 'content')} as verified from (
  select *, case chunk_order % 4 when 0 then lower(content) when 1 then substr(content, 1, length(content) // 2) || ' ... ' || substr(content, length(content) // 2 + 2)
    when 2 then substr(content, 1, length(content) // 2) || ' xyzxyz… ' || substr(content, length(content) // 2 + 2) else ' … ...' end as quote from kb_chunks)""",
    "t12_version_order": r"""select source_id, case when regexp_full_match(v, '\d+(\.\d+){1,3}')
    then array_to_string(list_resize(string_split(v, '.'), 4, '-1'), '.') else '0.0.-1.-1' end as version_key
from (select source_id, case doc_id % 7 when 0 then version || '.3' when 1 then 'v' || version else version end as v from kb_documents)""",
    "t15_prompt": "select query_id, length(prompt) as n_chars, md5(prompt) as prompt_md5 from prompts",
    "t16_parse_reply": """select item_id, item_id % 4 <> 3 as valid, item_id % 4 <> 3 and item_id % 3 <> 0 as answerable,
  case when item_id % 4 = 3 then '' else json_extract_string(json_object('answer', text), '$.answer') end as answer,
  case when item_id % 4 = 3 then '' else 'C' || item_id || '=' || md5(text) || ',C1=' || md5('') end as citations,
  case when item_id % 4 = 3 then 0 else item_id % 3 end as n_conflicts,
  case when item_id % 4 = 3 then '' else ['', 'C1<C2', 'C1<C2,C3<C2'][item_id % 3 + 1] end as conflicts
from benchmark""",
    "c1_sections": """select source_id, cast(row_number() over (partition by source_id order by sec) - 1 as bigint) as section_no, cast(level as bigint) as level,
  coalesce(heading, '') as heading, md5(content) as content_md5 from kb_all_sections""",
    "c2_heading_path": """select source_id, row_number() over (partition by source_id order by sec) - 1 as section_no, section_path, md5(content) as content_md5
from kb_sections""",
    "c3_packed_chunks": "select source_id, section_path, length(content) as n_chars, md5(content) as content_md5 from kb_chunks",
    "c4_chunk_order": "select source_id, chunk_order, md5(content) as content_md5 from kb_chunks",
    "j1_bm25_matches": """select query_id, count(*) as matches, cast(sum(matched_terms) as bigint) as matched_terms,
  max(matched_terms) as most_terms from scored group by query_id""",
    "j2_query_idf": "select query_id, term, df, round(idf, 8) as idf, round(total_idf, 8) as total_idf from weighted join totals using (query_id)",
    "j3_reconcile": "select source_id, file_name, action, case when action = 'unchanged' then content_hash else content_hash end as content_hash from reconciled",
    "j5_dense_scores": "select query_id, source_id, chunk_order, dense_score from lex_hits h join dense d using (query_id, source_id, chunk_order)".replace(
        "dense_score from", "d.dense_score from"),
    "j8_kept": "select query_id, rank, source_id, chunk_order from resolution where kept",
    "j9_discarded": """select query_id, source_id, min(rank) as first_rank, any_value(version) as version, any_value(effective_date) as effective_date,
  any_value(reason) as reason from resolution where not kept group by query_id, source_id""",
    "j10_substitution": "select query_id, document_key, source_id, replaced_rank from needs",
    "j11_citations": """select c.query_id, cast(c.position as bigint) as position, label, source_id, section_path, md5(quote) as quote_md5, quote_verified
from citations c join validated v using (query_id) where v.answerable""",
    "j12_conflicts": """select c.query_id, cast(conflict_no as bigint) as conflict_no, topic, chosen_id, rejected, reason
from conflicts c join validated v using (query_id) where v.answerable""",
    "j13_lookup": """select w.source_id, document_key, version, cast(case when document_key is null then 404 else 200 end as bigint) as http_status
from (select 'doc-' || lpad(cast(item_id * 37 as varchar), 19, '0') as source_id from benchmark) w left join kb_documents using (source_id)""",
    "a1_term_freq": "select source_id, chunk_order, dl, term, tf from postings",
    "a2_doc_freq": "select term, df from document_frequency",
    "a3_corpus": "select n as n_chunks, cast(total as bigint) as n_terms, round(avgdl, 6) as average_length from corpus",
    "a4_bm25": """select query_id, count(*) as matches, sum(cast(score as decimal(20, 8))) as total, max(score) as best, min(score) as least
from scored group by query_id""",
    "a5_coverage": """select query_id, count(*) as matches, sum(cast(coverage as decimal(20, 8))) as total, max(coverage) as best, min(coverage) as least
from scored group by query_id""",
    "a6_query_stats": "select query_id, mode, max_dense, max_coverage from stats",
    "a7_rrf": "select query_id, source_id, chunk_order, fused_score from hyb_hits",
    "a8_families": """select document_key, source_id, version, effective_date, count(*) over (partition by document_key) as n_versions from kb_documents""",
    "a9_mode": """select 'one model' as store, count(*) as chunks, 'hybrid' as mode from kb_vectors
union all select 'two models', count(*), case when bool_and(vec_id % 50 <> 0) then 'hybrid' else 'lexical' end from kb_vectors""",
    "a10_ingest_summary": """select count(*) filter (action <> 'removed') as documents, count(*) filter (action = 'added') as added,
  count(*) filter (action = 'updated') as updated, count(*) filter (action = 'removed') as removed, count(*) filter (action = 'unchanged') as unchanged
from reconciled""",
    "a11_section_count": f"select source_id, coalesce(section_count, 0) as section_count from kb_documents left join ({COUNTED}) using (source_id)",
    "a12_conflict_rule": "select c.query_id, cast(conflict_no as bigint) as conflict_no, rule_satisfied from conflicts c join validated v using (query_id) where v.answerable",
    "s7_next_store": """select r.source_id, r.file_name, r.content_hash, case when action = 'unchanged' then 1 else coalesce(n, 0) end as n_chunks
from reconciled r left join (select upper(source_id) as id, count(*) as n from new_chunks group by 1) c on c.id = upper(r.source_id)
where action <> 'removed'""",
    "s7_store_changes": """select r.source_id, r.file_name, r.content_hash, case when action = 'unchanged' then 1 else coalesce(n, 0) end as n_chunks,
  action <> 'unchanged' as rewritten
from reconciled r left join (select upper(source_id) as id, count(*) as n from new_chunks group by 1) c on c.id = upper(r.source_id)
where action <> 'removed'""",
    "x1_embed": """select doc_id, failed, case when not failed then round(cast(a / sqrt(a * a + b * b) as float)::double, 5) end as first_part,
  case when not failed then round(cast(b / sqrt(a * a + b * b) as float)::double, 5) end as second_part
from (select doc_id, contains(text, 'AKIA') as failed, cast(length(text) as double) as a,
  cast(length(text) - length(replace(text, 'e', '')) + 1 as double) as b from documents)""",
    "x1_reused_vectors": """select source_id, chunk_order, md5(content) as content_md5, known is not null as reused, round(known[1]::double, 5) as first_part
from noted_chunks left join (select source_id, section_path, content, min(embedding::float[]) as known from kb_vectors group by all)
  using (source_id, section_path, content)""",
    "x2_reply_ledger": """with turns as (select conv_id * 1000 + turn as query_id, role, coalesce(text, '') as said from conversations)
select query_id, case when length(said) % 7 > 1 then md5(said) end as answer,
  case length(said) % 7 when 0 then 'unavailable' when 1 then 'invalid_output' end as failure,
  cast(case when length(said) % 7 = 1 then 2 else 1 end as bigint) as attempts,
  length(said) % 7 > 1 and said in (select said from turns where role = 'user') as kept
from turns""",
    "a14_status": """select 'ok' as status, true as ready, (select count(*) from kb_documents) as documents, (select count(*) from kb_chunks) as sections,
  'hybrid' as retrieval_mode, true as generator_configured, true as embedder_configured""",
    "w1_lexical_topk": "select query_id, rank, source_id, chunk_order, score, coverage from lex_lexical_pool",
    "w2_dense_topk": "select query_id, rank, source_id, chunk_order, dense_score from hyb_dense_pool",
    "w2_dense_cells": "select query_id, rank, source_id, chunk_order, dense_score from hyb_dense_pool",
    "w3_fused_topk": "select query_id, rank, source_id, chunk_order from hyb_hits",
    "w4_current_version": "select document_key, n_versions, current_id as source_id, current_version as version from families",
    "w6_context_labels": "select query_id, label, source_id, chunk_order from context",
    "u2_substituted_context": """select query_id, c.position, source_id, chunk_order, n.replaced_rank from context c join needs n using (query_id, source_id)""",
    "l1_ingest_summary": """select (select count(*) from reconciled where action <> 'removed') as documents,
  (select count(*) from new_chunks) + (select count(*) from reconciled where action = 'unchanged') as chunks,
  (select count(*) from reconciled where action = 'added') as added, (select count(*) from reconciled where action = 'updated') as updated,
  (select count(*) from reconciled where action = 'removed') as removed, (select count(*) from reconciled where action = 'unchanged') as unchanged,
  cast(0 as bigint) as embedded_chunks, 'lexical' as retrieval_mode, cast(null as varchar) as warning""",
    "l4_search_lexical": f"select {HIT_COLUMNS} from lex_hits",
    "l4_search_hybrid": f"select {HIT_COLUMNS} from hyb_hits",
    "l4_search_filtered": f"select {HIT_COLUMNS} from flt_hits",
    "l4_search_requests": """select 'ready' as state, query_id, cast(case when code is null then 200 else 400 end as bigint) as status,
  code as message_code, case when code is null then least(k, 20, coalesce(n, 0)) else 0 end as n_hits
from checked_requests left join found_by_requests using (query_id)
union all select 'no index', query_id, case when code is null then 503 else 400 end, coalesce(code, 'index_not_ready'), 0 from checked_requests""",
    "w1_lexical_blocks": "select query_id, rank, source_id, chunk_order, score, coverage from lex_lexical_pool",
    "l2_incremental_index": f"select {HIT_COLUMNS} from lex_hits",
    "l2_incremental_stats": """select term, df from document_frequency union all select ' documents', count(*) from kb_documents
union all select ' chunks', count(*) from kb_chunks union all select ' occurrences', cast(sum(tf) as bigint) from postings""",
    "l5_as_of_resolution": "select query_id, as_of, rank, source_id, multi_version, kept, reason, current_id, needs_substitution from own_resolution",
    "s1_folder_scan": "select file_name, length(valid_text) as n_chars, md5(valid_text) as text_md5 from kb_valid",
    "l5_resolution": "select query_id, rank, source_id, multi_version, kept, reason, current_id, needs_substitution from resolution",
    "l6_report_cited": """select r.* from report r semi join (select query_id, document_key from citations semi join
  (select query_id from validated where answerable) v using (query_id)) c using (query_id, document_key)""",
    "l6_report_retrieved": "select * from report",
    "l7_context": "select query_id, position, label, source_id, chunk_order, version, section_path, md5(content) as content_md5 from context",
    "l8_validated_answers": "select query_id, valid, answerable, answer, missing_information, refusal_reason from validated",
    "l9_answers": f"""select query_id, status, status = 200 and reason = '' as answerable, case when status = 200 then reason end as refusal_reason,
  case when status = 200 then case when reason = '' then {trimmed("line")} else 'Bu soruyu yanıtlamak için dokümanlarda yeterli bilgi bulunamadı.' end end as answer,
  case when status = 200 and reason = '' then source_id else '' end as source_ids, true as all_verified,
  discarded > 0 as applied, selected as n_selected, discarded as n_discarded
from (select *, case when status <> 200 then 0 when reason = '' then n_selected when reason = 'LowRelevance' then 0 else all_selected end as selected,
    case when status <> 200 then 0 when reason = '' then n_discarded when reason = 'LowRelevance' then 0 else all_discarded end as discarded
  from (select *, cast(case when reason = '' and length(line) % 5 = 0 then 503 when reason = '' and length(line) % 5 = 1 then 502 else 200 end as bigint) as status
    from (select g.query_id, case when not evidence then 'LowRelevance' when x.source_id is null then 'ModelInsufficientContext' else '' end as reason,
        string_split(x.content, chr(10))[1] as line, x.source_id, coalesce(n_selected, 0) as n_selected, coalesce(n_discarded, 0) as n_discarded,
        coalesce(all_selected, 0) as all_selected, coalesce(all_discarded, 0) as all_discarded
      from gated g left join (select * from context where position = 1) x using (query_id)
        left join (select query_id, document_key, count(*) filter (kind = 'selected') as n_selected, count(*) filter (kind = 'discarded') as n_discarded
          from report group by 1, 2) r on r.query_id = g.query_id and r.document_key = x.document_key
        left join (select query_id, count(*) filter (kind = 'selected') as all_selected, count(*) filter (kind = 'discarded') as all_discarded
          from report group by 1) a on a.query_id = g.query_id)))
union all select query_id, 400, false, null, null, '', true, false, 0, 0 from (select unnest([-1, -2]) as query_id)""",
    "l10_documents": f"""select source_id, document_key, title, version, effective_date, status, category, supersedes, coalesce(section_count, 0) as section_count
from kb_documents left join ({COUNTED}) using (source_id)""",
    "l11_sections": """select source_id, cast(200 as bigint) as http_status, chunk_order, section_path, md5(content) as content_md5
from kb_documents left join kb_chunks using (source_id)""",
}

_QUERIES["s8_audit_log"] = f"""select a.query_id, md5(b.text) as question_md5, true as same_question, answerable, refusal_reason, answerable as json_answerable,
  answer as json_answer, refusal_reason as json_reason, source_ids, n_selected, n_discarded, 'hybrid' as mode, coalesce(candidates, '') as candidates,
  coalesce(context_ids, '') as context_ids
from ({_QUERIES["l9_answers"]}) a join benchmark b on b.item_id = a.query_id
  left join (select query_id, string_agg(source_id, ',' order by first_rank) as candidates
    from (select query_id, source_id, min(rank) as first_rank from candidates group by all) group by 1) c on c.query_id = a.query_id
  left join (select query_id, string_agg(source_id, ',' order by position) as context_ids from context group by 1) x on x.query_id = a.query_id
where status = 200"""

ORACLES = {name: statement(sql) for name, sql in _QUERIES.items()}
