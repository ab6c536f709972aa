"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as k,
    lag(role) over (partition by conv_id order by turn, role, text) as prev,
    count(*) over (partition by conv_id) as total,
    length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2'))
      + length('### ' || case role when 'system' then 'System' when 'user' then 'User' else 'Assistant' end || ': ')
      + length('</turn>') + 1 as chars
  from t
), j as (
  select *, case when prev is null then role in ('system', 'user') when prev in ('system', 'assistant') then role = 'user'
    else role = 'assistant' end as fits from n
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(length(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars,
  min(case when not fits then k end) is null and arg_max(role, k) <> 'system' as valid,
  cast(coalesce(min(case when not fits then k - 1 end), case when arg_max(role, k) = 'system' then count(*) end) as bigint) as first_bad_turn
from j group by conv_id
"""



def _shared(nodes: str, parent: str, child: str, out: str) -> str:
    """One level of the tree: the budget of each parent divided among its children."""
    join = f"join {nodes}_up p using ({parent})" if parent else f"cross join {nodes}_up p"
    over = f"partition by {parent}" if parent else ""
    alike = f"partition by {parent + ', ' if parent else ''}is_full"
    order = "order by case when weight > 0 then capacity / cast(weight as double) else 'inf'::double end, " + child
    return f"""
{out}_a as (
  select n.*, p.budget as up, cast(p.budget as hugeint) - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as remains,
    sum(weight) over (w rows between current row and unbounded following) as open_weight
  from {nodes} n {join} window w as ({over} {order})
), {out}_b as (
  select *, weight > 0 and capacity * open_weight <= remains * weight as is_full from {out}_a
), {out}_c as (
  select *, sum(weight) over ({alike} {order} rows between unbounded preceding and current row) as upto,
    sum(weight) over ({alike}) as whole, max(remains) over ({alike}) as rest from {out}_b
), {out} as (
  select *, case when is_full then capacity when whole > 0 then (rest * upto) // whole - (rest * (upto - weight)) // whole else 0 end as budget from {out}_c
)"""


LANG_WEIGHT = "case lang when 'en' then 4 when 'de' then 2 when 'fr' then 3 when 'es' then 1 else 1 end"
SOURCE_WEIGHT = "case when domain = 'books' and lang = 'en' and source = 'src1' then 3 when domain = 'forum' and source = 'src12' then 0 else 1 end"
DOMAIN_WEIGHT = "case domain when 'web' then 3 when 'books' then 5 when 'forum' then 2 else 1 end"
OP3 = f"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, lang as own_lang, source as own_source,
    case when source = 'src0' then 'web' when source in ('src1', 'src2', 'src3', 'src4', 'src5') then 'books' else 'forum' end as domain,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as hugeint) as n
  from documents
), leaves as (
  select domain, lang, source, sum(n) as tokens, case when {SOURCE_WEIGHT} = 0 then 0 else 3 * sum(n) end as capacity, {SOURCE_WEIGHT} as weight
  from docs group by domain, lang, source
), langs as (
  select domain, lang, sum(capacity) as capacity, {LANG_WEIGHT} as weight from leaves group by domain, lang
), domains as (
  select domain, sum(capacity) as capacity, {DOMAIN_WEIGHT} as weight from leaves group by domain
), domains_up as (
  select least(sum(capacity), (sum(tokens) * 60) // 100) as budget from leaves
), {_shared("domains", "", "domain", "d")},
langs_up as (select domain, budget from d), {_shared("langs", "domain", "lang", "l")},
leaves_up as (select domain, lang, budget from l), {_shared("leaves", "domain, lang", "source", "s")},
plan as (
  select domain, lang, source, case when tokens > 0 then budget // tokens else 0 end as full_epochs,
    case when tokens > 0 then budget % tokens else 0 end as rest from s
), placed as (
  select docs.*, full_epochs, rest, sha256('17:' || full_epochs || ':' || doc_id) as key from docs join plan using (domain, lang, source)
), started as (
  select *, coalesce(sum(n) over (partition by domain, lang, source order by key rows between unbounded preceding and 1 preceding), 0) as start from placed
), taken as (
  select *, unnest(range(0, cast(full_epochs as bigint) + case when start < rest then 1 else 0 end)) as epoch from started
)
select doc_id, domain, own_lang as lang, own_source as source, epoch, cast(n as bigint) as n_tokens,
  cast(case when epoch < full_epochs then n else least(n, rest - start) end as bigint) as take_tokens
from taken
"""

OP10 = """
with recursive good as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from good union select r.a, p.b from reach r join pairs p on r.b = p.a
), tops as (
  select a as vec_id, min(b) as component_id from reach group by a
), links as (
  select a as vec_id, count(*) as n from pairs group by a
)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component_id, e.vec_id) as component_id,
  coalesce(e.vec_id = coalesce(component_id, e.vec_id), false) as kept
from embeddings e left join tops using (vec_id) left join links using (vec_id)
"""

ORACLES = {"op10_cover_tree": OP10, "op3_mixture": OP3, "op1_chat_format": OP1}
