"""Equivalent SQL for DuckDB, by query name."""

from __future__ import annotations

SOURCE = "replace(lower(trim(source)), '-', '_')"
HEAD = r"^(?:\[[^\]]*\])?\w+: "
TS = r"regexp_extract({}, '^(?:\[([^\]]*)\])?(\w+): ', 1)"
ROLE = r"regexp_extract({}, '^(?:\[([^\]]*)\])?(\w+): ', 2)"
BODY = rf"regexp_replace({{}}, '{HEAD}', '')"
IS_USER = r"regexp_matches({}, '^(?:\[[^\]]*\])?user: ')"


def _name(c: str) -> str:
    return f"upper(trim(replace({c}, '\"', '')))"


SESS = rf"""sess as (
  select doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '{HEAD}')) parts
  from documents where {SOURCE} = 'lme_session' and text is not null
), us as (
  select doc_id, parts, list_transform(list_filter(parts, lambda p: {IS_USER.format('p')}), lambda p: {BODY.format('p')}) u from sess
)"""
NOTES = """notes as (
  select distinct memory_id, user_uuid, content from memory_notes where memory_id is not null and user_uuid is not null and content is not null
), docs as (select memory_id, user_uuid, content, string_split(lower(content), ' ') tokens from notes)"""
ASK = r"""ask as (
  select user_uuid question, persona_info, lower(regexp_extract(persona_info, 'Interests: ([^\n]*)$', 1)) interests
  from halu_users where regexp_extract(persona_info, 'Interests: ([^\n]*)$', 1) <> ''
), qt as (select question, unnest(regexp_split_to_array(trim(replace(interests, ',', '')), '\s+')) term from ask)"""
BM25 = f"""{NOTES}, {ASK}, stats as (select user_uuid corpus, count(*) n, avg(len(tokens)) avgdl from docs group by 1),
tok as (select user_uuid corpus, memory_id doc, len(tokens) dl, unnest(tokens) term from docs),
post as (select corpus, doc, term, count(*) tf, max(dl) dl from tok group by 1, 2, 3),
raw as (select corpus, term, count(*) df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) r from post join stats using (corpus) group by 1, 2),
mean as (select corpus, avg(r) m from raw group by 1),
terms as (select corpus, term, df, case when r < 0 then 0.25 * m else r end idf from raw join mean using (corpus)),
qf as (select question, term, count(*) qf from qt group by 1, 2),
scored as (
  select question, doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
  from qf join post on post.corpus = question and post.term = qf.term join terms on terms.corpus = question and terms.term = qf.term join stats on stats.corpus = question
  group by 1, 2
)"""
METRICS = f"""{BM25}, ranked as (
  select question, doc, row_number() over (partition by question order by round(coalesce(score, 0), 9) desc, doc) rank
  from (select distinct a.question, d.memory_id doc from ask a join docs d on d.user_uuid = a.question) left join scored using (question, doc)
), gold as (
  select distinct a.question, memory_id doc from (select question, unnest(string_split(interests, ', ')) phrase from ask) a join docs d on d.user_uuid = a.question and contains(lower(d.content), a.phrase)
), ng as (select question, count(*) n from gold group by 1), ks as (select unnest([5, 10, 20, 30]) k),
per as (select question, k, count(*) found, sum(case when rank <= 1 then 1 else 1 / log2(rank) end) dcg from ranked join gold using (question, doc) join ks on rank <= k group by 1, 2),
m as (
  select a.question, ks.k, coalesce(ng.n, 0) n, coalesce(found, 0) found, coalesce(dcg, 0) dcg,
    list_sum(list_transform(range(1, least(ks.k, coalesce(ng.n, 0)) + 1), lambda i: case when i <= 1 then 1.0 else 1 / log2(i) end)) ideal
  from ask a cross join ks left join ng using (question) left join per on per.question = a.question and per.k = ks.k
), metrics as (
  select question, k, (found > 0)::int recall_any, (found >= n)::int recall_all, case when n > 0 then dcg / ideal else 0 end ndcg from m
)"""
EXP = """base as (
  select distinct memory_id session, user_uuid, content text, summary, keywords, facts from memory_notes where memory_id is not null and content is not null
), extra as (
  select session, 'summary' kind, 0::bigint pos, summary text from base
  union all select session, 'keyphrase', i::bigint - 1, p[i] from (select session, string_split(keywords, ';') p from base where keywords is not null), unnest(range(1, len(p) + 1)) t(i)
  union all select session, 'userfact', i::bigint - 1, p[i] from (select session, string_split(facts, ';') p from base where facts is not null), unnest(range(1, len(p) + 1)) t(i)
), kept as (select session, kind, pos, trim(text) text from extra where text is not null and trim(text) <> '')"""
ENT = f"""ent as (
  select distinct entity_row_id, graph_id, {_name('entity_name')} as name, {_name('entity_type')} as type, description, source_id,
    case when isnan(importance_score) then null else importance_score end importance
  from entities where graph_id is not null and {_name('entity_name')} <> ''
), node as (
  select graph_id, name, coalesce(list_sort(list(distinct description) filter (where description is not null)), []) descriptions,
    coalesce(list_sort(list(distinct source_id) filter (where source_id is not null)), []) source_ids from ent group by 1, 2
), tc as (select graph_id, name, type, count(*) n, min(entity_row_id) f from ent where type is not null group by 1, 2, 3),
major as (select graph_id, name, type, n from (select *, row_number() over (partition by graph_id, name order by n desc, f, type) r from tc) where r = 1)"""
REL = f"""rel as (
  select distinct rel_row_id, graph_id, {_name('src_id')} a, {_name('tgt_id')} b, description, case when isnan(weight) then null else weight end weight, ord, source_id
  from relationships where graph_id is not null and {_name('src_id')} <> '' and {_name('tgt_id')} <> ''
), edge as (
  select graph_id, least(a, b) src, greatest(a, b) tgt, sum(coalesce(weight, 1)) weight, min(coalesce(ord, 1))::bigint ord,
    coalesce(list_sort(list(distinct description) filter (where description is not null)), []) descriptions,
    coalesce(list_sort(list(distinct source_id) filter (where source_id is not null)), []) source_ids from rel group by 1, 2, 3
), inc as (select graph_id, src as name, tgt neighbour from edge union all select graph_id, tgt, src from edge),
deg as (select graph_id, name, count(*) degree from inc group by 1, 2)"""


def _seeds(k: int) -> str:
    return f"""seed as (
  select graph_id, name, r entity_order from (
    select graph_id, name, row_number() over (partition by graph_id order by max(importance) desc, name) r from ent where importance is not null group by 1, 2
  ) where r <= {k}
)"""


COUNTS = f"""{ENT}, {REL}, {_seeds(20)}, cites as (select graph_id, name, unnest(source_ids) chunk_id from node),
near as (select distinct i.graph_id, i.name, i.neighbour from inc i join seed using (graph_id, name)),
shared as (select n.graph_id, n.name, c.chunk_id, count(*) k from near n join cites c on c.graph_id = n.graph_id and c.name = n.neighbour group by 1, 2, 3),
cnt as (select s.graph_id, s.name, c.chunk_id, s.entity_order, coalesce(k, 0) relation_count from seed s join cites c using (graph_id, name) left join shared using (graph_id, name, chunk_id)),
unit as (select * from (select *, row_number() over (partition by graph_id, chunk_id order by entity_order, name) r from cnt) where r = 1)"""


def _hex(text: str) -> str:
    digits = rf"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: md5(w)[1])"
    return f"list_transform(string_split('0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f', ','), lambda h: len(list_filter({digits}, lambda d: d = h))::double)"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-9)"


UNITS = f"""{COUNTS}, txt as (select chunk_id, min(content) content from text_chunks where content is not null group by 1),
sim as (
  select u.graph_id, u.chunk_id, u.entity_order, u.relation_count, round({_cos('cv', 'pv')}, 9) sim
  from unit u join (select chunk_id, {_hex('content')} cv from txt where chunk_id in (select chunk_id from unit)) using (chunk_id)
  left join (select user_uuid, {_hex("coalesce(persona_info, '')")} pv from halu_users) h on h.user_uuid = u.graph_id
)"""
RANK_ORDER = {
    "vector": "sim desc", "entity": "entity_order", "count": "relation_count desc", "entity_vector": "entity_order, sim desc", "count_vector": "relation_count desc, sim desc",
    "entity_count_vector": "entity_order, relation_count desc, sim desc", "entity_count": "entity_order, relation_count desc",
}
VEC = "v as (select vec_id id, embedding::double[] x, label from embeddings where embedding is not null)"
JUDGED = rf"""j as (
  select doc_id, case when regexp_extract(text, 'Score: (\d)', 1) <> '' then regexp_extract(text, 'Score: (\d)', 1)::int end score,
    nullif(regexp_extract(text, 'Label: (\w+)', 1), '') as label, (n_chars % 5 + 1)::double importance, doc_id % 7 = 0 interference,
    case doc_id % 3 when 0 then 'true' when 1 then 'True' else 'false' end is_target,
    case doc_id % 3 when 0 then 'Event Memory' when 1 then 'Persona Memory' else 'Relationship Memory' end memory_type
  from documents where {SOURCE} = 'judge_rationale'
)"""


def _div(a: str, b: str) -> str:
    return f"round(coalesce(({a})::double / nullif({b}, 0), 0), 6)"


def _ratios(labels: list[str]) -> str:
    cols = ", ".join(f"{_div(f"count(*) filter (where label = '{x}')", 'count(*)')} as {x.lower()}_all, {_div(f"count(*) filter (where label = '{x}')", 'count(label)')} as {x.lower()}_valid" for x in labels)
    return f"with {JUDGED} select count(*) total, count(label) as valid, {cols} from j"


POINTS = """pt as (
  select distinct memory_id, user_uuid, content, summary, keywords, facts from memory_notes where memory_id is not null
), arr as (
  select memory_id, user_uuid, list_concat(list_concat(
    list_transform(list_filter(list_transform(string_split(coalesce(facts, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {'point_type': 'fact', 'point': x}),
    list_filter([{'point_type': 'summary', 'point': trim(coalesce(summary, ''))}], lambda s: s.point <> '')), list_concat(
    list_transform(list_filter(list_transform(string_split(coalesce(keywords, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {'point_type': 'keyword', 'point': x}),
    list_filter([{'point_type': 'content', 'point': trim(coalesce(content, ''))}], lambda s: s.point <> ''))) p from pt
), points as (select memory_id, user_uuid, i::bigint - 1 pos, p[i].point_type point_type, p[i].point point from arr, unnest(range(1, len(p) + 1)) t(i))"""


def _words(c: str) -> str:
    return f"case when trim(coalesce({c}, '')) = '' then 0 else len(regexp_split_to_array(trim({c}), '\\s+')) end"


_CELL = r"""'"' || regexp_replace(regexp_replace(trim(coalesce({0}, '')), '^''+|''+$', '', 'g'), '^"+|"+$', '', 'g') || '"'"""
_TAB = "',' || chr(9)"
EDGE_RANK = """er as (
  select e.graph_id, e.src, e.tgt, e.weight, array_to_string(e.descriptions, '<SEP>') description, a.degree + b.degree edge_rank
  from edge e join deg a on a.graph_id = e.graph_id and a.name = e.src join deg b on b.graph_id = e.graph_id and b.name = e.tgt
)"""
Q_VEC = f"qv as (select question graph_id, {_hex('interests')} q from ask)"


def _hits(items: str, keys: str) -> str:
    """The 20 best of ``items (graph_id, keys, vec)``."""
    return f"""(select graph_id, {keys}, sim, hit from (select *, row_number() over (partition by graph_id order by sim desc, {keys}) hit from (
  select i.graph_id, {keys}, round({_cos('vec', 'q')}, 9) sim from {items} i join qv using (graph_id)) where sim >= 0.2) where hit <= 20)"""


CLUSTERS = """cl as (select graph_id, name, 0 as level, type as cluster from major union all select graph_id, name, 1, unnest(source_ids) from node),
rep as (select graph_id, cluster, case when count(*) % 5 <> 0 then (count(*) % 10)::double end rating, '# ' || cluster || chr(10) || chr(10) || count(*) || ' members' || chr(10) || chr(10) report from cl group by 1, 2)"""
E_HITS = f"""{ENT}, {REL}, {ASK}, {Q_VEC}, ev as (select graph_id, name, {_hex("name || ' ' || coalesce(array_to_string(descriptions, ' '), '')")} vec from node),
hits as {_hits('ev', 'name')}, {CLUSTERS}, {EDGE_RANK}"""
R_HITS = f"""{ENT}, {REL}, {ASK}, {Q_VEC}, rv as (select graph_id, src, tgt, {_hex("src || ' ' || tgt || ' ' || coalesce(array_to_string(descriptions, ' '), '')")} vec from edge),
rh as {_hits('rv', 'src, tgt')}, ends as (select graph_id, name, row_number() over (partition by graph_id order by min(a)) hit from (select graph_id, src as name, 2 * hit a from rh union all select graph_id, tgt, 2 * hit + 1 from rh) group by 1, 2),
hits as (select * from ends), {CLUSTERS}, {EDGE_RANK}"""
COMMUNITIES = """com as (select * from (
  select graph_id, cluster, count(*) hits, any_value(r.rating) rating, any_value(r.report) report, row_number() over (partition by graph_id order by count(*) desc, coalesce(any_value(r.rating), -1) desc, cluster) as rank
  from cl join hits using (graph_id, name) join rep r using (graph_id, cluster) where level <= 2 group by 1, 2) where rank <= 5)"""


def _budget_edges(budget: int, seeds: str = "hits") -> str:
    return f"""ke as (select distinct i.graph_id, least(i.name, i.neighbour) src, greatest(i.name, i.neighbour) tgt from inc i join {seeds} using (graph_id, name)),
re as (select *, row_number() over (partition by graph_id order by edge_rank desc, round(weight, 6) desc, src, tgt) as rank from er join ke using (graph_id, src, tgt)),
be as (select * from (select *, sum({_words('description')} + 1) over (partition by graph_id order by rank) running from re) where running <= {budget})"""


UNITS_OF_HITS = """cites as (select graph_id, name, unnest(source_ids) chunk_id from node),
near as (select distinct i.graph_id, i.name, i.neighbour from inc i join hits using (graph_id, name)),
shared as (select n.graph_id, n.name, c.chunk_id, count(*) k from near n join cites c on c.graph_id = n.graph_id and c.name = n.neighbour group by 1, 2, 3),
un as (select graph_id, chunk_id, row_number() over (partition by graph_id order by hit, k desc, chunk_id) as rank from (
  select h.graph_id, h.name, c.chunk_id, h.hit, coalesce(k, 0) k, row_number() over (partition by h.graph_id, c.chunk_id order by h.hit, h.name) r
  from hits h join cites c using (graph_id, name) left join shared using (graph_id, name, chunk_id)) where r = 1),
ents as (select h.graph_id, h.hit, h.name, m.type, array_to_string(n.descriptions, '<SEP>') description, coalesce(degree, 0) degree from hits h join node n using (graph_id, name) left join major m using (graph_id, name) left join deg using (graph_id, name))"""
REPORTS = f"""r as (select user_uuid graph_id, doc_id report_id, n_chars::double occurrence, case when doc_id % 5 <> 0 then (doc_id % 10)::double end rating, text from documents where {SOURCE} = 'graph_report' and user_uuid is not null),
f as (select * from (select *, row_number() over (partition by graph_id order by occurrence desc, report_id) pick from r) where pick <= 512),
sp as (select *, row_number() over (partition by graph_id order by occurrence desc, coalesce(rating, 0) desc, report_id) as rank from f where coalesce(rating, 0) >= 3)"""
GROUPS = f"""{REPORTS}, t as (select graph_id, report_id, rank, {_words('text')}::bigint tokens from sp),
g as (
  select graph_id, report_id, rank, tokens, 0::bigint as "group", tokens used from t where rank = 1
  union all select t.graph_id, t.report_id, t.rank, t.tokens, case when g.used + t.tokens > 400 then g."group" + 1 else g."group" end, case when g.used + t.tokens > 400 then t.tokens else g.used + t.tokens end
  from g join t on t.graph_id = g.graph_id and t.rank = g.rank + 1
)"""
DESCRIBED = f"""{ENT}, {REL}, {EDGE_RANK}, mem as (select graph_id, type as cluster, name from major),
dn as (select m.graph_id, cluster, 'entity' as kind, name as item, coalesce(array_to_string(n.descriptions, '<SEP>'), '') as content, coalesce(degree, 0) degree from mem m join node n using (graph_id, name) left join deg using (graph_id, name)),
de as (select e.graph_id, a.cluster, 'relation', src || ' - ' || tgt, coalesce(description, ''), edge_rank from er e join mem a on a.graph_id = e.graph_id and a.name = src join mem b on b.graph_id = e.graph_id and b.name = tgt and a.cluster = b.cluster where src <> tgt),
da as (select *, count(*) over (partition by graph_id, cluster) total, count(*) over (partition by graph_id, cluster, kind) own from (select * from dn union all select * from de)),
dr as (select *, sum({_words("item || ' ' || content")} + 1) over (partition by graph_id, cluster, kind order by degree desc, item) running, floor(120 * own / total) share from da),
described as (select graph_id, cluster, kind, item, content, degree from dr where running <= share)"""


def _section(title: str, header: str, rows: str) -> str:
    quoted = (" || " + _TAB + " || ").join(f"'\"{h}\"'" for h in header.split())
    return f"'-----{title}-----' || chr(10) || '```csv' || chr(10) || {quoted} || coalesce(chr(10) || ({rows}), '') || chr(10) || '```'"


def _lines(cells: list[str], order: str, source: str) -> str:
    line = (" || " + _TAB + " || ").join([f"({order} - 1)::varchar", *cells])
    return f"select string_agg({line}, chr(10) order by {order}) from {source} x where x.graph_id = u.graph_id"


LOCAL = (
    f"with {E_HITS}, {COMMUNITIES}, {_budget_edges(4800)}, {UNITS_OF_HITS}, src as (select graph_id, rank, case when len(regexp_split_to_array(trim(content), '\\s+')) > 20 then array_to_string(regexp_split_to_array(trim(content), '\\s+')[1:20], ' ') else content end as content from un join (select chunk_id, min(content) as content from text_chunks where content is not null group by 1) using (chunk_id))"
    f" select u.graph_id, {_section('Reports', 'id content', _lines([_CELL.format('report')], 'rank', 'com'))} || chr(10)"
    f" || {_section('Entities', 'id entity type description rank', _lines([_CELL.format('name'), _CELL.format('type'), _CELL.format('description'), 'degree::varchar'], 'hit', 'ents'))} || chr(10)"
    f" || {_section('Relationships', 'id source target description weight rank', _lines([_CELL.format('src'), _CELL.format('tgt'), _CELL.format('description'), "printf('%.2f', weight)", 'edge_rank::varchar'], 'rank', 'be'))} || chr(10)"
    f" || {_section('Sources', 'id content', _lines([_CELL.format('content')], 'rank', 'src'))} as context from (select distinct graph_id from ents) u"
)

NOTE_CORPUS = f"""{ASK}, {Q_VEC}, nc as (select distinct memory_id doc, user_uuid corpus, keywords, facts, summary, content from memory_notes where memory_id is not null and user_uuid is not null)"""
SEPARATE = f"""{NOTE_CORPUS}, cp as (select doc, corpus, unnest([keywords, facts, summary, content]) t from nc),
cs as (select q.graph_id question, doc, {_cos('v', 'q.q')} s from (select doc, corpus, {_hex('t')} v from cp where trim(coalesce(t, '')) <> '') x join qv q on q.graph_id = x.corpus),
sv as (select a.question, n.doc, round(coalesce(avg(s), 0), 6) score from ask a join nc n on n.corpus = a.question left join cs on cs.question = a.question and cs.doc = n.doc group by 1, 2),
sr as (select *, row_number() over (partition by question order by score desc, doc) as rank from sv)"""

ORACLE: dict[str, str] = {
    "separate_view_scores": f"with {SEPARATE} select question, doc, rank, score from sr where rank <= 5",
    "merged_mean_scores": f"""with {NOTE_CORPUS}, s as (
    select q.graph_id question, doc, round(({_cos('m', 'q.q')} + {_cos('c', 'q.q')}) / 2, 6) score
    from (select doc, corpus, {_hex("concat_ws(' ', keywords, facts, summary)")} m, {_hex("coalesce(content, '')")} c from nc) x join qv q on q.graph_id = x.corpus)
  select question, doc, rank, score from (select *, row_number() over (partition by question order by score desc, doc) as rank from s) where rank <= 5""",
    "points_of_hits": f"""with {SEPARATE}, {POINTS}, p as (select question, memory_id, pos, point_type, round(score, 4) score, sr.rank nr from sr join points on points.memory_id = sr.doc where sr.rank <= 3)
  select question, memory_id, pos, point_type, rank, score from (select *, row_number() over (partition by question order by score desc, nr, pos) as rank from p) where rank <= 8""",
    "documents_replaced": """select distinct memory_id doc, user_uuid corpus, case when summary is null then content else summary end as text from memory_notes
  where memory_id is not null and user_uuid is not null and (summary is null or summary <> '')""",
    "session_id_mapping": """with t as (select distinct user_uuid, full_doc_id, chunk_id from text_chunks where user_uuid is not null and full_doc_id is not null),
  r as (select *, row_number() over (partition by user_uuid, full_doc_id order by chunk_id) n from t)
  select user_uuid, chunk_id, case when n = 1 then full_doc_id else full_doc_id || '_' || substr(md5(full_doc_id || '|' || n), 1, 6) end unique_id, n > 1 mapped from r""",
    "tokenizer_windows": r"""with t as (select distinct chunk_id, content from text_chunks where content is not null and content <> ''), w as (select chunk_id, regexp_extract_all(content, '[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+$') w from t),
  s as (select chunk_id, w, unnest(range(0, len(w), 180)) a from w)
  select chunk_id, a // 180 chunk_order_index, least(200, len(w) - a) tokens, regexp_replace(array_to_string(w[a + 1:a + 200], ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') as content from s""",
    "empty_extraction_scores": "select distinct memory_id point_id, case when trim(coalesce(summary, '')) = '' then 0 else length(summary) % 3 end::int score from memory_notes where memory_id is not null",
    "merged_eval_rows": f"""with {ENT}, c as (select full_doc_id session, min(chunk_id) chunk_id from text_chunks where full_doc_id is not null group by 1),
  a as (select distinct full_doc_id session, user_uuid question from text_chunks where user_uuid is not null and full_doc_id is not null),
  i as (select source_id chunk_id, case when entity_row_id % 4 = 0 then 'chunk' else 'entity' end t, entity_row_id r, any_value(name) as name from ent where source_id is not null group by 1, 2, 3),
  k as (select *, row_number() over (partition by chunk_id, t order by r) p from i), x as (select chunk_id, string_agg(name, ' | ' order by t, r) context from k where p <= case t when 'chunk' then 2 else 3 end group by 1),
  m as (select session_id session, count(distinct memory_id) n from memory_notes where memory_id is not null and session_id is not null and summary is not null group by 1)
  select chunk_id || '_question36' as key, session, question, coalesce(context, '') context, coalesce(n, 0) n_memories from a join c using (session) left join x using (chunk_id) left join m using (session)""",
    "original_session_ids": """with h as (select distinct operation_id question, lower(trim(new_memory_id)) doc from memory_operations where operation_id is not null and new_memory_id is not null),
  m as (select memory_id doc, min(session_id) session from memory_notes where memory_id is not null and session_id is not null group by 1)
  select question, doc, coalesce(session, doc) session from h left join m using (doc)""",
    "ignored_questions": f"""with {SESS}, q as (select doc_id, doc_id % 5 = 0 a, len(list_filter(u, lambda x: contains(x, 'April'))) = 0 b from us)
  select reason, count(*) n from (select 'abstention' reason from q where a union all select 'no_target' from q where b) group by 1""",
    "token_usage": f"""with t as (select distinct memory_id, user_uuid, content, summary from memory_notes where memory_id is not null)
  select sum({_words('content')})::bigint prompt_tokens, sum(case when summary is not null then {_words('summary')} end)::bigint completion_tokens, (sum({_words('content')}) + sum(case when summary is not null then {_words('summary')} end))::bigint total_tokens, count(*) calls from t""",
    "store_stats": "with t as (select distinct operation_id, op_action from memory_operations where operation_id is not null) select count(*) operations, count(*) filter (where op_action = 'created') memories, count(*) filter (where op_action = 'updated') updated, count(*) filter (where op_action = 'no_action') rejected from t",
    "session_user_text": f"with {SESS} select doc_id, coalesce(array_to_string(u, ' '), '') flat_text, coalesce(array_to_string(list_transform(u, lambda x: x || chr(10)), ''), '') graph_text from us",
    "session_dialogue_render": rf"""with s as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '{HEAD}')) parts from documents where {SOURCE} = 'halu_dialogue'
) select doc_id,
  array_to_string(list_transform(parts, lambda p: upper(left({ROLE.format('p')}, 1)) || lower(substr({ROLE.format('p')}, 2)) || ': ' || {BODY.format('p')}), chr(10) || chr(10)) titled,
  array_to_string(list_transform(parts, lambda p: '[' || {TS.format('p')} || ']' || {ROLE.format('p')} || ': ' || {BODY.format('p')} || case when {ROLE.format('p')} = 'assistant' then chr(10) else '' end), chr(10)) judge_text,
  array_to_string(list_transform(parts, lambda p: {TS.format('p')} || {ROLE.format('p')} || ': ' || {BODY.format('p')} || chr(10)), '') graph_text from s""",
    "session_user_turn_stats": f"with {SESS} select doc_id, len(parts)::bigint n_turns, len(u)::bigint n_user, length(coalesce(array_to_string(u, ' '), ''))::bigint user_chars, len(list_filter(u, lambda x: contains(x, 'April'))) > 0 has_target from us",
    "noans_rewrite": f"""with {SESS} select doc_id, case when len(list_filter(u, lambda x: contains(x, 'April'))) > 0 then 'answer_' else 'noans_' end || doc_id session_id,
  len(list_filter(parts, lambda p: contains({BODY.format('p')}, 'April'))) > 0 is_gold from us""",
    "duplicate_content_guard": "select memory_id, count(*) n_rows, count(distinct md5(content)) n_contents from memory_notes where memory_id is not null group by 1 having count(*) > 1",
    "session_id_dedup": """with t as (select distinct user_uuid, full_doc_id, chunk_id from text_chunks where user_uuid is not null and full_doc_id is not null),
  r as (select *, row_number() over (partition by user_uuid, full_doc_id order by chunk_id) occurrence from t)
  select user_uuid, full_doc_id, chunk_id, occurrence, case when occurrence = 1 then full_doc_id else full_doc_id || '_' || substr(md5(user_uuid || '|' || full_doc_id || '|' || occurrence), 1, 6) end unique_id from r""",
    "session_actions": "select user_uuid, ['created', 'updated', 'no_action'][min(case op_action when 'created' then 1 when 'updated' then 2 else 3 end)] session_action from memory_operations where user_uuid is not null group by 1",
    "persona_names": r"select user_uuid, nullif(trim(regexp_extract(persona_info, 'Name:\s*(.*?); Gender:', 1)), '') as name from halu_users",
    "note_components": """with t as (select distinct memory_id, user_uuid, keywords, summary, facts, session_id from memory_notes where memory_id is not null)
  select memory_id, keywords is null or trim(keywords) in ('', ',', ';') no_keywords, summary is null or trim(summary) in ('', ',', ';') no_summary,
    array_to_string(list_filter([summary, keywords, facts], lambda x: x is not null and trim(x) <> ''), ' | ') memories,
    len(list_filter(string_split(coalesce(keywords, ''), ';'), lambda x: trim(x) <> ''))::bigint n_keywords,
    case when contains(session_id, '_') then regexp_replace(session_id, '_[^_]*$', '') when session_id is not null then '' end session_head, 'note-' || md5(summary) summary_id from t""",
    "note_vector_text": """with t as (select distinct memory_id, user_uuid, keywords, facts, summary, content from memory_notes where memory_id is not null)
  select memory_id, 'Keywords: ' || chr(10) || coalesce(keywords, '') || chr(10) || chr(10) || 'Facts: ' || chr(10) || coalesce(facts, '') || chr(10) || chr(10) || 'Summary: ' || chr(10) || coalesce(summary, '') || chr(10) || chr(10) || 'Content: ' || chr(10) || coalesce(content, '') as text from t""",
    "bm25_term_stats": f"with {BM25} select corpus, term, df, round(idf, 6) idf from terms",
    "bm25_scores_topk": f"with {BM25} select question, doc, rank, round(score, 6) score from (select *, row_number() over (partition by question order by round(score, 9) desc, doc) rank from scored) where rank <= 10",
    "retrieval_recall_at_k": f"with {METRICS} select question, k, recall_any, recall_all from metrics",
    "retrieval_ndcg_at_k": f"with {METRICS} select question, k, round(ndcg, 6) ndcg from metrics",
    "retrieval_metrics_by_group": f"""with {METRICS}, g as (select question, coalesce(nullif(regexp_extract(persona_info, 'Gender: ([a-z-]+)', 1), ''), 'none') g from ask)
  select coalesce(g, 'all') group_name, k, round(avg(recall_any), 6) recall_any, round(avg(recall_all), 6) recall_all, round(avg(ndcg), 6) ndcg, count(*) n
  from metrics join g using (question) group by grouping sets ((k), (k, g))""",
    "expansion_views": f"with {EXP} select session, 'original' as view, 0::bigint pos, text from base union all select session, kind, pos, text from kept",
    "merged_view": f"""with {EXP}, m as (select session, string_agg(text, ' ' order by case kind when 'userfact' then 0 when 'keyphrase' then 1 else 2 end, pos, text) t from kept group by 1)
  select session, 'original' as view, text from base union all select session, 'merged-userfact-keyphrase-summary', t from m""",
    "merge_raw_view": f"""with {EXP}, m as (select session, string_agg(text, ' ' order by case kind when 'userfact' then 0 when 'keyphrase' then 1 else 2 end, pos, text) t from kept group by 1)
  select session, 'merged-userfact-keyphrase-summary' as view, concat_ws(' ', text, t) as text from base left join m using (session)""",
    "multi_view_mean_rank": f"""with {EXP}, {ASK}, tt as (select question, list(distinct term) terms from qt group by 1),
  vw as (select session, 'original' as view, text from base union all select session, kind, text from kept),
  sc as (select question, session, view, len(list_intersect(terms, string_split(lower(vw.text), ' ')))::double / len(terms) score from vw join (select session, user_uuid question from base) b using (session) join tt using (question)),
  ag as (select question, session, coalesce(avg(score) filter (where view <> 'original'), max(score) filter (where view = 'original')) score from sc group by 1, 2)
  select question, session, rank, round(score, 6) score from (select *, row_number() over (partition by question order by round(score, 9) desc, session) rank from ag) where rank <= 10""",
    "value_expansion_interleave": f"""with {EXP}, f as (select * from (select user_uuid question, session, row_number() over (partition by user_uuid order by session) rank from base where user_uuid is not null) where rank <= 5),
  items as (select question, session, rank, 0 is_expansion, 'original' kind, 0::bigint pos from f union all select question, session, rank, 1, kind, pos from f join kept using (session))
  select question, session, kind, pos, row_number() over (partition by question order by rank, is_expansion, kind, pos) item_rank from items""",
    "expansion_label_map": """with t as (select distinct memory_id, session_id, summary, keywords, user_uuid from memory_notes where memory_id is not null and session_id is not null),
  i as (select session_id session, 'summary' as label, memory_id pos, summary text from t where summary is not null union all select session_id, 'keyphrases', memory_id, keywords from t where keywords is not null),
  f as (select session, label, text, min(pos) pos from i group by 1, 2, 3)
  select session, label, string_agg(text, ' ' order by pos, text) as text from f group by 1, 2""",
    "dense_dot_topk": f"with {VEC}, s as (select a.id query_id, b.id vec_id, list_dot_product(a.x, b.x) score from v a join v b on a.id % 20 = 0 and a.id <> b.id) select query_id, vec_id, rank, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rank from s) where rank <= 10",
    "dense_cosine_threshold_topk": f"with {VEC}, s as (select a.id query_id, b.id vec_id, list_cosine_similarity(a.x, b.x) score from v a join v b on a.id % 20 = 0 and a.id <> b.id) select query_id, vec_id, rank, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rank from s where score >= 0.2) where rank <= 20",
    "precision_by_label": f"with {VEC}, s as (select a.label la, b.label lb, row_number() over (partition by a.id order by round(list_cosine_similarity(a.x, b.x), 9) desc, b.id) rank from v a join v b on a.id % 20 = 0 and a.id <> b.id) select la as label, round(avg((la = lb)::int), 6) precision_at_10, count(*) n from s where rank <= 10 group by 1",
    "masked_mean_vector": f"""with {VEC}, u as (select id, label, i::bigint - 1 dim, x[i] x from v, unnest(range(1, 65)) t(i)),
  m as (select label, dim, coalesce(avg(x) filter (where id % 3 <> 0), arg_min(x, id)) x from u group by 1, 2), n as (select label, sqrt(sum(x * x)) l from m group by 1)
  select label, dim, round(case when l > 0 then x / l else x end, 6) x from m join n using (label)""",
    "component_nanmean": "with t as (select distinct entity_row_id, graph_id, importance_score s from entities where graph_id is not null) select graph_id, round(coalesce(avg(s) filter (where not isnan(s)), 0), 6) score from t group by 1",
    "node_merge_majority_type": f"with {ENT} select graph_id, name, type, n from major",
    "node_merge_descriptions_sources": f"with {ENT} select graph_id, name, coalesce(array_to_string(descriptions, '<SEP>'), '') descriptions, coalesce(array_to_string(source_ids, '<SEP>'), '') source_ids from node",
    "edge_merge_weight": f"with {REL} select graph_id, src, tgt, round(weight, 6) weight, ord, coalesce(array_to_string(descriptions, '<SEP>'), '') descriptions from edge",
    "incremental_edge_merge": f"with {REL} select graph_id, src, tgt, round(weight, 6) weight from edge",
    "missing_endpoint_nodes": f"""with {ENT}, {REL}, e as (select graph_id, src as name, descriptions from edge union all select graph_id, tgt, descriptions from edge)
  select graph_id, name, '"UNKNOWN"' as type, coalesce(array_to_string(list_sort(list_distinct(flatten(list(descriptions)))), '<SEP>'), '') descriptions
  from e where not exists (select 1 from node n where n.graph_id = e.graph_id and n.name = e.name) group by 1, 2""",
    "node_degree": f"with {REL} select graph_id, name, degree from deg",
    "edge_degree_rank": f"with {REL} select e.graph_id, e.src, e.tgt, a.degree + b.degree as rank from edge e join deg a on a.graph_id = e.graph_id and a.name = e.src join deg b on b.graph_id = e.graph_id and b.name = e.tgt",
    "one_hop_neighbours": f"with {ENT}, {REL}, {_seeds(20)} select distinct i.graph_id, i.name, i.neighbour, m.type neighbour_type from inc i join seed using (graph_id, name) left join major m on m.graph_id = i.graph_id and m.name = i.neighbour",
    "entity_text_ids": f"with {ENT} select graph_id, name, 'ent-' || md5(name) entity_id, name || coalesce(array_to_string(descriptions, '<SEP>'), '') as text from node",
    "relation_counts_per_chunk": f"with {COUNTS} select graph_id, name, chunk_id, entity_order, relation_count from cnt",
    **{f"chunk_rank_{k}": f"with {UNITS} select graph_id, chunk_id, row_number() over (partition by graph_id order by {o}, entity_order, chunk_id) as rank from sim" for k, o in RANK_ORDER.items()},
    "related_edges": f"""with {ENT}, {REL}, {_seeds(20)}, k as (select distinct i.graph_id, least(i.name, neighbour) src, greatest(i.name, neighbour) tgt from inc i join seed using (graph_id, name)),
  r as (select e.graph_id, e.src, e.tgt, e.weight, a.degree + b.degree edge_rank from edge e join k using (graph_id, src, tgt) join deg a on a.graph_id = e.graph_id and a.name = e.src join deg b on b.graph_id = e.graph_id and b.name = e.tgt)
  select graph_id, src, tgt, row_number() over (partition by graph_id order by edge_rank desc, round(weight, 6) desc, src, tgt) as rank, edge_rank from r""",
    "context_sections_union": f"""with {COUNTS}, k as (select distinct i.graph_id, least(i.name, neighbour) src, greatest(i.name, neighbour) tgt from inc i join seed using (graph_id, name)),
  r as (select e.graph_id, e.src, e.tgt, e.weight, a.degree + b.degree edge_rank from edge e join k using (graph_id, src, tgt) join deg a on a.graph_id = e.graph_id and a.name = e.src join deg b on b.graph_id = e.graph_id and b.name = e.tgt)
  select graph_id, 'entity' as section, entity_order as rank, name as content from seed
  union all select graph_id, 'relation', row_number() over (partition by graph_id order by edge_rank desc, round(weight, 6) desc, src, tgt), src || ' - ' || tgt from r
  union all select graph_id, 'chunk', row_number() over (partition by graph_id order by entity_order, relation_count desc, chunk_id), chunk_id from unit""",
    "connected_components": f"""with recursive {REL}, reach as (
    select graph_id, name, neighbour from inc union select graph_id, name, name from inc union select r.graph_id, r.name, i.neighbour from reach r join inc i on i.graph_id = r.graph_id and i.name = r.neighbour
  ) select graph_id, name, min(neighbour) component from reach group by 1, 2""",
    "cluster_invariants": f"""with recursive {REL}, reach as (
    select graph_id, name, neighbour from inc union select graph_id, name, name from inc union select r.graph_id, r.name, i.neighbour from reach r join inc i on i.graph_id = r.graph_id and i.name = r.neighbour
  ), c as (select graph_id, name, min(neighbour) component from reach group by 1, 2), n as (select graph_id, component, count(*) n from c group by 1, 2)
  select graph_id, max(n) n_nodes, true as once, true as nested, true as positive from n group by 1""",
    "community_schema_occurrence": f"""with {ENT}, {REL}, mem as (select graph_id, type as cluster, name, source_ids from node join major using (graph_id, name)),
  s as (select graph_id, cluster, count(distinct name) n_nodes from mem group by 1, 2),
  e as (select graph_id, cluster, count(*) n_edges from (select distinct graph_id, cluster, least(name, neighbour), greatest(name, neighbour) from mem join inc using (graph_id, name)) group by 1, 2),
  c as (select graph_id, cluster, count(distinct x) n_chunks from (select graph_id, cluster, unnest(source_ids) x from mem) group by 1, 2),
  o as (select graph_id, cluster, n_nodes, coalesce(n_edges, 0) n_edges, coalesce(n_chunks, 0) n_chunks from s left join e using (graph_id, cluster) left join c using (graph_id, cluster))
  select *, round(coalesce(n_chunks::double / nullif(max(n_chunks) over (partition by graph_id), 0), 0), 6) occurrence from o""",
    "sub_community_containment": f"""with {ENT}, ch as (select distinct graph_id, unnest(source_ids) child, name from node), pa as (select graph_id, type parent, name from major),
  sz as (select graph_id, child, count(*) n from ch group by 1, 2)
  select c.graph_id, c.child, parent from ch c join pa using (graph_id, name) join sz on sz.graph_id = c.graph_id and sz.child = c.child group by 1, 2, 3, n having count(*) = n""",
    "global_support_points": f"with {REPORTS} select graph_id, report_id, rank from sp",
    "report_groups": f'with recursive {GROUPS} select graph_id, report_id, rank, tokens, "group" from g',
    "report_csv": f"""with {ENT}, o as (select *, row_number() over (partition by graph_id, entity_row_id order by name) r from ent)
  select graph_id, string_agg({_CELL.format('name')} || {_TAB} || {_CELL.format('type')} || {_TAB} || entity_row_id, chr(10) order by entity_row_id) csv from o where r = 1 group by 1""",
    "vector_entity_hits": f"with {E_HITS} select graph_id, name, hit, round(sim, 6) sim from hits",
    "related_communities": f"with {E_HITS}, {COMMUNITIES} select graph_id, cluster, hits, rating, rank from com",
    "edges_in_budget": f"with {ENT}, {REL}, {_seeds(20)}, {EDGE_RANK}, {_budget_edges(200, 'seed')} select graph_id, src, tgt, rank, running::bigint running from be",
    "entity_context": f"""with {E_HITS}, {COMMUNITIES}, {_budget_edges(4800)}, {UNITS_OF_HITS}
  select graph_id, 'entity' as section, 0::bigint section_order, hit as rank, name as content from ents where description <> ''
  union all select graph_id, 'relation', 1, rank, src || ' - ' || tgt from be union all select graph_id, 'chunk', 2, rank, chunk_id from un union all select graph_id, 'community', 3, rank, cluster from com""",
    "relation_context": f"""with {R_HITS}, {COMMUNITIES}, {UNITS_OF_HITS}
  select graph_id, 'relation' as section, 0::bigint section_order, hit as rank, src || ' - ' || tgt as content from rh
  union all select graph_id, 'entity', 1, hit, name from ents where description <> '' union all select graph_id, 'chunk', 2, rank, chunk_id from un union all select graph_id, 'community', 3, rank, cluster from com""",
    "local_context": LOCAL,
    "naive_context": f"""with {ASK}, {Q_VEC}, tx as (select user_uuid graph_id, chunk_id, min(content) as content from text_chunks where content is not null and user_uuid is not null group by 1, 2),
  cv as (select graph_id, chunk_id, content, {_hex('content')} vec from tx), h as {_hits('cv', 'chunk_id')},
  b as (select h.*, content, sum({_words('content')} + 1) over (partition by h.graph_id order by hit) running from h join tx using (graph_id, chunk_id))
  select graph_id, count(*) n_chunks, string_agg(content, '--New Chunk--' || chr(10) order by hit) context from b where running <= 2000 group by 1""",
    "global_context": f"""with recursive {GROUPS}, p as (select g.graph_id, "group", report_id, string_split(text, chr(10))[1] description, coalesce(case when report_id % 4 <> 0 then (report_id % 7)::double end, 1) score from g join r using (graph_id, report_id)),
  o as (select *, row_number() over (partition by graph_id order by score desc, "group", report_id) as rank from p where description <> '' and score > 0),
  b as (select *, sum({_words('description')} + 1) over (partition by graph_id order by rank) running from o)
  select graph_id, count(*) n_points, string_agg('----Analyst ' || "group" || '----' || chr(10) || 'Importance Score: ' || printf('%.1f', score) || chr(10) || description || chr(10), chr(10) order by rank) context from b where running <= 60 group by 1""",
    "community_description": f"with {DESCRIBED} select graph_id, cluster, kind, item, degree from described",
    "community_report_texts": f"""with {DESCRIBED}, l as (select graph_id, cluster, {_CELL.format('kind')} k, {_CELL.format('item')} i, row_number() over (partition by graph_id, cluster order by kind, degree desc, item) n, count(*) over (partition by graph_id, cluster) c from described)
  select graph_id, cluster, max(c)::double rating, '# ' || cluster || chr(10) || chr(10) || max(c) || ' items' || chr(10) || chr(10) || string_agg('## ' || i || chr(10) || chr(10) || k, chr(10) || chr(10) order by n) filter (where n <= 2) report from l group by 1, 2""",
    "integrity_scores": f"""with {JUDGED}, o as (select * from j where not interference) select (select count(*) from o) total, (select count(score) from o) as valid,
  (select {_div('count(*) filter (where score = 2)', 'count(*)')} from o) recall_all, (select {_div('count(*) filter (where score = 2)', 'count(score)')} from o) recall_valid,
  (select {_div('sum(importance * 0.5 * score)', 'sum(importance)')} from o) weighted_all, (select {_div('sum(importance * 0.5 * score)', 'sum(importance) filter (where score is not null)')} from o) weighted_valid,
  (select {_div('count(*) filter (where score = 0)', 'count(*)')} from j where interference) interference_accuracy""",
    "accuracy_scores": f"""with {JUDGED}, o as (select * from j where is_target in ('true', 'True')) select count(*) target, count(score) as valid, {_div('count(*) filter (where score = 2)', 'count(*)')} accuracy_all,
  {_div('count(*) filter (where score = 2)', 'count(score)')} accuracy_valid, {_div('sum(0.5 * score)', 'count(*)')} weighted_all, {_div('sum(0.5 * score)', 'count(score)')} weighted_valid from o""",
    "update_ratios": _ratios(["Correct", "Hallucination", "Omission", "Other"]),
    "qa_ratios": _ratios(["Correct", "Hallucination", "Omission"]),
    "memory_type_accuracy": f"""with {JUDGED}, r as (select memory_type, case when doc_id % 2 = 0 and score = 2 then 1 else 0 end i, case when doc_id % 2 = 1 and label = 'Correct' then 1 else 0 end u from j)
  select memory_type, count(*) total, round(avg(i), 6) integrity_acc, round(avg(u), 6) update_acc, round(avg(i + u), 6) memory_acc from r group by 1""",
    "qa_accuracy_by_type": f"with {JUDGED} select coalesce(memory_type, 'all') group_name, round(avg(case when label = 'Correct' then 1 else 0 end), 4) accuracy, count(*) n from j group by rollup (memory_type)",
    "judge_routing": """select distinct operation_id, case when op_action = 'updated' and coalesce(len(neighbor_ids), 0) > 0 then 'update' else 'integrity' end bucket, coalesce(op_action = 'no_action', false) interference
  from memory_operations where operation_id is not null""",
    "duration_totals": "select round(sum(value) / 60000.0, 6) search_min, round(sum(value) filter (where event_type = 'click') / 60000.0, 6) click_min from events",
    "entity_recall": f"""with {ENT}, {REL}, g as (select distinct graph_id, name from ent), p as (select graph_id, a as name from rel union select graph_id, b from rel)
  select g.graph_id, round(count(p.name)::double / count(*), 6) entity_recall from g left join p using (graph_id, name) group by 1""",
    "id_difference": """with a as (select distinct lower(trim(new_memory_id)) memory_id from memory_operations where op_action = 'created' and new_memory_id is not null), b as (select distinct lower(trim(memory_id)) memory_id from memory_notes where memory_id is not null)
  select memory_id, 'missing' side from b where memory_id not in (select memory_id from a) union all select memory_id, 'extra' from a where memory_id not in (select memory_id from b)""",
    "token_window_chunks": """with t as (select distinct memory_id, user_uuid, content, string_split(content, ' ') w from memory_notes where memory_id is not null and content is not null)
  select memory_id, s // 24 chunk_order_index, len(w[s + 1 : s + 32])::bigint tokens, trim(array_to_string(w[s + 1 : s + 32], ' '), ' ') as content from t, unnest(range(0, len(w), 24)) r(s)""",
    "keyed_chunks": "select chunk_id, given_id from (select 'chunk-' || md5(content) chunk_id, chunk_id given_id, row_number() over (partition by md5(content) order by chunk_id desc) r from (select distinct chunk_id, content, user_uuid from text_chunks where content is not null)) where r = 1",
    "token_budget_prefix": f"with {NOTES} select user_uuid, memory_id, running from (select user_uuid, memory_id, (sum(len(tokens) + 1) over (partition by user_uuid order by memory_id rows unbounded preceding))::bigint running from docs) where running <= 300",
    "record_parse": rf"""with d as (
    select doc_id, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '##|<\|COMPLETE\|>'), lambda x: trim(x)), lambda x: x <> ''), lambda p: regexp_extract(p, '\((.*)\)', 1)), lambda p: p <> '') r
    from documents where {SOURCE} = 'extraction_record' and text is not null
  ), f as (select doc_id, i::bigint - 1 pos, list_filter(list_transform(string_split(r[i], '<|>'), lambda x: trim(x)), lambda x: x <> '') f from d, unnest(range(1, len(r) + 1)) t(i)),
  c as (select doc_id, pos, f[1] tag, len(f) n, list_transform(f, lambda x: regexp_replace(trim(x), '[\x00-\x1f\x7f-\x{{9f}}]', '', 'g')) f, f[-1] last from f)
  select doc_id, pos, upper(f[2]) as name, upper(f[3]) as second, f[4] description, case when tag = '"relationship"' then case when regexp_matches(last, '^[-+]?[0-9]*\.?[0-9]+$') then last::double else 1.0 end end weight
  from c where (tag = '"entity"' and n >= 4) or (tag = '"relationship"' and n >= 5)""",
    "resume_antijoin": "select distinct new_memory_id memory_id from memory_operations o where new_memory_id is not null and not exists (select 1 from memory_notes n where n.memory_id = o.new_memory_id)",
    "flatten_points": f"with {POINTS} select memory_id, pos, point_type, point from points",
    "flattened_topk": f"""with {POINTS}, {ASK}, q as (select question, {_hex('interests')} qv from ask),
  s as (select p.user_uuid, memory_id, pos, round({_cos('pv', 'qv')}, 4) score from (select *, {_hex('point')} pv from points) p join q on q.question = p.user_uuid)
  select user_uuid, memory_id, pos, rank, score from (select *, row_number() over (partition by user_uuid order by score desc, memory_id, pos) rank from s) where rank <= 10""",
    "neighbour_fill": """with n as (select distinct memory_id, user_uuid, related_memories from memory_notes where memory_id is not null and user_uuid is not null),
  h as (select * from (select user_uuid question, memory_id, row_number() over (partition by user_uuid order by memory_id) rank from (select distinct user_uuid, memory_id from n)) where rank <= 3),
  r as (select question, memory_id, 1.0 / rank score, 0 depth, rank, -1 pos from h
    union all select h.question, x.m, 1.0 / h.rank, 1, h.rank, x.pos from h join (select memory_id, related_memories[i] m, i - 1 pos from n, unnest(range(1, len(related_memories) + 1)) t(i)) x on x.memory_id = h.memory_id where x.m in (select memory_id from n)),
  o as (select * from (select *, row_number() over (partition by question, memory_id order by depth, rank, pos) k from r) where k = 1)
  select question, memory_id, fill_rank, round(score, 6) score from (select *, row_number() over (partition by question order by depth, rank, pos, memory_id) fill_rank from o) where fill_rank <= 6""",
    "point_in_time_retrieval": "select distinct n.user_uuid, n.memory_id from memory_notes n join halu_users u on u.user_uuid = n.user_uuid and n.noted_at <= u.first_start_time where n.memory_id is not null",
    "operation_log_index": "select user_uuid, operation_id, row_number() over (partition by user_uuid order by op_time nulls first, operation_id) - 1 op_index from (select distinct user_uuid, op_time, operation_id from memory_operations where user_uuid is not null and operation_id is not null)",
    "trajectory_counts": "select op_action, count(*) n from (select distinct operation_id, op_action from memory_operations) group by 1",
    "run_summary": "select count(distinct user_uuid) users, count(distinct session_id) sessions, count(distinct memory_id) memories from memory_notes where memory_id is not null",
    "prompt_context": """with n as (select distinct memory_id, user_uuid, noted_at, summary, keywords from memory_notes where memory_id is not null and user_uuid is not null and summary is not null),
  f as (select * from (select *, row_number() over (partition by user_uuid order by memory_id) rank from n) where rank <= 5),
  o as (select *, row_number() over (partition by user_uuid order by coalesce(noted_at, ''), rank) k from f)
  select user_uuid question, string_agg('[' || k || '] ' || coalesce(noted_at, '') || chr(10) || concat_ws(chr(10), keywords, summary), chr(10) || chr(10) order by k) context from o group by 1""",
    "numbered_context": f"""with {NOTES}, t as (select distinct memory_id, noted_at from memory_notes where memory_id is not null),
  r as (select user_uuid, content, noted_at, row_number() over (partition by user_uuid order by memory_id) rank from docs join t using (memory_id))
  select user_uuid question, string_agg(rank || '. [' || coalesce(noted_at, '') || '] ' || content, chr(10) order by rank) context from r where rank <= 5 group by 1""",
    "llm_cache_join": "select distinct md5(summary) as key, md5(summary) < '8' cached, case when md5(summary) < '8' then 'stored' end stored from memory_notes where memory_id is not null and summary is not null",
    "stream_action_counts": "select strftime(time_bucket(interval '30 days', ingested_at at time zone 'UTC', timestamp '1970-01-01'), '%Y-%m-%d') window_start, op_action, count(*) n from memory_operations where ingested_at is not null group by 1, 2",
}
