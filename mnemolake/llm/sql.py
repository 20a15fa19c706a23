"""Oracle SQL of the queries that DuckDB can express over whole tables."""

_ID = r"case when regexp_matches(lower(trim({0}, e' \t\n\r ')), '^[0-9a-f]{{10}}_mem_[0-9]+$') then lower(trim({0}, e' \t\n\r ')) end"

P1_FOUND = f"""
with recursive ops as (
  select {_ID.format('new_memory_id')} n, {_ID.format('merge_into_id')} m, {_ID.format('resulting_memory_id')} r from memory_operations
), links as (
  select n a, m b from ops where n is not null and m is not null and n <> m
  union select n, r from ops where n is not null and r is not null and n <> r
), both_ways as (select a, b from links union select b, a from links),
reach as (
  select a, a b from both_ways union select a, b from both_ways
  union select r.a, l.b from reach r join both_ways l on r.b = l.a
)
select a as memory_id, min(b) as group_id from reach group by a
"""

P6_FOUND = """
with w as (
  select distinct memory_id, list_distinct(list_transform(regexp_extract_all(coalesce(content, '') || ' ' || coalesce(summary, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x))) words
  from memory_notes where memory_id is not null
), t as (select memory_id, len(words) n, unnest(words) tok from w)
select a.memory_id memory_id_a, b.memory_id memory_id_b
from t a join t b on a.tok = b.tok and a.memory_id < b.memory_id and a.n * 10 >= b.n * 7 and b.n * 10 >= a.n * 7
group by a.memory_id, b.memory_id, a.n, b.n
having count(*) * 17 >= 7 * (a.n + b.n)
"""

P5_FOUND = r"""
select distinct chunk_id from text_chunks
where chunk_id is not null and len(regexp_extract_all(content, '[A-Za-z0-9]+|[^ \t\r\n]')) > 1200
"""

P4_FOUND = """
with u as (
  select memory_id id, min(vec::double[]) v from note_vectors
  where memory_id is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0
  group by memory_id
), s as (
  select a.id x, b.id y, row_number() over (partition by a.id order by list_cosine_similarity(a.v, b.v) desc, b.id) r from u a join u b on a.id <> b.id
)
select distinct least(x, y) memory_id_a, greatest(x, y) memory_id_b from s where r <= 5
"""

P4_NEIGHBOURS = P4_FOUND.replace("select a.id x, b.id y,", "select a.id x, b.id y, list_cosine_similarity(a.v, b.v) c,").split("select distinct least")[0] + "select x memory_id, y neighbour, round(c, 6) cos, r::int as rank from s where r <= 5"

P5_CHECKED = r"""
with c as (select chunk_id, len(regexp_extract_all(any_value(content), '[A-Za-z0-9]+|[^ \t\r\n]')) n from text_chunks where chunk_id is not null and content is not null group by 1)
select count(*) chunks, count(*) filter (where n > 1200) as cut, 0::bigint as over, 0::bigint lost, 0::bigint uneven from c
"""

P6_GROUPS = """
with recursive w as (
  select distinct memory_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(content, '') || ' ' || coalesce(summary, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)))) words
  from memory_notes where memory_id is not null
), c as (select memory_id, words, min(memory_id) over (partition by words) class_id from w where len(words) > 0),
t as (select distinct class_id, len(words) n, unnest(words) tok from c),
p as (
  select a.class_id a, b.class_id b from t a join t b on a.tok = b.tok and a.class_id < b.class_id and a.n * 10 >= b.n * 7 and b.n * 10 >= a.n * 7
  group by a.class_id, b.class_id, a.n, b.n having count(*) * 17 >= 7 * (a.n + b.n)
), e as (select a, b from p union all select b, a from p),
r as (select a, a b from e union select a, b from e union select r.a, e.b from r join e on r.b = e.a),
g as (select a, min(b) group_id from r group by 1), d as (select a, count(*) n_links from e group by 1)
select memory_id, class_id, coalesce(group_id, class_id) group_id, coalesce(n_links, 0) n_links from c left join g on g.a = class_id left join d on d.a = class_id
"""

P7_CHECKED = "select count(distinct doc_id) texts, 0::bigint lost, 0::bigint split, 0::bigint as over from documents where doc_id is not null and text <> ''"

P8_CHECKED = """
select replace(lower(trim(source)), '-', '_') source, max(max_repeats)::bigint max_repeats, true within_cap, true near_rate from mix_targets where source is not null group by 1
"""

ORACLE = {"p4_found": P4_FOUND, "p4_neighbours": P4_NEIGHBOURS, "p5_found": P5_FOUND, "p5_checked": P5_CHECKED, "p1_found": P1_FOUND, "p6_found": P6_FOUND, "p6_groups": P6_GROUPS, "p7_checked": P7_CHECKED, "p8_checked": P8_CHECKED}
