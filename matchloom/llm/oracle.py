"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op4_vector_search"] = """
with v as (
  select cast(vec_id as bigint) as vec_id,
         list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 5
"""

ORACLE["op2_decontamination"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
),
iw as (
  select distinct item_id, w[s:s + 9] as win, len(w[s:s + 9]) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)
),
sizes as (select distinct n from iw),
dw as (
  select doc_id, s, n, w[s:s + n - 1] as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes)
),
hits as (select dw.doc_id, dw.s, dw.n, iw.item_id from dw join iw on dw.win = iw.win and dw.n = iw.n),
covered as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from hits)) group by doc_id
),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""

ORACLE["op9_line_spread"] = """
with l as (
  select doc_id, source, row_number() over (partition by doc_id order by pos) as pos, line
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos
        from documents where text is not null)
),
shared as (
  select trim(line, ' ') as bare from l where length(trim(line, ' ')) >= 1
  group by 1 having count(distinct source) >= 8
),
met as (
  select l.*, row_number() over (partition by trim(line, ' ') order by doc_id, pos) as nth
  from l join shared on trim(l.line, ' ') = shared.bare
),
gone as (select doc_id, pos from met where nth > 1),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
         string_agg(case when g.pos is null then l.line end, chr(10) order by l.pos) as text
  from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines,
       cast(coalesce(n_removed, 0) as bigint) as n_removed,
       case when d.text is null then null else sha256(coalesce(kept.text, '')) end as kept_sha256
from documents d left join kept using (doc_id)
"""

ORACLE["op3_repeated_passages"] = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
),
w as (
  select doc_id, s, md5(substr(h, 2 * s + 1, 800)) as k
  from (select doc_id, h, unnest(range(0, n - 399)) as s from d where n >= 400)
),
dup as (select doc_id, s from (select *, count(*) over (partition by k) as c from w) where c > 1),
marked as (
  select doc_id, s, sum(fresh) over (partition by doc_id order by s) as island
  from (select *, case when s - lag(s) over (partition by doc_id order by s) <= 400 then 0 else 1 end as fresh from dup)
),
spans as (
  select *, lag(b, 1, 0) over (partition by doc_id order by a) as before
  from (select doc_id, min(s) as a, max(s) + 400 as b from marked group by doc_id, island)
),
kept as (
  select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as front
  from spans join d using (doc_id) group by doc_id
)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join kept using (doc_id)
"""
