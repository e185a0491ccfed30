"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

_SYMBOLS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * p + 1}, 5))::bigint >> {s}) & 31)::int, 1)"
    for p in range(8)
    for s in (15, 10, 5, 0)
)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC = f"""
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
     d as (select page_id, octet_length(body) as n, sha1(body) as h from p),
     m as (select *, max(page_id) over (partition by h, n) as first_id from d)
select page_id, n::bigint as payload_bytes, {_SYMBOLS} as payload_digest,
       case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first_id then first_id end as refers_to
from m
"""

_CHAT = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as body
  from conversations),
p as (select distinct conv_id, speaker as participant from t where speaker <> 'system'),
r as (
  select t.conv_id, p.participant, t.turn, t.speaker, t.body,
    case when t.speaker = p.participant then 'assistant' when t.speaker = 'system' then 'system' else 'user' end as role,
    case when t.speaker = p.participant then '<|assistant|>' || chr(10)
         when t.speaker = 'system' then '<|system|>' || chr(10)
         else '<|user name=' || replace(t.speaker, '<|', '< |') || '|>' || chr(10) end as mark
  from t join p on t.conv_id is not distinct from p.conv_id),
c as (
  select *, mark || body || '<|end|>' || chr(10) as content from r),
s as (
  select *,
    row_number() over w as position,
    (sum(length(content)) over w)::bigint as upto
  from c window w as (partition by conv_id, participant order by turn nulls first, speaker, body
                      rows between unbounded preceding and current row))
select conv_id, participant, position, turn, role, case when role = 'user' then speaker end as name, content,
  upto - length(content) as start, upto as "end",
  case when role = 'assistant' then upto - length(content) + length(mark) end as mask_start,
  case when role = 'assistant' then upto - 1 end as mask_end
from s
"""

_EXACT = f"""
with d as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from d window g as (partition by text_sha256)
"""

_NEAR = f"""
with recursive w as materialized (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as words from documents),
s as materialized (
  select distinct doc_id, shingle from (
    select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
      else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle
    from w)),
n as materialized (select doc_id, count(*) as n from s group by all),
i as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as n_both
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as materialized (
  select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * n_both >= 75 * (x.n + y.n - n_both)),
e as materialized (select a, b from l union all select b, a from l),
r(doc_id, other) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id)
join (select doc_id, min(other) as component_id from r group by all) c using (doc_id)
"""

_REPEATS = """
with w as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
p as materialized (
  select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
m as (select h, min(doc_id) as least from p group by h),
g as (
  select distinct doc_id, unnest(range(i, i + 50)) as place
  from p join m using (h) where doc_id > least),
gone as (select doc_id, list(place) as places from g group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when places is null then words else
    list_transform(list_filter(range(1, len(words) + 1), lambda k: not list_contains(places, k)), lambda k: words[k])
  end, ' '), '')) as kept_sha256
from w left join gone using (doc_id)
"""

_TRIE = """
with recursive t as materialized (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from conversations where conv_id is not null),
v as materialized (
  select c, c - c % 100 as base,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, x: list_reduce(list_concat([xor(a, x)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda y, z: case when y % 2 = 1 then xor(y // 2, 3988292384::bigint) else y // 2 end)), 4294967295::bigint) % 6 as h
  from (select distinct c from t)),
o as (
  select v.c, 0 as own, t.i, t.role, t.text from v join t on t.c = v.base and t.i <= v.h
  union all
  select v.c, 1, t.i, t.role, t.text from v join t on t.c = v.c and t.i > v.h),
n as materialized (
  select c, row_number() over (partition by c order by own, i) as d, length(text) as chars,
    sha256(length(role) || ':' || role || text) as m
  from o),
p(c, d, k, up, chars) as (
  select c, 0::bigint, '', null::varchar, 0::bigint from v
  union all
  select n.c, n.d, sha256(p.k || n.m), p.k, n.chars from p join n on n.c = p.c and n.d = p.d + 1),
q as materialized (
  select k, any_value(d) as d, any_value(up) as up, any_value(chars) as chars, min(c) as conv_id, count(*) as n_convs from p group by k),
ch as (select up as k, count(*) as n_children from q where up is not null group by up),
s as materialized (
  select q.*, coalesce(n_children, 0) as n_children, up_q.conv_id as parent_conv_id
  from q left join ch using (k) left join (select k as up, conv_id from q) up_q using (up)),
b as (
  select p.k, count(*) filter (s.n_children = 0) as n_leaves, sum((s.n_convs - 1) * s.chars)::bigint as saved_tokens
  from s join p on p.c = s.conv_id and p.d <= s.d group by p.k),
l as (select c, max(d) as d from p group by c),
e as (select p.k, sha256(string_agg(c::varchar, ',' order by c)) as h from l join p using (c, d) group by p.k)
select s.conv_id, s.d::bigint as depth, s.parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved_tokens,
  coalesce(e.h, sha256('')) as ends_sha256
from s join b using (k) left join e using (k)
"""

ORACLES = {
    "op1_warc": _WARC,
    "op2_chat": _CHAT,
    "op5_minhash": _NEAR,
    "op6_exact": _EXACT,
    "op8_substring": _REPEATS,
    "op13_trie": _TRIE,
}
