"""DuckDB SQL of the queries that SQL can state: op1, op7, op8, op10, op11 and op13 (op2's is in ``secrets``)."""

from __future__ import annotations

#: Whitespace of the contract; A-Z alone are lower-cased, as lower() would touch other letters.
_WORDS = "string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+')"

#: Shingle sets, links by counts of common shingles, and the smallest reachable doc_id.
NEAR_DUPLICATES = f"""with recursive docs as (select doc_id, case when regexp_matches(text, '[^\\x20\\x09-\\x0D]') then {_WORDS} else [] end as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from docs),
classes as (select hash(list_sort(s)) as c, any_value(s) as s, len(any_value(s)) as n, min(doc_id) as rep from sets where len(s) > 0 group by list_sort(s)),
cells as (select rep, n, unnest(s) as x from classes),
links as (select a.rep as a, b.rep as b from cells a join cells b on a.x = b.x and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways as (select a, b from links union all select b, a from links),
reach(node, low) as (select rep, rep from classes union select w.b, r.low from reach r join ways w on w.a = r.node where r.low < w.b),
found as (select node, min(low) as low from reach group by node)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(f.low, d.doc_id) as component_id, coalesce(f.low, d.doc_id) = d.doc_id as kept
from sets d left join classes c on len(d.s) > 0 and list_sort(d.s) = list_sort(c.s) left join found f on f.node = c.rep"""

#: Every string of 50 bytes as hexadecimal digits, its smallest document, and the bytes that later ones cover.
REPEATS = """with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as (select doc_id, p, substr(h, 2 * p + 1, 498) as h from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 200)) as p from docs)),
strings as (select doc_id, p + k as i, substr(h, 2 * k + 1, 100) as s from (select doc_id, p, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as k from pieces)),
first as (select s, min(doc_id) as low from strings group by s),
hit as (select doc_id, i, coalesce(lag(i) over w, -100) as before from strings join first using (s) where low < doc_id window w as (partition by doc_id order by i)),
spans as (select doc_id, i, sum(case when i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as span from hit),
runs as (select doc_id, span, min(i) as a, max(i) + 50 as b from spans group by doc_id, span),
gaps as (select doc_id, a, b, coalesce(lag(b) over w, 0) as last from runs window w as (partition by doc_id order by a)),
cut as (select g.doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) as head, max(b) as b, sum(b - a)::bigint as n_removed, count(*) as n_spans from gaps g join docs using (doc_id) group by g.doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when c.doc_id is null then h else coalesce(head, '') || substr(h, 2 * b + 1) end)) as kept_sha256
from docs d left join cut c using (doc_id)"""

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20"""

#: A digest's 40 hexadecimal digits are 8 groups of 20 bits, each four letters of base32.
WARC = """with p as (select page_id, coalesce(html, '') as h from pages where page_id is not null),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x, max(page_id) over (partition by sha1(h)) as last from p),
b as (select *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (5 * i + 1)::int, 5))::bigint >> k) & 31)::int + 1, 1)), '')), '') as payload_digest from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to from b"""


#: As NEAR_DUPLICATES with shingles of three words, 90 in 100, and the rows that each row links with.
JACCARD_JOIN = f"""with recursive docs as (select doc_id, case when regexp_matches(text, '[^\\x20\\x09-\\x0D]') then {_WORDS} else [] end as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from docs),
classes as (select hash(list_sort(s)) as c, any_value(s) as s, len(any_value(s)) as n, min(doc_id) as rep, count(*) as copies from sets where len(s) > 0 group by list_sort(s)),
cells as (select rep, n, unnest(s) as x from classes),
links as (select a.rep as a, b.rep as b from cells a join cells b on a.x = b.x and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ways as (select a, b from links union all select b, a from links),
reach(node, low) as (select rep, rep from classes union select w.b, r.low from reach r join ways w on w.a = r.node where r.low < w.b),
found as (select node, min(low) as low from reach group by node),
others as (select w.a as node, sum(c.copies) as n from ways w join classes c on c.rep = w.b group by w.a)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(f.low, d.doc_id) as component_id, (coalesce(c.copies - 1, 0) + coalesce(o.n, 0))::bigint as n_links
from sets d left join classes c on len(d.s) > 0 and list_sort(d.s) = list_sort(c.s) left join found f on f.node = c.rep left join others o on o.node = c.rep"""

#: The crc32 of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""

#: Nodes by the digest of all their turns, subtrees by all pairs of a node and one below it.
TRIE = f"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, {_CRC} % 9 as h, conv_id - conv_id % 5 as source from t group by conv_id),
p as (select c.conv_id, c.h, c.source, least(c.h, coalesce(s.n, 0)) as took from c left join c s on s.conv_id = c.source),
r as (select p.conv_id, t.i as place, role, text from p join t on t.conv_id = p.source and t.i < p.took union all select p.conv_id, p.took + t.i - p.h, role, text from p join t on t.conv_id = p.conv_id and t.i >= p.h),
named as (select conv_id, place + 1 as depth, octet_length(encode(text)) as size, md5(string_agg(hex(encode(role)) || ':' || hex(encode(text)), ',') over (partition by conv_id order by place)) as k from r union all select conv_id, 0, 0, '' from c),
path as (select *, lag(k) over w as up, depth = max(depth) over (partition by conv_id) as last from named window w as (partition by conv_id order by depth)),
nodes as (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, any_value(up) as up, (count(*) - 1) * max(size) as own, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '') as ends from path group by depth, k),
counted as (select n.*, coalesce(m.n_children, 0) as n_children from nodes n left join (select depth - 1 as depth, up as k, count(*) as n_children from nodes where depth > 0 group by all) m using (depth, k)),
below as (select distinct a.depth, a.k, b.depth as d, b.k as j from path a join path b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (select w.depth, w.k, sum(x.own)::bigint as saved_tokens, count(*) filter (x.n_children = 0) as n_leaves from below w join counted x on x.depth = w.d and x.k = w.j group by w.depth, w.k)
select n.conv_id, n.depth::bigint as depth, m.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) as ends_sha256
from counted n join sums s using (depth, k) left join nodes m on m.depth = n.depth - 1 and m.k = n.up"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": NEAR_DUPLICATES, "op7_substrings": REPEATS, "op8_topk": TOP_K, "op10_warc": WARC, "op11_jaccard": JACCARD_JOIN, "op13_trie": TRIE}
