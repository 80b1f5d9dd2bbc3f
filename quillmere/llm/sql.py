"""DuckDB SQL that gives the same rows as the registered queries, where SQL can express them."""

OP10 = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8)),
hit as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from hit) group by doc_id),
f as (
  select d.doc_id, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines
  from d left join cov using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or n_symbols * 10 > n_words
            or n_dup_lines * 100 > n_lines * 50 or word_chars < n_words * 2 or word_chars > n_words * 16) as kept
from f
"""

OP8 = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
  from e a join e b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

OP5 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (
  select page_id, h, max(page_id) over (partition by h) as best,
         string_agg_bits as bits
  from (select *, list_aggregate(list_transform(range(1, 41), lambda i:
          substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (strpos('0123456789abcdef', substr(sha1(h), i, 1)) - 1), 4)), 'string_agg', '') as string_agg_bits from p))
select page_id, strlen(h)::bigint as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * k + 1, 1)::int + 8 * substr(bits, 5 * k + 2, 1)::int + 4 * substr(bits, 5 * k + 3, 1)::int
           + 2 * substr(bits, 5 * k + 4, 1)::int + substr(bits, 5 * k + 5, 1)::int, 1)), 'string_agg', '') as payload_digest,
       case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id < best then best end as refers_to
from d
"""

OP11 = r"""
with tbl as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_transform(range(8), lambda k: 0::bigint)),
           lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
texts as (
  select 's' as side, doc_id as id, coalesce(text, '') as t from documents
  union all select 't', item_id, coalesce(text, '') from benchmark),
w as (
  select side, id, list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
f as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
names as (select f, hex(f) as h from (select distinct f from f)),
crc as (
  select f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i:
           16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
           lambda c, b: xor(c >> 8, tbl.t[(xor(c, b) & 255) + 1]))) % 10000 as bucket
  from names, tbl),
fb as (select side, id, bucket from f join crc using (f)),
n as (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from fb group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from n) + 10000)::double / ((s + 1)::double * ((select sum(t) from n) + 10000)::double)))::bigint as g from n),
weight as (select id, count(*) as n_features, floor(sum(g)::double / count(*))::bigint as weight from fb join gain using (bucket) where side = 's' group by id),
h as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('7:' || id)[i]) - 1), lambda a, b: 16 * a + b) as h
  from w left join weight using (id) where side = 's'),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from h),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20)
select doc_id, n_features, weight, score,
       case when rank <= floor(25 * (select count(*) from drawn) / 100) then rank end as rank
from scored left join drawn using (doc_id)
"""

ORACLES = {"op11_importance": OP11, "op5_warc": OP5, "op8_topk_search": OP8, "op10_quality_rules": OP10}
