"""DuckDB SQL that gives the same rows as the registered queries."""

_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_SQUEEZE = r"regexp_replace(regexp_replace({}, '[ \t\n\r]+', ' ', 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


def _words(text: str) -> str:
    return _WORDS.format(text)


def _squeeze(text: str) -> str:
    return _SQUEEZE.format(text)


_POSTINGS = f"""
tok as (select doc_id, {_words("coalesce(text, '')")} as w from documents),
post as (select term, doc_id, count(*) as tf, any_value(doc_len) as doc_len
         from (select doc_id, len(w) as doc_len, unnest(w) as term from tok) group by term, doc_id),
tot as (select count(*) as n_docs, sum(len(w)) / count(*) as avg_len from tok)"""


def _bm25(asked: str) -> str:
    """CTEs ending in bm(qid, doc_id, score, n_terms) for questions(qid, text)."""
    return f"""{_POSTINGS},
asked as (select distinct qid, unnest({_words("text")}) as term from ({asked})),
dfs as (select term, count(*) as df from post group by term),
bm as (select qid, doc_id, sum((ln(n_docs / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) as score,
              count(*) as n_terms
       from asked join post using (term) join dfs using (term) cross join tot group by qid, doc_id)"""


_QUESTIONS = "select item_id as qid, text from benchmark"
_BM = _bm25(_QUESTIONS)
_RANK = "row_number() over (partition by qid order by round(score, 6) desc, doc_id)"
_DENSE = """
dn as (select q.vec_id as qid, v.vec_id as doc_id,
              round(list_inner_product(q.embedding::double[], v.embedding::double[]), 9) as score
       from embeddings v cross join embeddings q
       where v.vec_id in (select doc_id from documents) and q.vec_id in (select item_id from benchmark)),
dr as (select *, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rank from dn)"""
_FUSED = f"""{_BM}, {_DENSE},
br as (select qid, doc_id, {_RANK} as rank from bm),
rr as (select qid, doc_id, sum(1000000000000 // (60 + rank)) as s
       from (select qid, doc_id, rank from dr where rank <= 20 union all select qid, doc_id, rank from br where rank <= 20) group by 1, 2),
fused as (select qid, doc_id, ((20000 * s + max(s) over (partition by qid)) // (2 * max(s) over (partition by qid))) / 10000.0 as score from rr)"""
_FUSED_ALL = _FUSED.replace(" where rank <= 20", "")
_SPLIT = rf"""
parts as (select qid, text, i as pos, l[i] as part
          from (select qid, text, l, unnest(range(1, len(l) + 1)) as i
                from (select qid, text, case when len(f) > 0 then f[1:3] else [text] end as l
                      from (select qid, text, list_filter(list_transform(string_split_regex(text, '[?？；;。]|(?:以及|并且|还有|同时|分别)'), lambda x: trim(x, ' ，,、')), lambda x: x <> '') as f
                            from ({_QUESTIONS})))))"""


def letters(x: str) -> str:
    """Distinct lower-case characters but punctuation and white space."""
    return rf"list_filter(list_distinct(string_split(regexp_replace(lower({x}), '[ \t\n\r\x0b\x0c，。？！；;,.!?]', '', 'g'), '')), lambda v: v <> '')"


def traced(original: str, query: str) -> str:
    """Whether the query can be traced to the original."""
    return f"""(len(list_filter(regexp_extract_all(lower({query}), '[a-z0-9_]{{2,}}'), lambda t: contains(lower({original}), t))) > 0
       or (len({letters(query)}) > 0 and len(list_intersect({letters(original)}, {letters(query)})) * 5 >= len({letters(query)})))"""


_EVENTS = "e as (select *, epoch_us(ts) as us from events)"
_ANSWERS = """
ans as (select conv_id, turn, case when turn % 2 = 0 then text else text || ' [S' || lpad((turn + 1)::varchar, 4, '0') || ']' end as text
        from conversations where role = 'assistant'),
lines as (select conv_id, turn, i as line, string_split(text, chr(10))[i] as raw
          from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from ans)),
cl as (select conv_id, turn, line, len(regexp_extract_all(raw, '\\[S(\\d{4})\\]')) as n_citations,
              nullif(regexp_extract(raw, '\\[S(\\d{4})\\]', 1), '') as first_ref,
              regexp_replace(regexp_replace(raw, '\\[S(\\d{4})\\]', '', 'g'), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') as claim
       from lines),
claims as (select * from cl where claim <> '' and not starts_with(claim, '#'))"""
_JUDGED = f"""{_BM},
found as (select qid, doc_id, {_RANK} as rank from bm),
expected as (select qid, count(d.doc_id) as n_expected from ({_QUESTIONS}) q left join documents d on contains(lower(d.text), lower(q.text)) group by qid),
judged as (select f.qid, f.doc_id, f.rank, d.source, d.lang, contains(lower(d.text), lower(q.text)) as relevant, n_expected
           from found f join ({_QUESTIONS}) q using (qid) join expected using (qid) join documents d using (doc_id) where f.rank <= 10)"""
_BEST = """
select qid, doc_id, shared from (select *, rank() over (partition by qid order by shared desc) as r from s where shared > 0) where r = 1"""
_STALE = "stale as (select doc_id, sha256(case when lang = 'de' then text || '!' else text end) as digest from documents where source <> 'src3')"
_PREDICTED = """
pred as (select doc_id, lang, (length(text) - length(translate(text, '#*$%&|<>!', ''))) * 50 <= length(text) as a,
                (len(string_split(text, chr(10))) - len(list_distinct(string_split(text, chr(10))))) * 3 <= len(string_split(text, chr(10)))
                and length(text) >= 60 as b
         from documents)"""
_NEAREST = """
select event_type, max(n)::bigint as n,
       max(case when i = round_even((n - 1) * 0.5, 0) then value end) as p50,
       max(case when i = round_even((n - 1) * 0.95, 0) then value end) as p95
from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n
      from {} where value is not null) group by event_type"""

ORACLES = {
    "dense_topk": f"with {_DENSE} select qid, doc_id, rank::int as rank, round(score, 6) as score from dr where rank <= 5",
    "bm25_topk": f"with {_BM} select qid, doc_id, rank::int as rank, round(score, 6) as score from (select *, {_RANK} as rank from bm) where rank <= 12",
    "bm25_match_all": f"""with {_BM},
need as (select qid, count(*) as need from asked group by qid)
select qid, doc_id, round(score, 6) as score from bm join need using (qid) where n_terms = need""",
    "rrf_fusion": f"with {_FUSED} select qid, doc_id, score from fused",
    "hybrid_search": f"with {_FUSED} select qid, doc_id, score, rank::int as rank from (select *, {_RANK} as rank from fused) where rank <= 5",
    "hybrid_filtered": f"with {_FUSED_ALL} select qid, doc_id, rank::int as rank, score, lang from (select *, {_RANK} as rank from fused join documents using (doc_id) where lang in ('en', 'de')) where rank <= 5",
    "hybrid_dedup": f"""with {_FUSED},
u as (select qid, doc_id, score, row_number() over (partition by qid, {_squeeze("coalesce(text, '')")} order by score desc, doc_id) as n from fused join documents using (doc_id))
select qid, doc_id, score, rank::int as rank from (select qid, doc_id, score, {_RANK} as rank from u where n = 1) where rank <= 5""",
    "batch_questions": f"""with {_SPLIT.lstrip()}, {_bm25("select qid * 1000 + pos as qid, part as text from parts")},
top as (select qid // 1000 as qid, doc_id, round(score, 6) as score from (select *, {_RANK} as rank from bm) where rank <= 5),
best as (select qid, doc_id, max(score) as score from top group by 1, 2)
select qid::bigint as qid, doc_id, score, rank::int as rank from (select *, {_RANK} as rank from best) where rank <= 5""",
    "rerank_overlap": f"""with {_BM},
found as (select qid, doc_id from (select qid, doc_id, {_RANK} as rank from bm) where rank <= 20),
s as (select qid, doc_id, list_distinct({_words("q.text")}) as a, list_distinct({_words("d.text")}) as b from found join ({_QUESTIONS}) q using (qid) join documents d using (doc_id)),
o as (select qid, doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as score from s)
select qid, doc_id, score, rank::int as rank from (select *, {_RANK} as rank from o) where rank <= 5""",
    "backtrace_raw": """select doc_id, source, lang from documents d where exists (
  select 1 from documents s join labels l using (doc_id) where l.quality = 1 and s.n_chars < 500 and s.source = d.source and s.lang = d.lang)""",
    "query_rewrite": """with r as (select item_id as qid, text, contains(lower(text), 'with') as a, contains(lower(text), 'the th') or contains(lower(text), 'that th') as b, contains(lower(text), 'ing ') as c from benchmark)
select qid, text || ' ' || array_to_string(list_filter([case when a then 'along beside' end, case when b then 'these' end, case when c then 'doing' end], lambda x: x is not null), ' ') as rewritten,
       array_to_string(list_filter([case when a then 'with' end, case when b then 'the' end, case when c then 'ing' end], lambda x: x is not null), ',') as applied from r""",
    "query_split": f"with {_SPLIT.lstrip()} select qid, pos::bigint as pos, part from parts",
    "traceable_parts": f"with {_SPLIT.lstrip()} select qid, pos::bigint as pos, {traced('text', 'part')} as traceable from parts",
    "postings": f"with {_POSTINGS.lstrip()} select term, doc_id, tf, doc_len::bigint as doc_len from post",
    "term_stats": f"with {_POSTINGS.lstrip()} select term, count(*) as df, sum(tf)::bigint as cf from post group by term",
    "corpus_stats": f"with {_POSTINGS.lstrip()} select count(*) as n_docs, sum(len(w))::bigint as n_tokens, round(avg(len(w)), 6) as avg_len from tok",
    "chunk_ids": """select doc_id || '__' || lang as document_id, source as section,
  doc_id || '__' || lang || '_' || substr(sha256(doc_id || '__' || lang || chr(10) || source || chr(10) || text), 1, 16) as chunk_id from documents""",
    "dedup_prefer": "select digest, doc_id, source from (select sha256(text) as digest, doc_id, source, row_number() over (partition by sha256(text) order by n_chars desc, doc_id) as n from documents) where n = 1",
    "index_health": f"""with {_STALE}, now as (select doc_id, sha256(text) as digest from documents where source <> 'src5')
select coalesce(n.doc_id, s.doc_id) as doc_id, case when s.doc_id is null then 'missing' when n.doc_id is null then 'orphaned' when n.digest is distinct from s.digest then 'stale' else 'current' end as status
from now n full join stale s on n.doc_id = s.doc_id""",
    "index_upsert": "select doc_id, lang, case when lang = 'de' then -n_chars else n_chars end as n from documents",
    "staged_validation": """select doc_id, 'left' as side from (select doc_id from documents except select vec_id from embeddings)
union all select vec_id, 'right' from (select vec_id from embeddings except select doc_id from documents)""",
    "inventory_last": "select source, count(*) as n_rows, arg_max(lang, doc_id) as lang, arg_max(n_chars, doc_id) as n_chars, max(doc_id) as doc_id from documents group by source",
    "facet_counts": "select 'lang' as field, lang as value, count(*) as n from documents group by lang union all select 'source', source, count(*) from documents group by source",
    "line_segments": r"""with l as (select doc_id, i - 1 as pos, regexp_replace(string_split(text, chr(10))[i], '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') as line
  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))
select doc_id, pos::bigint as pos, sha256(line) as digest from l where line <> '' and not starts_with(line, '#')""",
    "transcript_lines": r"""select conv_id as doc_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as pos, turn::double as start, turn + 0.5::double as "end",
  sha256(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '^[ \t]+|[ \t]+$', '', 'g')) as digest, from conversations""",
    "segment_lead_fill": f'with {_EVENTS} select event_id, user_id, us, coalesce(lead(us) over (partition by user_id order by us, event_id), us) as "end" from e',
    "contiguous_runs": f"""with {_EVENTS},
s as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) < 14400000000 then 0 else 1 end as fresh from e),
r as (select user_id, us, sum(fresh) over (partition by user_id order by us, event_id rows unbounded preceding) as run from s),
g as (select user_id, run, min(us) as start, max(us) as "end", count(*) as n from r group by 1, 2)
select user_id, start, "end", n from (select *, row_number() over (partition by user_id order by n desc, run) as k from g) where k = 1""",
    "merged_intervals": f"""with {_EVENTS}, i as (select user_id, us - 1800000000 as a, us + 1800000000 as z from e),
m as (select *, case when a <= max(z) over (partition by user_id order by a, z rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from i),
g as (select *, sum(fresh) over (partition by user_id order by a, z rows unbounded preceding) as k from m)
select user_id, min(a) as start, max(z) as "end", count(*) as n from g group by user_id, k""",
    "range_overlap_join": f"with {_EVENTS} select r.event_id as error_id, e.event_id from e join e r on r.user_id = e.user_id and r.event_type = 'error' and e.us between r.us - 3600000000 and r.us + 3600000000",
    "nearest_segment": f"""with {_EVENTS},
f as (select event_id, event_type, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by us, event_id rows unbounded preceding) as nearest from e)
select event_id, nearest from f where event_type <> 'click'""",
    "fixed_windows": "select doc_id, w_start, least(w_start + 480, n_chars) as w_end from (select doc_id, n_chars, unnest(range(0, n_chars, 470)) as w_start from documents where n_chars > 0)",
    "source_blocks": """with recursive c as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
b as (select conv_id, turn, n, k, 0 as block, n as size from c where k = 1
      union all
      select c.conv_id, c.turn, c.n, c.k, case when b.size + 1 + c.n <= 700 then b.block else b.block + 1 end, case when b.size + 1 + c.n <= 700 then b.size + 1 + c.n else c.n end
      from b join c on c.conv_id = b.conv_id and c.k = b.k + 1)
select conv_id, block::bigint as block, min(turn) as first_pos, max(turn) as last_pos, max(size)::bigint as n_chars from b group by conv_id, block""",
    "html_clean": rf"""select page_id, sha256({_squeeze("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")}) as digest from pages""",
    "language_rank": "select doc_id, case lang when 'de' then 0 when 'en' then 3 when 'fr' then 4 else 6 end::bigint as lang_rank from documents",
    "char_bigram_overlap": rf"""with g as (select true as asked, item_id as id, regexp_replace(lower(text), '[ \t\n\r]+', '', 'g') as t from benchmark union all select false, doc_id, regexp_replace(lower(text), '[ \t\n\r]+', '', 'g') from documents where text is not null),
m as (select asked, id, unnest(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) as g from g),
s as (select q.id as qid, d.id as doc_id, count(*) as shared from m q join m d using (g) where q.asked and not d.asked group by 1, 2){_BEST}""",
    "claim_citations": f"with {_ANSWERS.lstrip()} select conv_id, turn, line::bigint as line, n_citations::bigint as n_citations, first_ref, sha256(claim) as digest from claims",
    "admission": "select source, count(*) as n_units, bool_and(n_chars > 40 and toxic = 0) as allowed from documents join labels using (doc_id) group by source",
    "output_gate": f"""with {_ANSWERS.lstrip()}
select conv_id, case when bool_and(n_citations > 0) then 'allow' when bool_and(n_citations = 0) then 'block' else 'redact' end as action,
       coalesce(string_agg(turn || '.' || line, ',' order by turn, line) filter (n_citations = 0), '') as blocked_lines from claims group by conv_id""",
    "safety_decision": """select doc_id, case when lang = 'es' and coalesce(toxic, 0) <> 1 then 'allow' when contains(lower(text), 'password') then 'block'
  when not coalesce(quality = 1, false) then 'block' when coalesce(toxic, 0) = 1 or contains(lower(text), 'licensed') then 'warn' else 'allow' end as decision
from documents left join labels using (doc_id)""",
    "evidence_fingerprint": "select doc_id, sha256(concat_ws(chr(31), coalesce(doc_id::varchar, chr(30)), coalesce(lang, chr(30)), coalesce(source, chr(30)), coalesce(text, chr(30)))) as fingerprint from documents",
    "evidence_freshness": f"""with {_STALE} select d.doc_id, case when s.doc_id is null then 'missing' when sha256(d.text) is not distinct from s.digest then 'unchanged' else 'changed' end as status
from documents d left join stale s on d.doc_id = s.doc_id""",
    "audit_scan": f"""with {_EVENTS}, a as (select user_id, ((select max(us) from e) - us) // 86400000000 as age from e)
select user_id, count(*) as n, count(*) filter (age >= 14) as n_expired, max(age)::bigint as oldest from a group by user_id""",
    "coverage_rollup": f"""with {_SPLIT.lstrip()}, t as (select qid, {traced('text', 'part')} as ok from parts)
select qid, count(*) as n_parts, count(*) filter (ok) as n_covered, case when bool_and(ok) then 'covered' when not bool_or(ok) then 'unsupported' else 'partial' end as overall from t group by qid""",
    "context_budget": f"""with {_BM},
f as (select qid, doc_id, rank, n_chars, sum(n_chars) over (partition by qid order by rank rows unbounded preceding) as total from (select qid, doc_id, {_RANK} as rank from bm) join documents using (doc_id) where rank <= 10)
select qid, doc_id, rank::int as rank, least(total, 2800)::bigint as used from f where total <= 2800 or rank = 1""",
    "answer_confidence": f"""with {_ANSWERS.lstrip()},
p as (select conv_id, count(*) as n_claims, count(*) filter (n_citations > 0) as n_supported, count(distinct first_ref) as n_sources from claims group by conv_id)
select *, case when n_supported = n_claims and n_sources >= 2 then 'high' when n_supported * 2 >= n_claims then 'medium' else 'low' end as confidence from p""",
    "retrieval_metrics": f"""with {_JUDGED}
select qid, round(count(*) filter (relevant) / 5, 6) as precision, max(relevant::int)::bigint as hit, round(coalesce(max(case when relevant then 1.0::double / rank end), 0), 6) as reciprocal_rank,
       round(case when max(n_expected) > 0 then sum(case when relevant then 1.0::double / log2(rank + 1) else 0 end)
             / list_sum(list_transform(range(1, least(max(n_expected), 5) + 1), lambda i: 1.0::double / log2(i + 1))) else 0 end, 6) as ndcg
from judged where rank <= 5 group by qid""",
    "metrics_by_category": f"with {_JUDGED} select coalesce(lang, 'all') as lang, count(*) as n, count(*) filter (relevant) as n_relevant from judged where rank <= 5 group by rollup (lang)",
    "ndcg_novelty": f"with {_JUDGED} select qid, doc_id, rank::int as rank, case when relevant and row_number() over (partition by qid, relevant, source order by rank) = 1 then 1 else 0 end::bigint as gain from judged",
    "classifier_f1": f"""with {_PREDICTED.lstrip()},
c as (select lang, count(*) as n, count(*) filter (quality = 1 and a) as tp, count(*) filter (quality <> 1 and a) as fp, count(*) filter (quality = 1 and not a) as fn from pred join labels using (doc_id) group by lang),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as q from c)
select lang, n, tp, fp, fn, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 6) as f1 from r""",
    "judge_agreement": f"with {_PREDICTED.lstrip()} select lang, count(*) as n, count(*) filter (a = b) as agree, round(count(*) filter (a = b) / count(*), 6) as rate from pred group by lang",
    "repeat_stats": """select event_type, count(*) as n_runs, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, round(min(m), 6) as least, round(max(m), 6) as most
from (select event_type, strftime(ts, '%Y-%m-%d') as day, avg(value) as m from events group by 1, 2) group by event_type""",
    "ab_delta": """select *, round(b - a, 5) as delta from (select event_type, round(avg(value) filter (day(ts) <= 15), 6) as a, round(avg(value) filter (day(ts) > 15), 6) as b from events group by event_type)""",
    "latency_percentiles": _NEAREST.format("events"),
    "metrics_last_1000": _NEAREST.format("(select * from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 1000)"),
    "similarity_candidates": f"""with {_POSTINGS.lstrip()}, asked as (select distinct qid, unnest({_words("text")}) as term from ({_QUESTIONS})),
s as (select qid, doc_id, count(*) as shared from asked join post using (term) group by 1, 2){_BEST}""",
    "window_digests": f"""select conv_id, count(*) as n, sha256(string_agg(turn || ' ' || role || ' ' || {_squeeze("text")}, chr(10) order by turn)) as digest from conversations group by conv_id""",
    "required_units": """select conv_id, turn, n from (select conv_id, turn, length(text)::bigint as n, min(turn) over w as f, sum(length(text)) over w as s, count(text) over w as k from conversations window w as (partition by conv_id))
where turn = f or n * k > s""",
    "coverage_validation": """select case when n <> k then 'repeated' when top + 1 <> n then 'gap' else 'complete' end as state, count(*) as n_conversations
from (select conv_id, count(*) as n, count(distinct turn) as k, max(turn) as top from conversations group by conv_id) group by 1""",
    "pipeline_skip": "select doc_id from documents where text not in (select text from documents join labels using (doc_id))",
    "sliding_rate_window": f"with {_EVENTS} select event_id, user_id, count(*) over (partition by user_id order by us range between 3599999999 preceding and current row) as n_recent from e",
    "rate_limit_accept": f"""with recursive {_EVENTS}, o as (select event_id, user_id, us, row_number() over (partition by user_id order by us, event_id) as k from e),
r as (select event_id, user_id, us, k, true as accepted, [us] as held from o where k = 1
      union all
      select o.event_id, o.user_id, o.us, o.k, len(list_filter(r.held, lambda t: t > o.us - 86400000000)) < 3,
             case when len(list_filter(r.held, lambda t: t > o.us - 86400000000)) < 3 then list_append(list_filter(r.held, lambda t: t > o.us - 86400000000), o.us) else list_filter(r.held, lambda t: t > o.us - 86400000000) end
      from r join o on o.user_id = r.user_id and o.k = r.k + 1)
select event_id, user_id, accepted from r""",
    "session_gap": f"""with {_EVENTS},
s as (select *, case when us - lag(us) over (partition by user_id order by us) < 21600000000 then 0 else 1 end as fresh from e),
g as (select *, sum(fresh) over (partition by user_id order by us range unbounded preceding) as k from s)
select user_id, min(us) as start_us, max(us) as end_us, count(*) as n from g group by user_id, k""",
    "tumbling_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "json_props": "select event_type, count(k) as n, sum(k)::bigint as sum_k, max(k) as max_k from (select event_type, (props->>'$.k')::bigint as k from events) group by event_type",
    "star_join_agg": """select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n_items
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "pricing_summary": """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(avg(l_discount), 6) as avg_discount, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    "customers_without_orders": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "suppliers_with_returns": "select s_suppkey, s_nationkey from supplier where s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R' group by 1 having sum(l_quantity) > 100)",
    "nation_balance": """select coalesce(a.k, b.k) as k, coalesce(n_customers, 0) as n_customers, coalesce(n_suppliers, 0) as n_suppliers
from (select c_nationkey as k, count(*) as n_customers from customer group by 1) a full join (select s_nationkey as k, count(*) as n_suppliers from supplier group by 1) b on a.k = b.k""",
    "status_rollup": "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)",
    "top_parts_by_brand": """select p_brand, p_partkey, qty, rank::int as rank from (select p_brand, p_partkey, qty, row_number() over (partition by p_brand order by qty desc, p_partkey) as rank
from (select l_partkey, sum(l_quantity) as qty from lineitem group by 1) join part on l_partkey = p_partkey) where rank <= 3""",
    "brand_set_ops": """(select p_brand, p_type from part where p_size > 25 intersect select p_brand, p_type from part where p_size <= 25)
except select p_brand, p_type from part where p_retailprice < 905""",
}
