"""Queries over segments, glossaries and review rules made from the given tables, with their DuckDB SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import cases as cs
from ..operators import glossary as gl
from ..operators import payloads as pay
from ..operators import review as rv
from ..operators import runstate as rs
from ..operators import segments as sg
from ..sources import audits as ad
from ..sources import index_store
from . import sql
from .queries import Query, questions, serving, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a query, with its SQL if it has some."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


# segments: the turns of a conversation as heard twice, the second time with other words, later or in part


def heard_segments(spark, d):
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", (F.col("turn") * 4).alias("pos"), (F.col("turn") * 6.0).alias("start"), (F.col("turn") * 6.0 + 5.5).alias("end"), "text", "turn")
    later = lambda by, more, text: rows.where(by).select("conv_id", (F.col("pos") + 1).alias("pos"), (F.col("start") + more).alias("start"), (F.col("end") + more).alias("end"), text.alias("text"))
    copies = [later("turn % 3 = 0", 0.7, F.regexp_replace("text", "[aeiou] ", "o ")), later("turn % 4 = 1", 4.0, F.substring(F.col("text"), F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))), later("turn % 5 = 2", 5.2, F.regexp_replace("text", "e", "a"))]
    out = rows.drop("turn")
    for c in copies:
        out = out.unionByName(c)
    return sg.clean_segments(out)


@query()
def segment_dedup(spark, d):
    kept = sg.dedup_segments(heard_segments(spark, d), "conv_id", "pos")
    return kept.select("conv_id", "pos", "start", "end", F.md5("text").alias("digest"))


@query("""with s as (select conv_id, turn * 6.0::double as st, turn * 6.0::double + 5.5 as en, turn * 4 as pos, turn from conversations where text is not null and trim(text) <> ''),
a as (select conv_id, st, en, pos from s union all select conv_id, st + 0.7, en + 0.7, pos + 1 from s where turn % 3 = 0
      union all select conv_id, st + 4.0, en + 4.0, pos + 1 from s join conversations using (conv_id, turn) where turn % 4 = 1 and trim(substr(text, 1, length(text) // 2)) <> ''
      union all select conv_id, st + 5.2, en + 5.2, pos + 1 from s where turn % 5 = 2),
r as (select conv_id, round(st, 2) as st, round(en, 2) as en, pos, max(round(en, 2)) over (partition by conv_id order by round(st, 2), round(en, 2), pos rows between unbounded preceding and 1 preceding) as reach from a),
g as (select *, max(case when reach is null or reach <= st then st end) over (partition by conv_id order by st, en, pos rows unbounded preceding) as island from r)
select conv_id, island, count(*) as n_segments, max(en) as "end" from g group by conv_id, island""")
def segment_islands(spark, d):
    """Stretches of segments that overlap one another."""
    rows = sg.islands(heard_segments(spark, d), ["conv_id"], "start", "end", "pos")
    return rows.groupBy("conv_id", "island").agg(F.count("*").alias("n_segments"), F.max("end").alias("end"))


_ALIGN = """
v as (select regexp_extract(source, '(\\d+)$', 1)::bigint as grp, doc_id, doc_id * 0.5::double as st, doc_id * 0.5::double + 8 as en, embedding::double[] as e
      from documents join embeddings on vec_id = doc_id where source is not null),
p as (select a.grp, a.doc_id as chunk, b.doc_id as pos, b.st, b.en,
             row_number() over (partition by a.grp, a.doc_id order by round(round(list_inner_product(a.e, b.e), 9), 6) desc, b.doc_id) as n
      from v a join v b using (grp)),
t as (select *, case when st - lag(en) over (partition by grp, chunk order by pos) >= 20 then 1 else 0 end as fresh from p where n <= 8),
r as (select *, sum(fresh) over (partition by grp, chunk order by pos) as run from t),
z as (select grp, chunk, run, count(*) as n_segments, arg_min(st, pos) as start, arg_max(en, pos) as "end" from r group by 1, 2, 3)"""


@query(f"""with {_ALIGN.lstrip()}
select grp, chunk, start, "end", n_segments from (select *, row_number() over (partition by grp, chunk order by n_segments desc, run) as k from z) where k = 1""")
def time_align(spark, d):
    """The documents of a source as chunks and as segments."""
    docs = table(spark, d, "documents").where("source is not null").select(F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("grp"), "doc_id")
    rows = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    segments = rows.select("grp", F.col("doc_id").alias("pos"), (F.col("doc_id") * 0.5).alias("start"), (F.col("doc_id") * 0.5 + 8).alias("end"), "embedding")
    return sg.align_time(rows.select("grp", F.col("doc_id").alias("chunk"), "embedding"), segments)


# glossary: conversations as transcripts with timed lines

GLOSSARY = [
    (0, "retition", "repetition", ["ing the", "ion the"], ["and"], "check"),
    (1, "", "thereof", ["th the", "the"], [], ""),
    (2, "erent", None, ["ere", " "], ["would", "thing", "tion"], "a note"),
    (3, "", "", ["nothing"], [], ""),
    (4, "erent", "different", ["ere"], [], ""),
    (5, "sur", "sur", ["ou", "our", "s, "], ["ment", "que"], ""),
]


def glossary(spark):
    return gl.glossary_entries(spark.createDataFrame(GLOSSARY, "pos int, canonical string, candidate string, aliases array<string>, context array<string>, note string"))


def timed_transcripts(spark, d):
    line = F.concat(F.format_string("[%d.0s -> %d.5s] ", F.col("turn"), F.col("turn")), F.regexp_replace("text", "[\r\n]+", " "))
    rows = table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.struct("turn", line.alias("line")).alias("l"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


_ASR = """
d as (select conv_id as doc_id, string_agg('[' || turn || '.0s -> ' || turn || '.5s] ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g'), chr(10) order by turn) as text from conversations where text is not null group by 1),
g(entry, canonical, candidate, aliases, context, note) as (values
  (0, 'retition', 'repetition', ['ing the', 'ion the'], ['and'], 'check'), (1, 'thereof', 'thereof', ['th the', 'the'], []::varchar[], ''),
  (2, 'erent', 'erent', ['ere'], ['would', 'thing', 'tion'], 'a note'), (5, 'sur', 'sur', ['ou', 'our', 's,'], ['ment', 'que'], '')),
a as (select entry, canonical, candidate, context, note, unnest(range(0, len(aliases))) as alias, unnest(aliases) as original from g),
p as (select doc_id, text, entry, alias, original, canonical, candidate, context, string_split(text, original) as parts from d join a on contains(text, original)),
q as (select * exclude (parts), unnest(range(1, len(parts))) as i, unnest(parts[:len(parts) - 1]) as part from p),
h as (select *, (sum(length(part)) over (partition by doc_id, entry, alias order by i) + (i - 1) * length(original))::int as start_char from q),
c as (select *, start_char + length(original) as end_char,
             substr(text, greatest(start_char - 120, 0) + 1, start_char - greatest(start_char - 120, 0)) || substr(text, start_char + length(original) + 1, 120) as around,
             string_split(string_split(substr(text, 1, start_char), chr(10))[-1] || substr(text, start_char + 1, 60), chr(10))[1] as head from h)"""


@query(f"""with {_ASR.lstrip()}
select doc_id, start_char, end_char::int as end_char, canonical, candidate, original, array_to_string(list_filter(context, lambda x: contains(around, x)), ',') as contexts,
       try_cast(nullif(regexp_extract(head, '^\\[(\\d+(?:\\.\\d+)?)s\\s*->\\s*(\\d+(?:\\.\\d+)?)s\\]', 1), '') as double) as segment_start,
       try_cast(nullif(regexp_extract(head, '^\\[(\\d+(?:\\.\\d+)?)s\\s*->\\s*(\\d+(?:\\.\\d+)?)s\\]', 2), '') as double) as segment_end,
       case when len(context) = 0 or len(list_filter(context, lambda x: contains(around, x))) > 0 then 'annotated' else 'retained' end as action from c""")
def asr_terms(spark, d):
    records = gl.corrections(gl.alias_records(timed_transcripts(spark, d), glossary(spark).collect()))
    return records.select("doc_id", "start_char", "end_char", "canonical", "candidate", "original", F.array_join("matched_contexts", ",").alias("contexts"), "segment_start", "segment_end", "action")


@query()
def alias_annotation(spark, d):
    """Digests of the marked texts, and whether taking the marks off gives the texts again."""
    rows = gl.restored(gl.annotated(gl.alias_records(timed_transcripts(spark, d), glossary(spark).collect())))
    marked = F.size(F.filter("records", lambda r: r["marked"])).cast("long")
    return rows.select("doc_id", F.size("records").cast("long").alias("n_records"), marked.alias("n_marked"), F.md5("annotated").alias("digest"), (F.col("restored") == F.col("text")).alias("reversible"))


# review rules: a checklist for each source, of words of its first document


def checklists(spark, d):
    # the first twelve words are all that is looked at; structs without arrays are aggregated without a sort of all rows
    head = F.regexp_extract(F.lower("text"), r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){12}", 0)
    first = table(spark, d, "documents").where("text is not null and source is not null and doc_id is not null").select("doc_id", "source", "lang", head.alias("head")).where("head <> ''")
    ids = first.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    rows = first.join(ids, ["source", "doc_id"]).groupBy("source").agg(F.min(F.struct("doc_id", "lang", "head")).alias("f")).select("source", "f.doc_id", "f.lang", words(F.col("f.head")).alias("w"))
    w = lambda i: F.element_at("w", i)
    text = F.concat(
        F.lit("## "), "source", F.lit("\n- `〔疑似转写错误："), w(3), F.lit("、 "), w(5), F.lit("〕`：later\n### Part "), "lang", F.lit("\n〔术语边界不清："), w(9), F.lit(" / "), w(10), F.lit("〕 and 〔 药名待核 ："), w(11),
        F.lit("〕\n- `not pending`\n## 仍需人工确认  \n- `"), w(7), F.lit("，"), w(8), F.lit(","), w(7), F.lit("`：pending\nplain 〔无〕"),
    )
    return rows.select("doc_id", text.alias("text"))


_RULES = rf"""
w as (select doc_id, source, lang, {sql._words("text")} as w from documents where text is not null and source is not null),
f as (select source, arg_min(doc_id, doc_id) as doc_id, arg_min(lang, doc_id) as lang, arg_min(w, doc_id) as w from w where len(w) >= 12 group by source),
ck as (select doc_id, '## ' || source || chr(10) || '- `〔疑似转写错误：' || w[3] || '、 ' || w[5] || '〕`：later' || chr(10) || '### Part ' || lang || chr(10) || '〔术语边界不清：' || w[9] || ' / ' || w[10] || '〕 and 〔 药名待核 ：' || w[11]
              || '〕' || chr(10) || '- `not pending`' || chr(10) || '## 仍需人工确认  ' || chr(10) || '- `' || w[7] || '，' || w[8] || ',' || w[7] || '`：pending' || chr(10) || 'plain 〔无〕' as text from f),
ln as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, unnest(string_split(text, chr(10))) as line from ck),
sc as (select *, coalesce(last_value(nullif(regexp_extract(line, '^#{{2,3}}\s+(.+?)\s*$', 1), '') ignore nulls) over (partition by doc_id order by n rows unbounded preceding), '') as section from ln),
found as (select doc_id, n, section, line, unnest(regexp_extract_all(line, '〔([^：〕]+)：([^〕]+)〕', 1)) as kind, unnest(regexp_extract_all(line, '〔([^：〕]+)：([^〕]+)〕', 2)) as terms,
                 unnest(range(0, len(regexp_extract_all(line, '〔([^：〕]+)：([^〕]+)〕')))) as pos from sc
          union all
          select doc_id, n, section, line, '人工确认', regexp_extract(line, '^-\s+`([^`]+)`', 1), len(regexp_extract_all(line, '〔([^：〕]+)：([^〕]+)〕')) from sc where section = '仍需人工确认' and regexp_matches(line, '^-\s+`([^`]+)`')),
split as (select *, list_filter(list_transform(string_split_regex(terms, '\s*(?:、|，|,|/|\s+或\s+)\s*'), lambda x: trim(x)), lambda x: x <> '') as t from found),
rules as (select doc_id, n as line_number, pos, trim(kind) as issue_type, case when kind = '人工确认' or regexp_matches(kind, '转写错误|待核|信息缺失|疾病名|机制表述') then 'block' else 'warn' end as severity,
                 list_filter(t, lambda x, i: list_position(t, x) = i) as terms, section, trim(line) as note from split)"""


@query(f"with {_RULES.lstrip()} select doc_id, line_number::bigint as line_number, pos::bigint as pos, issue_type, severity, array_to_string(terms, '|') as terms, section, note from rules")
def review_rules(spark, d):
    return rv.review_rules(checklists(spark, d)).withColumn("terms", F.array_join("terms", "|"))


@query(f"with {_RULES.lstrip()} select doc_id, count(*) as rule_count, count(*) filter (severity = 'block') as blocking_rule_count, count(*) filter (severity = 'warn') as warning_rule_count from rules group by doc_id")
def review_rule_counts(spark, d):
    return rv.rule_counts(rv.review_rules(checklists(spark, d)))


def judged_results(spark, d):
    """(fields, texts) of each question's results, the documents whose number it has, modulo the number of questions;
    fields from labels."""
    qid = F.pmod("doc_id", F.lit(max(questions(spark, d).count(), 1))).alias("qid")
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    fields = rows.select(
        qid, F.when(F.col("source").isin("src1", "src2"), "medical").alias("domain"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("risk_level"),
        F.when(F.col("lang") == "de", "raw_transcript").otherwise("structured_summary").alias("chunk_type"), F.when(F.col("quality") == 1, "human_reviewed").when(F.col("quality") == 0, "derived_pending_review").alias("quality"),
        F.when(F.col("lang") == "fr", "summary_requires_raw_evidence").alias("answer_policy"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 == 1).alias("source_of_truth"),
    )
    return fields, docs.select(qid, "text")


_HIGH = rv.HIGH_RISK
_SAFETY = f"""{_RULES},
qs as (select item_id as qid, case when item_id % 4 = 0 then '剂量 ' else '' end || text as question from benchmark),
rs as (select doc_id % (select count(*) from benchmark) as qid, text, coalesce(source in ('src1', 'src2'), false) as medical, coalesce(toxic = 1, false) as risk, coalesce(lang = 'de', false) as raw, coalesce(quality = 1, false) as reviewed,
              coalesce(quality = 0, false) as pending, coalesce(lang = 'fr', false) and not coalesce(case when doc_id % 3 > 0 then doc_id % 3 = 1 end, false) as summary from documents left join labels using (doc_id)),
per as (select qid, bool_or(medical or risk) as domain, bool_or(risk) as risk, bool_or(raw) as raw, bool_or(reviewed) as reviewed, bool_or(pending) as pending, bool_or(summary) as summary from rs group by qid),
tm as (select severity, term, min(struct_pack(a := line_number, b := pos, c := k)) as place from (select severity, line_number, pos, unnest(range(0, len(terms))) as k, unnest(terms) as term from rules) where length(term) >= 2 group by 1, 2),
hit as (select distinct qid, severity, term, place from (select qid, question as t from qs union all select qid, text from rs) x join tm on contains(lower(x.t), lower(term))),
ht as (select qid, string_agg(term, ',' order by place, term) filter (severity = 'block') as blk, string_agg(term, ',' order by place, term) filter (severity = 'warn') as wrn from hit group by qid),
al as (select qs.qid, coalesce(domain, false) as domain, coalesce(raw, false) as raw, coalesce(reviewed, false) as reviewed, coalesce(pending, false) as pending, coalesce(summary, false) as summary, coalesce(blk, '') as blk, coalesce(wrn, '') as wrn,
              regexp_matches(question, '{_HIGH}') or coalesce(risk, false) as high from qs left join per using (qid) left join ht using (qid)),
dc as (select *, case when not domain and not high then 0 when blk <> '' then 1 when high and summary and not raw then 2 when high and not reviewed and not raw then 3 when high or wrn <> '' or pending then 4 else 5 end as k from al)"""


@query(f"""with {_SAFETY.lstrip()}
select qid, case k when 0 then 'allow' when 4 then 'warn' when 5 then 'allow' else 'block' end as action, case when k in (0, 5) then 'low' when high then 'high' else 'medium' end as risk_level,
       case k when 1 then '{rv.PENDING_TERMS}' when 2 then '{rv.SUMMARY_ONLY}' when 3 then '{rv.NO_SOURCE}'
         when 4 then coalesce(nullif(array_to_string(list_filter([case when high and not reviewed then '{rv.UNREVIEWED}' end, case when wrn <> '' then '{rv.AMBIGUOUS}' end], lambda x: x is not null), '|'), ''), '{rv.PENDING_SUMMARY}') else '' end as reasons,
       case k when 1 then blk when 4 then wrn else '' end as matched_terms from dc""")
def medical_safety(spark, d):
    asked = questions(spark, d).select("qid", F.concat(F.when(F.col("qid") % 4 == 0, "剂量 ").otherwise(""), "text").alias("question"))
    fields, texts = judged_results(spark, d)
    found = rv.safety_gate(asked, fields, rv.review_rules(checklists(spark, d)), texts)
    return found.select("qid", "action", "risk_level", F.array_join("reasons", "|").alias("reasons"), F.array_join("matched_terms", ",").alias("matched_terms"))


# the stored index


@query(f"""with {sql._POSTINGS.lstrip()}
select term, doc_id // {index_store.BLOCK_IDS} as block, count(*) as n_postings, min(doc_id) as first_id, max(doc_id) as last_id, sum(tf)::bigint as tokens from post group by 1, 2""")
def index_blocks(spark, d):
    """Posting blocks as they are stored."""
    rows = serving(spark, d).postings
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("term", "block", F.size("doc_ids").cast("long").alias("n_postings"), F.array_min("doc_ids").alias("first_id"), F.array_max("doc_ids").alias("last_id"), total.alias("tokens"))


@query("""select doc_id, 'documents' as side from documents where doc_id not in (select vec_id from embeddings where vec_id is not null)""")
def index_staged_rows(spark, d):
    """Documents of the stored index without a vector, and vectors without a document."""
    return index_store.staged_rows(serving(spark, d))


# answers of models: payloads of many shapes, made of each document's number and words

_PICK = "{}[({}) % {} + 1]"
VERDICT_CASES = ["supported", " Contradicted ", "insufficient_evidence", "SUPPORTED", "maybe"]
LEVEL_CASES = ["high", "LOW", "medium", "high", "low", "sure"]
RATIONALE_CASES = ['"ok"', '"  x "', "5", "null", '""', '"a \\"b\\""']
ID_CASES = ["[]", '["c1"]', '["c1 ", "c2", "c1"]', '["c9", "c1"]', "[1]", '"c1"', '["", "c2"]']


def pick(cases: list[str], at) -> Column:
    return F.element_at(F.array(*map(F.lit, cases)), (at % len(cases) + 1).cast("int"))


def _pick(cases: list[str], at: str) -> str:
    return _PICK.format("[" + ", ".join("'" + c.replace("'", "''") + "'" for c in cases) + "]", at, len(cases))


def judge_answers(spark, d):
    i = F.col("doc_id")
    body = F.concat(F.lit('{"verdict": "'), pick(VERDICT_CASES, i), F.lit('", "confidence": "'), pick(LEVEL_CASES, F.floor(i / 2)), F.lit('", "rationale": '), pick(RATIONALE_CASES, F.floor(i / 3)), F.lit(', "evidence_chunk_ids": '), pick(ID_CASES, F.floor(i / 5)), F.when(i % 13 == 0, "").otherwise("}"))
    whole = F.when(i % 17 == 0, "[1]").when(i % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, d, "documents").where("doc_id is not null").select("doc_id", whole.alias("payload"), F.array(F.lit("c1"), F.lit("c2")).alias("shown"))


_JUDGED = rf"""
b as (select doc_id, '{{"verdict": "' || {_pick(VERDICT_CASES, "doc_id")} || '", "confidence": "' || {_pick(LEVEL_CASES, "doc_id // 2")} || '", "rationale": ' || {_pick(RATIONALE_CASES, "doc_id // 3")} || ', "evidence_chunk_ids": ' || {_pick(ID_CASES, "doc_id // 5")} || case when doc_id % 13 = 0 then '' else '}}' end as body from documents where doc_id is not null),
w as (select doc_id, case when doc_id % 17 = 0 then '[1]' when doc_id % 6 = 0 then '```json' || chr(10) || body || chr(10) || '```' else body end as payload from b),
c as (select doc_id, trim(regexp_replace(regexp_replace(payload, '^```(?:json)?\s*', '', 'i'), '\s*```$', '')) as clean from w),
j as (select doc_id, case when json_valid(clean) then clean::json end as j from c),
f as (select doc_id, j, lower(trim(coalesce(j->>'$.verdict', ''))) as verdict, lower(trim(coalesce(j->>'$.confidence', ''))) as confidence,
             trim(case when json_type(j, '$.rationale') = 'NULL' then 'None' else coalesce(j->>'$.rationale', '') end) as rationale,
             case when json_type(j, '$.evidence_chunk_ids') = 'ARRAY' and len(list_filter(json_extract(j, '$.evidence_chunk_ids[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0
                  then list_filter(list_transform(json_extract_string(j, '$.evidence_chunk_ids[*]'), lambda x: trim(x)), lambda x: x <> '') end as ids from j),
e as (select *, case when j is null then 'invalid_json' when json_type(j) <> 'OBJECT' then 'not_object' when verdict not in ('supported', 'contradicted', 'insufficient_evidence') then 'verdict' when confidence not in ('high', 'medium', 'low') then 'confidence'
                 when rationale = '' then 'rationale' when ids is null then 'chunk_ids' when len(list_filter(ids, lambda x: x not in ('c1', 'c2'))) > 0 then 'unknown_chunks' when verdict <> 'insufficient_evidence' and len(ids) = 0 then 'uncited' end as error from f)"""


@query(f"""with {_JUDGED.lstrip()}
select doc_id, case when error is null then verdict end as verdict, case when error is null then confidence end as confidence, case when error is null then rationale end as rationale,
       case when error is null then array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') end as chunk_ids, error from e""")
def judge_payloads(spark, d):
    found = pay.judgments(judge_answers(spark, d), "payload", "shown")
    return found.select("doc_id", "verdict", "confidence", "rationale", F.array_join("evidence_chunk_ids", ",").alias("chunk_ids"), "error")


@query(f"with {_JUDGED.lstrip()} select coalesce(error, verdict) as outcome, count(*) as n from e group by 1")
def judge_outcomes(spark, d):
    """How often each verdict, and each fault of an answer, comes."""
    return pay.judgments(judge_answers(spark, d), "payload", "shown").groupBy(F.coalesce("error", "verdict").alias("outcome")).agg(F.count("*").alias("n"))


@query()
def question_plan_payloads(spark, d):
    """Planners' answers made of each question's words, some of them wrong."""
    w = words(F.col("text"))
    part = lambda a, n: F.concat(F.lit('"'), F.array_join(F.slice(w, a, n), "  "), F.lit('"'))
    listed = F.when(F.col("qid") % 5 == 0, F.lit("[]")).when(F.col("qid") % 5 == 1, F.concat(F.lit("["), part(1, 4), F.lit(", "), part(1, 4), F.lit("]"))).when(F.col("qid") % 5 == 2, F.concat(F.lit("["), part(1, 3), F.lit(', "漢字"]'))).otherwise(F.concat(F.lit("["), part(2, 3), F.lit(", "), part(5, 3), F.lit("]")))
    level = pick(["high", "medium", "none"], F.col("qid"))
    asked = questions(spark, d).select("qid", "text", F.concat(F.lit('```\n{"sub_queries": '), listed, F.lit(', "confidence": "'), level, F.lit('", "intent": 3}\n```')).alias("payload"))
    return pay.plan_payloads(asked, "text", "payload").select("qid", F.array_join("sub_queries", "|").alias("sub_queries"), "intent", "domain", "confidence", "error")


@query()
def window_map_payloads(spark, d):
    """Window maps made of the turns of each conversation, some of them wrong."""
    text = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), r'["\\\x00-\x1f]', " ")
    unit = F.concat(F.lit('{"title": "'), F.when(F.col("turn") % 4 == 1, "").otherwise(text), F.lit('", "summary": "'), F.when(F.col("turn") % 4 == 2, " ").otherwise(text), F.lit('", "importance": "'), pick(["major", "big"], F.col("turn")), F.lit('", "key_points": ["a", " "], "source_refs": ["S'), F.lpad((F.col("turn") + 1).cast("string"), 4, "0"), F.lit('"]'), F.when(F.col("turn") % 7 == 6, ', "more": 1').otherwise(""), F.lit("}"))
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", unit.alias("u")).alias("s")).groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    maps = rows.select("conv_id", F.concat(F.lit('{"units": ['), F.when(F.col("conv_id") % 4 > 0, F.array_join(F.transform("s", lambda x: x["u"]), ", ")).otherwise(""), F.lit('], "content_type": "empty", "non_content_reason": "'), pick(["", "片头", "广告 x", "none"], F.floor(F.col("conv_id") / 4)), F.lit('"}')).alias("payload"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.format_string("S%04d", i)).alias("shown"))
    found = pay.window_maps(maps.withColumn("own", F.slice("shown", 2, 3)), "payload", "shown", "own")
    return found.select("conv_id", "content_type", F.size("units").cast("long").alias("n_units"), "non_content_reason", F.array_join("violations", "|").alias("violations"))


# evidence audits: each conversation as an answered question that rests on some documents

NOW_DAYS = 40


def audit_results(spark, d, changed: bool = False):
    """Each document as evidence of one conversation; changed: as the index is later."""
    n = table(spark, d, "conversations").select("conv_id").distinct().count()
    docs = table(spark, d, "documents")
    if changed:
        docs = docs.where("source <> 'src3'").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    text = lambda c, value=None: F.lit(value).cast("string").alias(c)
    return docs.select(
        F.pmod("doc_id", F.lit(max(n, 1))).alias("conv_id"), F.lit(1).alias("rank"), F.concat(F.lit(" d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("document_id"), text("video_id"), "text", F.col("lang").alias("chunk_type"),
        text("risk_level"), text("review_status", ""), F.lit(None).cast("boolean").alias("source_of_truth"), text("answer_policy", "direct"), F.array(F.col("lang"), F.col("lang")).alias("source_refs"),
    )


def audits(spark, d):
    units = ad.evidence_units(audit_results(spark, d), ["conv_id"])
    claim = F.struct(F.concat(F.lit("C"), F.substring("evidence_id", 4, 20)).alias("claim_id"), F.array(F.col("evidence_id")).alias("evidence_unit_ids"))
    per = units.groupBy("conv_id").agg(F.collect_list(F.struct("evidence_id", "evidence_fingerprint")).alias("evidence_units"), F.collect_list(claim).alias("claims"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).join(per, "conv_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    created = (F.col("conv_id") % NOW_DAYS) * ad.DAY_US + F.col("conv_id") * 1000
    return rows.select(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("audit_id"), created.alias("created_us"), F.when(F.col("conv_id") % 2 == 0, "g1").otherwise("g2").alias("index_generation"), "question", F.lit("").alias("answer"), empty("claims", "array<struct<claim_id:string,evidence_unit_ids:array<string>>>"), empty("evidence_units", "array<struct<evidence_id:string,evidence_fingerprint:string>>"), F.lit("allow").alias("gate"))


_AUDIT = f"""
u as (select doc_id % (select count(distinct conv_id) from conversations) as conv_id, 'E:d' || doc_id as e, doc_id, case when source = 'src3' then 'missing' when doc_id % 7 = 0 and text is not null then 'changed' end as state from documents),
p as (select conv_id, count(*) as n, coalesce(string_agg(e, ',' order by e) filter (state = 'changed'), '') as changed, coalesce(string_agg(e, ',' order by e) filter (state = 'missing'), '') as missing,
             coalesce(string_agg('C' || doc_id, ',' order by 'C' || doc_id) filter (state is not null), '') as affected from u group by 1),
s as (select 'a' || c.conv_id as audit_id, case when coalesce(changed, '') <> '' or coalesce(missing, '') <> '' then 'invalidated' when c.conv_id % 2 = 0 then 'generation_changed' when n is null then 'not_applicable' else 'current' end as status,
             floor(({NOW_DAYS} * 86400000000 - (c.conv_id % {NOW_DAYS} * 86400000000 + c.conv_id * 1000)) * 1000.0::double / 86400000000) / 1000 as age_days,
             {NOW_DAYS} * 86400000000 - (c.conv_id % {NOW_DAYS} * 86400000000 + c.conv_id * 1000) >= 14 * 86400000000 as expired, coalesce(affected, '') as affected_claim_ids, coalesce(changed, '') as changed, coalesce(missing, '') as missing
      from (select distinct conv_id from conversations) c left join p using (conv_id))"""


def _scanned(spark, d):
    current = ad.evidence_units(audit_results(spark, d, changed=True), ["conv_id"])
    return ad.scan(audits(spark, d), current, "g2", NOW_DAYS * ad.DAY_US, 14)


@query(f"with {_AUDIT.lstrip()} select * from s")
def evidence_audit_scan(spark, d):
    return _scanned(spark, d).withColumns({c: F.array_join(c, ",") for c in ("affected_claim_ids", "changed", "missing")})


@query(f"""with {_AUDIT.lstrip()}
select count(*) as total, count(*) filter (status = 'current') as current, count(*) filter (status = 'generation_changed') as generation_changed, count(*) filter (status = 'invalidated') as invalidated,
       count(*) filter (status = 'not_applicable') as not_applicable, count(*) filter (expired) as expired, case when bool_or(status = 'invalidated' or expired) then 'attention_required' else 'ok' end as status from s""")
def evidence_audit_health(spark, d):
    return ad.health(_scanned(spark, d))


# evaluation cases: questions and labels with faults planted by number


@query("""with q as (select item_id::varchar as id, case when item_id % 7 = 3 then ' ' else text end as question, item_id as n from benchmark union all select item_id::varchar, text, item_id from benchmark where item_id % 11 = 0),
e as (select case when item_id % 13 = 5 then 'x' || item_id else item_id::varchar end as id, item_id % 3 <> 1 as answer, [['v1'], ['v1', 'v2'], [], ['v1']][item_id % 4 + 1] as videos, case when item_id % 5 = 0 then [] else ['S0001', 'S0002'] end as refs,
             case item_id % 6 when 2 then [['v1', 'S0001'], ['v1', 'S0002']] when 3 then [['v1', '']] when 4 then [['v1', 'S0001']] end as named from benchmark where item_id % 9 <> 4),
qc as (select id, count(*) as n_q, bool_and(trim(question) = '') as bare, min(case when trim(question) <> '' then 0 else 1 end) as some, arg_min(question, '{"question":"' || question || '"') as question from q group by id),
j as (select coalesce(qc.id, e.id) as id, n_q, qc.question, e.id is not null as lab, answer, coalesce(videos, []) as videos, coalesce(refs, []) as refs, named, case when named is not null then len(list_filter(named, lambda s: s[2] = '')) = 0 end as whole, list_transform(named, lambda s: s[2]) as own from qc full join e on qc.id = e.id)
select id, array_to_string(list_filter([case when n_q > 1 then 'repeated_question' end, case when not lab then 'no_label' end, case when n_q is null then 'no_question' end, case when n_q is not null and trim(question) = '' then 'empty_question' end,
  case when lab and answer and (len(refs) = 0 or len(videos) = 0) then 'no_sources' end, case when lab and not answer and (len(refs) > 0 or len(videos) > 0) then 'has_sources' end, case when lab and named is null and len(videos) > 1 then 'needs_pairs' end,
  case when whole = false then 'pair_incomplete' end, case when whole and (len(list_filter(own, lambda x: not list_contains(refs, x))) > 0 or len(list_filter(refs, lambda x: not list_contains(own, x))) > 0) then 'pairs_differ' end], lambda x: x is not null), ',') as violations from j""")
def case_integrity(spark, d):
    i = F.col("qid")
    asked = questions(spark, d)
    quest = asked.select(i.cast("string").alias("id"), F.when(i % 7 == 3, " ").otherwise(F.col("text")).alias("question")).unionByName(asked.where("qid % 11 = 0").select(i.cast("string").alias("id"), F.col("text").alias("question")))
    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    pair = lambda v, r: F.struct(F.lit(v).alias("video_id"), F.lit(r).alias("source_ref"))
    videos = F.when(i % 4 == 1, lists("v1", "v2")).when(i % 4 == 2, lists()).otherwise(lists("v1"))
    named = F.when(i % 6 == 2, F.array(pair("v1", "S0001"), pair("v1", "S0002"))).when(i % 6 == 3, F.array(pair("v1", ""))).when(i % 6 == 4, F.array(pair("v1", "S0001")))
    labels = asked.where("qid % 9 <> 4").select(
        F.when(i % 13 == 5, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("id"), (i % 3 != 1).alias("expected_answer"), videos.alias("expected_video_ids"), F.when(i % 5 == 0, lists()).otherwise(lists("S0001", "S0002")).alias("expected_source_refs"),
        named.alias("expected_sources"), lists().alias("answer_points"), F.lit(None).cast("string").alias("risk_level"),
    )
    found = cs.evaluation_cases(quest.withColumn("category", F.lit(None).cast("string")), labels)
    return found.select("id", F.array_join("violations", ",").alias("violations"))


# run state: each conversation as a video whose states are stored in one of two layouts


@query("""with c as (select distinct conv_id as i from conversations),
s as (select i, i % 5 <> 4 as known, case when i % 7 = 1 then 'failed' else 'completed' end as status, case when i % 2 = 0 then 'p' else 'default' end as own, case when i % 11 = 3 then '0' else '1' end as prompt, case when i % 3 = 0 then 'asr' when i % 3 = 1 then 'subtitle' end as src, case when i % 6 = 0 then 'b' else 'c' end as backend, case when i % 13 = 2 then 'gone' else 'm' end as md from c)
select 'v' || i as video_id, own as profile, case when not known then 'new' when status <> 'completed' then 'unfinished' when prompt <> '1' then 'profile_changed' when src is null or (src = 'asr' and backend <> 'b') then 'transcript_changed' when md = 'gone' then 'note_missing' when i % 17 = 8 then 'not_indexed' end as reason
from s where not known or status <> 'completed' or prompt <> '1' or src is null or (src = 'asr' and backend <> 'b') or md = 'gone' or i % 17 = 8""")
def pipeline_resume(spark, d):
    i = F.col("conv_id")
    rows = table(spark, d, "conversations").select("conv_id").distinct()
    source = F.when(i % 3 == 0, '"text_source": "asr", ').when(i % 3 == 1, '"text_source": "subtitle", ').otherwise("")
    state = F.concat(F.lit('{"status": "'), F.when(i % 7 == 1, "failed").otherwise("completed"), F.lit('", "md_path": "'), F.when(i % 13 == 2, "gone").otherwise("m"), F.lit('", "schema_version": "v1", "prompt_version": "'), F.when(i % 11 == 3, "0").otherwise("1"), F.lit('", "transcript": {'), source, F.lit('"backend": "'), F.when(i % 6 == 0, "b").otherwise("c"), F.lit('"}'))
    video = F.concat(F.lit("v"), i.cast("string"))
    nested = F.concat(F.lit('{"version": 2, "videos": {"'), video, F.lit('": {"p": '), state, F.lit(', "profile": "p"}}}}'))
    flat = F.concat(F.lit('{"'), video, F.lit('": '), state, F.lit("}}"))
    stores = rows.where("conv_id % 5 <> 4").select(F.when(i % 2 == 0, nested).otherwise(flat).alias("payload"))
    wanted = rows.select(video.alias("video_id"), F.when(i % 2 == 0, "p").otherwise("default").alias("profile"), F.lit("v1").alias("schema_version"), F.lit("1").alias("prompt_version"), F.create_map(F.lit("backend"), F.lit("b")).alias("asr_config"))
    return rs.to_do(wanted, rs.run_states(stores, "payload"), spark.createDataFrame([("m",)], "md_path string"), rows.where("conv_id % 17 <> 8").select(video.alias("video_id")))
