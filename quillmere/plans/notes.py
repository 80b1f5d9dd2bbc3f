"""Queries over notes, transcripts, plans and claims made from the given tables, each with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import trim_all
from ..operators import chunking as ch
from ..operators import planning as pl
from .queries import Query, table
from .sql import traced

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def both(sql: str):
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_TRIM = r"regexp_replace({}, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


def trim(x: str) -> str:
    return _TRIM.format(x)


# notes: each conversation as a note whose turns are its sections


def notes(spark, d):
    text = trim_all(F.coalesce("text", F.lit("")))
    ref = F.when(F.col("turn") % 4 == 0, F.format_string(" S%04d", F.col("turn") + 1)).otherwise("")
    head = F.when(F.col("turn") % 7 == 6, "## Transcript").when(F.col("turn") % 3 == 0, F.format_string("## Part %d", "turn")).otherwise(F.format_string("### Step %d", "turn"))
    body = F.when(F.col("turn") % 5 == 3, text).otherwise(F.concat(text, F.lit(" "), F.regexp_replace(text, "[ ,]+", ". "), F.lit(" "), text))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(head, F.lit("\n"), body, ref, F.lit("\n")).alias("part"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("text"))


_NOTES = f"""
src as (select conv_id, turn, {trim("coalesce(text, '')")} as t from conversations),
note as (select conv_id as doc_id, string_agg(
           (case when turn % 7 = 6 then '## Transcript' when turn % 3 = 0 then '## Part ' || turn else '### Step ' || turn end) || chr(10)
           || (case when turn % 5 = 3 then t else t || ' ' || regexp_replace(t, '[ ,]+', '. ', 'g') || ' ' || t end)
           || (case when turn % 4 = 0 then ' S' || lpad((turn + 1)::varchar, 4, '0') else '' end) || chr(10), chr(10) order by turn) as text
         from src group by 1),
ln as (select doc_id, i, string_split(text, chr(10))[i] as line from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from note)),
hd as (select *, regexp_matches(line, '^#{{2,3}}\\s+\\S') as head from ln),
gr as (select *, sum(head::int) over (partition by doc_id order by i) as s from hd),
sc as (select doc_id, s as pos, max(case when head then regexp_extract(line, '^(#{{2,3}})\\s', 1) end) as level,
              max(case when head then regexp_extract(line, '^#{{2,3}}\\s+(.+?)\\s*$', 1) end) as title,
              {trim("coalesce(string_agg(case when not head then line end, chr(10) order by i), '')")} as body
       from gr where s > 0 group by doc_id, s),
pa as (select *, last_value(case when level = '##' then title end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as parent from sc),
sections as (select doc_id, pos::bigint as pos, case when level = '###' and parent is not null then parent || ' > ' || title else title end as section, body from pa),
kept as (select *, '## ' || section || chr(10) || body as content from sections where lower(section) <> 'transcript' and body <> ''),
fresh as (select *, case when length(body) < 80 and not regexp_matches(content, '\\bS\\d{{4}}\\b') and row_number() over w > 1 then 0 else 1 end as new
          from kept window w as (partition by doc_id order by pos)),
numbered as (select *, sum(new) over (partition by doc_id order by pos) as chunk from fresh),
merged as (select doc_id, chunk::bigint as chunk, string_agg(section, ' + ' order by pos) as section, string_agg(content, chr(10) || chr(10) order by pos) as content,
                  regexp_extract_all(arg_min(content, pos), '\\bS\\d{{4}}\\b') as all_refs from numbered group by doc_id, chunk)"""


def _first_seen(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@both(f"with {_NOTES.lstrip()} select doc_id, pos, section, md5(body) as digest from sections")
def note_sections(spark, d):
    return ch.sections(notes(spark, d)).select("doc_id", F.dense_rank().over(ch.Window.partitionBy("doc_id").orderBy("pos")).cast("long").alias("pos"), "section", F.md5("body").alias("digest"))


@both(f"with {_NOTES.lstrip()} select doc_id, chunk, section, md5(content) as digest, array_to_string({_first_seen('all_refs')}, ',') as refs from merged")
def merged_sections(spark, d):
    rows = ch.merged_sections(ch.sections(notes(spark, d)))
    return rows.select("doc_id", "chunk", "section", F.md5("content").alias("digest"), F.array_join("refs", ",").alias("refs"))


def _packing(source: str, key: str, text: str) -> str:
    """CTEs ending in packed({key}, piece, content): sentences of `text` packed to 600 characters."""
    return f"""
sent as (select {key}, list_filter(list_transform(string_split(regexp_replace(coalesce({text}, ''), '([。！？.\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim("x")}), lambda x: x <> '') as s from {source}),
st as (select {key}, s, 1 as i, case when length(s[1]) > 600 then null else 1 end as f, case when length(s[1]) > 600 then 0 else length(s[1]) end as total from sent where len(s) > 0
       union all
       select {key}, s, i + 1,
              case when length(s[i + 1]) > 600 then null when f is null then i + 1 when total + length(s[i + 1]) <= 600 then f
                   when length(s[i]) + length(s[i + 1]) <= 600 then i else i + 1 end,
              case when length(s[i + 1]) > 600 then 0 when f is null then length(s[i + 1]) when total + length(s[i + 1]) <= 600 then total + length(s[i + 1])
                   when length(s[i]) + length(s[i + 1]) <= 600 then length(s[i]) + length(s[i + 1]) else length(s[i + 1]) end
       from st where i < len(s)),
runs as (select {key}, any_value(s) as s, f, max(i) as z, -1 as cut from st where f is not null group by {key}, f
         union all
         select {key}, s, i, i, unnest(range(0, length(s[i]), 600)) from st where f is null),
packed as (select {key}, row_number() over (partition by {key} order by z, f, cut) - 1 as piece,
                  case when cut < 0 then array_to_string(s[f:z], '') else substr(s[z], cut + 1, 600) end as content from runs)"""


@both(f"with recursive {_packing('documents', 'doc_id', 'text').lstrip()} select doc_id, piece, length(content) as n_chars, md5(content) as digest from packed")
def sentence_chunks(spark, d):
    """Chunks of every whole document."""
    rows = ch.packed(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "piece", F.char_length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@both(f"""with recursive {_NOTES.lstrip()},
big as (select doc_id, chunk, section, all_refs, content from merged where length(content) > 600), {_packing('big', 'doc_id, chunk', 'content').lstrip()},
every as (select doc_id, chunk, 0 as piece, section, content, all_refs from merged where length(content) <= 600
          union all
          select doc_id, chunk, piece, section, p.content, case when regexp_matches(p.content, '\\bS\\d{{4}}\\b') then regexp_extract_all(p.content, '\\bS\\d{{4}}\\b') else all_refs end
          from packed p join big using (doc_id, chunk))
select doc_id, chunk, piece::bigint as piece, section, md5(content) as digest, array_to_string({_first_seen('all_refs')}, ',') as refs from every""")
def section_chunks(spark, d):
    rows = ch.section_chunks(notes(spark, d))
    return rows.select("doc_id", "chunk", "piece", "section", F.md5("content").alias("digest"), F.array_join("refs", ",").alias("refs"))


# transcripts: each conversation's turns as timed lines


def transcript(spark, d):
    start = F.col("turn") * 9.0
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), start.alias("start"), (start + 2.0 + F.char_length("text") % 11).alias("end"), "text", F.lit(True).alias("timed")).where("text is not null")


_LINES = """
tl as (select conv_id, row_number() over (partition by conv_id order by turn) as k, turn * 9.0::double as st, turn * 9.0::double + 2 + length(text) % 11 as en, text from conversations where text is not null)"""
_RAW = f"""{_LINES},
rl as (select *, '[S' || printf('%04d', k) || printf(' %.2fs-%.2fs] ', st, en) || text as line from tl),
rg as (select conv_id, k, line, st, en, 0 as g, length(line) as total from rl where k = 1
       union all
       select n.conv_id, n.k, n.line, n.st, n.en, case when r.total + 1 + length(n.line) <= 600 then g else g + 1 end,
              case when r.total + 1 + length(n.line) <= 600 then r.total + 1 + length(n.line) else length(n.line) end
       from rg r join rl n on n.conv_id = r.conv_id and n.k = r.k + 1)"""
_BLOCKS = f"""{_LINES},
bg as (select conv_id, k, st, en, text, 1 as g, length(text) as chars, st as since from tl where k = 1
       union all
       select n.conv_id, n.k, n.st, n.en, n.text, case when new then b.g + 1 else b.g end,
              case when new then length(n.text) else b.chars + (case when b.chars > 0 then 1 else 0 end) + length(n.text) end, case when new then n.st else b.since end
       from bg b join tl n on n.conv_id = b.conv_id and n.k = b.k + 1,
            lateral (select b.chars + 1 + length(n.text) > 400 or n.st - b.en > 5 or n.en - b.since > 30 as new) x),
blk as (select conv_id, g, arg_min(st, k) as st, arg_max(en, k) as en, string_agg(text, chr(10) order by k) as text from bg group by conv_id, g)"""


@both(f"with recursive {_RAW.lstrip()} select conv_id, (g + 1)::bigint as chunk, printf('S%04d', min(k)) as first_ref, printf('S%04d', max(k)) as last_ref, arg_min(st, k) as start, arg_max(en, k) as \"end\", md5(string_agg(line, chr(10) order by k)) as digest from rg group by conv_id, g")
def raw_transcript_chunks(spark, d):
    return ch.raw_chunks(transcript(spark, d), "conv_id").select("conv_id", "chunk", "first_ref", "last_ref", "start", "end", F.md5("content").alias("digest"))


@both(f"with recursive {_BLOCKS.lstrip()} select conv_id, printf('S%04d', g) as ref_id, st as start, en as \"end\", md5(text) as digest from blk")
def transcript_blocks(spark, d):
    return ch.source_blocks(transcript(spark, d), "conv_id").select("conv_id", "ref_id", "start", "end", F.md5("text").alias("digest"))


@both(f"""with recursive {_BLOCKS.lstrip()},
wg as (select conv_id, g, st, en, 1 as w, length(text) as chars, st as since from blk where g = 1
       union all
       select n.conv_id, n.g, n.st, n.en, case when new then w.w + 1 else w.w end, case when new then length(n.text) else w.chars + 1 + length(n.text) end, case when new then n.st else w.since end
       from wg w join blk n on n.conv_id = w.conv_id and n.g = w.g + 1, lateral (select w.chars + 1 + length(n.text) > 900 or n.en - w.since > 60 as new) x),
win as (select conv_id, w, min(g) as a, max(g) as z from wg group by conv_id, w)
select win.conv_id, 'W' || lpad(w::varchar, 3, '0') as window_id, 'S' || lpad((1 + coalesce(max(case when f.st - b.en > 20 then b.g end), 0))::varchar, 4, '0') as context_ref,
       printf('S%04d', a) as first_ref, printf('S%04d', z) as last_ref
from win join blk f on f.conv_id = win.conv_id and f.g = a left join blk b on b.conv_id = win.conv_id and b.g < a group by win.conv_id, w, a, z""")
def transcript_windows(spark, d):
    return ch.transcript_windows(ch.source_blocks(transcript(spark, d), "conv_id"), "conv_id", seconds=60.0, max_chars=900)


# plans and claims

_PLAN = r"""
pt as (select conv_id, turn, text, list_filter(list_transform(string_split_regex(text, '[?？；;。]|(?:以及|并且|还有|同时|分别)'), lambda x: trim(x, ' ，,、')), lambda x: x <> '') as l from conversations where role = 'user' and text is not null),
pq as (select conv_id, turn, text, case when len(l) > 0 then l[1:3] else [text] end as parts from pt)"""


@both(f"with {_PLAN.lstrip()} select conv_id, turn, array_to_string(parts, '|') as parts, case when len(parts) = 1 then 'high' else 'medium' end as confidence, len(parts) > 1 or length(text) > 80 as is_complex from pq")
def question_plan(spark, d):
    parts = pl.question_parts(F.col("text"))
    rows = table(spark, d, "conversations").where("role = 'user' and text is not null")
    return rows.select("conv_id", "turn", F.array_join(parts, "|").alias("parts"), pl.plan_confidence(parts).alias("confidence"), pl.is_complex(F.col("text"), parts).alias("is_complex"))


@both(f"""with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, {traced('before', 'text')} as traceable
from p where before is not null and text is not null""")
def turn_traceable(spark, d):
    """Whether a turn can be traced to the one before."""
    before = F.lag("text").over(ch.Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("before", before).where("before is not null and text is not null")
    return rows.select("conv_id", "turn", pl.traceable(F.col("before"), F.col("text")).alias("traceable"))


def answer_lines(spark, d):
    """Lines of assistant turns, cited rightly or wrongly by turn."""
    c = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    cite = lambda refs: F.concat(F.lit(" ["), c, F.lit(f" | {refs}]"))
    v = (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("line")) % 6
    mark = F.when(v == 1, cite("S0001")).when(v == 2, cite("S0001, S0009")).when(v == 3, F.lit(" [x9 | S0001]")).when(v == 4, cite("N/A")).when(v == 5, F.concat(cite("none"), cite("S0002"))).otherwise("")
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return rows.select("conv_id", "turn", "line", F.concat(F.when(F.col("line") % 3 == 1, "- ").otherwise(""), "raw", mark).alias("text"))


def conversation_evidence(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    refs = F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(5)).cast("int")), lambda i: F.format_string("S%04d", i))
    found = rows.select("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chunk_id"), F.when(F.col("conv_id") % 3 != 0, refs).otherwise(F.array().cast("array<string>")).alias("refs"), F.lit(1).alias("rank"))
    # some chunks come a second time, with other references
    return found.unionByName(found.where("conv_id % 2 = 0").withColumns({"refs": F.array(F.lit("S0009")), "rank": F.lit(2)}))


_CLAIMS = f"""
al as (select conv_id, turn, i - 1 as line, string_split(text, chr(10))[i] as raw from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from conversations where role = 'assistant')),
an as (select conv_id, turn, line, (case when line % 3 = 1 then '- ' else '' end) || raw || (case (conv_id * 7 + turn * 3 + line) % 6 when 1 then ' [c' || conv_id || ' | S0001]'
         when 2 then ' [c' || conv_id || ' | S0001, S0009]' when 3 then ' [x9 | S0001]' when 4 then ' [c' || conv_id || ' | N/A]'
         when 5 then ' [c' || conv_id || ' | none] [c' || conv_id || ' | S0002]' else '' end) as text from al),
ev as (select conv_id, 'c' || conv_id as chunk_id, case when conv_id % 3 <> 0 then list_transform(range(1, least(count(*), 5) + 1), lambda i: 'S' || lpad(i::varchar, 4, '0')) else [] end as refs from conversations group by conv_id),
cl as (select conv_id, turn, line, text, {trim(f"regexp_replace({trim(f'''regexp_replace({trim(chr(39).join(['regexp_replace(text, ', '\\[\\s*([A-Za-z0-9_-]+)\\s*\\|\\s*([^\\]]*)\\]', ', ', '', ', ', 'g', ')']))}, '^(?:[-*]|\\d+[.)、])\\s*', '')''')}, '^【[^】]+】\\s*', '')")} as claim from an),
ct as (select conv_id, turn, line, claim, unnest(case when len(l) > 0 then l else [null] end) as chunk_id, unnest(case when len(l) > 0 then r else [null] end) as raw
       from (select *, regexp_extract_all(text, '\\[\\s*([A-Za-z0-9_-]+)\\s*\\|\\s*([^\\]]*)\\]', 1) as l, regexp_extract_all(text, '\\[\\s*([A-Za-z0-9_-]+)\\s*\\|\\s*([^\\]]*)\\]', 2) as r from cl where claim <> '')),
ju as (select ct.*, case when ct.chunk_id is null then 'missing_citation' when ev.chunk_id is null then 'chunk_not_in_retrieval'
          when trim(raw) in ('N/A', '') then case when len(refs) > 0 then 'source_refs_missing' end
          when not regexp_matches(raw, '\\bS\\d{{4}}\\b') then 'source_refs_malformed'
          when len(list_filter(regexp_extract_all(raw, '\\bS\\d{{4}}\\b'), lambda x: not list_contains(refs, x))) > 0 then 'source_refs_not_in_chunk' end as error
       from ct left join ev on ev.conv_id = ct.conv_id and ev.chunk_id = ct.chunk_id),
checked as (select conv_id, turn, line, md5(claim) as digest, count(chunk_id) as n_citations, count(error) = 0 as valid,
              coalesce(string_agg(distinct error, ',' order by error), '') as errors, coalesce(string_agg(distinct case when error is null then chunk_id end, ',' order by case when error is null then chunk_id end), '') as chunk_ids
            from ju group by conv_id, turn, line, claim)"""


@both(f"with {_CLAIMS.lstrip()} select conv_id, turn, line::int as line, digest, n_citations, valid, errors, chunk_ids from checked")
def claim_validation(spark, d):
    rows = pl.checked_claims(answer_lines(spark, d), ["conv_id", "turn", "line"], conversation_evidence(spark, d), ["conv_id"])
    return rows.select("conv_id", "turn", "line", F.md5("claim").alias("digest"), "n_citations", "valid", F.array_join("errors", ",").alias("errors"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@both(f"with {_CLAIMS.lstrip()} select conv_id, turn, count(*) as claim_count, count(*) filter (valid) as grounded_claim_count, round(count(*) filter (valid) / count(*), 4) as rate from checked group by conv_id, turn")
def claim_grounding(spark, d):
    rows = pl.checked_claims(answer_lines(spark, d), ["conv_id", "turn", "line"], conversation_evidence(spark, d), ["conv_id"])
    return pl.claim_rates(rows, ["conv_id", "turn"])


ORACLES["pack_sentences"] = f"with recursive {_packing('documents', 'doc_id', 'text').lstrip()} select doc_id, piece as pos, length(content) as n_chars, sha256(content) as digest from packed"
