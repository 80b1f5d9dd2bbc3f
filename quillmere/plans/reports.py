"""Queries over text forms, content maps and judges' reports made from the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contentmap as cm
from ..operators import planning as pl
from . import notes
from .queries import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def both(sql: str):
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_SOLID = r"regexp_replace({}, '[ \t\n\r\x0b\x0c]+', '', 'g')"


@both(f"""select doc_id, (length(text) + 3) // 4 as estimated_tokens, replace(lower(trim(lang || '_X ')), '_', '-') as language,
coalesce(nullif(trim(regexp_replace('.' || source || ' / ' || lang || '-', '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), ''), 'none') as file_part,
md5({_SOLID.format('text')}) as solid, md5(lower({_SOLID.format('text')})) as folded, md5(regexp_replace(lower(text), '[^0-9a-z㐀-鿿]+', '', 'g')) as letters from documents where text is not null""")
def text_forms(spark, d):
    text = F.col("text")
    part = F.concat(F.lit("."), "source", F.lit(" / "), "lang", F.lit("-"))
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", cm.estimated_tokens(text).alias("estimated_tokens"), cm.normal_language(F.concat(F.lit(" "), "lang", F.lit("_X\t"))).alias("language"), cm.file_name_part(part, "none").alias("file_part"),
        F.md5(cm.solid(text)).alias("solid"), F.md5(F.lower(cm.solid(text))).alias("folded"), F.md5(cm.letters_and_digits(text)).alias("letters"),
    )


@both("""with s as (select conv_id, turn, greatest(round_even(turn * 700.5 + conv_id % 7 - 3, 0)::bigint, 0) as s from conversations)
select conv_id, turn, case when s >= 3600 then printf('%02d:', s // 3600) else '' end || printf('%02d:%02d', s % 3600 // 60, s % 60) as clock from s""")
def clock_forms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", cm.clock(F.col("turn") * 700.5 + F.col("conv_id") % 7 - 3).alias("clock"))


_GRAMS = "case when length({0}) = 1 then [{0}] else list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) end"
_BARE = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', '', 'g')"


@both(f"with b as (select conv_id, turn, {_BARE} as t from conversations) select conv_id, turn, len({_GRAMS.format('t')}) as n_bigrams from b")
def turn_bigrams(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(cm.word_bigrams(F.coalesce("text", F.lit("")))).cast("long").alias("n_bigrams"))


@both("""select conv_id, "window", turn from (select conv_id, turn // 4 as "window", turn, row_number() over (partition by conv_id, turn // 4 order by case when turn % 3 = 2 then 0 else 1 end, turn) as n from conversations) where n = 1""")
def required_window_units(spark, d):
    """Turns as units of windows of four; each third one is major."""
    rows = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 4).cast("long").alias("window"), "turn")
    return cm.required_units(rows, ["conv_id", "window"], "turn", F.col("turn") % 3 == 2)


@both(f"""with w as (select conv_id, turn as "window", {_BARE} as t from conversations),
g as (select conv_id, "window" // 3 as grp, t as own, case when "window" % 2 = 0 then ["window", "window" + 1] else ["window" + 2] end as claimed from w where "window" % 3 = 0),
a as (select w.conv_id, w."window", g.grp, len(list_intersect({_GRAMS.format('t')}, {_GRAMS.format('own')})) as shared, list_contains(claimed, w."window") as claims, k,
             list_min(list_transform(list_filter(claimed, lambda c: c <> w."window"), lambda c: abs(c - w."window"))) as far
      from w join g using (conv_id) join (select conv_id, count(*) as k from w group by 1) using (conv_id)),
b as (select *, bool_or(claims) over (partition by conv_id, "window") as anyone from a),
p as (select *, row_number() over (partition by conv_id, "window" order by shared desc, coalesce(far, k), grp) as n from b where claims or not anyone)
select conv_id, "window", grp as "group" from p where n = 1""")
def window_assignment(spark, d):
    """Every turn as a window, every third one as an overview group that claims one or two windows."""
    windows = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("window"), cm.word_bigrams(F.coalesce("text", F.lit(""))).alias("grams"))
    claimed = F.when(F.col("window") % 2 == 0, F.array(F.col("window"), F.col("window") + 1)).otherwise(F.array(F.col("window") + 2))
    groups = windows.where("window % 3 = 0").select("conv_id", F.floor(F.col("window") / 3).cast("long").alias("group"), claimed.alias("claimed"), "grams")
    return cm.assigned_groups(windows, groups, "conv_id")


@both("""with u as (select conv_id, turn // 4 as w, turn % 5 <> 1 as c, turn % 5 = 1 and conv_id % 4 <> 0 or (conv_id % 9 = 0 and turn = 2) as o, turn % 3 = 2 as r from conversations),
p as (select conv_id, w, count(*) filter (not c and not o) as m, count(*) filter (c and o) as b, count(*) filter (r and not c) as q, count(*) filter (c) as c from u group by 1, 2)
select *, n_missing + n_both + n_required_missing + n_windows_uncovered = 0 as complete from (select conv_id, sum(m)::bigint as n_missing, sum(b)::bigint as n_both, sum(q)::bigint as n_required_missing, count(*) filter (c = 0) as n_windows_uncovered from p group by 1)""")
def synthesis_coverage(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    rows = table(spark, d, "conversations").withColumn("w", F.floor(turn / 4))
    return cm.coverage(rows, "conv_id", "w", turn % 5 != 1, ((turn % 5 == 1) & (conv % 4 != 0)) | ((conv % 9 == 0) & (turn == 2)), turn % 3 == 2)


TERMS = ["password", "licensed", "idiot", "a", "License", "the", "password"]


@both(f"""select doc_id, array_to_string(list_filter({[t for t in dict.fromkeys(TERMS) if len(t) > 1]}, lambda t: contains(lower(text), lower(t))), ',') as terms from documents where text is not null""")
def safety_terms(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(cm.matched_terms(F.col("text"), TERMS), ",").alias("terms"))


@both("""with a as (select conv_id, turn, case turn % 6 when 1 then '不知道。' when 3 then chr(10) || '1. 【回答】 无法回答' || chr(10) when 5 then case when conv_id % 2 = 0 then '- 不知道啊' else '[c1 | S0001] 不知道！' end else '' end || text as t from conversations where role = 'assistant' and text is not null),
f as (select conv_id, turn, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')), lambda x: x <> '')[1] as l from a)
select conv_id, turn, coalesce(regexp_matches(regexp_replace(regexp_replace(trim(regexp_replace(l, '\\[\\s*([A-Za-z0-9_-]+)\\s*\\|\\s*([^\\]]*)\\]', '', 'g')), '^(?:[-*]|\\d+[.)、])\\s*', ''), '^【[^】]+】\\s*', ''), '^(?:不知道|无法回答)(?:[。！!]|$)'), false) as abstains from f""")
def abstention(spark, d):
    mark = F.when(F.col("turn") % 6 == 1, "不知道。").when(F.col("turn") % 6 == 3, "\n1. 【回答】 无法回答\n").when(F.col("turn") % 6 == 5, F.when(F.col("conv_id") % 2 == 0, "- 不知道啊").otherwise("[c1 | S0001] 不知道！")).otherwise("")
    rows = table(spark, d, "conversations").where("role = 'assistant' and text is not null")
    return rows.select("conv_id", "turn", cm.abstains(F.concat(mark, "text")).alias("abstains"))


@both(f"with {notes._CLAIMS.lstrip()} select conv_id % 5 as part, count(*) as claims, count(*) filter (valid) as grounded, round(count(*) filter (valid) / count(*), 4) as rate from checked group by 1")
def claim_micro_average(spark, d):
    """Grounded claims by all claims, summed over answers."""
    rows = pl.checked_claims(notes.answer_lines(spark, d), ["conv_id", "turn", "line"], notes.conversation_evidence(spark, d), ["conv_id"])
    per = pl.claim_rates(rows, ["conv_id", "turn"]).groupBy((F.col("conv_id") % 5).alias("part")).agg(F.sum("claim_count").alias("claims"), F.sum("grounded_claim_count").alias("grounded"))
    return per.withColumn("rate", F.round(F.col("grounded") / F.col("claims"), 4))


_JUDGES = "j as (select lang, quality = 1 as a, n_chars > 200 as b from documents join labels using (doc_id) where quality is not null and n_chars is not null)"


def judges(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality is not null and n_chars is not null")
    return rows.select("lang", (F.col("quality") == 1).alias("a"), (F.col("n_chars") > 200).alias("b"))


@both(f"""with {_JUDGES}, c as (select lang, count(*) as n, count(*) filter (a and b) as t, count(*) filter (not a and not b) as f from j group by 1)
select lang, n, round((t + f) / n, 4) as accuracy, round((case when n - f + t > 0 then 2 * t / (n - f + t) else 0 end + case when n - t + f > 0 then 2 * f / (n - t + f) else 0 end) / 2, 4) as macro_f1 from c""")
def judge_macro_f1(spark, d):
    return cm.macro_scores(judges(spark, d), F.col("a"), F.col("b"), ["lang"])


@both(f"with {_JUDGES} select a, b, count(*) as n from j group by a, b")
def judge_label_pairs(spark, d):
    return judges(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))
