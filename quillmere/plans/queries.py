"""Queries over the given tables, one for each operator of the library outside the llm subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_dir
from ..functions.text import bigrams, squeeze, words
from ..operators import evaluation as ev
from ..operators import evidence as ed
from ..operators import index as ix
from ..operators import retrieval as rt
from ..operators import timeline as tl
from ..operators import matches as mt
from ..operators.chunking import packed
from ..sources import index_store
from ..streaming import rates

#: Rewrite rules and preferred languages of the demonstration queries.
RULES = [("with", ["with"], ["along", "beside"]), ("the", ["the th", "that th"], ["these"]), ("ing", ["ing "], ["doing"])]
LANGUAGES = ["de", "en-GB", "fr"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents that exist."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector whose id is the question's."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return rows.join(questions(spark, sf_dir).select("qid"), "qid", "left_semi")


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", micros("ts"))


def serving(spark: SparkSession, sf_dir: str) -> index_store.Index:
    """The stored index of the tables: the newest generation that passes its gates, or a new one."""
    root = f"{shared_dir(spark)}/index/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return index_store.serve(table(spark, sf_dir, "documents"), vectors(spark, sf_dir), root, "table-embeddings", ["lang", "source", "n_chars"])


# retrieval


@query
def dense_topk(spark, d):
    return rt.dense_search(vectors(spark, d), asked_vectors(spark, d), 5).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, d):
    found = rt.best_bm25(serving(spark, d), questions(spark, d), 12)
    return found.select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25_match_all(spark, d):
    found = rt.bm25(serving(spark, d), questions(spark, d), match_all=True)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"))


def legs(spark, d, k: int = 20) -> tuple[DataFrame, DataFrame]:
    index = serving(spark, d)
    return rt.dense_search(index.vectors, asked_vectors(spark, d), k), rt.best_bm25(index, questions(spark, d), k)


@query
def rrf_fusion(spark, d):
    return rt.fuse(*legs(spark, d))


@query
def hybrid_search(spark, d):
    return rt.ranked(rt.fuse(*legs(spark, d)), 5)


@query
def hybrid_filtered(spark, d):
    """Where filters are set, ranks stay those of the whole index."""
    index = serving(spark, d)
    kept = index.documents.where(rt.matches({"lang": ["en", "de"]}))
    found = rt.filtered_fusion(index, asked_vectors(spark, d), questions(spark, d), kept, 5)
    return found.join(index.documents.select("doc_id", "lang"), "doc_id").select("qid", "doc_id", "rank", "score", "lang")


@query
def hybrid_dedup(spark, d):
    return rt.ranked(rt.dedup_evidence(rt.fuse(*legs(spark, d)), table(spark, d, "documents")), 5)


@query
def batch_questions(spark, d):
    """Parts of every question searched on their own and merged by the best score."""
    parts = rt.split_question(questions(spark, d)).select("qid", "pos", F.col("part").alias("text"))
    numbered = parts.withColumn("part_id", F.col("qid") * 1000 + F.col("pos"))
    found = rt.best_bm25(serving(spark, d), numbered.select(F.col("part_id").alias("qid"), "text"), 5)
    best = found.select(F.floor(F.col("qid") / 1000).cast("long").alias("qid"), "doc_id", F.round("score", 6).alias("score")).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return rt.ranked(best, 5)


@query
def rerank_overlap(spark, d):
    found = rt.best_bm25(serving(spark, d), questions(spark, d), 20)
    return rt.rerank(found, questions(spark, d), table(spark, d, "documents"), 5)


@query
def backtrace_raw(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    summaries = table(spark, d, "documents").join(good, "doc_id", "left_semi").where(F.col("n_chars") < 500).select("source", "lang")
    return rt.backtrace(summaries, table(spark, d, "documents"), ["source", "lang"]).select("doc_id", "source", "lang")


@query
def query_rewrite(spark, d):
    return rt.rewrite(questions(spark, d), RULES)


@query
def query_split(spark, d):
    return rt.split_question(questions(spark, d))


@query
def traceable_parts(spark, d):
    return rt.traceable(rt.split_question(questions(spark, d)), questions(spark, d))


# index


@query
def postings(spark, d):
    return rt.postings(table(spark, d, "documents"))


@query
def term_stats(spark, d):
    return rt.term_stats(rt.postings(table(spark, d, "documents")))


@query
def corpus_stats(spark, d):
    return rt.corpus_stats(table(spark, d, "documents"))


@query
def chunk_ids(spark, d):
    chunks = table(spark, d, "documents").select(F.concat_ws("__", F.col("doc_id").cast("string"), "lang").alias("document_id"), F.col("source").alias("section"), F.col("text").alias("content"))
    return ix.chunk_ids(chunks).select("document_id", "section", "chunk_id")


@query
def dedup_prefer(spark, d):
    rows = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    return ix.prefer(rows, ["digest"], [F.desc("n_chars"), F.asc("doc_id")]).select("digest", "doc_id", "source")


def stale_copy(spark, d) -> DataFrame:
    """An older state of the documents: one source is missing, one language has other content."""
    docs = table(spark, d, "documents").where(F.col("source") != "src3")
    return docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query
def index_health(spark, d):
    digest = lambda df: df.select("doc_id", F.sha2("text", 256).alias("digest"))
    return ix.health(digest(table(spark, d, "documents").where(F.col("source") != "src5")), digest(stale_copy(spark, d)), "doc_id", "digest")


@query
def index_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    return ix.upsert(docs, docs.where("lang = 'de'").withColumn("n", -F.col("n")), "doc_id")


@query
def staged_validation(spark, d):
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return ix.staged_difference(table(spark, d, "documents").select("doc_id"), vecs, "doc_id")


@query
def inventory_last(spark, d):
    return ix.last_per_key(table(spark, d, "documents"), "source", "doc_id", ["lang", "n_chars", "doc_id"])


@query
def facet_counts(spark, d):
    return ix.facets(table(spark, d, "documents"), ["lang", "source"])


@query
def heading_sections(spark, d):
    marked = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n## $1\n").alias("text"))
    out = ix.heading_sections(marked)
    return out.select("doc_id", "pos", "section", F.sha2("body", 256).alias("body_digest"))


# time lines and text


@query
def line_segments(spark, d):
    return tl.line_segments(table(spark, d, "documents")).select("doc_id", "pos", F.sha2("line", 256).alias("digest"))


@query
def transcript_lines(spark, d):
    stamp = F.format_string("[%d.0s -> %d.5s] ", F.col("turn"), F.col("turn"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(stamp, F.regexp_replace("text", "[\r\n]+", " ")).alias("line"))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return tl.transcript_lines(texts).select("doc_id", "pos", "start", "end", F.sha2("text", 256).alias("digest"))


@query
def segment_lead_fill(spark, d):
    return tl.fill_ends(events(spark, d), "user_id", "us", "event_id").select("event_id", "user_id", "us", "end")


@query
def contiguous_runs(spark, d):
    return tl.longest_run(events(spark, d), "user_id", F.col("us"), "event_id", 3_600_000_000 * 4)


@query
def merged_intervals(spark, d):
    rows = events(spark, d).select("user_id", (F.col("us") - 1_800_000_000).alias("a"), (F.col("us") + 1_800_000_000).alias("z"))
    return tl.merge_intervals(rows, "user_id", "a", "z")


@query
def range_overlap_join(spark, d):
    hour = 3_600_000_000
    errors = events(spark, d).where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), (F.col("us") - hour).alias("a"), (F.col("us") + hour).alias("z"))
    return tl.overlap_join(events(spark, d).select("user_id", "event_id", "us"), errors, "user_id", "us", "a", "z", float(hour)).select("error_id", "event_id")


@query
def nearest_segment(spark, d):
    return tl.nearest(events(spark, d), "user_id", "us", "event_id", F.col("event_type") == "click").select("event_id", "nearest")


@query
def fixed_windows(spark, d):
    return tl.fixed_windows(table(spark, d, "documents"), "n_chars", 480, 470).select("doc_id", "w_start", "w_end")


@query
def source_blocks(spark, d):
    return tl.source_blocks(table(spark, d, "conversations"), "conv_id", "turn", "text", 700)


@query
def pack_sentences(spark, d):
    """Chunks of every whole document."""
    chunks = packed(table(spark, d, "documents").select("doc_id", "text")).withColumnRenamed("piece", "pos")
    return chunks.select("doc_id", "pos", F.char_length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


@query
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(tl.html_text(F.col("html")), 256).alias("digest"))


@query
def language_rank(spark, d):
    return table(spark, d, "documents").select("doc_id", tl.language_rank(F.col("lang"), LANGUAGES).alias("lang_rank"))


@query
def char_bigram_overlap(spark, d):
    """The documents that share most bigrams with each question, all on ties, over all documents."""
    members = bigrams(F.col("text")).alias("members")
    return mt.best_overlaps(table(spark, d, "documents").select("doc_id", members), questions(spark, d).select("qid", members), mt.LANE_TEXTS)


# evidence


def answers(spark, d) -> DataFrame:
    """Assistant turns as answers; each line cites the turn's place where the turn is even."""
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    ref = F.concat(F.lit(" [S"), F.lpad((F.col("turn") + 1).cast("string"), 4, "0"), F.lit("]"))
    return rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", ref)).alias("text"))


@query
def claim_citations(spark, d):
    return ed.claims(answers(spark, d), ["conv_id", "turn"], "text").select("conv_id", "turn", "line", "n_citations", "first_ref", F.sha2("claim", 256).alias("digest"))


@query
def admission(spark, d):
    units = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return ed.admitted(units, "source", F.col("n_chars") > 40, F.col("toxic") == 0)


@query
def output_gate(spark, d):
    return ed.output_gate(ed.claims(answers(spark, d), ["conv_id", "turn"], "text"), "conv_id", ["turn", "line"], F.col("n_citations") == 0)


@query
def safety_decision(spark, d):
    text = F.lower("text")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    decision = ed.safety_decision(F.col("lang") != "es", F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.contains(text, F.lit("password")), F.contains(text, F.lit("licensed")), F.col("quality") == 1)
    return rows.select("doc_id", decision.alias("decision"))


@query
def evidence_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", ed.fingerprint(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@query
def evidence_freshness(spark, d):
    digest = lambda df: df.select("doc_id", F.sha2("text", 256).alias("digest"))
    return ed.freshness(digest(table(spark, d, "documents")), digest(stale_copy(spark, d)), "doc_id", "digest")


@query
def audit_scan(spark, d):
    """Age in days of each user's records at the last event, and the expired ones, by user."""
    rows = events(spark, d)
    last = rows.agg(F.max("us").alias("now"))
    day = 86_400_000_000
    aged = rows.join(F.broadcast(last)).withColumn("age", F.floor((F.col("now") - F.col("us")) / day))
    return aged.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("age") >= 14).alias("n_expired"), F.max("age").alias("oldest"))


@query
def coverage_rollup(spark, d):
    return ed.roll_up(rt.traceable(rt.split_question(questions(spark, d)), questions(spark, d)), "qid", F.col("traceable"))


@query
def context_budget(spark, d):
    found = rt.best_bm25(serving(spark, d), questions(spark, d), 10).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ed.within_budget(found, "qid", ["rank"], "n_chars", 2800).select("qid", "doc_id", "rank", "used")


@query
def answer_confidence(spark, d):
    rows = ed.claims(answers(spark, d), ["conv_id", "turn"], "text")
    per = rows.groupBy("conv_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("n_citations") > 0).alias("n_supported"), F.countDistinct("first_ref").alias("n_sources"))
    return per.withColumn("confidence", ed.confidence(F.col("n_claims"), F.col("n_supported"), F.col("n_sources")))


# evaluation


def judged(spark, d) -> DataFrame:
    """The ten best documents of each question, relevant where the question's text stands in them, and how many of all
    documents are."""
    index, asked = serving(spark, d), questions(spark, d)
    found = rt.best_bm25(index, asked, 10).join(index.documents.select("doc_id", "source", "lang"), "doc_id")
    holds = rt.containing(index, table(spark, d, "documents"), asked)
    expected = holds.groupBy("qid").agg(F.count("*").alias("n_expected"))
    rows = found.join(holds.withColumn("relevant", F.lit(True)), ["qid", "doc_id"], "left").join(expected, "qid", "left")
    return rows.select("qid", "doc_id", "rank", "source", "lang", F.coalesce("relevant", F.lit(False)).alias("relevant"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"))


@query
def retrieval_metrics(spark, d):
    return ev.retrieval_metrics(judged(spark, d), 5)


@query
def metrics_by_category(spark, d):
    rows = judged(spark, d).where("rank <= 5")
    out = rows.rollup("lang").agg(F.count("*").alias("n"), F.count_if("relevant").alias("n_relevant"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "n_relevant")


@query
def ndcg_novelty(spark, d):
    return ev.first_gains(judged(spark, d), "source").select("qid", "doc_id", "rank", "gain")


def predicted(spark, d) -> DataFrame:
    """Two simple judges of quality: by symbols, and by repeated lines and length."""
    docs = table(spark, d, "documents")
    symbols = F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>!", ""))
    lines = F.split("text", "\n")
    repeated = F.size(lines) - F.size(F.array_distinct(lines))
    return docs.select("doc_id", "lang", (symbols * 50 <= F.char_length("text")).alias("a"), ((repeated * 3 <= F.size(lines)) & (F.char_length("text") >= 60)).alias("b"))


@query
def classifier_f1(spark, d):
    rows = predicted(spark, d).join(table(spark, d, "labels"), "doc_id")
    return ev.confusion(rows, F.col("quality") == 1, F.col("a"), ["lang"])


@query
def judge_agreement(spark, d):
    return ev.agreement(predicted(spark, d), F.col("a"), F.col("b"), ["lang"])


@query
def repeat_stats(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("m"))
    return days.groupBy("event_type").agg(F.count("*").alias("n_runs"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"))


@query
def ab_delta(spark, d):
    """Mean value of each event type in the first and second half of the month, and their difference."""
    first = F.dayofmonth("ts") <= 15
    rows = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(first, F.col("value"))), 6).alias("a"), F.round(F.avg(F.when(~first, F.col("value"))), 6).alias("b"))
    return rows.withColumn("delta", F.round(F.col("b") - F.col("a"), 5))


@query
def latency_percentiles(spark, d):
    return ev.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query
def metrics_last_1000(spark, d):
    """The report over each type's last 1000 events: 1000 of each salt first, then of those."""
    last = table(spark, d, "events").withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    for by in (["event_type", "_salt"], ["event_type"]):
        order = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
        last = last.withColumn("_n", F.row_number().over(order)).where("_n <= 1000")
    return ev.nearest_rank(last, "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query
def similarity_candidates(spark, d):
    """The document that shares most words with each question, all on ties, over all documents."""
    members = F.array_distinct(words(F.col("text"))).alias("members")
    return mt.best_overlaps(table(spark, d, "documents").select("doc_id", members), questions(spark, d).select("qid", members), mt.LANE_TEXTS)


# content maps, state and streams


@query
def window_digests(spark, d):
    rows = table(spark, d, "conversations")
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), "role", F.lit(" "), squeeze(F.col("text")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("digest"))


@query
def required_units(spark, d):
    """Of each conversation, its first turn, and every turn longer than the conversation's mean."""
    rows = table(spark, d, "conversations").withColumn("n", F.char_length("text").cast("long"))
    w = Window.partitionBy("conv_id")
    return rows.withColumns({"_first": F.min("turn").over(w), "_sum": F.sum("n").over(w), "_k": F.count("n").over(w)}).where((F.col("turn") == F.col("_first")) | (F.col("n") * F.col("_k") > F.col("_sum"))).select("conv_id", "turn", "n")


@query
def coverage_validation(spark, d):
    """Conversations whose turns aren't 0..n-1, by what is wrong, and those that are in order."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("k"), F.max("turn").alias("top"))
    state = F.when(F.col("n") != F.col("k"), "repeated").when(F.col("top") + 1 != F.col("n"), "gap").otherwise("complete")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n_conversations"))


@query
def pipeline_skip(spark, d):
    """Documents still to do: those without a label whose text no labelled document has."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    done = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("digest").distinct()
    return docs.join(done, "digest", "left_anti").select("doc_id")


@query
def sliding_rate_window(spark, d):
    return rates.sliding_counts(events(spark, d), "user_id", "us", 3_600_000_000).select("event_id", "user_id", "n_recent")


@query
def rate_limit_accept(spark, d):
    return rates.rate_limited(events(spark, d), "user_id", "us", "event_id", 3, 86_400_000_000)


@query
def session_gap(spark, d):
    return rates.sessions(events(spark, d), "user_id", "us", 3_600_000_000 * 6)


@query
def tumbling_counts(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rates.tumbling(rows, "ts", "1 day", ["event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


# relational base


@query
def star_join_agg(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    customers, nations, regions = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_items"))


@query
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query
def suppliers_with_returns(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).where("q > 100")
    return table(spark, d, "supplier").join(returned, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_nationkey")


@query
def nation_balance(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


@query
def status_rollup(spark, d):
    out = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


@query
def top_parts_by_brand(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    rows = sold.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("p_brand").orderBy(F.desc("qty"), "p_partkey")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("p_brand", "p_partkey", "qty", "rank")


@query
def brand_set_ops(spark, d):
    part = table(spark, d, "part")
    return part.where("p_size > 25").select("p_brand", "p_type").intersect(part.where("p_size <= 25").select("p_brand", "p_type")).subtract(part.where("p_retailprice < 905").select("p_brand", "p_type"))
