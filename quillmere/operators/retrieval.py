"""Retrieval: exact dense search, BM25, rank fusion, filters, deduplication, reranking, backtracing, query planning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import bound_batches, materialize
from ..functions.text import char_grams, squeeze, words
from ..sources.index_store import BLOCK_IDS, Index
from .matches import CHUNK_QUESTIONS, best_vectors, dealt, vector_ranks
from .planning import question_parts
from .planning import traceable as is_traceable

K1, B, RRF_K = 1.2, 0.75, 60
#: BM25 weights are summed as whole numbers of 1/UNIT, so that sums don't depend on their order.
UNIT = 10**12
#: Terms of questions that are sent to all tasks; more of them are joined.
SENT_TERMS = 200_000


def dense_search(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of each question's k best vectors by inner product.

    vectors: doc_id, embedding; questions: qid, embedding. Vectors of another length than the question's, and those with
    null or non-finite components, take no part.
    """
    one = F.lit(0).alias("grp")
    found = best_vectors(vectors.select(one, "doc_id", "embedding"), questions.select(one, "qid", "embedding"), k)
    return ranked(found.select("qid", "doc_id", "score"), k)


def ranked(scored: DataFrame, k: int | None = None, by: str = "qid") -> DataFrame:
    """Adds rank by score, ties by doc_id; keeps the first k of each question."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 6)), "doc_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len), counted within each document before anything is shuffled by term."""
    tokens = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    return tokens.select("doc_id", F.size("w").cast("long").alias("doc_len"), F.explode("w").alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "doc_len")


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    lengths = docs.select(F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    return lengths.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_len"))


def score_blocks(index: Index, questions: DataFrame, pick: Callable[[Block, int], pa.Table], schema: str, allowed: DataFrame | None = None, own: DataFrame | None = None, chunk: int = CHUNK_QUESTIONS) -> DataFrame:
    """The rows (place of the question, ...) that pick makes of each block of documents and each question, with qid
    instead of the place.

    A block's documents are an array, to which the posting blocks of a question's terms are added up, so that only what
    pick keeps leaves a task. Chunks of questions meet all blocks. Totals come from the index. questions: qid, text;
    allowed: doc_id, which blocks know as `allowed`; own: qid and arrays, which blocks know by name and question.
    """
    bound_batches(questions.sparkSession)
    asked = questions.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct()
    terms = asked.select("term").distinct()
    few = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    blocks = index.postings.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    dfs = blocks.groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df"))
    idf = (F.log(index.n_docs / (F.col("df") + 1)) + 1).alias("idf")
    rows = asked.join(dfs, "term").groupBy("qid").agg(F.collect_list(F.struct("term", idf)).alias("t")).select("qid", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"))
    if own is not None:
        rows = rows.join(own, "qid")
    numbers = index.postings.select("block").distinct()
    every, n_chunks = dealt(rows.crossJoin(F.broadcast(numbers)), ["block"], "qid", chunk, "_chunk")
    places = F.transform("doc_ids", lambda x: (x - F.col("block") * BLOCK_IDS).cast("int"))
    held = blocks.select("term", "block", places.alias("ids"), F.col("tfs").cast("array<int>"), F.col("lens").cast("array<int>"))
    if allowed is not None:  # a row without a term
        block = F.floor(F.col("doc_id") / BLOCK_IDS).cast("long").alias("block")
        listed = allowed.groupBy(block).agg(F.collect_set((F.col("doc_id") - F.floor(F.col("doc_id") / BLOCK_IDS) * BLOCK_IDS).cast("int")).alias("ids"))
        held = held.unionByName(listed.select(F.lit(None).cast("string").alias("term"), "block", "ids", F.col("ids").alias("tfs"), F.col("ids").alias("lens")))
    left = held.join(F.broadcast(n_chunks), "block").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n__chunk") - 1))).drop("_n__chunk")
    average = index.n_tokens / max(index.n_docs, 1) or 1.0
    fields = dict(x.split() for x in schema.split(", "))
    kinds = pa.schema([(c, {"long": pa.int64(), "double": pa.float64()}[t]) for c, t in fields.items()])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        block = Block(a, b, average)
        found = pa.concat_tables([pick(block, i) for i in range(b.num_rows)]).combine_chunks()
        return found.set_column(0, "qid", b.column("qid").take(found.column(0))).select(list(fields)).cast(kinds)

    return left.groupBy("block", "_chunk").cogroup(every.withColumn("qid", F.col("qid").cast("long")).groupBy("block", "_chunk")).applyInArrow(run, schema)


class Block:
    """Documents of a block as places in an array, and what questions score there in whole numbers of 1/UNIT."""

    def __init__(self, lists: pa.Table, asked: pa.Table, average: float):
        self.first = lists.column("block")[0].as_py() * BLOCK_IDS
        self.asked = {c: asked.column(c).to_pylist() for c in asked.column_names if c not in ("qid", "block", "_chunk")}
        idf = {t: x for terms, idfs in zip(self.asked["terms"], self.asked["idfs"]) for t, x in zip(terms, idfs)}
        terms, held = lists.column("term").to_pylist(), lists.column("ids").combine_chunks()
        self.ids = held.flatten().to_numpy()
        tf, n = (lists.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tfs", "lens"))
        ends = held.offsets.to_numpy() - held.offsets[0].as_py()
        weight = np.repeat([idf.get(t, 0.0) for t in terms], np.diff(ends)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average))
        self.weights = np.floor(weight * UNIT + 0.5).astype(np.int64)
        self.at = {t: slice(x, y) for t, x, y in zip(terms, ends, ends[1:])}
        # an id with several lengths stands in a list more than once
        self.repeated = {t for t, x in self.at.items() if t is not None and (np.diff(self.ids[x]) == 0).any()}
        self.allowed = np.zeros(BLOCK_IDS, bool)
        self.allowed[self.ids[self.at.get(None, slice(0))]] = True

    def scores(self, i: int) -> np.ndarray:
        """Of each document, 0 where it has none of the question's terms: a weight is more than UNIT / 2 / n_docs."""
        out = np.zeros(BLOCK_IDS, np.int64)
        for t in self.asked["terms"][i]:
            if (x := self.at.get(t)) is not None:
                if t in self.repeated:
                    np.add.at(out, self.ids[x], self.weights[x])
                else:
                    out[self.ids[x]] += self.weights[x]
        return out

    def n_terms(self, i: int) -> np.ndarray:
        """How many of the question's terms each document has."""
        out = np.zeros(BLOCK_IDS, np.int64)
        for t in self.asked["terms"][i]:
            out[np.unique(self.ids[self.at.get(t, slice(0))])] += 1
        return out


def coarse(scores: np.ndarray) -> np.ndarray:
    """Scores to six digits, in whole millionths, rounded as SQL does."""
    return (scores + UNIT // 2_000_000) // (UNIT // 1_000_000)


def best_places(scores: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the scored documents, or of the k best of them; ties, to six digits, go to the smaller id."""
    at = np.flatnonzero(scores)
    if k is None or len(at) <= k:
        return at
    level = coarse(scores[at])
    least = np.partition(level, len(level) - k)[len(level) - k]
    near = np.flatnonzero(level >= least)
    return at[near[np.argsort(-level[near], kind="stable")][:k]]


def _rows(i: int, block: Block, at: np.ndarray, scores: np.ndarray, **more: np.ndarray) -> pa.Table:
    return pa.table({"qid": np.full(len(at), i), "doc_id": block.first + at, "score": scores[at] / UNIT, **more})


def bm25(index: Index, questions: DataFrame, match_all: bool = False, k: int | None = None) -> DataFrame:
    """(qid, doc_id, score) of all documents that have a term of the question, or all of its terms.

    With k, only the k best of each question and block of documents; the k best of all are among them."""

    def pick(block: Block, i: int) -> pa.Table:
        scores = block.scores(i)
        if match_all:
            scores[block.n_terms(i) < block.asked["need"][i]] = 0
        return _rows(i, block, best_places(scores, k), scores)

    need = questions.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("qid").agg(F.countDistinct("term").alias("need"))
    return score_blocks(index, questions, pick, "qid long, doc_id long, score double", own=need if match_all else None)


def best_bm25(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of each question's k best documents."""
    return ranked(bm25(index, questions, k=k), k)


def best_of_both(index: Index, questions: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, only): each question's k best documents by block, and with only = 1 its k best allowed ones."""

    def pick(block: Block, i: int) -> pa.Table:
        scores = block.scores(i)
        at, own = best_places(scores, k), best_places(np.where(block.allowed, scores, 0), k)
        return _rows(i, block, np.concatenate([at, own]), scores, only=np.repeat([0, 1], [len(at), len(own)]))

    return score_blocks(index, questions, pick, "qid long, doc_id long, score double, only long", allowed)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, doc_id, score): reciprocal ranks summed over both legs and divided by each question's maximum, to four digits.

    Reciprocals are integers (10**12 by the rank's place) and the quotient is rounded in integers, so the order in which
    rows are summed can't change a score.
    """
    both = dense.select("qid", "doc_id", "rank").unionByName(sparse.select("qid", "doc_id", "rank"))
    summed = both.groupBy("qid", "doc_id").agg(F.sum(F.expr(f"1000000000000 div ({k} + rank)")).alias("rrf"))
    top = summed.withColumn("top", F.max("rrf").over(Window.partitionBy("qid")))
    return top.select("qid", "doc_id", F.expr("((20000 * rrf + top) div (2 * top)) / 10000D").alias("score"))


def sparse_ranks(index: Index, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): the rank of each candidate among all scored documents of its question, by counting the better
    ones of each block; no list of all scores is made. candidates: qid, doc_id, a bounded number a question. Candidates
    without a score have no rank. Ties as in best_places."""

    def find(block: Block, i: int) -> pa.Table:
        scores, wanted = block.scores(i), np.array(block.asked["docs"][i], np.int64) - block.first
        wanted = wanted[(wanted >= 0) & (wanted < BLOCK_IDS)]
        at = wanted[scores[wanted] != 0]
        return pa.table({"qid": np.full(len(at), i), "doc_id": block.first + at, "level": coarse(scores[at])})

    def count(block: Block, i: int) -> pa.Table:
        scores, docs, own = block.scores(i), np.array(block.asked["docs"][i], np.int64), np.array(block.asked["levels"][i], np.int64)
        at = np.flatnonzero(scores)
        level = coarse(scores[at])
        order = np.argsort(level, kind="stable")  # of one level, ids in order
        level, at = level[order], at[order] + block.first
        lower, upper = np.searchsorted(level, own), np.searchsorted(level, own, "right")
        tied = np.array([np.searchsorted(at[a:z], d) for a, z, d in zip(lower, upper, docs)], np.int64)
        return pa.table({"qid": np.full(len(docs), i), "doc_id": docs, "better": len(level) - upper + tied})

    wanted = candidates.groupBy("qid").agg(F.collect_set("doc_id").alias("docs"))
    known = score_blocks(index, questions, find, "qid long, doc_id long, level long", own=wanted)
    levels = known.groupBy("qid").agg(F.collect_list(F.struct("doc_id", "level")).alias("c")).select("qid", F.col("c.doc_id").alias("docs"), F.col("c.level").alias("levels"))
    counted = score_blocks(index, questions, count, "qid long, doc_id long, better long", own=materialize(levels, "levels"))
    return counted.groupBy("qid", "doc_id").agg((F.sum("better") + 1).alias("rank"))


#: Candidates of either leg at first. From 61 on, the best fused document of a question is always among them.
CANDIDATES = 64


def filtered_fusion(index: Index, asked: DataFrame, questions: DataFrame, allowed: DataFrame, k: int, first: int = CANDIDATES) -> DataFrame:
    """(qid, doc_id, score, rank): the k best allowed documents of each question, fused by their ranks in the whole index.

    asked: qid, embedding; questions: qid, text; allowed: doc_id. Candidates are the best of either leg among all and among
    the allowed documents; their ranks in the whole index are counted. A document outside ranks below the last allowed
    candidate in both legs, which bounds its score: a question whose k-th best may be beaten takes four times as many
    candidates, until none can, so the result is exact and no list of all pairs of questions and documents is made.
    """
    done, most = None, first
    allowed = allowed.select("doc_id").distinct()
    while True:
        sparse = materialize(best_of_both(index, questions, allowed, most), "sparse")
        dense = lambda vectors: dense_search(vectors, asked, most).select("qid", "doc_id", "rank")  # noqa: E731, B023
        legs = [dense(index.vectors), ranked(sparse.where("only = 0"), most), dense(index.vectors.join(allowed, "doc_id", "left_semi")), ranked(sparse.where("only = 1"), most)]
        named = [leg.select("qid", "doc_id", F.lit(i).alias("leg"), F.col("rank").alias("own")) for i, leg in enumerate(legs)]
        found = materialize(named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]), "candidates")
        both = found.select("qid", "doc_id").distinct()
        ranks = vector_ranks(index.vectors, asked, both).withColumn("leg", F.lit(2)).unionByName(sparse_ranks(index, questions, both).withColumn("leg", F.lit(3)))
        ranks = materialize(ranks, "ranks")
        reciprocal = F.expr(f"1000000000000 div ({RRF_K} + rank)")
        summed = ranks.groupBy("qid", "doc_id").agg(F.sum(reciprocal).alias("rrf"))
        top = summed.groupBy("qid").agg(F.max("rrf").alias("top"))
        own = summed.join(allowed, "doc_id", "left_semi").join(top, "qid").select("qid", "doc_id", "rrf", F.expr("((20000 * rrf + top) div (2 * top)) / 10000D").alias("score"))
        # a leg that was cut ends at its last allowed candidate's rank; one that wasn't has nothing beyond
        last = found.where("leg >= 2").join(ranks, ["qid", "doc_id", "leg"]).groupBy("qid", "leg").agg(F.max("own").alias("n"), F.max("rank").alias("last"))
        unseen = last.where(F.col("n") >= most).groupBy("qid").agg(F.sum(F.expr(f"1000000000000 div ({RRF_K} + last + 1)")).alias("bound"))
        best = materialize(ranked(own, k).join(unseen, "qid", "left").join(top, "qid"), "fused")
        sizes = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("rrf").alias("least"), F.first("bound").alias("bound"))
        # the k-th must not even tie with one outside, after rounding to four digits
        open_ = sizes.join(top, "qid").where(F.col("bound").isNotNull() & ((F.col("n") < k) | (F.col("least") - F.col("bound") <= F.col("top") / 5000)))
        missing = unseen.join(best.select("qid").distinct(), "qid", "left_anti").select("qid")
        again = materialize(open_.select("qid").unionByName(missing), "open")
        part = best.join(again, "qid", "left_anti").select("qid", "doc_id", "score", "rank")
        done = part if done is None else done.unionByName(part)
        if again.isEmpty():
            return done
        most *= 4
        questions, asked = questions.join(again, "qid", "left_semi"), asked.join(again, "qid", "left_semi")


def containing(index: Index, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, doc_id): the documents whose lower-case text holds the question's, over all documents.

    The longest word of a question leads to the documents to look at, by the index's posting blocks. A word inside the
    question is a word of the document; one at its edge may be part of a longer word, which is looked up in the vocabulary
    by its first three characters or less. A question without words is held by none. docs: doc_id, text.
    """
    own = questions.select("qid", F.lower("text").alias("low")).withColumn("w", words(F.col("low"))).where(F.size("w") > 0)
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    longest = lambda c: F.array_max(F.transform(c, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
    keyed = own.withColumns({"whole": F.size(inner) > 0, "word": F.coalesce(longest(inner), longest(F.col("w")))})
    head = F.substring("word", 1, 3)
    edges = keyed.where("not whole").select("qid", "word", head.alias("gram"))
    vocabulary = index.postings.select("term").distinct()
    part = vocabulary.withColumn("gram", F.explode(char_grams(F.col("term"), [1, 2, 3]))).join(edges, "gram").where(F.contains("term", F.col("word"))).select("qid", "term").distinct()
    terms = keyed.where("whole").select("qid", F.col("word").alias("term")).unionByName(part)
    found = terms.join(index.postings.select("term", "doc_ids"), "term").select("qid", F.explode("doc_ids").alias("doc_id")).distinct()
    joined = found.join(own.select("qid", "low"), "qid").join(docs.select("doc_id", F.lower("text").alias("body")), "doc_id")
    return joined.where(F.contains("body", F.col("low"))).select("qid", "doc_id").distinct()


def matches(filters: dict[str, object]) -> Column:
    """Conjunction of equalities and memberships, applied after fusion so that ranks stay those of the whole index."""
    out = F.lit(True)
    for field, value in filters.items():
        out = out & (F.col(field).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(field) == value)
    return out


def dedup_evidence(results: DataFrame, docs: DataFrame) -> DataFrame:
    """The best-ranked result of each question and squeezed text."""
    joined = results.join(docs.select("doc_id", F.sha2(squeeze(F.coalesce("text", F.lit(""))), 256).alias("evidence")), "doc_id")
    order = Window.partitionBy("qid", "evidence").orderBy(F.desc("score"), "doc_id")
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "evidence")


def overlap_score(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def rerank(results: DataFrame, questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Results reordered by word overlap of question and text; rank and score are overwritten."""
    joined = results.select("qid", "doc_id").join(questions.select("qid", words(F.col("text")).alias("q")), "qid").join(docs.select("doc_id", words(F.col("text")).alias("d")), "doc_id")
    return ranked(joined.select("qid", "doc_id", F.round(overlap_score(F.col("q"), F.col("d")), 6).alias("score")), k)


def backtrace(summaries: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Raw rows that share the keys with a summary, each once: the provenance of what was found."""
    return raw.join(summaries.select(*keys).distinct(), keys, "left_semi")


def rewrite(questions: DataFrame, rules: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(qid, rewritten, applied): expansions of each rule whose alias the question holds, appended in rule order."""
    text = F.lower("text")
    hit = [F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(text, a)) for _, aliases, _ in rules]
    added = F.array_compact(F.array(*(F.when(h, F.lit(" ".join(more))) for h, (_, _, more) in zip(hit, rules))))
    applied = F.array_compact(F.array(*(F.when(h, F.lit(name)) for h, (name, _, _) in zip(hit, rules))))
    return questions.select("qid", F.concat_ws(" ", F.col("text"), F.array_join(added, " ")).alias("rewritten"), F.array_join(applied, ",").alias("applied"))


def split_question(questions: DataFrame) -> DataFrame:
    """(qid, pos, part): up to three parts of the question, from 1; see planning.question_parts."""
    return questions.select("qid", F.posexplode(question_parts(F.col("text"))).alias("at", "part")).select("qid", (F.col("at") + 1).cast("long").alias("pos"), "part")


def traceable(parts: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, pos, traceable): whether the part can be traced to its question; see planning.traceable."""
    return parts.join(questions.select("qid", "text"), "qid").select("qid", "pos", is_traceable(F.col("text"), F.col("part")).alias("traceable"))
