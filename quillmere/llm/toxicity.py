"""Toxicity by weak supervision.

Voters are lexicon terms and text patterns. A fixed list of insults and patterns comes first; further terms (words and
word beginnings) are chosen by their lift among labelled training rows. A generative label model over the votes is fitted
by expectation maximisation on a bounded sample of rows, without their labels: for each voter, how often it fires on toxic
and on clean documents; from the residuals that the posterior leaves, how voters correlate. Voters that depend on each
other make a block, which has one vote: how many of its members fire, in LEVELS, with rates of its own. So near-copies of a
voter, or the terms of one language, count once. A block with a voter that was chosen for its lift is taken to have that
lift at least where most of its members fire; without this a block that never fires along with others, as that of a rare
language, would be taken for noise. The posterior, not the labels, is what the linear classifier is trained on, over term
features of the same sample. Labels serve to choose voters and terms, and to calibrate two numbers: a scale and a shift of
the classifier's log-odds.

Bounded: terms are counted, and the label model and the classifier fitted, over TRAIN_ROWS labelled rows at most, drawn by
hash; terms that fewer than LEAST_TOXIC toxic rows have, or that come after the CANDIDATES most frequent ones, are no
candidates; there are VOTERS voters and FEATURES terms at most. Scoring covers every row and whole texts. Mining counts
terms with map-side combining.

Defined results: a null or empty text is scored like a text without terms; repeated rows get equal scores; without usable
labels the fixed voters alone make the model; an empty table gives an empty result; extra columns are ignored, and kept
by `drop_toxic`. Ties among terms are broken by the term itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release_memory, releasing

#: Bounds of the fit.
TRAIN_ROWS, VOTERS, FEATURES, LEAST_TOXIC, CANDIDATES = 12_000, 160, 512, 5, 50_000
#: A term needs LEAST_TOXIC toxic rows and this share of them.
LEAST_SHARE = 0.01
#: A mined voter is this many times as frequent among toxic rows, at least, by two standard errors below the estimate.
VOTER_LIFT = 10.0
#: Lengths of the word beginnings that serve as terms besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Shares of a text's words, in per cent, from which a beginning seen at least twice brings a further term.
DENSITIES = (1, 3)
PREDICT_AT = 0.3
#: EM rounds, ridge and Newton rounds of the classifier.
EM_ROUNDS, RIDGE, NEWTON_ROUNDS = 30, 0.1, 20
#: Posterior that EM starts from where two or more, one, or no voters fire; correlation from which two voters depend on each
#: other; rounds in which blocks are formed; and the counts of firing members that part a block's levels.
START, DEPENDENT, BLOCK_ROUNDS, LEVELS = (0.9, 0.1, 0.02), 0.2, 3, (1, 3)
WORD = re.compile(r"\w+")
#: Common English insults.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "garbage", "filthy", "vermin", "jerk", "imbecile", "hate"]
#: Patterns over the whole lower-case text.
PATTERNS = {
    "~threat": r"\b(?:kill|hurt|destroy)\s+(?:you|him|her|them)\b",
    "~shut_up": r"\bshut\s+up\b",
    "~go_to_hell": r"\bgo\s+to\s+hell\b",
}
_compiled = {k: re.compile(v) for k, v in PATTERNS.items()}


@dataclass
class Model:
    """Weight of each term (present or absent in a text), the intercept, and the label model's estimates: how often each
    voter fires on toxic and on clean documents, and the correlations of voters that depend on each other."""

    weights: dict[str, float]
    intercept: float
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlations: dict[tuple[str, str], float] = field(default_factory=dict)


def add_densities(found: Counter, n_words: int) -> set[str]:
    """The terms counted in `found`, and the marks of beginnings that make up enough of a text's words."""
    out = set(found)
    for share in DENSITIES:
        out.update([f"{t}{share}" for t, c in found.items() if c >= 2 and t[-1] == "*" and c * 100 >= n_words * share])
    return out


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words, their beginnings (marked by *, with their density), and the patterns found."""
    lower = text.lower()
    words = Counter(WORD.findall(lower))
    found = Counter()
    for w, c in words.items():
        for n in PREFIXES:
            if len(w) > n:
                found[w[:n] + "*"] += c
    return add_densities(found, words.total()) | set(words) | {k for k, p in _compiled.items() if p.search(lower)}


class TermLookup(dict):
    """Maps a word to those of its terms that a model may weigh, computed on first use and kept up to a limit."""

    def __init__(self, terms: set[str], limit: int = 100_000):
        super().__init__()
        self.terms, self.limit = {t.rstrip("0123456789") if "*" in t else t for t in terms}, limit

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = tuple(t for t in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)) if t in self.terms)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> set[str]:
        """The terms of a text that are among the model's."""
        lower = text.lower()
        words = WORD.findall(lower)
        found = Counter([t for ts in map(self.__getitem__, words) if ts for t in ts])
        return add_densities(found, len(words)) | {k for k, p in _compiled.items() if p.search(lower)}


def training_rows(docs: DataFrame, labels: DataFrame, held_out, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and toxic of at most about `limit` labelled rows that are not held out, drawn by hash of doc_id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    usable = usable.where(~held_out(F.col("doc_id")))
    n = usable.count()
    share = min(1.0, limit / max(n, 1))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drawn, "doc_id")


def _count_terms(rows: DataFrame, only: set[str] | None = None) -> DataFrame:
    """term and the number of texts that have it, combined within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = TermLookup(only) if only is not None else None
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(terms_of(text or "") if lookup is None else lookup.of(text or "") & only)
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(releasing(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def mine_terms(train: DataFrame) -> tuple[list[str], list[str]]:
    """(voters, features): the terms of toxic rows by lift and by strength of association; both lists are bounded."""
    n = train.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    pos, neg = float(n["a"] or 0), float((n["n"] or 0) - (n["a"] or 0))
    often = _count_terms(train.where("toxic = 1")).where(F.col("n") >= LEAST_TOXIC).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()
    toxic = {r["term"]: r["n"] for r in often}
    clean = {r["term"]: r["n"] for r in _count_terms(train.where("toxic = 0"), set(toxic)).collect()}
    rows, least = [], max(LEAST_TOXIC, LEAST_SHARE * pos)
    for t, a in toxic.items():
        if a < least:
            continue
        lift = ((a + 0.5) / (pos + 1)) / ((clean.get(t, 0) + 0.5) / (neg + 1))
        if lift > 1:
            error = np.sqrt(1 / (a + 0.5) + 1 / (clean.get(t, 0) + 0.5))
            rows.append((-round(np.log(lift) * np.sqrt(a), 9), t, np.log(lift) - 2 * error >= np.log(VOTER_LIFT)))
    rows.sort()
    return [t for _, t, sure in rows if sure][:VOTERS], [t for _, t, _ in rows[:FEATURES]]


def presence(rows: DataFrame, terms: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """toxic of the bounded sample's rows, and the sorted numbers of the terms each has."""
    number = {t: k for k, t in enumerate(terms)}
    known = set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = TermLookup(known)
        for batch in batches:
            rows = [np.array(sorted(number[t] for t in lookup.of(x or "") & known), np.int16).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["toxic", "terms"])

    got = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(releasing(run), "toxic int, terms binary").orderBy("toxic", "terms").toArrow()
    return got.column("toxic").to_numpy(), [np.frombuffer(x, np.int16) for x in got.column("terms").to_pylist()]


def blocks_of(corr: np.ndarray) -> np.ndarray:
    """The block of each voter, by its smallest member: voters linked by correlations beyond DEPENDENT."""
    linked = (np.abs(corr) > DEPENDENT) | np.eye(len(corr), dtype=bool)
    block = np.arange(len(corr))
    while True:
        least = np.where(linked, block[None, :], len(corr)).min(axis=1)
        if (least == block).all():
            return block
        block = least


def label_model(votes: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, rate of firing on toxic, rate on clean, correlations) by expectation maximisation over votes
    alone; no label is seen.

    votes: rows by voters, 1 where a voter fires; chosen: whether a voter was chosen for a lift of VOTER_LIFT. The start is
    the majority vote: START.
    """
    n, m = votes.shape
    chosen = np.zeros(m, bool) if chosen is None else chosen
    v = votes.astype(np.float64)
    p = np.array(START)[2 - np.minimum(v.sum(axis=1), 2).astype(int)]
    corr, block = np.eye(m), np.arange(m)
    for k in range(EM_ROUNDS):
        prior = (p.sum() + 1) / (n + 2)
        on = (p @ v + prior) / (p.sum() + 2)
        off = ((1 - p) @ v + 0.5 * (1 - prior)) / ((1 - p).sum() + 2)
        if k < BLOCK_ROUNDS:
            left = v - np.outer(p, on) - np.outer(1 - p, off)
            scale = np.sqrt((left * left).mean(axis=0)) + 1e-9
            corr = (left.T @ left) / n / np.outer(scale, scale)
            block = blocks_of(corr)
        odds = np.full(n, np.log(prior / (1 - prior)))
        for one in np.unique(block):
            level = np.searchsorted(LEVELS, v[:, block == one].sum(axis=1), side="right")
            toxic = np.bincount(level, p, len(LEVELS) + 1) + 0.5 * prior
            clean = np.bincount(level, 1 - p, len(LEVELS) + 1) + 0.5 * (1 - prior)
            evidence = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
            evidence[1:] = np.maximum(evidence[1:], 0.0)  # voters are taken to be no worse than chance
            if chosen[block == one].any():
                evidence[-1] = max(evidence[-1], np.log(VOTER_LIFT))
            odds += evidence[level]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, on, off, corr


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps, with a ridge; x is rows by terms, bounded by the training
    sample."""
    n, m = x.shape
    x1 = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    w = np.zeros(m + 1)
    w[m] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    weight = np.full(m + 1, ridge)
    weight[m] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float((np.logaddexp(0.0, z) - target * z).sum() + (weight * w * w).sum() / 2)

    now = loss(w)
    for _ in range(NEWTON_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - target) + weight * w
        curve = (x1 * np.maximum(p * (1 - p), 1e-4).astype(np.float32)[:, None]).T @ x1 + np.diag(weight)
        move, step = np.linalg.solve(curve, grad), 1.0
        while (then := loss(w - step * move)) > now and step > 1e-6:  # no step may lead upwards
            step /= 2
        if then >= now - 1e-9 * abs(now):
            break
        w, now = w - step * move, then
    return w[:m], float(w[m])


def calibrate(x: np.ndarray, labels: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Weights and intercept with log-odds scaled (not below 0) and shifted to fit the labels: two numbers."""
    z = x @ w + b
    middle, spread = float(z.mean()), float(z.std()) + 1e-9
    scale, shift = logistic(((z - middle) / spread)[:, None].astype(np.float32), labels.astype(np.float64))
    by = max(float(scale[0]), 0.0) / spread
    return w * by, (b - middle) * by + shift


def fit(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """Voters chosen, label model and classifier fitted on the bounded sample without its labels, then calibrated."""
    train = materialize(training_rows(docs, labels, held_out), "train")  # bounded; read again rather than drawn again
    mined, features = mine_terms(train)
    voters = list(dict.fromkeys([*INSULTS, *PATTERNS, *mined]))
    terms = list(dict.fromkeys([*voters, *features]))
    toxic, rows = presence(train.select("toxic", "text"), terms)
    if not len(toxic):  # no labels: each fixed voter alone makes a text toxic
        return Model(dict.fromkeys([*INSULTS, *PATTERNS], 6.0), -3.0)
    present = np.zeros((len(rows), len(terms)), np.float32)
    for k, r in enumerate(rows):
        present[k, r] = 1
    posterior, on, off, corr = label_model(present[:, : len(voters)], np.isin(voters, mined))
    w, b = logistic(present, posterior)
    w, b = calibrate(present, toxic, w, b)
    weights = {t: float(w[k]) for k, t in enumerate(terms) if abs(w[k]) > 1e-6}
    pairs = {(voters[i], voters[j]): float(corr[i, j]) for i, j in zip(*np.nonzero(np.triu(np.abs(corr) > DEPENDENT, 1)))}
    return Model(weights, b, {t: (float(on[k]), float(off[k])) for k, t in enumerate(voters)}, pairs)


def _scores(texts: list, model: Model, lookup: TermLookup) -> np.ndarray:
    weights = model.weights
    z = [model.intercept + sum(weights[t] for t in sorted(lookup.of(text or "") & weights.keys())) for text in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = TermLookup(set(model.weights))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1).to_pylist(), model, lookup))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """The rows of docs, with all their columns, that score below `at`; a narrow map."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = TermLookup(set(model.weights))
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place).to_pylist(), model, lookup) < at))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32 modulo 4 is 2 give no labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), is_held_out)
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
