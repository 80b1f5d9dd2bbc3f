"""Maximal periodic runs of words in texts, by string synchronising sets.

A run is a stretch of words with smallest period q and length of at least 2q that no neighbouring word extends. Periods
below DIRECT come from comparing the words with themselves q places on. Longer ones go by dyadic scales: at scale t,
windows of t words are named by hash, and a position is chosen if it or the position t further on has the least name among
the t + 1 windows from it. Choice depends on 2t words only, so equal contexts are chosen alike: a period of 3t to 6t words
shows as a pair of chosen positions with equal contexts at that distance. Windows inside runs with a period of at most t/3
take no part, which keeps the pairs of a position below 18; a square without chosen positions is two such highly periodic
regions that meet, and those propose its period. Every proposal is extended to its maximal stretch and checked word by word.

Defined results: null and empty texts have no words and no runs; a row without doc_id is never rewritten; repeated rows
are analysed each; an empty table gives an empty result; extra columns are ignored. Texts are processed whole; memory is
linear in a slice of texts, or in one text where that is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounds, mix64
from .words import NOT_SPACE, slices, split_words

#: Shortest run that is reported.
LEAST_LENGTH = 12
#: Periods below this are found by direct comparison; scale t finds 3t to 6t, so it is three times the first scale.
DIRECT = 12
#: Names are never this; it stands for windows that take no part.
NOBODY = np.uint64((1 << 64) - 1)
BASE = np.uint64(0xD1342543DE82EF95)
NAME_SEED = np.uint64(0x5851F42D4C957F2D)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width`: a window is a suffix of one block of that width and a prefix of the next."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    blocks = np.full(size, NOBODY)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Stretches:
    """Extension of proposals (i, d), word i against word i + d, to the stretch of places that agree.

    Prefix hashes modulo 2**64 bound each extension from above by binary search; the words themselves confirm it. Where a
    hash was wrong, the words decide."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        self.power = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:  # powers by doubling
            more = min(done, n + 1 - done)
            self.power[done : done + more] = self.power[:more] * (self.power[done - 1 : done] * BASE)
            done += more
        named = mix64(words.astype(np.uint64) + np.uint64(1))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(named * self.power[:n], dtype=np.uint64)])

    def _same(self, a: np.ndarray, size: np.ndarray, d: np.ndarray) -> np.ndarray:
        p = self.prefix
        return (p[a + size] - p[a]) * self.power[d] == p[a + d + size] - p[a + d]

    def _search(self, most: np.ndarray, same) -> np.ndarray:
        """Largest size up to `most` for which same(size) holds; it holds for 0."""
        lo, hi = np.zeros(len(most), np.int64), most.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            good = same(mid)
            lo = np.where(open_ & good, mid, lo)
            hi = np.where(open_ & ~good, mid - 1, hi)
        return lo

    def of(self, i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, d) of the distinct maximal stretches of agreeing places x, word x equal to word x + d, around i."""
        if not len(i):
            return i, i, d
        right = self._search(len(self.words) - d - i, lambda n: self._same(i, n, d))
        left = self._search(i.copy(), lambda n: self._same(i - n, n, d))
        found = np.unique(np.stack([d, i - left, i + right], 1), axis=0)
        out = []
        for q, a, z in found.tolist():
            equal = self.words[a:z] == self.words[a + q : z + q]
            if equal.all():
                out.append((a, z, q))
            else:  # the hash was wrong: all stretches of agreeing places in there
                edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
                out += [(a + s, a + e, q) for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist())]
        a, z, q = np.array(out, np.int64).reshape(-1, 3).T
        return a, z, q


def direct_runs(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches of period q and a length of 2q at least."""
    if len(words) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    equal = np.zeros(len(words) - q + 2, np.int8)
    equal[1:-1] = words[:-q] == words[q:]
    edge = np.flatnonzero(np.diff(equal))
    a, z = edge[0::2], edge[1::2]
    keep = z - a >= q
    return a[keep], z[keep] + q


def chosen_pairs(names: np.ndarray, contexts: np.ndarray, periodic: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, d) of pairs of chosen positions with equal contexts at a distance d of 3t to 6t - 1.

    names[i], contexts[i]: hashes of the t and 2t words from i; periodic[i]: the t words have a period of at most t/3."""
    none = np.zeros(0, np.int64)
    n = len(contexts)
    if n <= 0:
        return none, none
    ids = np.where(periodic, NOBODY, np.minimum(names, NOBODY - np.uint64(1)))
    least = sliding_min(ids, t + 1)[:n]
    at = np.flatnonzero((least != NOBODY) & ((least == ids[:n]) | (least == ids[t : t + n])))
    at = at[np.argsort(contexts[at], kind="stable")]
    of = contexts[at]
    left, right = [none], [none]
    k, live = 1, np.arange(len(at))
    while True:
        live = live[live + k < len(at)]
        live = live[of[live] == of[live + k]]
        gap = at[live + k] - at[live]
        near = gap < 6 * t
        live, gap = live[near], gap[near]
        if not len(live):
            break
        far = gap >= 3 * t
        left.append(at[live[far]])
        right.append(gap[far])
        k += 1
    return np.concatenate(left), np.concatenate(right)


def meeting_regions(words: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, d) of the squares whose halves lie in two highly periodic regions of one period p that meet: d is one of the
    shifts, p apart, that lay the second region's root on the first's."""
    i, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    long = runs[runs[:, 1] - runs[:, 0] >= 9 * runs[:, 2]]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    if len(long) > 1:
        meet = (long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1])
        for k in np.flatnonzero(meet).tolist():
            (a1, b1, p), (a2, b2, _) = long[k].tolist(), long[k + 1].tolist()
            root, around = words[a2 : a2 + p], words[a1 : a1 + 2 * p - 1]
            turn = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(around, p) == root).all(axis=1))
            if len(turn):
                first = (a2 - a1 - int(turn[0])) % p
                low = first + -(-(9 * p - first) // p) * p
                q = np.arange(low, min(b1 - a1, b2 - a2, (b2 - a1) // 2) + 1, p)
                i.append(np.maximum(a1, a2 - q))
                d.append(q)
    return np.concatenate(i), np.concatenate(d)


def all_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, smallest period) of the maximal runs of length 2 * period at least, periods up to half of
    `longest`; runs shorter than four words are left out. Words that must not match (row ends) are distinct numbers."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(DIRECT - 1, longest // 2) + 1):
        a, z = direct_runs(words, q)
        keep = z - a >= 4
        found.append(np.stack([a[keep], z[keep], np.full(keep.sum(), q)], 1))
    t = DIRECT // 3
    if longest < 6 * t:
        return smallest_periods(np.concatenate(found))
    names, size = mix64(words.astype(np.uint64) + NAME_SEED), 1
    while size < t:
        names, size = _double(names, size), 2 * size
    stretch = Stretches(words)
    while 6 * t <= longest:
        contexts = _double(names, t)
        runs = np.concatenate(found)
        small = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t)]
        marks = np.zeros(len(words) + 1, np.int32)
        np.add.at(marks, small[:, 0], 1)
        np.add.at(marks, small[:, 1] - t + 1, -1)
        i, d = chosen_pairs(names, contexts, np.cumsum(marks)[: len(names)] > 0, t)
        found.append(_runs_of(stretch, i, d))
        names, t = contexts, 2 * t
    found.append(_runs_of(stretch, *meeting_regions(words, smallest_periods(np.concatenate(found)))))
    return smallest_periods(np.concatenate(found))


def _double(names: np.ndarray, size: int) -> np.ndarray:
    """Names of windows of twice the size."""
    return mix64(names[:-size] * BASE + (names[size:] ^ (names[size:] >> np.uint64(29))) + np.uint64(size)) if len(names) > size else names[:0]


def _runs_of(stretch: Stretches, i: np.ndarray, d: np.ndarray) -> np.ndarray:
    a, z, q = stretch.of(i, d)
    keep = z - a >= q
    return np.stack([a[keep], z[keep] + q[keep], q[keep]], 1)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One row a (start, end), with the least of its periods: the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    head = np.ones(len(runs), bool)
    head[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    return runs[head]


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places each word is taken from in a document that gets a planted run, else None."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def runs_by_row(codes: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """Runs of each row that has some: rows (start, period, length, ...) by start, then period. Row r holds the codes
    from ends[r] to ends[r + 1]; rows of like length are worked on together."""
    n = np.diff(ends)
    out: dict[int, np.ndarray] = {}
    group = np.maximum(np.frexp(np.maximum(n, 1).astype(float))[1], 4)
    rows = np.flatnonzero(n >= 4)
    rows = rows[np.argsort(group[rows], kind="stable")]
    for a, z in zip(*bounds(group[rows])):
        own = rows[a:z]
        size = n[own] + 1
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) - np.repeat(first[:-1], size)
        words = np.empty(first[-1], np.int64)
        inner = at < np.repeat(n[own], size)
        words[inner] = codes[(np.repeat(ends[own], size) + at)[inner]]
        words[~inner] = codes.max(initial=0) + 1 + np.arange(len(own))  # no two ends match
        found = all_runs(words, int(n[own].max()))
        found = found[found[:, 1] - found[:, 0] >= LEAST_LENGTH]
        row = np.searchsorted(first, found[:, 0], "right") - 1
        for s, e in zip(*bounds(row)):
            part = found[s:e]
            part = np.stack([part[:, 0] - first[row[s]], part[:, 2], part[:, 1] - part[:, 0]], 1)
            out[int(own[row[s]])] = part[np.lexsort((part[:, 1], part[:, 0]))]
    return out


def analyse(doc_ids: list, texts: pa.Array, plant: bool = True) -> list[tuple]:
    """(doc_id, n_words, runs, kept words joined by a space, as bytes) of each text."""
    words = split_words(texts, NOT_SPACE)
    codes = words.codes.copy()
    for r, doc_id in enumerate(doc_ids if plant else []):
        a, z = words.bounds[r], words.bounds[r + 1]
        place = rewritten(doc_id, z - a)
        if place is not None:
            codes[a:z] = codes[a:z][place]
    runs = runs_by_row(codes, words.bounds)
    names = words.names.to_pylist()
    out = []
    for r, doc_id in enumerate(doc_ids):
        a, z = int(words.bounds[r]), int(words.bounds[r + 1])
        kept, found = codes[a:z], runs.get(r, np.zeros((0, 3), np.int64))
        if len(found):
            drop = np.zeros(z - a + 1, np.int32)
            np.add.at(drop, found[:, 0] + found[:, 1], 1)
            np.add.at(drop, found[:, 0] + found[:, 2], -1)
            kept = kept[np.cumsum(drop)[:-1] == 0]
        out.append((doc_id, z - a, found, b" ".join(map(names.__getitem__, kept.tolist()))))
    return out


SCHEMA = "doc_id long, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_runs, all runs (by start, then period) and the text without the words after the first period of
    each run, words joined by a space. plant: texts are rewritten by `rewritten` first. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                rows = analyse(part.column("doc_id").to_pylist(), part.column("t"), plant)
                listed = [[{"start": s, "length": size, "period": q} for s, q, size in found.tolist()] for _, _, found, _ in rows]
                cols = [[r[0] for r in rows], [r[1] for r in rows], [len(x) for x in listed]]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(listed, kind), pa.array([r[3].decode() if with_text else None for r in rows], pa.string())], ["doc_id", "n_words", "n_runs", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of all documents, with the contract's planted ones: the longest run, all runs, the rest."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.select(
        "doc_id",
        "n_runs",
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
