"""SentencePiece encoding by sampling without replacement, and decoding.

Encoding samples k distinct segmentations of a text from its lattice of pieces by Gumbel top-k: an A-star search takes the
partial segmentation with the largest perturbed log-probability. Its Gumbel value is the maximum over all completions,
so the order in which complete ones are found is the order of a draw without replacement. The (k+1)-th value, kappa, gives
each sample's inclusion score 1 - exp(-exp(log_prob - kappa)). The random stream is seeded by the row's key alone.

Taking a node means to draw the path that carries its value, edge by edge by the edges' probabilities, and at each place
the largest value among the other edges: a Gumbel of their mass, cut off at the node's value. Every open node has a
completion of exactly its value, so beyond the k + 1 - (found) best ones none is kept, and places from the right are only
looked at until no later one can have a better value. Paths of all rows of a batch are drawn together, place by place of
their words, with numpy.

A piece's weight follows Zipf's law of its rank in the vocabulary, -THETA * log(rank + 2); a character that no piece has
falls back to its byte pieces. Pieces never cross the mark that begins a word, so lattices are kept by word, with each
edge's probability given its end; those of a batch's distinct words are built together: a trie finds the pieces, and the
forward sums are taken place by place of all words.

Defined results: a null or empty text has the one empty segmentation (log_prob 0, inclusion 1); a text with fewer than k
segmentations gives all of them, with inclusion 1; repeated rows get equal samples; a null in a key column is a key of its
own; key columns may not bear the names of results; an empty table gives an empty result; extra columns are ignored.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from itertools import count as count_from
from math import exp, expm1, inf, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
from .common import bounds, releasing

MARK = "▁"
THETA = 1.0
#: Characters of texts whose lattices and paths are held at once (more for a longer single text), and the length from
#: which words get their sums one by one.
BATCH_CHARS, LONG_WORD = 200_000, 48
#: Forward sums beyond these bounds are taken anew as logarithms.
LEAST_SUM, MOST_SUM = 1e-250, 1e250
#: Places of a path, from the right, at which other edges are looked for first.
FIRST_PLACES = 256
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """The vocabulary of a model file: a trie of its pieces, with ids and weights, and byte pieces.

    Node 0 is none; nodes 1 to 4 stand for a character without a piece, by its number of bytes. Steps of the trie are in a
    table of hashed slots: the key is node * classes + class of the character; where a slot is taken, the next one follows.
    """

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, raw = {}, {}, [b""] * self.sp.get_piece_size()
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                raw[i] = bytes([int(piece[1:-1], 16)])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)) and MARK not in piece[1:]:
                self.pieces[piece] = i, -theta * log(i + 2)
                raw[i] = piece.replace(MARK, " ").encode()
        marked = next((i for p, (i, _) in self.pieces.items() if p[0] == MARK and len(p) > 1), None)
        self.drops_mark = marked is not None and self.sp.decode([marked]) == raw[marked].decode()[1:]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64)
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size
        self.longest = max(map(len, self.pieces))
        self.length_bits = self.longest.bit_length()
        self.byte_weight = -theta * log(self.sp.get_piece_size() + 2)
        nodes = {"": 0} | {n: n for n in range(1, 5)}
        for piece in self.pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        names = list(nodes)[5:]
        classes = {c: k + 1 for k, c in enumerate(sorted({n[-1] for n in names}))}
        self.classes = len(classes) + 1
        self.class_of = np.zeros(max(map(ord, classes)) + 2, np.int32)  # the last one is that of all higher codes
        self.class_of[[ord(c) for c in classes]] = list(classes.values())
        self.ids, self.weight = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -inf)
        self.weight[1:5] = self.byte_weight * np.arange(1, 5)
        self.depth = np.array([0, 1, 1, 1, 1, *map(len, names)], np.int32)
        self.inner = np.zeros(len(nodes), bool)
        self.inner[[nodes[n[:-1]] for n in names if len(n) > 1]] = True
        for piece, (i, weight) in self.pieces.items():
            self.ids[nodes[piece]], self.weight[nodes[piece]] = i, weight
        self.is_piece, self.linear = self.ids >= 0, np.exp(self.weight)
        self.first = np.zeros(self.classes, np.int32)
        self.first[[classes[n] for n in names if len(n) == 1]] = [nodes[n] for n in names if len(n) == 1]
        deeper = [n for n in names if len(n) > 1]
        keys = np.array([nodes[n[:-1]] * self.classes + classes[n[-1]] for n in deeper], np.int64)
        to = np.array([nodes[n] for n in deeper], np.int32)
        bits = max(len(keys), 1).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._slots(keys)
        while len(keys):
            one = np.unique(slot, return_index=True)[1]
            one = one[self.keys[slot[one]] < 0]
            self.keys[slot[one]], self.to[slot[one]] = keys[one], to[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, to, slot = keys[left], to[left], (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULT) >> self.shift).view(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters, given by their classes, lead to; 0 where there is none."""
        keys = node * np.int64(self.classes) + char
        slot = self._slots(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.to[slot], 0)
        off = np.flatnonzero(~hit & (there >= 0))
        slot = slot[off]
        while off.size:
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[off]
            out[off[hit]] = self.to[slot[hit]]
            on = np.flatnonzero(~hit & (there >= 0))
            off, slot = off[on], slot[on]
        return out


@dataclass
class Words:
    """Lattices of distinct words, with characters laid place by place: first those at place 0 of all words, by falling
    size, then those at place 1. For character c, start[c] to start[c + 1] are the edges that end with it, longest first.
    An edge has its node of the trie, its share (the probability given its end; in `cut`, the last one's is infinite), and
    in source the character that the edge before it ends with (`chars`: it begins the word), above the bits of its length."""

    words: list[str]
    size: np.ndarray
    rank: np.ndarray
    place: np.ndarray
    where: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    node: np.ndarray
    share: np.ndarray
    cut: np.ndarray
    source: np.ndarray
    lattices: Lattices

    @property
    def chars(self) -> int:
        return len(self.codes)

    @property
    def begin(self) -> dict[str, int]:
        """Where words begin when they are laid end to end."""
        return dict(zip(self.words, (np.cumsum(self.size) - self.size).tolist()))

    @property
    def ids(self) -> np.ndarray:
        """ids[n - 1, a]: the piece of n characters that begins with character a of the words laid end to end (-1: none)."""
        out = np.full((self.lattices.longest, self.chars), -1, np.int32)
        own = np.empty(self.chars, np.int64)
        own[self.where] = np.arange(self.chars)
        n = self.lattices.depth[self.node]
        out[n - 1, np.repeat(own, np.diff(self.start)) - n + 1] = self.lattices.ids[self.node]
        return out

    def shares(self, char: int) -> list[float]:
        """Probabilities of the edges that end with a character, shortest first."""
        return self.share[self.start[char] : self.start[char + 1]][::-1].tolist()


def build_words(words: list[str], lattices: Lattices) -> Words:
    """Lattices of distinct words, place by place of all words together."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars, begin = len(codes), np.cumsum(size) - size
    rank = np.empty(len(words), np.int64)
    order = np.argsort(-size, kind="stable")
    rank[order] = np.arange(len(words))
    deepest = int(size.max()) if len(words) else 0
    many = len(words) - np.cumsum(np.bincount(size, minlength=deepest + 1))[:deepest]  # words beyond each place
    place = np.cumsum(many) - many
    inner = np.arange(chars) - np.repeat(begin, size)
    room = np.repeat(size, size) - inner  # characters from here to the word's end
    where = (place[inner] + np.repeat(rank, size)).astype(np.int32)
    before = np.empty(chars, np.int32)
    before[1:] = where[:-1]
    before[begin] = chars
    # edges by length: ends, sources and nodes
    char = lattices.class_of[np.minimum(codes, len(lattices.class_of) - 1)]
    first = lattices.first[char]
    lone = np.flatnonzero(~lattices.is_piece[first])
    node = first.copy()
    node[lone] = 1 + (codes[lone] >= 0x80) + (codes[lone] >= 0x800) + (codes[lone] >= 0x10000)
    bits = lattices.length_bits
    before = before.astype(np.int64) << bits
    found = [(where, before | 1, node)]
    count = np.ones(chars, np.int32)
    at = np.flatnonzero(lattices.inner[first] & (room > 1))
    node = first[at]
    for n in range(2, lattices.longest + 1):
        if not len(at):
            break
        node = lattices.step(node, char[at + (n - 1)])
        hit = np.flatnonzero(lattices.is_piece[node])
        own = at[hit]
        end = where[own + (n - 1)]
        count[end] += 1
        found.append((end, before[own] | n, node[hit]))
        on = np.flatnonzero(lattices.inner[node] & (room[at] > n))
        at, node = at[on], node[on]
    start = np.zeros(chars + 1, np.int64)
    np.cumsum(count, out=start[1:])
    slots, edges = start[:-1].copy(), int(start[-1])
    nodes, source = np.empty(edges, np.int32), np.empty(edges, np.int64)
    while found:
        end, src, node = found.pop()
        slot = slots[end]
        nodes[slot], source[slot] = node, src
        slots[end] = slot + 1
    # forward sums, in which a word of usual length stays far from the bounds of a double
    share, total = lattices.linear[nodes], np.ones(chars + 1)
    with np.errstate(all="ignore"):
        for j in range(min(deepest, LONG_WORD)):
            a, z = int(place[j]), int(place[j] + many[j])
            e, f = int(start[a]), int(start[z])
            if j:
                share[e:f] *= total[source[e:f] >> bits]
            total[a:z] = np.add.reduceat(share[e:f], start[a:z] - e)
    odd = np.flatnonzero(~((total > LEAST_SUM) & (total < MOST_SUM)))
    again = set(range(int(many[LONG_WORD]) if deepest > LONG_WORD else 0))
    again |= set((odd - place[np.searchsorted(place, odd, side="right") - 1]).tolist())
    with np.errstate(all="ignore"):
        share /= np.repeat(total[:-1], count)
    laid = np.empty(chars, np.int32)
    laid[where] = codes
    out = Words(words, size, rank, place, where, laid, start, nodes, share, share, source, lattices)
    for w in again:  # few
        _sum_logs(out, [int(place[j]) + w for j in range(int(size[order[w]]))])
    out.cut = share.copy()
    out.cut[start[1:] - 1] = inf
    return out


def _sum_logs(built: Words, chars: list[int]) -> None:
    """The shares of one word's edges by logarithms."""
    values = {built.chars: 0.0}
    for c in chars:
        e, f = int(built.start[c]), int(built.start[c + 1])
        sources = (built.source[e:f] >> built.lattices.length_bits).tolist()
        parts = [values[s] + w for s, w in zip(sources, built.lattices.weight[built.node[e:f]].tolist())]
        top = max(parts)
        values[c] = top + log(sum(exp(x - top) for x in parts))
        built.share[e:f] = [exp(x - values[c]) for x in parts]


def words_of(text: str, sp) -> list[str]:
    """Words of the normalised text, each but perhaps the first beginning with the mark."""
    text = sp.normalize(text)
    if "\0" in text:
        first, *parts = text.split(MARK)
        words = [first, *(MARK + p for p in parts)]
    else:
        words = text.replace(MARK, "\0" + MARK).split("\0")
    return words if words[0] else words[1:]


class Row:
    """One text's search: its random stream, open nodes, and paths found."""

    def __init__(self, length: int, seed: bytes):
        self.rng = np.random.Generator(np.random.Philox(key=int.from_bytes(seed, "little")))
        root = -log(-log(self.rng.random() or 1e-300))
        # value, end of the part still to be drawn, log-probability so far, and the edges beyond
        self.open = [(root, length, 0.0, np.zeros(0, np.int64))]
        self.done: list[tuple[float, np.ndarray]] = []


class Texts:
    """The words of a batch's texts, laid end to end: ranks in `built`, and where words and texts end."""

    def __init__(self, texts: list[list[str]], lattices: Lattices):
        number = defaultdict(count_from().__next__)
        count = np.array([len(t) for t in texts], np.int64)
        own = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(count.sum()))
        self.built = build_words(list(number), lattices)
        self.rank, size = self.built.rank[own], self.built.size[own]
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.word = np.concatenate([[0], np.cumsum(count)])  # each text's first word
        self.edge = np.concatenate([[0], self.end])[self.word]  # each text's first character
        self.length = np.diff(self.edge)


def draw_paths(rows: list[tuple[int, Row, tuple]], texts: Texts, need: int) -> None:
    """Draws the path of each row's node, and opens the nodes beside it that can still be among the `need` best.

    Words of all rows take their steps together, from their ends down.
    """
    built, own = texts.built, np.array([i for i, _, _ in rows])
    low = texts.edge[own]
    high = low + np.array([node[1] for _, _, node in rows], np.int64)
    first, second = np.empty(texts.edge[-1]), np.empty(texts.edge[-1])
    for (_, row, _), a, z in zip(rows, low.tolist(), high.tolist()):
        row.rng.random(out=first[a:z])
        row.rng.random(out=second[a:z])
    words = texts.word[own]
    count = np.where(high > low, np.searchsorted(texts.begin, high, side="left") - words, 0)
    word = np.arange(int(count.sum())) + np.repeat(words - (np.cumsum(count) - count), count)
    at = np.minimum(texts.end.take(word), np.repeat(high, count))
    char = built.place.take(at - texts.begin.take(word) - 1) + texts.rank.take(word)
    at -= 1
    edge, bits = np.full(texts.edge[-1], -1, np.int64), built.lattices.length_bits
    while len(at):
        taken = built.start.take(char)
        left = 1.0 - first.take(at)
        left -= built.cut.take(taken)
        more = np.flatnonzero(left > 0)
        left = left.take(more)
        while more.size:
            then = taken.take(more) + 1
            taken[more] = then
            left -= built.cut.take(then)
            on = np.flatnonzero(left > 0)
            more, left = more.take(on), left.take(on)
        edge[at] = taken
        source = built.source.take(taken)
        on = np.flatnonzero(source < built.chars << bits)
        source = source.take(on)
        at, char = at.take(on) - (source & (1 << bits) - 1), source >> bits
    ends = np.flatnonzero(edge >= 0)[::-1]  # from the right
    taken = edge.take(ends)
    prob = built.share.take(taken)
    log_prob = np.log(prob)
    bound = np.searchsorted(-ends, -np.stack([high - 1, low - 1]), side="left")
    for (i, row, node), a, z in zip(rows, *bound.tolist()):
        own_log, path = log_prob[a:z], np.concatenate([taken[a:z][::-1], node[3]])
        row.done.append((node[2] + float(own_log.sum()), path))
        if not need:
            continue
        before, own_second = node[2] + np.cumsum(own_log) - own_log, second.take(ends[a:z])
        # `before` falls to the left, and no value is over it by more than the largest Gumbel
        most, m, best = -log(-log(max(own_second.max(initial=0.0), 1e-300))) + 1e-9, FIRST_PLACES, []
        while z > a:
            with np.errstate(divide="ignore", over="ignore"):
                where = before[:m] + np.log(1.0 - prob[a:z][:m])
                other = where - np.log(np.exp(np.minimum(where - node[0], 700.0)) - np.log(np.maximum(own_second[:m], 1e-300)))
            other[where == -inf] = -inf
            best = np.argsort(-other, kind="stable")[:need].tolist()
            if m >= z - a or len(best) == need and before[m] + most < other[best[-1]]:
                break
            m *= 4
        for k in best:
            if other[k] > -inf:
                end = int(ends[a + k]) + 1 - int(texts.edge[i])
                _branch(row, built, need, end, int(taken[a + k]), float(before[k]), float(other[k]), path[z - a - k :])


def _branch(row: Row, built: Words, need: int, end: int, edge: int, phi: float, bound: float, beyond: np.ndarray) -> None:
    """Opens the edges beside one of a path, which have the same end, best first."""
    char = int(built.start.searchsorted(edge, side="right")) - 1
    final = int(built.start[char + 1]) - 1
    left = [(final - k, p) for k, p in enumerate(built.shares(char)) if final - k != edge and p > 0.0]
    while left:
        if len(row.open) >= need and bound <= row.open[need - 1][0]:
            return
        total = sum(p for _, p in left)
        goal, at = row.rng.random() * total, 0
        for at, (_, p) in enumerate(left):
            goal -= p
            if goal < 0:
                break
        own, p = left.pop(at)
        row.open.append((bound, end - int(built.lattices.depth[built.node[own]]), phi + log(p), np.concatenate([[own], beyond])))
        row.open.sort(key=lambda x: -x[0])
        del row.open[need:]
        if not left:
            return
        where = phi + log(sum(p for _, p in left))
        bound = where - log(exp(min(where - bound, 700.0)) - log(row.rng.random() or 1e-300))


def sample_batch(texts: list[list[str]], lattices: Lattices, k: int, seeds: list[bytes]) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text, given as its words: (ids, log_prob, inclusion) of k distinct segmentations, as they are drawn."""
    own = Texts(texts, lattices)
    rows = [Row(n, seed) for n, seed in zip(own.length.tolist(), seeds)]
    for found in range(k):
        if active := [(i, r, r.open.pop(0)) for i, r in enumerate(rows) if r.open]:
            draw_paths(active, own, k - found)
    return _results(rows, own.built)


def _results(rows: list[Row], built: Words) -> list[list[tuple[np.ndarray, float, float]]]:
    paths = [path for r in rows for _, path in r.done]
    edges = np.concatenate([np.zeros(0, np.int64), *paths])
    ids, until = built.lattices.ids[built.node[edges]], np.cumsum([len(p) for p in paths])
    if (lone := np.flatnonzero(ids < 0)).size:
        chars = np.searchsorted(built.start, edges[lone], side="right") - 1
        codes = built.codes[chars].tolist()
        known = {c: [built.lattices.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in set(codes)}
        own = [known[c] for c in codes]
        times = np.ones(len(ids), np.int64)
        times[lone] = [len(x) for x in own]
        until = np.concatenate([[0], np.cumsum(times)])[until]
        ids = np.repeat(ids, times)
        ids[ids < 0] = np.concatenate(own)
    parts = iter(np.split(ids, until[:-1]))
    out = []
    for r in rows:
        kappa = r.open[0][0] if r.open else -inf
        out.append([(next(parts), phi, 1.0 if kappa == -inf else -expm1(-exp(min(phi - kappa, 700.0)))) for phi, _ in r.done])
    return out


_lattices: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    if path not in _lattices:
        _lattices[path] = Lattices(path)
    return _lattices[path]


def decode_ids(ids: np.ndarray, begin: np.ndarray, lattices: Lattices) -> list[str]:
    """The texts of lists of ids, laid end to end, that begin at begin[:-1], as the library decodes them: the mark that
    begins a text is dropped. Bytes that are no UTF-8, ids without a text and unusual beginnings are left to it."""
    known = np.clip(ids, 0, len(lattices.raw_size) - 1)
    size = lattices.raw_size.take(known)
    odd = set((np.searchsorted(begin, np.flatnonzero((known != ids) | (size == 0)), side="right") - 1).tolist())
    to = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(lattices.raw_begin.take(known) - to[:-1], size)
    place += np.arange(len(place))
    raw, bounds_of, out = lattices.raw.take(place).tobytes(), to[begin].tolist(), []
    for k, (a, z) in enumerate(zip(bounds_of, bounds_of[1:])):
        text = None
        if k not in odd:
            try:
                text = raw[a:z].decode()
            except UnicodeDecodeError:
                pass
        if text and text[0] == " ":
            text = text[1:] if lattices.drops_mark and size[begin[k]] > 1 and text[1:2] != " " else None
        out.append(lattices.sp.decode(ids[begin[k] : begin[k + 1]].tolist()) if text is None else text)
    return out


def _seed(key: list) -> bytes:
    return hashlib.blake2b(repr(key).encode(), digest_size=8).digest()


def sample_encode(rows: DataFrame, keys: list[str], path: str, k: int = 2, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The key columns, sample (from 1), ids, log_prob and inclusion of k samples of every whole text; a narrow map.

    decoded: adds the text of the ids, as `decode` gives it, in the same pass, so that no second Python worker is held and
    no ids travel to it. Key columns may not bear the name of one of the others.
    """
    added = [StructField("sample", IntegerType()), StructField("ids", ArrayType(IntegerType())), StructField("log_prob", DoubleType()), StructField("inclusion", DoubleType())]
    added += [StructField("decoded", StringType())] if decoded else []
    if clash := {c.lower() for c in keys} & {f.name for f in added}:
        raise ValueError(f"key columns named like results: {sorted(clash)}; rename them")
    m = len(keys)
    picked = rows.select(*(F.col(f"`{c}`") for c in keys), F.col(f"`{text_col}`").alias("_text"))
    schema = StructType([*picked.schema.fields[:m], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(path)

        def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
            own = list(zip(*(c.to_pylist() for c in part.columns)))
            found = sample_batch([words_of(r[m] or "", lattices.sp) for r in own], lattices, k, [_seed(list(r[:m])) for r in own])
            count = np.array([len(f) for f in found])
            flat = [x for f in found for x in f]
            lengths = np.array([len(x[0]) for x in flat])
            begin, values = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([x[0] for x in flat]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values))
            number = np.concatenate([np.arange(1, c + 1) for c in count]).astype(np.int32)
            chosen = part.take(pa.array(np.repeat(np.arange(part.num_rows), count))).columns[:m]
            texts = [pa.array(decode_ids(values, begin, lattices), pa.string())] if decoded else []
            return pa.RecordBatch.from_arrays([*chosen, pa.array(number), ids, pa.array([x[1] for x in flat]), pa.array([x[2] for x in flat]), *texts], names=schema.names)

        for batch in batches:
            size = np.array([len(t.as_py() or "") for t in batch.column(m)])
            group = (np.cumsum(size) - size) // BATCH_CHARS
            for a, z in zip(*bounds(group)):
                yield encoded(batch.slice(a, z - a))

    return picked.mapInArrow(releasing(run), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null; a column that is named out_col gives way to the result."""
    rows = rows.drop(out_col) if out_col.lower() in {c.lower() for c in rows.columns} else rows
    schema = StructType([*rows.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(path)
        for batch in batches:
            ids = batch.column(ids_col)
            count = np.array(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
            flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)  # the library refuses -1
            found = decode_ids(flat, np.concatenate([[0], np.cumsum(count)]), lattices)
            texts = [t if there else None for t, there in zip(found, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(releasing(run), schema)


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every whole document, with the SHA-1 of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    samples = sample_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], path, decoded=True)
    return samples.select("doc_id", "sample", F.size("ids").cast("long").alias("n_ids"), F.sha1(F.array_join("ids", " ").cast("binary")).alias("ids_sha1"), "log_prob", "inclusion", F.sha1(F.encode("decoded", "UTF-8")).alias("decoded_sha1"))
