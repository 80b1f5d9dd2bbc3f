"""Packing of documents into training sequences by minimum bin slack.

Each task streams its documents. Whole windows leave a document as they are; what remains of it waits in a pool. For
each window a bitset subset-sum over the pool's lengths (bit n: some multiset of waiting pieces has n tokens) finds the
total closest to the capacity, and a walk back over the bitsets gives how many pieces of each length it takes. A window
that stays short takes the head of one more piece; a last short rest is cut into powers of two, which need no padding.

No shuffle: a task holds at most POOL pieces, each shorter than a window. Every task fills all its windows, so the input's
partitioning doesn't change the padding.

Defined results: a null or empty text gives the end id alone; repeated rows are packed once each; an empty table gives an
empty result; extra input columns are ignored. Texts of any length are processed whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory

#: Pieces that wait in a task at most, and after a round of packing.
POOL, POOL_LOW = 4096, 1024
CACHE_ENTRIES = 1_000_000
#: Documents tokenised together.
DOCS_AT_ONCE = 256
#: Words of letters in a text that is tokenised for their ids.
WORDS_AT_ONCE = 200
#: Characters beyond those that the vocabulary's normaliser lower-cases one by one and leaves composed as they are.
BEYOND = re.compile("[^\\x00-\u012f]")
#: A comma or point before a space that follows neither a letter, a number nor a space: the pre-tokenizer may keep it with
#: the symbols before it.
JOINED = re.compile("[^ a-z0-9\u00df-\u00f6\u00f8-\u012f][,.] ")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: What may follow letters in a piece and is parted from them by the pre-tokenizer: no apostrophe, as contractions have one.
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_caches: dict[str, _Cache] = {}


class _Cache:
    """A vocabulary's tokenizers, and pieces of text with their ids in two generations: what is used again moves from the
    old one to the young one, the rest goes when the young one is full."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # lower-case letters that are composed are one pre-token: the vocabulary's normaliser and pattern leave them as they are
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # in a vocabulary with a mark for the end of a word, the last id of each word bears it, and no other
        mark, vocab = getattr(self.whole.model, "end_of_word_suffix", None), self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for x, i in vocab.items() if mark and x.endswith(mark)]] = True
        if any(self.whole.encode(x, add_special_tokens=False).ids != self.letters.encode(x, add_special_tokens=False).ids for x in ("ab", "the", "\u00e9\u00df\u0101")):
            self.letters = self.whole  # another kind of vocabulary
        # commas and points after letters and numbers are pre-tokens of their own
        self.parted = all(self.whole.encode(x + y, add_special_tokens=False).ids == self.whole.encode(f"{x} {y}", add_special_tokens=False).ids for x in ("ab", "the", "\u00e9\u00df\u0101", "a1", "it's") for y in ",.")
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.young, self.old = {"": b""}, {}

    def absent(self, pieces: set[str], most: int) -> set[str]:
        """Pieces that are in neither generation; the others are in the young one afterwards."""
        new = pieces.difference(self.young)
        if len(self.young) + len(new) > most // 2:
            self.old, self.young = self.young, {"": b""}
            new = pieces.difference(self.young)
        again = [c for c in new if c in self.old]
        for c in again:
            self.young[c] = self.old.pop(c)
        return new.difference(again)

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many of them in one text, parted behind the ids that end words."""
        if not words or self.letters is self.whole:
            return self.ids_of_pieces(words)
        texts = [" ".join(words[a : a + WORDS_AT_ONCE]) for a in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        stop = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(stop) != len(words) or stop[-1] != 4 * len(ids):  # another kind of vocabulary
            return self.ids_of_pieces(words)
        return list(map(ids.tobytes().__getitem__, map(slice, [0, *stop[:-1]], stop)))

    def learn(self, pieces: set[str]) -> None:
        """Ids of pieces between spaces. Letters and symbols after them are parted by the pre-tokenizer, so most such
        pieces share the letters' ids."""
        young, ended, others = self.young, [], set()
        letters = {c for c in pieces if c.isalpha() and c.islower() and (c.isascii() or not BEYOND.search(c))}
        for c in pieces.difference(letters):
            head = c.rstrip(SYMBOLS)
            if not (head.isalpha() and (head.isascii() or not BEYOND.search(head))):
                others.add(c)
                continue
            (letters if head.islower() else others).add(head)
            if len(head) < len(c):
                tail = c[len(head) :]
                others.add(tail)
                ended.append((c, head, tail))
        for own, of in ((letters, self.ids_of_words), (others, self.ids_of_pieces)):
            own = [c for c in own if c not in young]
            young.update(zip(own, of(own)))
        for c, head, tail in ended:
            young[c] = young[head] + young[tail]


def encode(texts: list[str], path: str, most: int = CACHE_ENTRIES) -> list[bytes]:
    """Little-endian 32-bit ids of each whole text.

    The vocabulary drops white space and splits at it, so the pieces between spaces and line feeds are encoded once and
    kept. The library sees all other white space and special strings. Texts of plain Latin letters are lower-cased first,
    as the library would, and commas and points after words stand alone, so that fewer pieces differ; not so texts with a special string in any case, as the library
    looks for those before it lower-cases.
    """
    if path not in _caches:
        _caches[path] = _Cache(path)
    cache = _caches[path]
    split = []
    for t in texts:
        if not BEYOND.search(t):
            low = t.lower()
            if not any(x in low for x in cache.special):
                t = low.replace("\n", " ")
                if cache.parted and not JOINED.search(t):  # a word is one piece with or without a comma or point after it
                    t = t.replace(", ", " , ").replace(". ", " . ")
        split.append(t.replace("\n", " ").split(" "))
    new = cache.absent(set().union(*split), most)
    cache.learn(new)
    out = [b"".join(map(cache.young.__getitem__, chunks)) for chunks in split]
    for c in new:
        if len(c) > 64:
            del cache.young[c]
    return out


def closest_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Pieces of each length whose total comes closest to capacity without passing it.

    counts: waiting pieces by length. Lengths are added to the bitset from the largest down until the capacity is met;
    those beyond half the capacity together, as no two of them fit.
    """
    mask, half = (1 << (capacity + 1)) - 1, capacity // 2
    bits, lengths = np.zeros(capacity + 1, np.uint8), np.fromiter(counts, np.int64, len(counts))
    bits[0], bits[lengths[(lengths > half) & (lengths <= capacity)]] = 1, 1
    reach = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    steps: list[tuple[int, int]] = []
    for length in np.sort(lengths[lengths <= half])[::-1].tolist():
        if reach >> capacity & 1:
            break
        for _ in range(counts[length]):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> capacity & 1:
                break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += 1
            total -= length
    if total:
        taken[total] += 1
    return dict(taken)


class Packer:
    """Packs one task's documents; emits (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.pool, self.waiting, self.sequence, self.out = capacity, defaultdict(list), 0, 0, []
        self.counts: dict[int, int] = {}  # pieces in the pool by length

    def put(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.pool[length].append(piece)
        self.counts[length] = len(self.pool[length])
        self.waiting += 1

    def take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        self.counts[length] = len(pieces)
        if not pieces:
            del self.pool[length], self.counts[length]
        self.waiting -= 1
        return piece

    def add(self, doc_id: int, ids: bytes) -> None:
        n, step = len(ids) // 4, self.capacity * 4
        for at in range(0, len(ids) - step + 1, step):
            self.emit([(doc_id, at // 4, ids[at : at + step], n)])
        if rest := n % self.capacity:
            self.put((doc_id, n - rest, ids[(n - rest) * 4 :], n))
        if self.waiting > POOL:
            self.drain(POOL_LOW)

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, ids, n, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def drain(self, keep: int) -> None:
        while self.waiting > keep:
            chosen = closest_multiset(self.counts, self.capacity)
            pieces = [self.take(length) for length, k in chosen.items() for _ in range(k)]
            gap = self.capacity - sum(len(p[2]) // 4 for p in pieces)
            if gap and self.waiting:
                doc_id, start, ids, n = self.take(max(self.pool))
                pieces.append((doc_id, start, ids[: gap * 4], n))
                self.put((doc_id, start + gap, ids[gap * 4 :], n))
                gap = 0
            if gap:
                self.powers(pieces, self.capacity - gap)
            else:
                self.emit(pieces)

    def powers(self, pieces: list[tuple], total: int) -> None:
        while total:
            room = size = 1 << (total.bit_length() - 1)
            own = []
            while room:
                doc_id, start, ids, n = pieces.pop()
                k = min(room, len(ids) // 4)
                own.append((doc_id, start, ids[: k * 4], n))
                if len(ids) > k * 4:
                    pieces.append((doc_id, start + k, ids[k * 4 :], n))
                room -= k
            self.emit(own)
            total -= size

    def flush(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces of documents with their places in sequences of at most `capacity` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (the piece's little-endian 32-bit
    ids; null where with_ids is false). cache_entries: pieces of text that a worker keeps with their ids.
    """
    end = end_id.to_bytes(4, "little")
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            out = packer.flush()
            cols = [
                pa.array([p[0] for p in out], pa.int64()),
                pa.array([p[1] for p in out], pa.int64()),
                pa.array([len(p[2]) // 4 for p in out], pa.int64()),
                pa.array([zlib.crc32(p[2]) for p in out], pa.int64()),
                pa.array([p[3] for p in out], pa.int64()),
                pa.array([base + p[4] for p in out], pa.int64()),
                pa.array([p[5] for p in out], pa.int64()),
                pa.array([p[2] if with_ids else None for p in out], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()], path, cache_entries)):
                    packer.add(doc_id, ids + end)
                if packer.out:
                    yield rows()
        packer.drain(0)
        yield rows()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens under the 49k word vocabulary, end id 2."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
