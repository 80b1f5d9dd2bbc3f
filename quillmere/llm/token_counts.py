"""Token counts of texts by heap-and-linked-list byte-pair merging.

Each pre-token starts as one symbol per UTF-8 byte in a doubly linked list; the heap holds the ranks of adjacent pairs.
The lowest rank is popped (ties: leftmost) and merged until no pair has a rank. The count is the initial symbols minus
the merges: no identifier is looked up.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an
empty result; extra input columns are ignored, so none can clash. Texts of any length are processed whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = re.compile(r"[ \n]+[^ \n]*|[^ \n]+")
#: White space that borders no chunk; re's own class covers more characters than the pattern's, which is safe here.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Pre-tokens (and chunks) kept with their counts in each Python worker; cleared when full.
CACHE_ENTRIES = 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class MergeCounter(dict):
    """Maps a pre-token to its token count, computed on first use.

    Symbols are small integers (bytes, then one per merge in rank order); `ranks` maps a pair, packed in one integer, to
    its rank. A heap entry packs rank and position, so that equal ranks pop leftmost first.
    """

    def __init__(self, merges: list[tuple[str, str]], limit: int = CACHE_ENTRIES):
        super().__init__()
        number = {s: b for b, s in enumerate(byte_symbols())}
        self.ranks, self.limit = {}, limit
        for rank, (a, b) in enumerate(merges):
            self.ranks[number[a] << 20 | number[b]] = rank
            number.setdefault(a + b, 256 + rank)
        self.merged = [number[a + b] for a, b in merges]

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.count(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, word: str) -> int:
        sym = list(word.encode())
        n, rank_of, merged = len(sym), self.ranks.get, self.merged
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := rank_of(a << 20 | b)) is not None]
        if not heap:
            return n
        heapify(heap)
        sym.append(-1)  # the end, in no pair
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        merges = 0
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            a = sym[i]
            if a < 0:
                continue  # merged into its left neighbour since
            j = nxt[i]
            b = sym[j]
            if b < 0 or rank_of(a << 20 | b) != rank:
                continue  # one of the two has grown since
            merges += 1
            sym[i], sym[j] = a, b = merged[rank], -1
            nxt[i] = k = nxt[j]
            prv[k] = i
            if (b := sym[k]) >= 0 and (r := rank_of(a << 20 | b)) is not None:
                heappush(heap, r << 32 | i)
            if (h := prv[i]) >= 0 and (r := rank_of(sym[h] << 20 | a)) is not None:
                heappush(heap, r << 32 | h)
        return n - merges


class ChunkCounter(dict):
    """Maps a run of spaces and line feeds with the text up to the next such run to its token count.

    No pre-token crosses such a border as long as these two are the only white space, so the pattern runs once a chunk.
    """

    def __init__(self, words: MergeCounter, pattern: regex.Pattern, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.words, self.pattern, self.limit = words, pattern, limit

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = sum(map(self.words.__getitem__, self.pattern.findall(chunk)))
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if OTHER_SPACE.search(text):
            return sum(map(self.words.__getitem__, self.pattern.findall(text)))
        return sum(map(self.__getitem__, CHUNK.findall(text)))


_counters: dict[str, tuple[ChunkCounter, regex.Pattern | None]] = {}


def counter(path: str) -> tuple[ChunkCounter, regex.Pattern | None]:
    """(counts, pattern of the special strings or None), kept for the life of the Python worker."""
    if path not in _counters:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = [t["content"] for t in spec["added_tokens"]]
        split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        _counters[path] = ChunkCounter(MergeCounter(pairs), regex.compile(PATTERN)), split
    return _counters[path]


def count_text(text: str, path: str) -> int:
    counts, special = counter(path)
    parts = special.split(text) if special else [text]
    return sum(map(counts.count, parts)) + len(parts) - 1


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text, under the byte-level vocabulary file at `path`.

    A narrow map: no shuffle, one Arrow batch in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([count_text(x, path) for x in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 50k byte-level vocabulary, with the 512-token limit flag."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
