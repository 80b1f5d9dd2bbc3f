"""Words of whole Arrow batches as numbers, without a Python loop over texts or words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


class Words(NamedTuple):
    """Word k of row r stands at bounds[r] + k; `codes` number the distinct words in `names` (binary)."""

    bounds: np.ndarray
    codes: np.ndarray
    names: pa.Array


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of the rows' UTF-8 bytes, null as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about `limit` bytes of text, each of one row at least."""
    at = text_bytes(batch.column(column))[0]
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield batch.slice(a, z - a)
        a = z


def split_words(texts: pa.Array, inside: np.ndarray, lower: bool = False) -> Words:
    """The rows' words: runs of bytes b with inside[b]; lower: A-Z become a-z. Bytes over 127 must all be inside."""
    at, raw = text_bytes(texts)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    held = inside[raw]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    cut = at[:-1][at[:-1] < len(raw)]  # a row starts a word where the row before ends in one
    first[cut] = held[cut]
    cut = at[1:][at[1:] > 0] - 1
    last[cut] = held[cut]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[held]))])
    coded = words.dictionary_encode()
    return Words(np.searchsorted(starts, at), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def inside_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte outside the given inclusive ranges."""
    table = np.ones(256, bool)
    for a, z in separators:
        table[a : z + 1] = False
    return table


#: The white space of `[^\x20\x09-\x0D]+`, and what `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` leaves out.
NOT_SPACE = inside_table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = inside_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
