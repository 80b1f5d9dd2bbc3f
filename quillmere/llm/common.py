"""Shared-folder tables and byte-level numpy helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from ..functions.storage import BATCH_BYTES, BATCH_CONF, SPARK_BYTES, bound_batches, materialize, materialize_last, new_path, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_CONF", "SPARK_BYTES", "bound_batches", "materialize", "materialize_last", "new_path", "shared_dir"]
#: Fixed odd multipliers for the hashes below.
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def release_memory() -> None:
    """Gives what a Python worker has freed back to the machine, as workers live on beside the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over batches, which gives memory back at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release_memory()

    return run


def releasing_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f over a group, which gives memory back after it."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release_memory()
        return out

    return run


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of uint64 values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def zip_bytes(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def planes(values: np.ndarray, width: int = 0) -> bytes:
    """Fixed-width numbers as zipped byte planes, the lowest `width` bytes of each or all."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zip_bytes(np.ascontiguousarray(rows[:, : width or rows.shape[1]].T).tobytes())


def unplane(data: bytes, kind: type, width: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = unzip(data)
    n = len(raw) // (width or size)
    out = np.zeros((n, size), np.uint8)
    if n:
        out[:, : width or size] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view(kind).reshape(n)


#: Bytes of a key within its part.
KEY_BYTES = 6


def squeeze(keys: np.ndarray) -> bytes:
    """Keys below 2**48 as zipped byte planes."""
    return planes(keys.astype(np.uint64), KEY_BYTES)


def expand(data: bytes) -> np.ndarray:
    return unplane(data, np.uint64, KEY_BYTES)


def split_key(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, rest) of evenly spread 64-bit keys: the whole and the fraction, in 48 bits, of key * parts / 2**64. Both
    grow with the key, so sorted keys are sorted by part and rest, and parts times 2**48 keys are told apart."""
    m, n = np.uint64((1 << 32) - 1), np.uint64(32)
    low = (keys & m) * np.uint64(parts)
    high = (keys >> n) * np.uint64(parts) + (low >> n)
    return (high >> n).astype(np.int64), (high & m) << np.uint64(16) | (low & m) >> np.uint64(16)


def bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return heads, np.concatenate([heads[1:], [len(sorted_values)]])


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    """Each value once. np.unique puts whole numbers in a hash table before it sorts them, which takes several times as
    long as sorting all."""
    if len(sorted_values) < 2:
        return sorted_values
    new = np.empty(len(sorted_values), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return sorted_values[new]


def known_keys(keys: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted known ones of their parts, and the value that goes with each (0 where none does)."""
    part, rest = split_key(keys, parts)
    order = np.argsort(part, kind="stable")
    hit, value = np.zeros(len(keys), bool), np.zeros(len(keys), next(iter(known.values()))[1].dtype if known else np.uint8)
    for a, z in zip(*bounds(part[order])):
        own = order[a:z]
        have = known.get(int(part[own[0]]))
        if have is not None and len(have[0]):
            k = np.minimum(np.searchsorted(have[0], rest[own]), len(have[0]) - 1)
            hit[own] = have[0][k] == rest[own]
            value[own] = have[1][k]
    return hit, value
