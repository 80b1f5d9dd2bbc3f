"""Removal of passages that also occur in a document with a smaller id, by suffix arrays.

Every byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id is removed. All documents
are compared with all others, exactly:

1. Documents are stored in the shared folder as blocks of compressed text.
2. Anchors: of the GRAM-byte strings inside each window, the one with the smallest hash. Equal windows have equal anchors,
   so a window can only occur in two documents if its anchors do. Each block sends the distinct keys of its anchors, dealt by
   hash; keys met in two documents come back to the blocks that sent them, with a level that says how many different
   stretches they have. A key that a third of all documents share travels once a block.
3. Each window belongs to one anchor. A block sends the stretch of text that an anchor's windows cover once per distinct
   stretch, with the places where the block has it. Anchors with many different stretches are split before they are dealt: their
   windows go in ranges (level 1) or one by one (level 2), under the hash of the bytes that a range's windows share, so
   that no anchor gathers in one task.
4. By anchor, distinct stretches are sorted together: suffix_sort builds their suffix arrays by linear grouping, many
   anchors at once, over the windows whose hash recurs. Equal windows are neighbours in the array; each run gets its
   smallest doc_id. Anchors with more than LANE_MOST distinct stretches are first split by the bytes that halves of their
   windows have in common. Stretches that are equal as wholes, byte by byte, are sorted once.
5. Blocks get the places back that smaller doc_ids hold, and cut them out.

Defined results: a null text is empty; a document without doc_id keeps its text and removes nothing from others; rows that
repeat a doc_id remove nothing from each other; a passage that only repeats within one document stays; texts under WINDOW
bytes stay; an empty table gives an empty result; extra columns of any name are kept by `dedup` and ignored by
`find_repeats`. Texts of any length are processed whole, as bytes; `dedup` decodes what is left with U+FFFD where a cut
splits a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounds, expand, known_keys, materialize, mix64, planes, releasing, releasing_group, split_key, squeeze, unplane, unzip, zip_bytes
from .suffix_sort import _ranges, suffix_arrays

WINDOW, GRAM = 50, 20
#: Plain bytes of a block (more for a longer single text), and of a slice that is hashed at once.
BLOCK_BYTES, SLICE_BYTES = 2 << 20, 1 << 15
#: Distinct stretches of one anchor that are sorted together, and bytes sorted in one call.
LANE_MOST, SORT_BYTES = 16, 1 << 19
#: Plain bytes and input partitions for each part that keys and stretches are dealt to.
PART_BYTES, KEY_PARTS = 8 << 20, 2
#: An anchor's different marks (of 256) beyond which its windows are dealt in ranges, blocks beyond which one by one, and
#: windows of a range.
HOT_MARKS, HOT_BLOCKS, RANGE = 128, 4096, 8
_ODD = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(6)]


def pack_blocks(docs: DataFrame, with_rest: bool = False) -> DataFrame:
    """Documents as rows of many: ids (64-bit), which of them are there, lengths (64-bit), zipped text, plain size, and,
    with with_rest, all other columns as one Arrow stream."""
    rest = [c for c in docs.columns if c != "text"] if with_rest else []
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in rest), F.col("text").isNull()).alias("rest")] if rest else []))
    names = ["block", "ids", "known", "lengths", "text", "rest", "size"]
    kinds = [pa.int64()] + [pa.binary()] * 5 + [pa.int64()]

    def stream(rows: list[pa.RecordBatch]) -> bytes | None:
        if not rows:
            return None
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema) as out:
            for r in rows:
                out.write_batch(r)
        return zip_bytes(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, own, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            there = np.array([i is not None for i in ids], bool)
            values = [number, np.array([i or 0 for i in ids], np.int64).tobytes(), there.tobytes(), lengths.tobytes(), zip_bytes(b"".join(texts), 6), stream(own), size]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            start = 0
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                data = (text.as_py() or "").encode()
                if texts and size + len(data) > BLOCK_BYTES:
                    if rest and k > start:
                        own.append(batch.slice(start, k - start).select([2]))
                    yield row()
                    number, ids, texts, own, size, start = number + 1, [], [], [], 0, k
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
            if rest and batch.num_rows > start:
                own.append(batch.slice(start).select([2]))
        if texts:
            yield row()

    return picked.mapInArrow(releasing(run), "block long, ids binary, known binary, lengths binary, text binary, rest binary, size long")


def _sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        a = f(a[:-have], a[have:])
        have *= 2
    return f(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings (16 + 4 bytes)."""
    h = b.astype(np.uint64)
    parts = {1: h}
    for k in range(4):
        step = 1 << k
        h = h[:-step] * np.uint64(_ODD[k]) + h[step:]
        parts[2 * step] = h
    n = len(b) - GRAM + 1
    return mix64(parts[16][:n] * np.uint64(_ODD[2]) + parts[4][16 : 16 + n])


def window_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all WINDOW-byte strings (32 + 16 + 2 bytes), slice by slice."""
    out = np.empty(max(0, len(b) - WINDOW + 1), np.uint64)
    for at in range(0, len(out), SLICE_BYTES):
        h, parts = b[at : at + SLICE_BYTES + WINDOW - 1].astype(np.uint64), {}
        for k in range(5):
            step = 1 << k
            h = h[:-step] * np.uint64(_ODD[k]) + h[step:]
            parts[2 * step] = h
        n = len(parts[32]) - WINDOW + 32
        out[at : at + n] = mix64((parts[32][:n] * np.uint64(_ODD[4]) + parts[16][32 : 32 + n]) * np.uint64(_ODD[1]) + parts[2][48 : 48 + n])
    return out


def distinct(keys: np.ndarray, off: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): entries sorted by key, and where in that order a stretch begins that differs from the one before
    in its key, anchor offset or bytes. Hashes bring equal stretches together; their bytes decide."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = hashes[lo] * np.uint64(_ODD[0]) + hashes[hi] + (off.astype(np.uint64) << np.uint64(8)) + (hi - lo).astype(np.uint64)
    order = np.lexsort((mark, keys))
    view = np.lib.stride_tricks.sliding_window_view(b, WINDOW)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 100_000):  # a stretch is at most two windows long, so its first and last show all of it
        x, y = order[a - 1 : a + 99_999], order[a : a + 100_000]
        x = x[: len(y)]
        same = (keys[x] == keys[y]) & (off[x] == off[y]) & (hi[x] - lo[x] == hi[y] - lo[y])
        k = np.flatnonzero(same)
        same[k] = (view[lo[x[k]]] == view[lo[y[k]]]).all(axis=1) & (view[hi[x[k]]] == view[hi[y[k]]]).all(axis=1)
        new[a : a + 100_000] = ~same
    return order, np.flatnonzero(new)


def anchors(data: bytes, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, first windows, last windows, keys, hashes) of each slice of concatenated texts.

    A window's anchor is the leftmost of the GRAM-byte strings in it with the smallest hash, and its key that hash: both
    depend on the window's bytes alone. Neighbouring windows with the same anchor make one entry; hashes[k] is that of the
    string at the slice's first window plus k.
    """
    b = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lengths)
    for at in range(0, len(b) - WINDOW + 1, SLICE_BYTES):
        g = _grams(b[at : min(len(b), at + SLICE_BYTES + WINDOW - 1)])
        least = _sliding(g, WINDOW - GRAM + 1, np.minimum)
        first, last = np.searchsorted(ends, [at, at + len(least) - 1], side="right")
        own = ends[first : last + 1]  # of the documents that the slice's windows start in
        until = np.repeat(own, np.diff(np.concatenate([[at], own[:-1], [at + len(least)]])))
        inside = np.arange(at + WINDOW, at + WINDOW + len(least)) <= until
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (g[: len(least) - 1] == least[:-1]) | (inside[1:] != inside[:-1])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(least)]]) - 1
        ok = inside[heads]
        heads, tails = heads[ok], tails[ok]
        yield at, heads + at, tails + at, least[heads], g


def anchor_places(last: np.ndarray, keys: np.ndarray, g: np.ndarray, at: int) -> np.ndarray:
    """Where the anchors are: the first string from an entry's last window on with the entry's hash."""
    at_last = (last - at)[:, None] + np.arange(WINDOW - GRAM + 1)
    return last + (g[np.minimum(at_last, len(g) - 1)] == keys[:, None]).argmax(axis=1)


def _unblock(r: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["lengths"], np.int64), unzip(r["text"])


def block_keys(blocks: DataFrame, parts: int) -> DataFrame:
    """For each block and part: its keys, and for each of them an 8-bit mark of one of its stretches, and whether
    several documents of the block have it."""
    names = ["part", "block", "keys", "marks", "several"]
    kinds = [pa.int64()] * 2 + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, lengths, data = _unblock(r)
                ends, found = np.cumsum(lengths), [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
                for start, lo, hi, keys, g in anchors(data, lengths):
                    mark = g[lo - start] * np.uint64(_ODD[0]) + g[hi + WINDOW - GRAM - start] + (hi - lo).astype(np.uint64)
                    found.append((np.searchsorted(ends, lo, side="right"), mix64(keys), (mix64(mark) >> np.uint64(56)).astype(np.uint8)))
                doc, keys, mark = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(keys)
                keys, doc = keys[order], doc[order]
                heads, _ = bounds(keys)
                several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads) if len(heads) else np.zeros(0, bool)
                part, rest = split_key(keys[heads], parts)
                mark, out = mark[order[heads]], []
                for a, z in zip(*bounds(part)):
                    out.append((int(part[a]), r["block"], squeeze(rest[a:z]), mark[a:z].tobytes(), zip_bytes(np.packbits(several[a:z]).tobytes())))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return blocks.mapInArrow(releasing(run), "part long, block long, keys binary, marks binary, several binary")


def shared_keys(keys: DataFrame) -> DataFrame:
    """block, part, keys of the block that at least two documents of the table have, and their levels: 1 where the marks
    show many different stretches, 2 where that many come from very many blocks."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pieces = [expand(r["keys"]) for r in rows]
        key, own = np.concatenate(pieces), np.repeat(np.arange(len(rows)), [len(x) for x in pieces])
        mark = np.concatenate([np.frombuffer(r["marks"], np.uint8) for r in rows])
        sure = np.concatenate([np.unpackbits(np.frombuffer(unzip(r["several"]), np.uint8), count=len(x)) for r, x in zip(rows, pieces)]).astype(bool)
        marked = key << np.uint64(8) | mark
        order = np.argsort(marked)
        marked, own, sure = marked[order], own[order], sure[order]
        key = marked >> np.uint64(8)
        heads, stops = bounds(key)
        blocks_with = stops - heads
        differs = np.concatenate([[True], marked[1:] != marked[:-1]])
        marks = np.add.reduceat(differs, heads, dtype=np.int64)
        level = (marks > HOT_MARKS).astype(np.uint8) + ((marks > HOT_MARKS) & (blocks_with > HOT_BLOCKS))
        good = np.repeat((blocks_with > 1) | np.logical_or.reduceat(sure, heads), blocks_with)
        key, own, level = key[good], own[good], np.repeat(level, blocks_with)[good]
        order = np.argsort(own, kind="stable")
        key, own, level = key[order], own[order], level[order]
        out = [(rows[own[a]]["block"], rows[own[a]]["part"], squeeze(key[a:z]), zip_bytes(level[a:z].tobytes())) for a, z in zip(*bounds(own))]
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names=["block", "part", "keys", "levels"])

    return keys.groupBy("part").applyInArrow(releasing_group(run), "block long, part long, keys binary, levels binary")


def block_entries(r: dict, key_parts: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, key, level) of a block's windows whose anchors other documents share."""
    ids, lengths, data = _unblock(r)
    shared = {x["part"]: (expand(x["keys"]), np.frombuffer(unzip(x["levels"]), np.uint8)) for x in r["shared"] or []}
    entries = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
    for start, lo, hi, keys, g in anchors(data, lengths) if shared else ():
        even = mix64(keys)  # the smallest of several hashes are small; dealing needs evenly spread keys
        hit, level = known_keys(even, shared, key_parts)
        entries.append((lo[hit], hi[hit], anchor_places(hi[hit], keys[hit], g, start), even[hit], level[hit]))
    lo, hi, at, keys, level = (np.concatenate(x) for x in zip(*entries))
    doc = np.searchsorted(np.cumsum(lengths), lo, side="right")
    ok = np.frombuffer(r["known"], bool)[doc]
    return doc[ok], lo[ok], hi[ok], at[ok], keys[ok], level[ok]


def deal_ranges(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, keys: np.ndarray, level: np.ndarray, data: bytes) -> tuple[np.ndarray, ...]:
    """(entry, first window, last window, key): entries of level 0 as they are, those above in ranges of windows by their
    offset to the anchor, keyed by a hash of the anchor and of the bytes that all windows of the range would share."""
    own, first, last, key = [np.flatnonzero(level == 0)], [lo[level == 0]], [hi[level == 0]], [keys[level == 0]]
    for want, width in ((1, RANGE), (2, 1)):
        pick = np.flatnonzero(level == want)
        for near in range(0, WINDOW - GRAM + 1, width) if len(pick) else ():  # windows that start near..far bytes before
            far = min(near + width - 1, WINDOW - GRAM)
            a, z = np.maximum(lo[pick], at[pick] - far), np.minimum(hi[pick], at[pick] - near)
            ok = a <= z
            rows, a, z = pick[ok], a[ok], z[ok]
            # the shared bytes of the windows that are there: from the last one's start to the first one's end; a window
            # range cut by a text's edge shares more, so only what the whole range shares is hashed
            start, length = at[rows] - near, WINDOW - (far - near)
            mixed = mix64(keys[rows] + np.uint64(near * 4 + want))
            text = [data[x : x + length] for x in start.tolist()]
            extra = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in text], np.uint64)
            own.append(rows)
            first.append(a)
            last.append(z)
            key.append(mix64(mixed ^ extra))
    return tuple(np.concatenate(x) for x in (own, first, last, key))


SENT_SCHEMA = "part long, block long, offsets binary, lengths binary, text binary, times binary, docs binary, ids binary, of binary, places binary"


def stretches(joined: DataFrame, parts: int) -> DataFrame:
    """A block's distinct stretches, dealt by their keys, as packed arrays, with the documents and places that have them.

    joined: blocks with `shared`, an array of (part, keys, levels), null where a block shares nothing.
    """
    names = [c.split(" ")[0] for c in SENT_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 2 + [pa.binary()] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, lengths, data = _unblock(r)
                begins = np.cumsum(lengths) - lengths
                doc, lo, hi, at, keys, level = block_entries(r, parts)
                own, lo, hi, keys = deal_ranges(lo, hi, at, keys, level, data)
                doc, off, b = doc[own], at[own] - lo, np.frombuffer(data, np.uint8)
                order, heads = distinct(keys, off, b, lo, hi, window_hashes(b) if len(own) else keys)
                doc, lo, hi, off, keys = doc[order], lo[order], hi[order], off[order], keys[order]
                stop = np.concatenate([heads[1:], [len(order)]]) if len(heads) else heads
                rows, to = [], split_key(keys[heads], parts)[0]
                for a, z in zip(*bounds(to)):  # sorted by key, so parts are runs
                    x, y, h = heads[a], stop[z - 1], heads[a:z]
                    used, of = np.unique(doc[x:y], return_inverse=True)
                    sizes = hi[h] - lo[h] + WINDOW
                    text = b[_ranges(lo[h], sizes)].tobytes()
                    rows.append((int(to[a]), r["block"], planes(off[h].astype(np.int16)), zip_bytes(sizes.astype(np.uint8).tobytes()), zip_bytes(text, 6), planes((stop[a:z] - h).astype(np.int32)), planes(used.astype(np.int32)), planes(ids[used]), planes(of.astype(np.int32)), planes((lo - begins[doc])[x:y])))
                cols = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return joined.mapInArrow(releasing(run), SENT_SCHEMA)


def split_lanes(items: list[tuple[int, int, int, int, int]], raw: bytes) -> Iterator[list[tuple[int, int, int, int]]]:
    """Lanes of (stretch, first window, place, length) that are sorted together, from one anchor's (stretch, first window,
    anchor offset, place, length); places are those in raw.

    A large group is split by halves of the windows' offsets to the anchor: windows of one half share the bytes around
    the anchor that all of them cover, and only those that agree there can be equal.
    """
    todo = [(items, 0, WINDOW - GRAM)]
    while todo:
        items, near, far = todo.pop()  # windows that start `near`..`far` bytes before the anchor
        if len(items) <= LANE_MOST or near == far:
            yield [(s, first, at, n) for s, first, _, at, n in items]
            continue
        middle = (near + far) // 2
        for a, z in ((near, middle), (middle + 1, far)):
            by: dict[bytes, list] = {}
            for s, first, off, at, n in items:  # window k starts off - k bytes before the anchor
                start, stop = max(off - z, 0), min(off - a, n - WINDOW)
                if start <= stop:
                    by.setdefault(raw[at + max(off - a, 0) : at + off - z + WINDOW], []).append((s, first + start, off - start, at + start, stop - start + WINDOW))
            todo += [(x, a, z) for x in by.values() if len(x) > 1]


def window_minima(b: np.ndarray, lane: np.ndarray, stretch: np.ndarray, first: np.ndarray, at: np.ndarray, length: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, window, smallest doc_id that holds the window) for every window of the lanes, from their suffix arrays.

    Items of a lane are neighbours: their stretch, first window, place in b and length.
    """
    head, stop = bounds(lane)
    total = np.add.reduceat(length + 1, head) if len(head) else length
    by_size = np.argsort(total, kind="stable")
    head, sizes = head[by_size], (stop - head)[by_size]
    pick = _ranges(head, sizes)
    stretch, first, at, length = stretch[pick], first[pick], at[pick], length[pick]
    chunk = np.cumsum(total[by_size]) // SORT_BYTES
    ends, out = np.cumsum(sizes), []
    for a, z in zip(*bounds(chunk)):
        x, y = ends[a] - sizes[a], ends[z - 1]
        n, count, own = length[x:y], sizes[a:z], stretch[x:y]
        # each text ends with a separator; a lane's last separator is its unique smallest symbol
        text = np.zeros(int(n.sum()) + len(n), np.int64)
        begin = np.cumsum(n + 1) - n - 1
        text[_ranges(begin, n)] = b[_ranges(at[x:y], n)].astype(np.int64) + 2
        text[begin + n] = 1
        text[(begin + n)[np.cumsum(count) - 1]] = 0
        lane_lengths = total[by_size[a:z]]
        sa = suffix_arrays(text, lane_lengths)
        item = np.repeat(np.arange(len(n)), n + 1)
        is_window = np.zeros(len(text), bool)
        is_window[_ranges(begin, n - WINDOW + 1)] = True
        starts = sa[is_window[sa]]
        lane_of = np.repeat(np.arange(len(count)), lane_lengths)[starts]
        view = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), WINDOW)
        new = np.ones(len(starts), bool)
        for i in range(1, len(starts), 200_000):  # neighbours in the array are compared
            j = min(len(starts), i + 200_000)
            new[i:j] = (lane_of[i:j] != lane_of[i - 1 : j - 1]) | (view[starts[i:j]] != view[starts[i - 1 : j - 1]]).any(axis=1)
        heads, stops = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:], [len(starts)]])
        owner = item[starts]
        lowest = np.repeat(np.minimum.reduceat(least[own[owner]], heads), stops - heads)
        out.append((own[owner], starts - begin[owner] + first[x:y][owner], lowest))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*out))


def anchor_keys(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM-byte strings at the given places."""
    view, out = np.lib.stride_tricks.sliding_window_view(b, GRAM), np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(_ODD[0]) + view[at, k]
    return mix64(out)


def sort_part(table: pa.Table) -> pa.Table:
    """For each block that sent stretches to this part: the places (document, start, end) that a smaller doc_id has too."""
    rows = table.to_pylist()
    raw = b"".join(unzip(r["text"]) for r in rows)
    b, hashes = np.frombuffer(raw, np.uint8), window_hashes(np.frombuffer(raw, np.uint8))
    off, size, times = (np.concatenate([f(r) for r in rows]) for f in (lambda r: unplane(r["offsets"], np.int16).astype(np.int64), lambda r: np.frombuffer(unzip(r["lengths"]), np.uint8).astype(np.int64), lambda r: unplane(r["times"], np.int32).astype(np.int64)))
    at = np.cumsum(size) - size
    keys = anchor_keys(b, at + off)
    order, heads = distinct(keys, off, b, at, at + size - WINDOW, hashes)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(order)]])))
    held = np.repeat(which, times)  # the stretch of every occurrence
    ids = [unplane(r["ids"], np.int64)[unplane(r["of"], np.int32)] for r in rows]
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, held, np.concatenate(ids))
    one = order[heads]  # an entry for each distinct stretch; these are sorted by key
    keys, off, size, at = keys[one], off[one], size[one], at[one]
    windows = size - WINDOW + 1
    first = np.cumsum(windows) - windows
    owner, lowest = np.repeat(np.arange(len(one)), windows), np.repeat(least, windows)  # of each window of each stretch
    # windows whose hash another stretch of the anchor has too, as runs; only these are sorted
    begin, stop = bounds(keys)
    several = np.repeat(stop - begin > 1, stop - begin)
    own = _ranges(first[several], windows[several])
    h = hashes[_ranges(at[several], windows[several])]
    by = np.argsort(h)
    same = h[by[1:]] == h[by[:-1]]
    flag = np.zeros(len(owner) + 1, bool)
    flag[own[by[1:][same]]] = flag[own[by[:-1][same]]] = True
    flag = flag[:-1]
    edge = owner[1:] != owner[:-1]
    run_head = np.flatnonzero(flag & np.concatenate([[True], ~flag[:-1] | edge]))
    run_tail = np.flatnonzero(flag & np.concatenate([~flag[1:] | edge, [True]]))
    run_least = least[owner[run_head]]
    s, lo, wide = owner[run_head], run_head - first[owner[run_head]], run_tail - run_head + 1
    place = at[s] + lo
    order, heads = distinct(keys[s], off[s] - lo, b, place, place + wide - 1, hashes)
    run_which = np.empty(len(order), np.int64)
    run_which[order] = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(order)]])))
    one_run = order[heads]
    low = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(low, run_which, run_least)
    anchor, before, place, length = keys[s[one_run]], (off[s] - lo)[one_run], place[one_run], wide[one_run] + WINDOW - 1
    lane_head, lane_stop = bounds(anchor)
    lane_size = lane_stop - lane_head
    usual = (lane_size > 1) & (lane_size <= LANE_MOST)
    plain = _ranges(lane_head[usual], lane_size[usual])
    items = [np.stack([np.repeat(np.arange(len(lane_head)), lane_size)[plain], plain, np.zeros(len(plain), np.int64), place[plain], length[plain]])]
    number = len(lane_head)
    for x, y in zip(lane_head[lane_size > LANE_MOST].tolist(), lane_stop[lane_size > LANE_MOST].tolist()):
        cut = slice(x, y)
        for got in split_lanes(list(zip(range(x, y), [0] * (y - x), before[cut].tolist(), place[cut].tolist(), length[cut].tolist())), raw):
            items.append(np.concatenate([np.full((1, len(got)), number), np.array(got, np.int64).T]))
            number += 1
    of, window, found = window_minima(b, *np.concatenate(items, axis=1), low)
    run_windows = length - WINDOW + 1
    run_first = np.cumsum(run_windows) - run_windows
    best = np.repeat(low, run_windows)
    np.minimum.at(best, run_first[of] + window, found)
    lowest[_ranges(run_head, wide)] = best[_ranges(run_first[run_which], wide)]
    head = np.flatnonzero(np.concatenate([[True], edge | (lowest[1:] != lowest[:-1])]))
    tail = np.concatenate([head[1:], [len(owner)]]) - 1
    run_of, run_lo, run_hi, run_id = owner[head], head - first[owner[head]], tail - first[owner[tail]], lowest[head]
    begin, end = np.searchsorted(run_of, np.arange(len(one))), np.searchsorted(run_of, np.arange(len(one)), side="right")
    out, x = [], 0
    for r, own_ids in zip(rows, ids):
        own = held[x : x + len(own_ids)]
        x += len(own_ids)
        count = (end - begin)[own]
        pick, local = _ranges(begin[own], count), np.repeat(np.arange(len(own)), count)
        good = run_id[pick] < own_ids[local]
        pick, local = pick[good], local[good]
        if len(pick):
            doc = unplane(r["docs"], np.int32)[unplane(r["of"], np.int32)[local]].astype(np.int64)
            start = unplane(r["places"], np.int64)[local] + run_lo[pick]
            order = np.lexsort((start, doc))
            out.append((r["block"], planes(np.concatenate([doc[order], start[order], (start + run_hi[pick] - run_lo[pick] + WINDOW)[order]]))))
    cols = list(zip(*out)) or [()] * 2
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary()])], names=["block", "places"])


def block_spans(r: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, starts, ends) of the maximal runs to be removed from a block's documents."""
    if not r["found"]:
        return
    of, start, end = np.concatenate([unplane(x, np.int64).reshape(3, -1) for x in r["found"]], axis=1)
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    for a, z in zip(*bounds(of)):
        reach = np.maximum.accumulate(end[a:z])
        cut = np.flatnonzero(np.concatenate([[True], start[a + 1 : z] > reach[:-1]]))
        yield int(of[a]), start[a:z][cut], reach[np.concatenate([cut[1:], [z - a]]) - 1]


def block_results(r: dict) -> tuple[np.ndarray, list[bytes], dict[int, tuple[bytes, np.ndarray, np.ndarray]]]:
    """A block's ids, whole texts, and for each document that loses something what is left, with the removed runs."""
    ids, lengths, data = _unblock(r)
    ends = np.cumsum(lengths)
    texts, changed = [data[a:z] for a, z in zip((ends - lengths).tolist(), ends.tolist())], {}
    for d, s, e in block_spans(r):
        edges = np.concatenate([[0], np.stack([s, e], axis=1).ravel(), [len(texts[d])]])
        changed[d] = b"".join(texts[d][x:y] for x, y in zip(edges[::2], edges[1::2])), s, e
    return ids, texts, changed


def found_places(docs: DataFrame, with_rest: bool = False) -> DataFrame:
    """The blocks of docs with `found`, an array of packed (document, start, end), null where nothing is removed.

    Both joins take the blocks with the same columns and the same filter, so that Spark shuffles them once for both.
    """
    blocks = materialize(pack_blocks(docs, with_rest), "blocks")
    size = blocks.agg(F.sum("size").alias("bytes"), F.countDistinct(F.shiftright("block", 32)).alias("tasks")).first()
    parts = max(1, -(-(size["bytes"] or 0) // PART_BYTES), KEY_PARTS * size["tasks"])
    shared = shared_keys(block_keys(blocks.drop("rest"), parts)).groupBy("block").agg(F.collect_list(F.struct("part", "keys", "levels")).alias("shared"))
    blocks = (blocks if with_rest else blocks.drop("rest")).where("block is not null")
    sent = stretches(blocks.join(shared, "block"), parts)  # blocks that share nothing have nothing to send
    places = sent.groupBy("part").applyInArrow(releasing_group(sort_part), "block long, places binary").groupBy("block").agg(F.collect_list("places").alias("found"))
    return blocks.join(places, "block", "left")


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every document; spans holds the 64-bit starts, then
    the 64-bit ends, of what is removed, in bytes."""
    names = [c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, texts, changed = block_results(r)
                there = np.frombuffer(r["known"], bool).tolist()
                spans = [(np.zeros(0, np.int64),) * 2 if d not in changed else changed[d][1:] for d in range(len(texts))]
                cols = [
                    [i if k else None for i, k in zip(ids.tolist(), there)],
                    [len(t) for t in texts],
                    [int((e - s).sum()) for s, e in spans],
                    [len(s) for s, _ in spans],
                    [hashlib.sha256(changed[d][0] if d in changed else t).hexdigest() for d, t in enumerate(texts)],
                    [s.tobytes() + e.tobytes() for s, e in spans],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return found_places(docs).mapInArrow(releasing(run), RESULT_SCHEMA)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with what find_repeats removes taken out of `text`; all columns stay, and n_chars follows where there is one.

    The other columns travel in the blocks, so the texts are joined with nothing but what is found in them.
    """
    schema, others = docs.schema, [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, texts, changed = block_results(r)
                rest = pa.ipc.open_stream(unzip(r["rest"])).read_all().column(0).combine_chunks()
                *columns, was_null = rest.flatten()
                own = dict(zip(others, columns))
                left = [changed[d][0].decode(errors="replace") if d in changed else t.decode() for d, t in enumerate(texts)]
                if "n_chars" in own and changed:
                    n = own["n_chars"].to_pylist()
                    for d in changed:
                        n[d] = len(left[d])
                    own["n_chars"] = pa.array(n, own["n_chars"].type)
                own["text"] = pa.array([None if e else t for t, e in zip(left, was_null.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([own[c] for c in schema.names], names=schema.names)

    return found_places(docs, with_rest=True).mapInArrow(releasing(run), schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a smaller doc_id also has in 50-byte strings."""
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
