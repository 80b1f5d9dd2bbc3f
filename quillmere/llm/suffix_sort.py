"""Suffix arrays of many short texts at once, by linear grouping.

Phase 1 starts from groups of equal first symbols and takes groups in descending order. For every suffix of the group,
the previous-smaller pointer is the nearest suffix to its left that lies in a lower group; the suffixes pointed to leave
their group, by the number of pointers they got, for new groups right above it. In the end a group holds the suffixes
that share their longest Lyndon prefix. Phase 2 reads the array upward: the suffix left of each emitted one, and those
that its pointers lead to, take the next free place of their groups. No text is renamed and nothing recurses.

All texts take their steps together, as numpy operations over one element or group of each text; texts that are done
drop out. The work is linear in the total length up to pointer walks.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] numbers, then the same for the others."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - ends + length, length)


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of the concatenated texts, each in its own text's place, as positions in `text`.

    text: non-negative integers; the last symbol of each text must be its unique smallest.
    """
    n = len(text)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    lane = np.repeat(np.arange(len(lengths)), lengths)
    # groups of equal first symbols: places by text, then symbol
    key = lane * (int(text.max(initial=0)) + 1) + text
    places = np.argsort(key, kind="stable")
    ordered = key[places]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.concatenate([head, [n]]))
    group = np.empty(n, np.int64)  # a group's number is its first place
    group[places] = np.repeat(head, size)
    at = np.empty(n, np.int64)
    at[places] = np.arange(n)
    first_of = np.zeros(n, np.int64)  # at a group's last place: its first
    first_of[head + size - 1] = head
    end = np.zeros(n + 1, np.int64)  # at a group's first place: one past its last
    end[head] = head + size
    prev = np.full(n, -1, np.int64)
    member = np.zeros(n, bool)

    top, low = (base + lengths).astype(np.int64), base
    while len(top):
        start = first_of[top - 1]
        own = np.sort(places[_ranges(start, top - start)])
        g = group[own]
        # previous-smaller pointers: walk left over higher groups
        p = own - 1
        walk = np.flatnonzero(p >= 0)
        while len(walk):
            walk = walk[group[p[walk]] > g[walk]]
            p[walk] = prev[p[walk]]
            walk = walk[p[walk] >= 0]
        same = np.zeros(len(own), bool)
        ok = p >= 0
        same[ok] = group[p[ok]] == g[ok]  # then it is the group's member before this one, whose pointer holds
        lead = np.where(same, 0, np.arange(len(own)))
        p = p[np.maximum.accumulate(lead)]
        ok = p >= 0
        ok[ok] = lane[p[ok]] == lane[own[ok]]
        p[~ok] = -1
        prev[own] = p
        # regroup what is pointed to
        hit, times = np.unique(p[ok], return_counts=True)
        if len(hit):
            old = group[hit]
            order = np.lexsort((times, old))
            hit, times, old = hit[order], times[order], old[order]
            new_old = np.concatenate([[True], old[1:] != old[:-1]])
            heads = np.flatnonzero(new_old)
            count = np.diff(np.concatenate([heads, [len(hit)]]))
            stop = end[old[heads]]
            slots = _ranges(stop - count, count)
            member[hit] = True
            displaced = places[slots]
            displaced = displaced[~member[displaced]]
            vacated = at[hit][at[hit] < np.repeat(stop - count, count)]
            member[hit] = False
            places[vacated] = displaced
            at[displaced] = vacated
            places[slots] = hit
            at[hit] = slots
            cut = np.flatnonzero(new_old | np.concatenate([[True], times[1:] != times[:-1]]))
            sizes = np.diff(np.concatenate([cut, [len(hit)]]))
            group[hit] = np.repeat(slots[cut], sizes)
            end[slots[cut]] = slots[cut] + sizes
            first_of[slots[cut] + sizes - 1] = slots[cut]
            left = stop - count
            rest = left > old[heads]
            end[old[heads][rest]] = left[rest]
            first_of[left[rest] - 1] = old[heads][rest]
        keep = start > low
        top, low = start[keep], low[keep]

    # phase 2
    out = np.full(n, -1, np.int64)
    out[base] = base + lengths - 1
    free = np.arange(n)  # next free place of each group
    placed = np.zeros(n, bool)
    placed[out[base]] = True
    order = np.argsort(-lengths, kind="stable")
    starts, longest = base[order], lengths[order]
    live = len(starts)
    for step in range(int(longest[0]) if live else 0):
        while longest[live - 1] <= step:
            live -= 1
        begin = starts[:live]
        s = out[begin + step] - 1
        s = s[s >= begin]
        while len(s):
            s = s[~placed[s]]
            g = group[s]
            spot = free[g]
            out[spot] = s
            free[g] = spot + 1
            placed[s] = True
            s = prev[s]
            s = s[s >= 0]
    return out
