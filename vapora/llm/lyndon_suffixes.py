"""Suffix arrays by linear grouping, for many short texts at once.

A text's suffixes are grouped by their first symbol. Groups are then taken in descending order: each suffix of a group gets
a pointer to the nearest earlier suffix of a lower group, and those suffixes, whose Lyndon prefix goes on with the group's, move
to new groups above the rest of their own, the more often they are pointed to the higher. When all groups were taken, each
holds the suffixes of one Lyndon prefix. A last sweep in ascending order puts the predecessor of each suffix, and what its
pointers lead to, at the front of its group, which gives the order within groups without ranking anew.

A step handles the current group of every text of a batch, so its cost is spread over all texts.
"""

from __future__ import annotations

import numpy as np


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of each run, run after run."""
    ends = np.cumsum(counts, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(starts - ends + counts, counts)


def _sorted_places(text: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places by text number, then symbol, then place; 16-bit keys are sorted by radix."""
    small = text.astype(np.int16) if text.max(initial=0) < 1 << 15 else text
    order = np.argsort(small, kind="stable")
    return order[np.argsort(of[order].astype(np.uint16 if of[-1] < 1 << 16 else np.int64), kind="stable")] if len(of) else order


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays, text after text, of texts laid end to end.

    starts: first places; every text ends with a symbol smaller than all of its others. Entries are places in `text`.
    """
    total, count = len(text), len(starts)
    starts = np.asarray(starts, np.int32)
    ends = np.r_[starts[1:], np.int32(total)]
    of = np.repeat(np.arange(count, dtype=np.int32), ends - starts)
    listed = _sorted_places(text, of).astype(np.int32)  # suffixes by group
    where = np.empty(total, np.int32)
    where[listed] = np.arange(total, dtype=np.int32)
    first = np.flatnonzero(np.r_[True, (text[listed][1:] != text[listed][:-1]) | (of[1:] != of[:-1])]).astype(np.int32)
    sizes = np.diff(np.r_[first, np.int32(total)])
    size = np.zeros(total, np.int32)
    size[first] = sizes
    group = np.empty(total, np.int32)
    group[listed] = np.repeat(first, sizes)
    lower = np.arange(-1, total - 1, dtype=np.int32)
    lower[starts] = -1

    top = ends.copy()
    live = np.flatnonzero(top > starts)
    while len(live):
        begin = group[listed[top[live] - 1]]
        members = listed[_ragged(begin, top[live] - begin)]
        top[live] = begin
        live = live[begin > starts[live]]
        at, mine = lower[members], group[members]
        go = np.flatnonzero((at >= 0) & (group[at] >= mine))
        while len(go):
            at[go] = lower[at[go]]
            go = go[(at[go] >= 0) & (group[at[go]] >= mine[go])]
        lower[members] = at
        hit = at[at >= 0]
        if not len(hit):
            continue
        up, times = np.unique(hit, return_counts=True)
        home = group[up]
        order = np.lexsort((times, home))
        up, times, home = up[order], times[order], home[order]
        heads = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        moved = np.diff(np.r_[heads, len(up)])
        homes = home[heads]
        tail = homes + size[homes] - moved
        slots = _ragged(tail, moved)
        # What stands in the tails and stays goes where the others came from.
        marked = np.zeros(len(up), bool)
        inside = where[up] >= np.repeat(tail, moved)
        standing = listed[slots]
        marked[where[up][inside] - np.repeat(tail - heads.astype(np.int32), moved)[inside]] = True
        stay, free = standing[~marked], where[up][~inside]
        listed[free] = stay
        where[stay] = free
        listed[slots] = up
        where[up] = slots
        size[homes] -= moved
        split = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (times[1:] != times[:-1])])
        lengths = np.diff(np.r_[split, len(up)])
        size[slots[split]] = lengths
        group[up] = np.repeat(slots[split], lengths)

    out = np.empty(total, np.int32)
    free = np.arange(total, dtype=np.int32)  # next place of the group that begins there
    placed = np.zeros(total, bool)
    last = ends - 1
    out[starts] = last
    placed[last] = True
    free[group[last]] += 1
    by_length = np.argsort(starts - ends, kind="stable")
    sorted_lengths = (ends - starts)[by_length]
    heads = starts[by_length]
    for i in range(int(sorted_lengths[0]) if count else 0):
        k = int(np.searchsorted(-sorted_lengths, -i, side="left"))  # texts longer than i
        at = out[heads[:k] + i] - 1
        at = at[at >= heads[:k]]
        at = at[~placed[at]]
        while len(at):
            g = group[at]
            slot = free[g]
            out[slot] = at
            free[g] = slot + 1
            placed[at] = True
            at = lower[at]
            at = at[at >= 0]
            at = at[~placed[at]]
    return out
