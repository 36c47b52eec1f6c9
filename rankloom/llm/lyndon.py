"""Suffix arrays by linear grouping, of many short strings at once.

Suffixes are first put into groups by their first symbol. Groups are processed in descending order: each member's
previous-smaller pointer leads to the nearest suffix before it in a lower group; suffixes that are pointed at, split by how
often and by their group, move into a new group right above the rest of theirs. At the end a group holds the
suffixes that share their longest Lyndon prefix. Then one pass over the suffix array, smallest first, places the suffix
before each placed one and those along its pointers at the front of their groups, which orders every group without
renaming or recursion.

Strings don't touch each other, so numpy takes one group of every string in each step.
"""

from __future__ import annotations

import numpy as np


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    many = hi - lo
    of = np.repeat(np.arange(len(lo)), many)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[of], of


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each string symbols[bounds[i]:bounds[i + 1]], its suffixes in order, as positions in symbols.

    Each string must end with a symbol that is smaller than all others in it and occurs only there.
    """
    n, lanes = len(symbols), len(bounds) - 1
    if not n:
        return np.zeros(0, np.int64)
    lane = np.repeat(np.arange(lanes), np.diff(bounds))
    base = bounds[:-1][lane]
    log = np.empty(2 * n, np.int64)
    log[:n] = order = np.lexsort((symbols, lane))
    s, ln = symbols[order], lane[order]
    first = np.ones(n, bool)
    first[1:] = (s[1:] != s[:-1]) | (ln[1:] != ln[:-1])
    starts = np.flatnonzero(first)
    groups, used = len(starts), n
    start, size, low, high, lo, hi = (np.full(n + 1, -1, np.int64) for _ in range(6))
    start[:groups], size[:groups] = starts, np.diff(np.append(starts, n))
    lo[:groups], hi[:groups] = starts, starts + size[:groups]
    of_lane = ln[starts]
    same = of_lane[1:] == of_lane[:-1]
    low[1:groups] = np.where(same, np.arange(groups - 1), -1)
    high[: groups - 1] = np.where(same, np.arange(1, groups), -1)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(first) - 1
    previous, pointer = np.full(n, -1, np.int64), np.arange(-1, n - 1)
    pointer[bounds[:-1][np.diff(bounds) > 0]] = -1

    current = np.append(np.flatnonzero(~same), groups - 1)
    while len(current):
        at, of = _ranges(lo[current], hi[current])
        m, g = log[at], current[of]
        stay = group[m] == g
        m, g = m[stay], g[stay]
        mine = start[g]
        todo = np.arange(len(m))
        while len(todo):
            q = pointer[m[todo]]
            todo, q = todo[q >= 0], q[q >= 0]
            theirs = start[group[q]]
            up = theirs >= mine[todo]
            todo, q, theirs = todo[up], q[up], theirs[up]
            pointer[m[todo]] = np.where(theirs > mine[todo], previous[q], pointer[q])
        previous[m] = pointer[m]
        pointed = previous[m]
        pointed, often = np.unique(pointed[pointed >= 0], return_counts=True)
        for k in np.unique(often)[::-1].tolist():
            p = pointed[often == k]
            p = p[np.argsort(group[p], kind="stable")]
            h, at, many = np.unique(group[p], return_index=True, return_counts=True)
            part = many < size[h]  # a whole group stays what it is
            h, at, many = h[part], at[part], many[part]
            if not len(h):
                continue
            new = groups + np.arange(len(h))
            groups += len(h)
            start[new], size[new] = start[h] + size[h] - many, many
            size[h] -= many
            above = high[h]
            high[new], low[new], high[h], low[above] = above, h, new, new
            i, of = _ranges(at, at + many)
            group[p[i]] = new[of]
            log[used : used + len(i)] = p[i]
            lo[new] = used + np.cumsum(many) - many
            hi[new] = lo[new] + many
            used += len(i)
        current = low[current]
        current = current[current >= 0]

    out, placed, front = np.full(n, -1, np.int64), np.zeros(n, bool), start.copy()
    length = np.diff(bounds)
    live = np.flatnonzero(length > 0)
    out[bounds[live]] = bounds[live + 1] - 1
    placed[out[bounds[live]]] = True
    step = 0
    while len(live):
        s = out[bounds[live] + step] - 1
        s = s[s >= bounds[live]]
        while len(s):
            s = s[~placed[s]]
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = previous[s]
            s = s[s >= 0]
        step += 1
        live = live[length[live] > step]
    del base
    return out
