"""Suffix arrays by linear grouping of Lyndon prefixes.

Phase 1 refines groups of suffixes, from the highest group down. A member's previous-smaller
pointer leads to the nearest earlier suffix of a lower group; the suffixes so pointed at are
greater than the rest of their own group by as many copies of the member's context as members
point at them, so they move to a group of their own just above it, most copies first. In the end
suffixes with the same Lyndon prefix form one group, and groups are in order.

Phase 2 emits the order: the suffix before each one emitted, and those its pointers lead to, take
the next free place of their groups. No text is renamed and nothing recurses.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(codes: np.ndarray) -> list[int]:
    """Suffix array of small non-negative integers whose last is 0; an end before any other end
    is smaller (a text's own end counts as below every code)."""
    n = len(codes) + 1  # the end, below every code
    first = np.argsort(codes, kind="stable").astype(np.int64)
    values = codes[first]
    sa = [n - 1, *first.tolist()]
    at = np.empty(n, dtype=np.int64)
    at[sa] = np.arange(n)
    starts = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=bool)
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(values)), 0)) + 1
    group_of = np.empty(n, dtype=np.int64)
    group_of[n - 1] = 0
    group_of[first] = begin
    # one object a number, so that reading the lists stays within the processor's cache
    number = list(range(n))
    sa, at, group = (list(map(number.__getitem__, x)) for x in (sa, at.tolist(), group_of.tolist()))
    size = np.bincount(group_of, minlength=n).tolist()
    prev = [-1] * n  # -1 stands for the end too: its group is below every other, so that searches stop there

    def lift_one(p: int) -> None:
        g = group[p]
        left = size[g] - 1
        if left:
            to = g + left
            here, other = at[p], sa[to]
            sa[here], sa[to], at[other], at[p] = other, p, here, to
            group[p] = to
            size[g], size[to] = left, 1

    end = n - 1
    while end > 0:
        i = sa[end]
        start = group[i]
        if start == end:  # a group of one, the most frequent case
            p = i - 1
            while group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                lift_one(p)
            end = start - 1
            continue
        if start + 1 == end:  # a group of two, as copies make them
            j = sa[start]
            if j < i:
                i, j = j, i
            p = i - 1
            while group[p] >= start:
                p = prev[p]
            prev[i] = p
            q = j - 1
            while group[q] >= start:
                q = prev[q]
            prev[j] = q
            if p == q:
                if p >= 0:
                    lift_one(p)
            elif p < 0:
                lift_one(q)
            elif group[p] != group[q]:
                lift_one(p)
                lift_one(q)
            else:
                g = group[p]
                left = size[g] - 2
                if left:
                    to = g + left
                    here, other = at[p], sa[to]
                    sa[here], sa[to], at[other], at[p] = other, p, here, to
                    here, other = at[q], sa[to + 1]
                    sa[here], sa[to + 1], at[other], at[q] = other, q, here, to + 1
                    size[g], size[to] = left, 2
                    group[p] = group[q] = to
            end = start - 1
            continue
        hits = []
        for i in sorted(sa[start : end + 1]):
            p = i - 1
            while group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                hits.append(p)
        if len(set(hits)) == len(hits):  # each is pointed at once, the most frequent case
            _lift(hits, sa, at, group, size)
        else:
            pointed = Counter(hits)
            counts = set(pointed.values())
            for k in sorted(counts, reverse=True):
                _lift([p for p, c in pointed.items() if c == k] if len(counts) > 1 else pointed, sa, at, group, size)
        end = start - 1

    free = number  # next place of a group, at its start
    out = [0] * n
    out[0], group[n - 1] = n - 1, -1  # -1: placed
    for i in range(n):
        j = out[i] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            group[j] = -1
            to = free[g]
            free[g] = to + 1
            out[to] = j
            j = prev[j]
    return out[1:]


def _lift(members, sa: list[int], at: list[int], group: list[int], size: list[int]) -> None:
    """Moves each member to a new group just above what is left of its group."""
    whole: dict[int, int] = {}
    for p in members:
        g = group[p]
        left = size[g]
        if g not in whole:
            whole[g] = left
        size[g] = left = left - 1
        to = g + left  # the back of the group, before those moved already
        here, other = at[p], sa[to]
        sa[here], sa[to], at[other], at[p] = other, p, here, to
    for g, n in whole.items():
        left = size[g]
        if left:
            size[g + left] = n - left
            for p in sa[g + left : g + n]:
                group[p] = g + left
        else:
            size[g] = n
