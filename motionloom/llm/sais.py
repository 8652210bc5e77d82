"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor. A first induction sorts the substrings
between leftmost S suffixes; they are named in that order, equal ones (compared byte by byte) alike. Where names repeat, the
string of names is sorted by the same method, recursively. From the sorted leftmost S
suffixes, a second induction places all others: L suffixes bucket by bucket from the left, S suffixes from the right.

Bytes are induced in whole-array steps: a bucket is read in waves, entries that put new ones into the same bucket being
followed by these, in order, as in a scan one by one; a wave is dealt out by a radix sort of its 16-bit keys. Names, whose alphabet may be as large as
their string, are induced one by one. Either way an induction reads each suffix once, so that the whole takes linear time.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; t ends with a sentinel that is its only smallest."""
    cuts = np.concatenate([np.flatnonzero(t[1:] != t[:-1]), [len(t) - 1]])  # last place of each run
    small = np.empty(len(cuts), bool)
    small[:-1] = t[cuts[:-1]] < t[cuts[:-1] + 1]
    small[-1] = True
    return np.repeat(small, np.diff(cuts, prepend=-1))


def _spread(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, each one's rank among equal keys, and the counts."""
    order = np.argsort(keys, kind="stable")
    counts = np.bincount(keys, minlength=size)
    first = np.cumsum(counts) - counts
    return order, np.arange(len(keys)) - first[keys[order]], counts


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array, given leftmost S suffixes in an order that is right within each bucket."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    kinds = t.astype(np.uint16)
    larger, smaller = ~small, small
    lms_counts = np.bincount(t[lms], minlength=size)
    lms_at = np.concatenate([[0], np.cumsum(lms_counts)])
    by_bucket = lms[np.argsort(kinds[lms], kind="stable")]
    # L suffixes, from the left.
    head = starts.copy()
    l_end = starts.copy()
    for k in range(size):
        if not counts[k]:
            continue
        done = starts[k]
        while done < head[k]:
            now = sa[done : head[k]]
            done = head[k]
            _push(now, kinds, larger, sa, head, 1, size)
        l_end[k] = head[k]
        now = by_bucket[lms_at[k] : lms_at[k + 1]]
        if len(now):
            _push(now, kinds, larger, sa, head, 1, size)
    # S suffixes, from the right; the sentinel stands first.
    tail = ends.copy()
    for k in range(size - 1, -1, -1):
        if not counts[k]:
            continue
        done = ends[k]
        while done > tail[k]:
            now = sa[tail[k] : done][::-1]
            done = tail[k]
            _push(now, kinds, smaller, sa, tail, -1, size)
        now = sa[starts[k] : l_end[k]][::-1]
        if len(now):
            _push(now, kinds, smaller, sa, tail, -1, size)
    sa[0] = n - 1
    return sa


def _push(now: np.ndarray, kinds: np.ndarray, wanted: np.ndarray, sa: np.ndarray, ends: np.ndarray, step: int, size: int) -> None:
    """Puts the predecessors of a wave into their buckets, in order."""
    before = now - 1
    before = before[before >= 0]
    before = before[wanted[before]]
    if not len(before):
        return
    keys = kinds[before]
    if len(before) == 1:
        k = keys[0]
        sa[ends[k] if step > 0 else ends[k] - 1] = before[0]
        ends[k] += step
        return
    order, rank, counts = _spread(keys, size)
    keys = keys[order]
    sa[ends[keys] + rank if step > 0 else ends[keys] - 1 - rank] = before[order]
    ends += step * counts


def _named(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings from one leftmost S suffix to the next (both ends included), in text order; and how many names there are."""
    place = np.empty(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    sizes = (np.append(lms[1:], len(t) - 1) + 1 - lms)[place[order]]
    # Neighbours in the sorted order that are as long as each other, compared place by place; the sentinel is nobody's equal.
    pairs = np.flatnonzero(sizes[1:] == sizes[:-1])
    new = np.ones(len(order), bool)
    if len(pairs):
        many = sizes[pairs]
        firsts = np.cumsum(many) - many
        ramp = np.arange(int(many.sum())) - np.repeat(firsts, many)
        equal = t[np.repeat(order[pairs], many) + ramp] == t[np.repeat(order[pairs + 1], many) + ramp]
        new[pairs + 1] = ~np.logical_and.reduceat(equal, firsts)
    names = np.empty(len(order), np.int64)
    names[place[order]] = np.cumsum(new) - 1
    return names, int(new.sum())


def _scan(t: list[int], small: list[bool], lms: list[int], size: int) -> list[int]:
    """As _induce, one by one, for any alphabet."""
    n = len(t)
    starts = [0] * (size + 1)
    for x in t:
        starts[x + 1] += 1
    for k in range(size):
        starts[k + 1] += starts[k]
    sa, tail = [-1] * n, starts[1:]
    for x in reversed(lms):
        k = t[x]
        tail[k] -= 1
        sa[tail[k]] = x
    head = starts[:size]
    for x in sa:
        if x > 0 and not small[x - 1]:
            k = t[x - 1]
            sa[head[k]] = x - 1
            head[k] += 1
    tail = starts[1:]
    for i in range(n - 1, -1, -1):
        x = sa[i] - 1
        if x >= 0 and small[x]:
            k = t[x]
            tail[k] -= 1
            sa[tail[k]] = x
    return sa


def _sorted_names(names: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of a string of names, which ends with a sentinel (0, its only smallest)."""
    if size == len(names):
        out = np.empty(size, np.int64)
        out[names] = np.arange(size)
        return out
    small = _types(names)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    t, kinds = names.tolist(), small.tolist()
    is_lms = np.zeros(len(names), bool)
    is_lms[lms] = True
    sa = np.array(_scan(t, kinds, lms.tolist(), size))
    inner, many = _named(names, lms, sa[is_lms[sa]])
    return np.array(_scan(t, kinds, lms[_sorted_names(inner, many)].tolist(), size))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a byte string."""
    t = np.concatenate([text.astype(np.int64) + 1, [0]])
    n, size = len(t), 257
    if n < 3:
        return np.arange(n - 1)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    names, many = _named(t, lms, sa[is_lms[sa]])
    return _induce(t, small, lms[_sorted_names(names, many)], size)[1:]


#: Places that one lane of common_prefixes goes through.
LANE = 256


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: of each suffix, by its place, with the one before it in sa, up to `most`.

    In text order a prefix is at most one shorter than the one before, so that each comparison of two bytes either makes a
    prefix longer or ends it: linear time. The text is cut into lanes of LANE places that take such steps side by side.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(most, np.uint8)])
    at = np.arange(0, n, LANE)
    stop = np.minimum(at + LANE, n)
    got = np.zeros(len(at), np.int64)
    while len(at):
        prev = before[at]
        more = (prev >= 0) & (got < most) & (np.maximum(at, prev) + got < n)
        more &= padded[at + got] == padded[prev + got]
        out[at] = got  # stands once the lane goes on to the next place
        got += np.where(more, 1, -np.minimum(got, 1))
        at = at + ~more
        if (ended := at == stop).any():
            on = ~ended
            at, stop, got = at[on], stop[on], got[on]
    out[sa[0]] = 0
    return out
