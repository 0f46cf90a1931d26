"""Suffix arrays by induced sorting, and the windows that repeat within a set of texts.

The array is built as usual for this method: suffixes are classified as smaller (S) or larger (L) than their successor, the
substrings from each leftmost S of a run (LMS) to the next are sorted and equal ones get equal names, the string of names is
sorted recursively, and an induction from the LMS in their final order gives all suffixes in linear time. Over byte alphabets the
induction works through the buckets with array operations; over the names, of which there are many, it is the plain loop. The
substrings are short (three symbols on average), so they are sorted symbol by symbol, only those that are still tied.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Symbols below the bytes: the end of all, and the end of a text.
END, BREAK, SHIFT = 0, 1, 2
#: An induction loops over buckets if there are at least so many symbols to a bucket on average.
BUCKET = 64


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol counts as smaller."""
    step = np.append(np.sign(np.diff(t.astype(np.int64))), 1)
    told = np.flatnonzero(step)
    return step[told[np.searchsorted(told, np.arange(len(t)))]] > 0


def _induce_buckets(t: np.ndarray, k: int, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    sizes, larger = np.bincount(t, minlength=k), np.bincount(t[~is_s], minlength=k)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(t), -1, np.int64)
    by = lms[np.argsort(t[lms], kind="stable")]
    cuts = np.searchsorted(t[by], np.arange(k + 1))
    at = starts.copy()

    def push(found: np.ndarray, want_s: bool) -> None:
        before = found[found > 0] - 1
        before = before[is_s[before] == want_s]
        if not len(before):
            return
        c = t[before]
        order = np.argsort(c, kind="stable")
        c, before = c[order], before[order]
        n = np.bincount(c, minlength=k)
        place = np.arange(len(c)) - np.repeat((np.cumsum(n) - n)[n > 0], n[n > 0])
        sa[at[c] - 1 - place if want_s else at[c] + place] = before
        at[:] += -n if want_s else n

    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < at[c]:
            some, done = sa[done : at[c]].copy(), at[c]
            push(some, False)
        push(by[cuts[c] : cuts[c + 1]], False)
    at = ends.copy()
    sa[0], at[END] = len(t) - 1, 0
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        while done > at[c]:
            some, done = sa[at[c] : done][::-1].copy(), at[c]
            push(some, True)
        push(sa[starts[c] : starts[c] + larger[c]][::-1].copy(), True)
    return sa


def _induce_loop(t: np.ndarray, k: int, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    sa = [0] * len(t)  # 0 has no suffix before it, so it also stands for an empty place
    tail = ends.tolist()
    for i, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        tail[c] -= 1
        sa[tail[c]] = i
    head = (ends - sizes).tolist()
    before = np.where(is_s, -1, t)[np.arange(-1, len(t) - 1)].tolist()  # of each suffix, the symbol before it if an L begins there
    before[0] = -1
    for i in sa:  # sees what is put behind it
        c = before[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    before = np.where(is_s, t, -1)[np.arange(-1, len(t) - 1)].tolist()
    before[0] = -1
    for i in reversed(sa):
        c = before[i]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = i - 1
    return np.array(sa, np.int64)


def substring_names(t: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """Numbers of the substrings from each LMS to the next, in their order; equal ones share a number. One that ends where another
    goes on is the larger: there, its suffix is S and the other's is L."""
    length = np.append(np.diff(lms) + 1, 1)
    names = np.zeros(len(lms), np.int64)  # how many are smaller, as far as is known
    tied, at = np.arange(len(lms)), 0
    while len(tied):
        key = names[tied] * (k + 1) + np.where(length[tied] > at, t[np.minimum(lms[tied] + at, len(t) - 1)], k)
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(key)))
        group = key[head] // (k + 1)  # as it was named before
        first = head[np.searchsorted(group, group)]
        names[tied] = np.repeat(group + head - first, size)
        tied = tied[np.repeat((size > 1) & (key[head] % (k + 1) < k), size)]
        at += 1
    return np.unique(names, return_inverse=True)[1].astype(np.int64)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of `t` in order; its symbols are below `k`, and the last one, END, occurs only there."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    is_s = smaller(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induce = _induce_buckets if len(t) >= BUCKET * k else _induce_loop
    names = substring_names(t, k, lms)
    if names.max() + 1 < len(lms):
        return induce(t, k, is_s, lms[suffix_array(names, int(names.max()) + 1)])
    return induce(t, k, is_s, lms[np.argsort(names)])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each with a BREAK behind it, then END; and where each text starts."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    t = np.full(int(sizes.sum()) + 1, BREAK, np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    inner = np.arange(len(data)) + np.repeat(np.arange(len(texts)), sizes - 1)
    t[inner] = data.astype(np.int64) + SHIFT
    t[-1] = END
    return t, starts


def long_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each place of `t` that starts a window: whether it shares `length` symbols with the suffix before it in `sa`.

    Permuted common prefixes: along a text, the common prefix with the preceding suffix shrinks by one at most from a place to
    the next. All texts advance together, a place at a time."""
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(len(t), bool)
    order = np.argsort(-windows, kind="stable")
    at, left, common = starts[order], windows[order], np.zeros(len(order), np.int64)
    for _ in range(int(windows.max(initial=0))):
        n = int(np.searchsorted(-left, 0, "left"))  # those that still have a window here come first
        at, left, common = at[:n], left[:n], common[:n]
        other = before[at]
        live = np.flatnonzero((common < length) & (other >= 0))
        while len(live):
            i, j = at[live] + common[live], other[live] + common[live]
            fit = (t[i] == t[j]) & (t[i] >= SHIFT)
            live = live[fit]
            common[live] += 1
            live = live[common[live] < length]
        shared[at[common >= length]] = True
        at, left, common = at + 1, left - 1, np.maximum(common - 1, 0)
    return shared


def repeats(texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(text, from, to) of the bytes covered by strings of `length` bytes that also start earlier, in an earlier text of the
    list or earlier in the same one; overlapping or touching strings are one stretch."""
    windows = np.array([max(0, len(x) - length + 1) for x in texts], np.int64)
    if not windows.sum():
        return []
    t, starts = joined(texts)
    sa = suffix_array(t, 256 + SHIFT)
    shared = long_prefixes(t, sa, starts, windows, length)
    heads = np.flatnonzero(~shared[sa])
    first = np.repeat(np.minimum.reduceat(sa, heads), np.diff(np.append(heads, len(sa))))
    again = np.zeros(len(t), bool)
    again[sa] = sa != first  # only windows share a run with others
    found = np.flatnonzero(again)
    if not len(found):
        return []
    text = np.searchsorted(starts, found, "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(found) > length) | (np.diff(text) > 0)]))
    last = np.append(cut[1:], len(found)) - 1
    return list(zip(text[cut].tolist(), (found[cut] - starts[text[cut]]).tolist(), (found[last] - starts[text[last]] + length).tolist(), strict=True))
