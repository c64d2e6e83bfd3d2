"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as smaller or larger than the next one; the leftmost-smaller
(LMS) substrings are sorted by one round of induction, named, ordered by their names and those after them
until all differ, and a second round induces all suffixes from them. A round goes bucket by bucket, each bucket
in waves of whole arrays: what a wave induces into its own bucket is the next wave. The names are nearly as
many as their places, where buckets would hold hardly any; their order is refined by doubling instead.
"""

from __future__ import annotations

import numpy as np


def smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the least."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    out = np.ones(n, bool)
    if n > 1:
        at = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
        out[:-1] = s[at] < s[at + 1]
    return out


def placed(symbols: np.ndarray, values: np.ndarray, out: np.ndarray, heads: np.ndarray, step: int) -> None:
    """Append values to their symbols' buckets, in order, forwards or backwards."""
    if not len(values):
        return
    order = np.argsort(symbols.astype(np.uint16) if len(heads) <= 1 << 16 else symbols, kind="stable")  # 16 bits are sorted in linear time
    symbols, values = symbols[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    counts = np.diff(np.append(first, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(first, counts)
    at = heads[symbols] + rank if step > 0 else heads[symbols] - 1 - rank
    out[at] = values
    heads[symbols[first]] += step * counts


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of ``lms``, the LMS suffixes."""
    out = np.full(len(s), -1, np.int64)
    used = np.flatnonzero(np.diff(bounds))
    heads, tails = bounds[:-1].copy(), bounds[1:].copy()
    own = s[lms]
    by = np.argsort(own.astype(np.uint16) if len(bounds) <= 1 << 16 else own, kind="stable")
    seeds, cuts = lms[by], np.searchsorted(own[by], np.arange(len(bounds)))

    def before(wave: np.ndarray, kind: bool) -> np.ndarray:
        prior = wave[wave > 0] - 1
        return prior[small[prior] == kind]

    for c in used:  # larger suffixes, from the left
        at = bounds[c]
        while at < heads[c]:
            wave = out[at : heads[c]]
            at = heads[c]
            prior = before(wave, False)
            placed(s[prior], prior, out, heads, 1)
        prior = before(seeds[cuts[c] : cuts[c + 1]], False)
        placed(s[prior], prior, out, heads, 1)
    for c in used[::-1]:  # smaller suffixes, from the right
        at = bounds[c + 1]
        if c == used[0]:
            out[bounds[c + 1] - 1] = len(s) - 1 if s[-1] == c else out[bounds[c + 1] - 1]
        while at > tails[c]:
            wave = out[tails[c] : at][::-1]
            at = tails[c]
            prior = before(wave, True)
            placed(s[prior], prior, out, tails, -1)
        prior = before(out[bounds[c] : heads[c]][::-1], True)
        placed(s[prior], prior, out, tails, -1)
    return out


def induce_singly(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """:func:`induce` one suffix at a time, for alphabets so large that a bucket has hardly any."""
    symbol, is_small, out = s.tolist(), small.tolist(), [-1] * len(s)
    room = bounds[1:].tolist()
    for i in lms[::-1].tolist():
        room[symbol[i]] -= 1
        out[room[symbol[i]]] = i
    room = bounds[:-1].tolist()
    for k in range(len(out)):
        j = out[k] - 1
        if j >= 0 and not is_small[j]:
            c = symbol[j]
            out[room[c]] = j
            room[c] += 1
    room = bounds[1:].tolist()
    for k in range(len(out) - 1, -1, -1):
        j = out[k] - 1
        if j >= 0 and is_small[j]:
            c = symbol[j]
            room[c] -= 1
            out[room[c]] = j
    return np.array(out)


def names_of(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each LMS substring, in the order of the substrings; equal ones share it."""
    ends = np.append(lms[1:], len(s) - 1)
    length = ends - lms + 1
    place = np.empty(len(s), np.int64)
    place[lms] = np.arange(len(lms))
    seq = place[order]
    a, b = seq[:-1], seq[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = s[lms[a[live]] + k] == s[lms[b[live]] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[length[a[live]] > k]
    out = np.empty(len(lms), np.int64)
    out[seq] = np.cumsum(np.concatenate([[0], (~same).astype(np.int64)]))
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of names whose last one is the least and occurs once.

    A suffix's rank is the first place of those that agree with it in their first k names; the ranks k
    further on order each such group, and a round looks at groups of more than one only.
    """
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    live, k = np.flatnonzero(counts[names] > 1), 1
    padded = np.append(rank, -1)
    while len(live):
        key = padded[live] * (len(names) + 1) + padded[np.minimum(live + k, len(names))] + 1
        by = np.argsort(key)
        live, key = live[by], key[by]
        old = padded[live]
        here = np.arange(len(live))
        head = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        padded[live] = old + np.maximum.accumulate(np.where(fresh, here, 0)) - np.maximum.accumulate(np.where(head, here, 0))
        live = live[~(fresh & np.append(fresh[1:], True))]
        k *= 2
    out = np.empty(len(names), np.int64)
    out[padded[:-1]] = np.arange(len(names))
    return out


def suffix_array(s: np.ndarray, symbols: int | None = None) -> np.ndarray:
    """Of integers whose last one is the least and occurs once."""
    s = np.asarray(s, np.int64)
    if len(s) == 1:
        return np.zeros(1, np.int64)
    symbols = int(s.max()) + 1 if symbols is None else symbols
    by = induce if symbols <= max(300, len(s) // 48) else induce_singly
    small = smaller(s)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = by(s, small, lms, bounds)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names = names_of(s, lms, order)
    if names[np.argmax(names)] + 1 < len(lms):
        order = lms[doubled(names)]
    return by(s, small, order, bounds)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, how much its suffix has in common with the one sorted before it.

    Only irreducible values are compared symbol by symbol; where the symbols before both
    suffixes agree, the value is one less than that of the place before.
    """
    n = len(s)
    prior = np.full(n, -1, np.int64)
    prior[order[1:]] = order[:-1]
    here = np.arange(n)
    agree = (here > 0) & (prior > 0)
    agree[agree] = s[here[agree] - 1] == s[prior[agree] - 1]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~agree & (prior >= 0))
    word = np.zeros(n + 16, np.uint64)
    padded = np.concatenate([s.astype(np.uint64), np.zeros(16, np.uint64)])
    for k in range(4):  # four symbols of up to 16 bits in a word
        word[: n + 8] |= padded[k : n + 8 + k] << np.uint64(16 * k)
    k = 0
    while len(live):
        a, b = live + k, prior[live] + k
        inside = (a < n) & (b < n)
        equal = inside & (word[np.minimum(a, n)] == word[np.minimum(b, n)])
        rest = live[~equal]
        if len(rest):
            x = word[np.minimum(rest + k, n)] ^ word[np.minimum(prior[rest] + k, n)]
            low = np.where(x == 0, 4, np.where(x & np.uint64(0xFFFF), 0, np.where(x & np.uint64(0xFFFFFFFF), 1, np.where(x & np.uint64(0xFFFFFFFFFFFF), 2, 3))))
            out[rest] = np.minimum(k + low, n - np.maximum(rest, prior[rest]))
        live = live[equal]
        k += 4
    at = np.where(agree, 0, here)
    at = np.maximum.accumulate(at)
    return np.where(agree, np.maximum(out[at] - (here - at), 0), out)
