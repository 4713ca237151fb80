"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised in numpy.

``suffix_array`` classifies suffixes as S or L, sorts the leftmost S (LMS) substrings by one induction, names them, sorts the
string of names by the same function, and induces the whole array from that order. An induction walks the buckets of first
characters; all entries that a bucket holds at a time are handled together, and entries that they add to the same bucket make
its next wave. Where buckets hold few entries each, as in strings of names, entries are handled one by one. Names that occur once
settle comparisons, so runs of them are left out of the recursion.
"""

from __future__ import annotations

import numpy as np

#: From so many entries a bucket on, buckets are handled as arrays.
LARGE_BUCKET = 32


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one, a unique least character, is."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    # the first place at or after i where neighbours differ decides for the whole run
    nxt = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, dtype=bool)
    at = differs[np.minimum(nxt, len(differs) - 1)]
    out[:-1] = t[at] < t[at + 1]
    return out


def _grouped(chars: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, the characters in it, and the place of each within its group."""
    order = np.argsort(chars.astype(np.uint16) if sigma <= 65536 else chars, kind="stable")
    own = chars[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    within = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order, own, within


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from the LMS suffixes in the given order."""
    n = len(t)
    if n < LARGE_BUCKET * sigma:
        return _induce_singly(t, small, lms, sigma)
    sa = np.full(n, -1, dtype=np.int64)
    count = np.bincount(t, minlength=sigma)
    ends = np.cumsum(count)
    heads, tails = ends - count, ends.copy()
    begins = heads.copy()
    order, own, within = _grouped(t[lms], sigma)
    per = np.bincount(own, minlength=sigma)
    sa[ends[own] - per[own] + within] = lms[order]

    def push(entries: np.ndarray, to_small: bool) -> None:
        j = entries[entries > 0] - 1
        j = j[small[j] == to_small]
        if not len(j):
            return
        order, own, within = _grouped(t[j], sigma)
        added = np.bincount(own, minlength=sigma)
        if to_small:
            sa[tails[own] - 1 - within] = j[order]
            tails[:] -= added
        else:
            sa[heads[own] + within] = j[order]
            heads[:] += added

    used = np.flatnonzero(count)
    for c in used:
        done = begins[c]
        while heads[c] > done:
            wave, done = sa[done : heads[c]], heads[c]
            push(wave, False)
        if per[c]:
            push(sa[ends[c] - per[c] : ends[c]], False)
    for c in used[::-1]:
        done = ends[c]
        while tails[c] < done:
            wave, done = sa[tails[c] : done][::-1], tails[c]
            push(wave, True)
        push(sa[begins[c] : heads[c]][::-1], True)
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same, entry by entry. Empty places hold 0, as does the place of position 0: neither has a suffix before it."""
    count = np.bincount(t, minlength=sigma)
    ends = np.cumsum(count)
    heads, tails = (ends - count).tolist(), ends.tolist()
    # the character of each suffix of the kind that a pass places, -1 for the others and for what comes before position 0
    large = np.where(small, -1, t).tolist()
    smaller = np.where(small, t, -1)
    smaller[-1] = -1
    order, own, within = _grouped(t[lms], sigma)
    filled = np.zeros(len(t), dtype=np.int64)
    per = np.bincount(own, minlength=sigma)
    filled[ends[own] - per[own] + within] = lms[order]
    sa = filled.tolist()
    for at in sa:
        c = large[at - 1]
        if c >= 0:
            place = heads[c]
            sa[place] = at - 1
            heads[c] = place + 1
    smaller = smaller.tolist()
    for at in reversed(sa):
        c = smaller[at - 1]
        if c >= 0:
            place = tails[c] - 1
            sa[place] = at - 1
            tails[c] = place
    return np.array(sa, dtype=np.int64)


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, width: int) -> np.ndarray:
    """Length of the common prefix at positions a and b, up to ``most``, by words of 8 // width characters."""
    out, live, at = np.full(len(a), most, dtype=np.int64), np.arange(len(a)), 0
    while len(live) and at < most:
        x = words[a[live] + at] ^ words[b[live] + at]
        ended = x != 0
        y = x[ended]
        same = np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)).astype(np.int64) // (8 * width)
        out[live[ended]] = np.minimum(most, at + same)
        live = live[~ended]
        at += 8 // width
    return out


def packed(t: np.ndarray, pad: int) -> np.ndarray:
    """At each position, the characters from there as one little-endian word of 8 bytes; zeros past the end."""
    held = np.zeros(len(t) + pad + 8, dtype=t.dtype)
    held[: len(t)] = t
    return np.ndarray(shape=(len(t) + pad,), dtype="<u8", buffer=held, strides=(t.itemsize,))


def suffix_array(t: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Suffix array of t, whose last character must be 0 and occur nowhere else."""
    t = t.astype(np.int64)
    n, sigma = len(t), int(sigma or t.max() + 1)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sa = _induce(t, small, lms, sigma)
    found = sa[is_lms[sa]]
    # substrings up to and with the next LMS character
    end = np.empty(n, dtype=np.int64)
    end[lms] = np.append(lms[1:], n - 1)
    size = end[found] - found + 1
    same = size[1:] == size[:-1]
    if same.any():
        a, b, m = found[1:][same], found[:-1][same], size[1:][same]
        same[same] = _equal(t, a, b, m, sigma)
    name = np.empty(n, dtype=np.int64)
    name[found] = np.concatenate([[0], np.cumsum(~same)])
    names = name[lms]
    highest = int(names.max())
    if highest + 1 == len(lms):
        order = np.argsort(names)
    else:
        order = _order_of_names(names)
    return _induce(t, small, lms[order], sigma)


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, the last one unique and least.

    A name that occurs once settles a comparison. So of a run of such names only the first goes into the string that is
    sorted by recursion, as the end of what comes before it.
    """
    once = np.bincount(names)[names] == 1
    kept = ~once
    kept[1:] |= ~once[:-1]
    kept[-1] = True
    at = np.flatnonzero(kept)
    _, own = np.unique(names[at], return_inverse=True)
    rank = np.zeros(len(names), dtype=np.int64)
    rank[at[suffix_array(own, int(own.max()) + 1)]] = np.arange(len(at))
    return np.lexsort((rank, names))


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, sigma: int) -> np.ndarray:
    """Whether t[a:a+size] and t[b:b+size] are equal, character by character over those still equal."""
    out, live, at = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
    while len(live):
        same = t[a[live] + at] == t[b[live] + at]
        out[live[~same]] = False
        at += 1
        live = live[same & (size[live] > at)]
    return out


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cuts: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in the array, right up to ``most`` minus a piece's length.

    Where the characters before both are equal, the value is one less than its left neighbour's; only the others, and the
    positions in ``cuts``, are compared. t: characters of one or two bytes.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    own = np.ones(n, dtype=bool)
    has = before > 0
    has[0] = False
    at = np.flatnonzero(has)
    own[at] = t[at - 1] != t[before[at] - 1]
    own[cuts] = True
    own &= before >= 0
    own_at = np.flatnonzero(own)
    value = np.zeros(n, dtype=np.int64)
    value[own_at] = common(packed(t, most + 8), own_at, before[own_at], most, t.itemsize)
    last = np.maximum.accumulate(np.where(own, np.arange(n), -1))
    out = np.where(last >= 0, np.maximum(0, value[np.maximum(last, 0)] - (np.arange(n) - last)), 0)
    out[sa[0]] = 0
    return out
