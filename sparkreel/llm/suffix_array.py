"""Suffix arrays by induced sorting.

classify -> sort the substrings between leftmost-smaller (LMS) positions by one
round of induction and name them -> order the LMS suffixes by recursion on the
string of names -> induce the whole array from them. Nothing is sorted by comparison.

The text has 256 buckets: induction walks them in order and moves a whole bucket at a time in
array passes; places inside come from a stable order of bytes, which numpy counts out (radix).
A string of names has many buckets of few entries: there the same induction goes entry by entry.
Each level has at most half of the entries of the one above (about a seventh of the bytes, in
prose). Public algorithm: Nong, Zhang, Chan, "Linear Suffix Array Construction by Almost Pure
Induced-Sorting", 2009; permuted common prefixes after Karkkainen, Manzini, Puglisi, "Permuted
Longest-Common-Prefix Array", 2009.
"""

from __future__ import annotations

from array import array

import numpy as np

PAD = 16


def padded(t: np.ndarray) -> np.ndarray:
    return np.concatenate([t, np.zeros(PAD, np.uint8)])


def word_view(p: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of a padded text, as one number."""
    return np.ndarray((len(p) - 8,), np.dtype("<u8"), p.data, strides=(1,))


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end of the text is smallest)."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.append(change, n - 1)
    run = np.diff(ends, prepend=-1)
    small = np.zeros(len(ends), bool)
    small[:-1] = t[change] < t[change + 1]
    return np.repeat(small, run)


def _induce(t, small, lms, heads, tails):
    """Suffixes in order, given the LMS suffixes in order."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    chars = np.flatnonzero(tails > heads)
    at = tails.copy()
    group = t[lms]
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=256)
    seeds = {}
    lo = 0
    for c in chars.tolist():
        if counts[c]:
            seeds[c] = lms[order[lo : lo + counts[c]]]
            lo += counts[c]
    rank = np.arange(n if n < 1 << 20 else 1 << 20)

    def place(pos, ch, step, own):
        """Puts pos (in scan order) to the next free places of their buckets; how many went to bucket own."""
        o = np.argsort(ch, kind="stable")
        ch = ch[o]
        cnt = np.bincount(ch, minlength=256)
        first = np.cumsum(cnt) - cnt
        r = (rank[: len(ch)] if len(ch) <= len(rank) else np.arange(len(ch))) - first[ch]
        sa[at[ch] + r if step > 0 else at[ch] - 1 - r] = pos[o]
        at[:] = at + step * cnt
        return cnt[own]

    def feed(block, keep_small, own, step):
        prev = block[block > 0] - 1
        prev = prev[small[prev] == keep_small]
        if len(prev):
            return place(prev, t[prev], step, own)
        return 0

    at[:] = heads
    if not small[n - 1]:
        place(np.array([n - 1], np.int32), t[n - 1 :], 1, 0)
    for c in chars.tolist():
        done = heads[c]
        while done < at[c]:
            upto = at[c]
            feed(sa[done:upto], False, c, 1)
            done = upto
        if c in seeds:
            feed(seeds[c], False, c, 1)
    large_end = at.copy()
    at[:] = tails
    for c in chars[::-1].tolist():
        done = tails[c]
        while done > at[c]:
            upto = at[c]
            feed(sa[upto:done][::-1], True, c, -1)
            done = upto
        feed(sa[heads[c] : large_end[c]][::-1], True, c, -1)
    return sa


def _same(words, a, b, length):
    """Whether the substrings of these lengths at a and b are equal."""
    out = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        left = length[live] - k
        x = words[a[live] + k] ^ words[b[live] + k]
        part = left < 8
        x[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        bad = x != 0
        out[live[bad]] = False
        live = live[~bad & (left > 8)]
        k += 8
    return out


def _induce_names(ordered: np.ndarray, name: np.ndarray, large_before: array, small_before: array, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order, given the LMS suffixes in order.

    large_before[p]: the name before p if the suffix there is large, else -1, and so small_before;
    both have an entry for the end of the text, which is the smallest suffix, and one of -1, which
    is what an empty place finds.
    """
    n = len(name)
    # LMS suffixes stand at the ends of their buckets
    own = name[ordered]
    by = np.argsort(own.astype(np.uint16) if tails.size <= 1 << 16 else own, kind="stable")  # counted out, by digits if there are many
    last = np.cumsum(np.bincount(own, minlength=tails.size))
    place = np.full(n, -1, np.int32)
    place[tails[own[by]] - last[own[by]] + np.arange(len(by))] = ordered[by]
    sa, at = array("i", place.tobytes()), array("i", heads.astype(np.int32).tobytes())
    c = large_before[n]
    if c >= 0:
        sa[at[c]] = n - 1
        at[c] += 1
    for p in sa:  # places ahead are filled on the way
        c = large_before[p]
        if c >= 0:
            k = at[c]
            sa[k] = p - 1
            at[c] = k + 1
    at = array("i", tails.astype(np.int32).tobytes())
    for p in reversed(sa):
        c = small_before[p]
        if c >= 0:
            at[c] = k = at[c] - 1
            sa[k] = p - 1
    return np.frombuffer(sa, np.int32).copy()


def rank_names(names: np.ndarray) -> np.ndarray:
    """Positions of a string of names (from 0) in suffix order, by induced sorting and recursion."""
    n = len(names)
    if n < 2:
        return np.arange(n)
    small = suffix_types(names)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms)
    tails = np.cumsum(np.bincount(names))
    heads = np.append(0, tails[:-1])
    before = np.append(-1, names)
    kinds = (np.append(False, ~small), np.append(False, small))  # of the suffix before each position; the end of the text has one, too
    large_before, small_before = (array("i", np.append(np.where(k, before, -1), -1).astype(np.int32).tobytes()) for k in kinds)
    induced = lambda order: _induce_names(order, names, large_before, small_before, heads, tails)
    if len(lms) > 1:
        sa = induced(lms)
        ordered = sa[is_lms[sa]]
        length = np.zeros(n, np.int64)
        length[lms] = np.diff(np.append(lms, n - 1)) + 1
        a, b = ordered[:-1], ordered[1:]
        # the last substring ends with the text, which no other does
        same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        live, k = np.flatnonzero(same), 0
        while len(live):
            differ = names[a[live] + k] != names[b[live] + k]
            same[live[differ]] = False
            live, k = live[~differ & (length[a[live]] > k + 1)], k + 1
        if same.any():
            name = np.empty(n, np.int64)
            name[ordered] = np.append(0, np.cumsum(~same))
            ordered = lms[rank_names(name[lms])]
        lms = ordered
    return induced(lms)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte text in ascending order."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = suffix_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    tails = np.cumsum(np.bincount(t, minlength=256))
    heads = np.append(0, tails[:-1])
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sa = _induce(t, small, lms, heads, tails)
        ordered = sa[is_lms[sa]]
        length = np.empty(n, np.int32)
        length[lms] = np.diff(np.append(lms, n - 1)) + 1
        words = word_view(padded(t))
        a, b = ordered[:-1], ordered[1:]
        equal = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        try_ = np.flatnonzero(equal)
        equal[try_] = _same(words, a[try_], b[try_], length[a[try_]])
        name = np.empty(n, np.int32)
        name[ordered] = np.append(0, np.cumsum(~equal))
        if equal.any():
            lms = lms[rank_names(name[lms])]
        else:
            lms = ordered
    return _induce(t, small, lms, heads, tails)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix in order, the length it shares with the one before (0 for the first).

    Only positions whose preceding byte differs from that of their neighbour are
    compared; any other is one less than the position before it in the text.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int32)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    own = np.ones(n, bool)
    own[1:] = (phi[1:] <= 0) | (t[:-1] != t[np.maximum(phi[1:], 1) - 1])
    at = np.flatnonzero(own)
    got = np.zeros(len(at), np.int64)
    words = word_view(padded(t))
    live = np.flatnonzero(phi[at] >= 0)
    k = 0
    while len(live):
        i, j = at[live] + k, phi[at[live]] + k
        room = n - np.maximum(i, j)
        i, j = np.minimum(i, n), np.minimum(j, n)
        x = words[i] ^ words[j]
        low = x & (~x + np.uint64(1))
        zeros = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        step = np.minimum(zeros, np.maximum(room, 0))
        got[live] += step
        live = live[step == 8]
        k += 8
    base = np.zeros(n, np.int64)
    base[at] = got + at
    plcp = np.maximum.accumulate(np.where(own, pos, 0))
    plcp = base[plcp] - pos
    return np.maximum(plcp[sa], 0).astype(np.int32)
