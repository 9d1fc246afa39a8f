"""Suffix arrays by induced sorting, in whole-array steps, and their common prefixes."""

from __future__ import annotations

import numpy as np


#: see `suffix_array`
RICH = 64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order.

    `text` holds whole numbers; its last entry must be smaller than any other. Suffixes are
    classified as smaller or larger than their right neighbour; the substrings between
    leftmost-smaller positions are sorted by one round of induction and named; if names repeat,
    the string of names is sorted by recursion; a second round of induction gives the rest. A
    string of names with a rich alphabet (a name for every `RICH` places) is settled by doubling
    instead: its buckets are too short to be read in whole-array steps.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    used, s = np.unique(text, return_inverse=True) if text.dtype.itemsize > 2 else _dense(text)
    sigma = len(used)
    smaller = _smaller(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    guess = lms[np.argsort(s[lms], kind="stable")]
    rough = _induce(s, sigma, smaller, guess)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    names = _names(s, lms, order)
    if names[-1] + 1 < len(lms):
        where = np.zeros(n, dtype=np.int32)
        where[order] = names
        rich = RICH * int(names[-1]) > len(lms)
        order = lms[(_settle if rich else suffix_array)(where[lms])]
    return _induce(s, sigma, smaller, order)


def _dense(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.flatnonzero(np.bincount(text))
    place = np.zeros(int(used[-1]) + 1, dtype=np.int32)
    place[used] = np.arange(len(used))
    return used, place[text]


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; the last one is."""
    change = np.flatnonzero(s[1:] != s[:-1])
    rising = s[change] < s[change + 1]
    return np.concatenate((np.repeat(rising, np.diff(change, prepend=-1)), [True]))


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the sorted substrings from one leftmost-smaller position through the next."""
    length = np.zeros(len(s), dtype=np.int32)
    length[lms] = np.diff(lms, append=lms[-1]) + 1
    a, b = order[:-1], order[1:]
    left = np.flatnonzero(length[a] == length[b])
    equal = np.zeros(len(a), dtype=bool)
    at = 0
    while len(left):
        left = left[s[a[left] + at] == s[b[left] + at]]
        at += 1
        over = length[a[left]] == at
        equal[left[over]] = True
        left = left[~over]
    return np.concatenate(([0], np.cumsum(~equal)))


def _settle(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names; its last one occurs once.

    Ranks double in reach each round; only suffixes that share a rank are sorted again.
    """
    order = np.argsort(names, kind="stable")
    first = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank = np.zeros(len(names), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))
    open_ = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
    reach = 1
    while len(open_):
        items = order[open_]
        low, high = rank[items], rank[items + reach]
        by = np.argsort(low * len(names) + high)
        items, low, high = items[by], low[by], high[by]
        order[open_] = items
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        rank[items] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.concatenate((new[1:], [True])))]
        reach *= 2
    return order


def _induce(s: np.ndarray, sigma: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones (`seeds`) in order."""
    larger = _sweep(s, sigma, ~smaller, seeds)
    last = np.arange(len(s)) == len(s) - 1
    down = _sweep(sigma - 1 - s, sigma, smaller & ~last, larger[::-1])
    both = np.concatenate((larger, np.array([len(s) - 1], dtype=np.int32), down[::-1]))
    letter = s[both].astype(np.uint16) if sigma < 1 << 16 else s[both]
    return both[np.argsort(letter, kind="stable")]


def _sweep(s: np.ndarray, sigma: int, movable: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The `movable` suffixes in order, each put in place by the suffix to its right.

    Buckets (first letters) are read upwards. What a bucket induces goes to higher buckets, or,
    within a run of one letter, to the end of the same one. Neighbouring buckets that induce
    nothing into each other are read in one step, runs in waves.
    """
    size = np.bincount(s[movable], minlength=sigma)
    start = np.concatenate(([0], np.cumsum(size)))
    head = start[:-1].copy()
    out = np.zeros(start[-1], dtype=np.int32)
    seeded = np.concatenate(([0], np.cumsum(np.bincount(s[seeds], minlength=sigma))))
    # where a suffix goes when its right neighbour is read: its letter, or -1; or the same run
    edge = s[:-1] != s[1:]
    goes = np.full(len(s), -1, dtype=np.int32)
    goes[:-1][movable[:-1] & edge] = s[:-1][movable[:-1] & edge]
    runs = np.zeros(len(s), dtype=bool)
    runs[:-1] = movable[:-1] & ~edge
    # the lowest bucket that a bucket induces into
    reach = np.full(sigma, sigma, dtype=np.int32)
    move = np.flatnonzero(goes >= 0)
    np.minimum.at(reach, s[move + 1], goes[move])
    low, width = 0, 64
    while low < sigma:
        bound = np.minimum.accumulate(reach[low : low + width])
        apart = bound > np.arange(low, low + len(bound))
        high = low + (len(bound) if apart.all() else int(apart.argmin()))
        width = min(max(64, 2 * (high - low)), 1 << 16)
        # runs: waves of equal letters
        fill = head[low:high] - start[low:high]
        total = int(fill.sum())
        wave = out[_ramp(start[low:high], fill, total)]
        while len(wave):
            # place -1 is the last entry, which never moves
            wave = wave - 1
            wave = wave[runs[wave]]
            if len(wave):
                _append(out, head, wave, s[wave])
        own, extra = out[start[low] : start[high]], seeds[seeded[low] : seeded[high]]
        if high == low + 1 or not len(extra) or not len(own):
            read = np.concatenate((own, extra))
        else:
            read = np.zeros(len(own) + len(extra), dtype=np.int32)
            read[np.arange(len(own)) + seeded[s[own]] - seeded[low]] = own
            read[np.arange(len(extra)) + start[s[extra] + 1] - start[low]] = extra
        read = read - 1
        letter = goes[read]
        there = letter >= 0
        read, letter = read[there], letter[there]
        if len(read):
            order = np.argsort(letter.astype(np.uint16) if sigma < 1 << 16 else letter, kind="stable")
            _append(out, head, read[order], letter[order])
        low = high
    return out


def _ramp(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def _append(out: np.ndarray, head: np.ndarray, items: np.ndarray, letters: np.ndarray) -> None:
    """Put items, grouped by letter, at the heads of their buckets."""
    first = np.concatenate(([0], np.flatnonzero(letters[1:] != letters[:-1]) + 1))
    run = np.diff(first, append=len(letters))
    which = letters[first]
    if len(items) > 32 * len(which):
        at = head[which].tolist()
        for h, f, n in zip(at, first.tolist(), run.tolist()):
            out[h : h + n] = items[f : f + n]
        head[which] += run
        return
    out[np.repeat(head[which] - first, run) + np.arange(len(items))] = items
    head[which] += run


def permuted_prefixes(text: np.ndarray, order: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the suffix before it in `order`, that suffix), by text position.

    A prefix ends before the symbol `stop` and anything below it. Where the two suffixes follow
    the same letter, their prefix is one less than that of the suffixes one place to the left;
    only the others are compared letter by letter, all at once.
    """
    n = len(text)
    before = np.zeros(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    same = np.zeros(n, dtype=bool)
    later = np.flatnonzero((before[1:] > 0) & (before[:-1] >= 0)) + 1
    same[later] = text[later - 1] == text[before[later] - 1]
    # a pair of separators to the left starts anew
    same[later] &= text[later - 1] > stop
    heads = np.flatnonzero(~same)
    prefix = np.zeros(len(heads), dtype=np.int64)
    left = np.flatnonzero(before[heads] >= 0)
    a, b = heads[left], before[heads[left]]
    at = 0
    while len(left):
        go = (text[a] == text[b]) & (text[a] > stop)
        prefix[left[~go]] = at
        left, a, b = left[go], a[go] + 1, b[go] + 1
        at += 1
    owner = np.cumsum(~same) - 1
    return np.maximum(prefix[owner] + heads[owner] - np.arange(n), 0), before


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts as one string of numbers, each closed by a separator; their sizes; their ends)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(sizes.sum()) + len(texts)
    text = np.ones(total + 1, dtype=np.uint16)
    text[-1] = 0
    ends = np.cumsum(sizes + 1)
    inside = np.ones(total + 1, dtype=bool)
    inside[ends - 1] = inside[-1] = False
    text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 2
    return text, sizes, ends


def repeated_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, whether each start's `width` bytes also start elsewhere in these texts."""
    text, sizes, ends = _joined(texts)
    prefix, before = permuted_prefixes(text, suffix_array(text), 1)
    long = np.flatnonzero(prefix >= width)
    hit = np.zeros(len(text), dtype=bool)
    hit[long] = True
    hit[before[long]] = True
    return [hit[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def repeats_and_firsts(
    texts: list[bytes], width: int, places: list[int]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (whether each start repeats, whether it is the first of its equals).

    `places` number the starts of each text onwards; the least number is first.
    """
    text, sizes, ends = _joined(texts)
    order = suffix_array(text)
    prefix, before = permuted_prefixes(text, order, 1)
    alike = prefix >= width
    hit = alike.copy()
    hit[before[np.flatnonzero(alike)]] = True
    number = np.full(len(text), np.iinfo(np.int64).max)
    for e, n, p in zip(ends.tolist(), sizes.tolist(), places):
        number[e - n - 1 : e - 1] = np.arange(p, p + n)
    # equal starts are neighbours in the order
    new = np.flatnonzero(~alike[order])
    least = np.repeat(np.minimum.reduceat(number[order], new), np.diff(new, append=len(order)))
    first = np.zeros(len(text), dtype=bool)
    first[order] = number[order] == least
    cut = lambda flags, e, n: flags[e - n - 1 : e - 1]
    return [(cut(hit, e, n), cut(first, e, n)) for e, n in zip(ends.tolist(), sizes.tolist())]
