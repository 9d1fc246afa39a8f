"""Splits texts into the pieces that a byte-level BPE merges separately, in whole-array steps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, BREAK = 1, 2, 3, 4, 5
#: fixed values: endings that the split pattern takes off after an apostrophe
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
#: characters of a very long text looked at in one step
SEGMENT = 1 << 20
_CUT = re.compile(r"[A-Za-z0-9](?=[ \n])")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    return out


def segments(text: str) -> Iterator[str]:
    """The text in parts; cut only before white space that follows a letter or digit."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def piece_bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, start and stop of all pieces in order, where each text's pieces begin,
    and the total at the end).

    The same as `regex.findall(PATTERN, text)` for each text: letters, digits or other symbols
    in runs, each with one space before it; the contractions; white space, of which the last
    character before something else stays apart.
    """
    joined = "\n".join(texts)
    if not texts or not joined:
        none = np.zeros(0, dtype=np.int64)
        return b"", none, none, np.zeros(len(texts) + 1, dtype=np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    kind = _classes()[codes]
    kind[begin[1:-1] - 1] = BREAK
    n = len(kind)
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    quote = np.flatnonzero(start[:n] & (codes == 39))
    if len(quote):
        after = np.concatenate((codes, [10, 10]))
        one, two = after[quote + 1], after[quote + 2]
        short = quote[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in LONG_ENDINGS]
        long = quote[np.logical_or.reduce(pairs)]
        start[np.concatenate((short, long)) + 1] = False
        start[short + 2] = True
        start[long + 3] = True
    edge = np.flatnonzero(start)
    low, high = edge[:-1], edge[1:]
    real = kind[low] != BREAK
    low, high = low[real], high[real]
    raw = joined.encode("utf-8", "surrogatepass")
    if len(raw) > n:
        wide = (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        place = np.concatenate(([0], np.cumsum(wide)))
        first, stop = low + place[low], high + place[high]
    else:
        first, stop = low, high
    return raw, first, stop, np.concatenate((np.searchsorted(low, begin[:-1]), [len(low)]))


def split_pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(UTF-8 of all pieces of all texts in order, where each text's pieces begin, and the total)."""
    raw, first, stop, begin = piece_bounds(texts)
    return [raw[s:e] for s, e in zip(first.tolist(), stop.tolist())], begin


@lru_cache(maxsize=1)
def _mixers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number a byte, powers of an odd number and their inverses, modulo 2^64."""
    base = 0xD6E8FEB86659FD93
    table = np.random.default_rng(6).integers(0, 1 << 64, 256, dtype=np.uint64)
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, np.uint64(b))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return table, out[0], out[1]


def ramp(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start .. start + length - 1, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def distinct_pieces(raw: bytes, first: np.ndarray, stop: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(each distinct piece once, the number of every piece's among them).

    Pieces are told apart by hashes; then the bytes of each are compared with those of the piece
    that stands for it, and if any differ, all are told apart by their bytes.
    """
    data = np.frombuffer(raw, np.uint8)
    table, up, down = _mixers(max(1 << 16, 1 << len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(raw)], out=sums[1:])
    hashes = (sums[stop] - sums[first]) * down[first]
    _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = stop - first
    same = (size == size[one][number]).all()
    if same:
        where, there = ramp(first, size), ramp(first[one][number], size)
        same = (data[where] == data[there]).all()
    pieces = [raw[s:e] for s, e in zip(first[one].tolist(), stop[one].tolist())]
    if same:
        return pieces, number
    known: dict[bytes, int] = {}
    every = (raw[s:e] for s, e in zip(first.tolist(), stop.tolist()))
    number = np.array([known.setdefault(p, len(known)) for p in every], dtype=np.int64)
    return list(known), number


class PieceCache:
    """Remembers the encoding of pieces within a worker, up to a bound of bytes; then starts anew."""

    def __init__(self, encode, bound: int = 96 << 20):
        self.encode, self.bound, self.known, self.held = encode, bound, {}, 0

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        missing = [p for p in pieces if p not in known]
        if missing:
            found = self.encode(missing)
            # an entry takes about 150 bytes beside its contents
            more = sum(map(len, missing)) + sum(map(len, found)) + 150 * len(missing)
            if self.held + more > self.bound:
                kept = {p: known[p] for p in pieces if p in known}
                known.clear()
                known.update(kept)
                self.held = sum(len(p) + len(i) + 150 for p, i in known.items())
            self.held += more
            known.update(zip(missing, found))
        return [known[p] for p in pieces]

    def ids(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """(little-endian 32-bit ids of all texts, where each text's ids begin, and the total)."""
        parts = [(i, part) for i, t in enumerate(texts) for part in segments(t)]
        raw, first, stop, begin = piece_bounds([p for _, p in parts])
        pieces, number = distinct_pieces(raw, first, stop) if len(first) else ([], first)
        encoded = self._encoded(pieces)
        length = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        own = np.frombuffer(b"".join(encoded), "<u4")
        at = np.cumsum(length) - length
        each = length[number]
        out = own[ramp(at[number], each)]
        size = np.concatenate(([0], np.cumsum(each)))
        counts = np.bincount(
            np.array([i for i, _ in parts], dtype=np.int64),
            weights=np.diff(size[begin]),
            minlength=len(texts),
        ).astype(np.int64)
        return out.tobytes(), np.concatenate(([0], np.cumsum(counts)))
