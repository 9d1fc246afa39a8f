"""Byte-level BPE on padded matrices, and back."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, with_columns
from .pretokens import PieceCache

NONE = np.int32(np.iinfo(np.int32).max)
#: widths of the matrices; a longer piece is merged alone
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256)
ROWS = 1 << 15
CHUNK = 2 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """A rank file and the hash table of its pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.token = {i: t for t, i in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (self.rank[t[:i]], self.rank[t[i:]], r)
            for t, r in self.rank.items()
            for i in range(1, len(t))
            if t[:i] in self.rank and t[i:] in self.rank
        ]
        left, right, made = (np.array(c, dtype=np.int64) for c in zip(*pairs))
        self.shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        size = 1 << int(np.uint64(64) - self.shift)
        self.mask = size - 1
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        key = left << 32 | right
        slot = self._slot(key)
        left_over = np.arange(len(key))
        while len(left_over):
            # of the keys that want an empty slot one gets it, the others move on
            free = left_over[self.keys[slot[left_over]] == -1]
            self.keys[slot[free]] = key[free]
            won = self.keys[slot[left_over]] == key[left_over]
            self.values[slot[left_over[won]]] = made[left_over[won]]
            left_over = left_over[~won]
            slot[left_over] = (slot[left_over] + 1) & self.mask
        size = max(self.token) + 1
        lengths = np.array([len(self.token.get(i, b"")) for i in range(size)])
        self.token_start = np.concatenate(([0], np.cumsum(lengths)))
        self.token_bytes = np.frombuffer(
            b"".join(self.token.get(i, b"") for i in range(size)), dtype=np.uint8
        )

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, which is also the id of what it merges to; else NONE."""
        key = (left.astype(np.int64) << 32 | right).ravel()
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        rest = np.flatnonzero((there != key) & (there != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            found = there == key[rest]
            out[rest[found]] = self.values[slot[rest[found]]]
            rest = rest[~found & (there != -1)]
        return out.reshape(left.shape)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.searchsorted(WIDTHS, sizes)
        for i, (b, n) in enumerate(zip(bucket.tolist(), sizes.tolist())):
            if n == 1:
                out[i] = self.single[pieces[i][0]].astype("<i4").tobytes()
            elif b == len(WIDTHS):
                out[i] = np.array(self._merge_alone(pieces[i]), dtype="<i4").tobytes()
            else:
                buckets.setdefault(b, []).append(i)
        for b, members in buckets.items():
            step = max(1, ROWS * 8 // WIDTHS[b])
            for at in range(0, len(members), step):
                self._merge_rows(pieces, members[at : at + step], WIDTHS[b], out)
        return out

    def _merge_rows(self, pieces, members: list[int], width: int, out: list[bytes]) -> None:
        """Every round each row merges its leftmost pair of least rank; finished rows leave."""
        raw = b"".join(pieces[i].ljust(width, b"\0") for i in members)
        size = np.fromiter((len(pieces[i]) for i in members), np.int64, len(members))
        tokens = self.single[np.frombuffer(raw, np.uint8).reshape(-1, width)]
        tokens[np.arange(width) >= size[:, None]] = -1
        ranks = self.lookup(tokens[:, :-1], tokens[:, 1:])
        rows = np.array(members)
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == NONE
            if done.any():
                for i, n, ids in zip(rows[done].tolist(), size[done].tolist(), tokens[done]):
                    out[i] = ids[:n].astype("<i4").tobytes()
                go = ~done
                rows, size, tokens, ranks = rows[go], size[go], tokens[go], ranks[go]
                at, best, line = at[go], best[go], np.arange(int(go.sum()))
                if not len(rows):
                    return
            # the merged pair becomes one entry, what follows moves up
            tokens[line, at] = best
            keep = np.ones(tokens.shape, dtype=bool)
            keep[line, at + 1] = False
            tokens = tokens[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            size -= 1
            if not ranks.shape[1]:
                for i, ids in zip(rows.tolist(), tokens):
                    out[i] = ids[:1].astype("<i4").tobytes()
                return
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.lookup(
                tokens[before, at[before] - 1], tokens[before, at[before]]
            )
            after = np.flatnonzero(at < ranks.shape[1])
            ranks[after, at[after]] = self.lookup(
                tokens[after, at[after]], tokens[after, at[after] + 1]
            )

    def _merge_alone(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap of (rank, place)."""
        ids = [int(self.single[b]) for b in piece]
        parts = [bytes([b]) for b in piece]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def rank(i: int) -> int | None:
            j = right[i]
            return self.rank.get(parts[i] + parts[j]) if j < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = right[i]
            parts[i], ids[i], alive[j] = parts[i] + parts[j], r, False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [v for v, a in zip(ids, alive) if a]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all tokens on end, where each token begins and the total)."""
        start = self.token_start[ids]
        size = self.token_start[ids + 1] - start
        begin = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(start - begin[:-1], size) + np.arange(begin[-1])
        return self.token_bytes[where], begin


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    return PieceCache(ranks(path).encode)


def _through(df: DataFrame, column: str, work, out: dict[str, str]) -> DataFrame:
    """All columns of `df`, whatever their names, and those that `work` makes of `column`."""
    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema)]
    kinds += [f"{n} {k}" for n, k in zip(("made", "decoded"), out.values())]
    rows = df.select("*", F.col(column)).toDF(*names, "given")
    return rows.mapInArrow(work, ", ".join(kinds)).toDF(*df.columns, *out)


def _decoded(table: Ranks, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of every text, of whose ids `begin` tells the first, and the total."""
    data, token = table.decode(ids)
    offsets = pa.py_buffer(token[begin].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(data)])


def encode(
    docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """`docs` with the ids of every whole text as an array column; null and empty give none.

    Each piece of the split pattern is merged by the ranks in `path`; no special tokens.
    Distinct pieces are merged once a worker. `decoded` names one more column, of the bytes that
    the ids stand for, made in the same pass.
    """

    def work(batches):
        cache, table = _cache(path), ranks(path)
        for batch in chunks(batches, "given", CHUNK):
            raw, begin = cache.ids([t or "" for t in batch.column("given").to_pylist()])
            ids = np.frombuffer(raw, "<i4")
            made = {"made": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))}
            if decoded:
                made["decoded"] = _decoded(table, ids, begin)
            yield with_columns(batch, ("given",), made)

    more = {decoded: "binary"} if decoded else {}
    return _through(docs, text_col, work, {out: "array<int>", **more})


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes that the ids stand for; a null or empty array gives none."""

    def work(batches):
        table = ranks(path)
        for batch in batches:
            given = batch.column("given").fill_null([]) if batch.num_rows else None
            if given is None:
                continue
            offsets = given.offsets.to_numpy()
            made = _decoded(table, given.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
            yield with_columns(batch, ("given",), {"made": made})

    return _through(df, ids_col, work, {out: "binary"})
