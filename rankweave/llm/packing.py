"""Token sequences of a fixed length, filled best-fit decreasing."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import chunks
from .pretokens import PieceCache

CAPACITY = 2048
END = 0
#: bytes of text worked on at once
CHUNK = 2 << 20
#: pieces packed in one task; every task leaves at most about one sequence half empty
PER_TASK = 1 << 15


class Ids:
    """Ids of texts as the tokenizers library gives them without special tokens of its own.

    Added tokens that a text spells out have their ids, so texts are split there first; the rest
    is split into pieces, each distinct one encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        added = self.whole.get_added_tokens_decoder()
        self.marks = {t.content: i for i, t in added.items()}
        #: tokens that take part of what surrounds them; texts with them are encoded whole
        self.greedy = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]
        longest = sorted(self.marks, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

        def encode(pieces: list[bytes]) -> list[bytes]:
            found = plain.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
            return [array("I", x.ids).tobytes() for x in found]

        self.cache = PieceCache(encode)

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.marks)]
        parts = {i: [texts[i]] if any(g in texts[i] for g in self.greedy) else self.split.split(texts[i]) for i in marked}
        flat, owner = list(texts), {}
        for i, own in parts.items():
            flat[i] = ""
            if len(own) > 1:
                owner[i] = len(flat)
                # what lies between the tokens
                flat.extend(own[::2])
        raw, begin = self.cache.ids(flat)
        at = (4 * begin).tolist()
        out = [raw[at[i] : at[i + 1]] for i in range(len(texts))]
        for i, own in parts.items():
            if len(own) == 1:
                out[i] = array("I", self.whole.encode(own[0], add_special_tokens=False).ids).tobytes()
                continue
            made = []
            for n, mark in enumerate([*own[1::2], None]):
                f = owner[i] + n
                made.append(raw[at[f] : at[f + 1]])
                if mark is not None:
                    made.append(array("I", [self.marks[mark]]).tobytes())
            out[i] = b"".join(made)
        return out


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]): every document's ids in pieces that fit.

    A document is the ids of its whole text (null: none) and one `end` id, so none is empty.
    `tokenizer` is the path of a byte-level BPE file of the tokenizers library; texts are split
    at the tokens added to it and where its own pattern splits them, and each distinct part is
    encoded once a worker. Longer
    documents are cut into pieces of `capacity`; the first takes the odd rest. Repeated rows
    and null ids stay as they are; other columns are not looked at.
    """

    def work(batches):
        ids_of, last = _ids(tokenizer).of, np.array([end], dtype="<u4").tobytes()
        for batch in chunks(batches, "text", CHUNK):
            rows, made = [], []
            for i, ids in enumerate(ids_of([t or "" for t in batch.column("text").to_pylist()])):
                ids = ids + last
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = capacity if at or n <= capacity else n % capacity or capacity
                    size = min(size, n - at)
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append(i)
                    made.append((piece, at, size, zlib.crc32(part), part))
                    at, piece = at + size, piece + 1
            piece, start, length, crc, parts = zip(*made)
            columns = [
                batch.column("doc").take(pa.array(rows, pa.int32())),
                pa.array(piece, pa.int32()),
                *[pa.array(c, pa.int64()) for c in (start, length, crc)],
            ]
            if with_ids:
                columns.append(
                    pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32()))
                )
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(work, schema + ", ids array<int>" * with_ids)


class OpenBins:
    """Open bins by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        node = remaining + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity of at least `needed`, and that capacity."""
        count, node = self.count, needed + self.size
        if not count[node]:
            # up to the first subtree to the right that holds a bin, then down its left edge
            while True:
                if node & (node + 1) == 0:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        remaining = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return self.bins[remaining].pop(), remaining


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, longest first, each into the tightest bin that holds it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, used = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = open_.take(size)
        if found is None:
            found, used = (used, capacity), used + 1
        number, remaining = found
        bins[i], offsets[i] = number, capacity - remaining
        if remaining > size:
            open_.put(remaining - size, number)
    return bins, offsets


def pack(
    pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, per_task: int = PER_TASK
) -> DataFrame:
    """`pieces` with sequence_id and offset: rows share sequences of `capacity`, without gaps.

    Rows are dealt evenly over as many tasks as keep `per_task` rows each, whatever their keys;
    every task packs its rows best-fit decreasing and numbers its own sequences. Lengths must
    be 1 to `capacity`. An empty table gives no rows.
    """
    pieces = cut_lineage(pieces)
    tasks = -(-pieces.count() // per_task) or 1
    at = pieces.columns.index(length_col)

    def work(batches):
        batches = list(batches)
        if not batches:
            return
        whole = pa.Table.from_batches(batches).combine_chunks()
        bins, offsets = best_fit(whole.column(at).to_numpy(), capacity)
        first = TaskContext.get().partitionId() << 32
        whole = whole.append_column("sequence_id", pa.array(bins + first))
        yield from whole.append_column("offset", pa.array(offsets)).to_batches(1 << 16)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(tasks).mapInArrow(work, f"{schema}, sequence_id long, offset long")
