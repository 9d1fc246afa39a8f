"""Removal of every long byte string that occurs more than once, by sharded suffix arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import chunks, fresh, with_columns
from .suffix_array import repeated_starts, repeats_and_firsts

#: bytes of a string that counts as repeated
WIDTH = 400
#: bytes of the anchor that picks a string's shard; longer than most lines that many texts share
ANCHOR = 128
#: the same for whole passages: shorter than any 51 words of the languages at hand
PASSAGE = 256
#: bytes of the anchor of a passage
PASSAGE_ANCHOR = 96
#: string starts looked at in one step
STEP = 1 << 20
#: bytes of one suffix array; an anchor with more different text goes another way
SHARD = 2 << 20
#: bytes of text worked on at once
CHUNK = 4 << 20

PLACE = np.uint64((1 << 21) - 1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number a byte, powers of an odd number and their inverses, modulo 2^64."""
    base = 0x9E3779B97F4A7C15 | 1
    table = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)
    size = STEP + 2 * WIDTH
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, np.uint64(b))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return table, *out


def anchors(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, starts): which starts each anchor of a text owns.

    The anchor of a string of `width` bytes is its `k` bytes with the lowest hash, the leftmost
    of equals. It depends on the string alone, so equal strings have equal anchors; the starts
    of a text fall into consecutive runs with one anchor.
    """
    table, up, down = _powers()
    n, window = len(data) - width + 1, width - k + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n, STEP):
        part = data[at : min(at + STEP, n) + width - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # hash above, place below: the minimum is the leftmost lowest
        packed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(packed) // window)
        grid = np.full(rows * window, np.iinfo(np.uint64).max)
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = len(packed) - window + 1
        place = (np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts]) & PLACE).astype(
            np.int64
        )
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        found.append((h[place[first]].view(np.int64), first + at, np.diff(first, append=starts)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def anchor_rows(texts: DataFrame, width: int, k: int) -> DataFrame:
    """(h, c1, c2, row1, row2, lo, n): the runs of starts of every text with their anchor.

    c1, c2 hash the run's context, all bytes that its strings cover.
    """

    def work(batches):
        for batch in chunks(batches, "data", CHUNK):
            rows: list[int] = []
            parts, digests = [], []
            for i, text in enumerate(batch.column("data").to_pylist()):
                h, lo, n = anchors(np.frombuffer(text, np.uint8), width, k)
                parts.append((h, lo, n))
                digests += [
                    xxhash.xxh3_128_digest(text[a:b])
                    for a, b in zip(lo.tolist(), (lo + n + width - 1).tolist())
                ]
                rows += [i] * len(h)
            h, lo, n = (np.concatenate(c) for c in zip(*parts))
            context = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int32())
            columns = [h, context[:, 0], context[:, 1], lo, n.astype(np.int32)]
            made = [pa.array(np.ascontiguousarray(c)) for c in columns]
            ids = [batch.column(r).take(take) for r in ("row1", "row2")]
            yield pa.RecordBatch.from_arrays(
                [*made[:3], *ids, *made[3:]], names=["h", "c1", "c2", "row1", "row2", "lo", "n"]
            )

    long = texts.where(F.octet_length("data") >= width)
    return long.mapInArrow(
        work, "h long, c1 long, c2 long, row1 long, row2 long, lo long, n int"
    )


#: columns of a context; row1, row2 and lo are those of its first place
CONTEXT = ("h", "c1", "c2", "n", "many", "row1", "row2", "lo", "data")
#: repeated starts s .. e - 1 of a context; `first`: they are the first of their equals
RUNS = "h long, c1 long, c2 long, s long, e long, first boolean"
PLACES = 1 << 32


def _changes(*flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges in which no flag changes."""
    n = len(flags[0])
    new = np.zeros(n, dtype=bool)
    for f in flags:
        new[1:] |= f[1:] != f[:-1]
    at = np.concatenate(([0], np.flatnonzero(new), [n]))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def _sorted_runs(contexts: DataFrame, width: int, shard: int, keep_first: bool) -> DataFrame:
    """(h, c1, c2, s, e, first): repeated starts of the contexts of every anchor, by suffix arrays.

    Contexts come sorted by anchor; whole anchors are gathered up to `shard` bytes and get one
    suffix array.
    """

    def solve(block):
        texts = [row[-1] for row in block]
        if keep_first:
            # rows in their order, then places within a row
            rows = {r: i for i, r in enumerate(sorted({row[5:7] for row in block}))}
            flags = repeats_and_firsts(texts, width, [rows[row[5:7]] * PLACES + row[7] for row in block])
        else:
            flags = [(hit, np.zeros(len(hit), dtype=bool)) for hit in repeated_starts(texts, width)]
        for (h, c1, c2, n, many, *_), (hit, first) in zip(block, flags):
            hit, first = hit[:n] | many, first[:n]
            for s, e in _changes(hit, first & hit):
                if hit[s]:
                    yield h, c1, c2, s, e, bool(first[s])

    # numbering the places takes as much room again as the array
    held = shard // 2 if keep_first else shard

    def blocks(batches):
        block, group, size, last = [], [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in CONTEXT]):
                if group and row[0] != group[0][0]:
                    more = sum(len(r[-1]) for r in group)
                    if block and size + more > held:
                        yield block
                        block, size = [], 0
                    # an anchor with one context has nothing to be compared with
                    block, size, group = block + group, size + more, []
                if row[:3] != last:
                    group.append(row)
                last = row[:3]
        if block or group:
            yield block + group

    def work(batches):
        for block in blocks(batches):
            found = list(solve(block))
            if found:
                columns = [pa.array(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c1", "c2", "s", "e", "first"])

    ordered = contexts.select(*CONTEXT).repartition("h").sortWithinPartitions("h", "c1", "c2")
    return ordered.mapInArrow(work, RUNS)


def _counted_runs(contexts: DataFrame, width: int) -> DataFrame:
    """The same for anchors with too much text for one task: every string by its 128-bit hash."""
    kept = ("h", "c1", "c2", "row1", "row2")

    def work(batches):
        for batch in chunks(batches, "data", 1 << 16):
            for *ids, lo, n, many, data in zip(
                *[batch.column(c).to_pylist() for c in (*kept, "lo", "n", "many", "data")]
            ):
                raw = b"".join(xxhash.xxh3_128_digest(data[i : i + width]) for i in range(n))
                d = np.frombuffer(raw, "<i8").reshape(-1, 2)
                columns = [np.full(n, v, dtype=np.int64) for v in ids]
                columns += [np.arange(n) + lo, np.arange(n), np.full(n, 2 if many else 1)]
                columns += [d[:, 0].copy(), d[:, 1].copy()]
                names = [*kept, "place", "s", "times", "d1", "d2"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    strings = contexts.dropDuplicates(["h", "c1", "c2"]).mapInArrow(
        work, "h long, c1 long, c2 long, row1 long, row2 long, place long, s long, times long, d1 long, d2 long"
    )
    place = F.struct("row1", "row2", "place")
    twice = strings.groupBy("d1", "d2").agg(F.sum("times").alias("times"), F.min(place).alias("least"))
    hit = strings.join(twice.where("times > 1").select("d1", "d2", "least"), ["d1", "d2"])
    return hit.select("h", "c1", "c2", "s", (F.col("s") + 1).alias("e"), (place == F.col("least")).alias("first"))


def repeated_spans(
    texts: DataFrame, width: int = WIDTH, k: int = ANCHOR, shard: int = SHARD, keep_first: bool = False
) -> DataFrame:
    """(row1, row2, spans): per text the byte ranges covered by strings that occur again; with
    `keep_first`, by strings that occur before, in a row with smaller hashes or earlier in the row.

    `texts` has row1, row2 (two hashes that name a row) and `data` (bytes). Every string of
    `width` bytes belongs to the shard of its anchor, so all places where it starts are in one
    shard. Anchors that occur once are dropped by a count that combines map-side. Of the rest,
    equal contexts are merged (a group of copies counts once), their bytes are fetched once and
    sorted in suffix arrays; neighbours in the order with `width` bytes in common are repeats.
    """
    first_place = F.min(F.struct("row1", "row2", "lo"))
    runs = cut_lineage(anchor_rows(texts, width, k))
    seen = runs.groupBy("h").agg(
        F.count("*").alias("places"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)],
    )
    seen = cut_lineage(
        seen.where("places > 1").select(
            "h", F.expr("min_c1 = max_c1 AND min_c2 = max_c2").alias("uniform")
        )
    )
    again = cut_lineage(runs.join(seen, "h"))
    whole = (
        again.where("uniform")
        .groupBy("h", "c1", "c2")
        .agg(
            F.lit(0).cast("long").alias("s"), F.max("n").cast("long").alias("e"),
            F.lit(True).alias("first"), first_place.alias("place"),
        )
    )
    distinct = cut_lineage(
        again.where("NOT uniform")
        .groupBy("h", "c1", "c2")
        .agg(
            (F.count("*") > 1).alias("many"),
            F.first("n").alias("n"),
            first_place.alias("place"),
        )
        .select("h", "c1", "c2", "many", "n", "place.*")
    )
    heavy = cut_lineage(
        distinct.groupBy("h")
        .agg(F.sum(F.col("n") + width - 1).alias("size"))
        .where(F.col("size") > shard)
        .select("h")
    )
    cut = F.expr(f"substring(data, CAST(lo + 1 AS INT), n + {width - 1})")
    contexts = distinct.join(texts, ["row1", "row2"]).select(*CONTEXT[:-1], cut.alias("data"))
    if not keep_first:
        # nothing asks for places: constants take no room in an exchange
        contexts = contexts.withColumns({c: F.lit(0).cast("long") for c in ("row1", "row2", "lo")})
    sorted_ = _sorted_runs(contexts.join(heavy, "h", "left_anti"), width, shard, keep_first)
    if not heavy.isEmpty():
        sorted_ = sorted_.unionByName(_counted_runs(contexts.join(heavy, "h", "left_semi"), width))
    columns = ["h", "c1", "c2", "s", "e", "first"]
    if keep_first:
        # of equal strings the one in the first place of its context stays
        named = distinct.select("h", "c1", "c2", F.struct("row1", "row2", "lo").alias("place"))
        sorted_ = sorted_.join(named, ["h", "c1", "c2"])
        columns.append("place")
    found = cut_lineage(whole.select(columns).unionByName(sorted_.select(columns)))
    places = again.select("h", "c1", "c2", "row1", "row2", "lo").join(found, ["h", "c1", "c2"])
    if keep_first:
        places = places.where(~(F.col("first") & (F.struct("row1", "row2", "lo") == F.col("place"))))
    span = F.struct(
        (F.col("lo") + F.col("s")).alias("start"),
        (F.col("lo") + F.col("e") + (width - 1)).alias("stop"),
    )
    return places.groupBy("row1", "row2").agg(F.collect_set(span).alias("spans"))


def _join_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    k: int = ANCHOR,
    shard: int = SHARD,
    kept_out: str = "kept",
    spans_out: str = "removed",
    as_text: bool = False,
    keep_first: bool = False,
) -> DataFrame:
    """`docs` with the bytes that stay and the ranges that go (start, stop; maximal, in order).

    A text is its UTF-8 bytes, null as empty. A byte goes if a string of `width` bytes that
    covers it starts anywhere else, in another text or the same one; strings are judged on the
    input and don't cross texts. With `keep_first` one occurrence of every string stays: that in the
    row with the least hashes of id and text, the first one in it. Texts shorter than `width` stay whole. Rows stay as they are,
    repeated rows and ids too (rows are told apart by hashes of id and text; equal rows get
    equal answers); other columns pass through. With `as_text` the kept bytes are a string, in
    which a character that was cut in two is left out.
    """
    r1, r2 = fresh(docs, "row1"), fresh(docs, "row2")
    marks = [F.xxhash64(F.lit("id"), id_col), F.xxhash64(text_col)]
    texts = docs.select(marks[0].alias("row1"), marks[1].alias("row2"), _bytes(text_col).alias("data"))
    spans = repeated_spans(texts, width, k, shard, keep_first).toDF(r1, r2, spans_out)
    joined = docs.select("*", marks[0].alias(r1), marks[1].alias(r2)).join(spans, [r1, r2], "left")
    rows = joined.select(*docs.columns, _bytes(text_col).alias(kept_out), spans_out)
    kinds = [f.dataType.simpleString() for f in docs.schema]
    names = [f"x{i}" for i in range(len(kinds))]

    def work(batches):
        for batch in chunks(batches, "data", CHUNK):
            kept, gone = [], []
            for text, marked in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                ranges = _join_spans(marked)
                at, parts = 0, []
                for s, e in ranges:
                    parts.append(text[at:s])
                    at = e
                kept.append(b"".join([*parts, text[at:]]) if ranges else text)
                gone.append([{"start": s, "stop": e} for s, e in ranges])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            if as_text:
                kept = [b.decode("utf-8", "ignore") for b in kept]
            made = {"data": pa.array(kept, pa.string() if as_text else pa.binary()), "spans": pa.array(gone, kind)}
            yield with_columns(batch, ("data", "spans"), made)

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    span_kind = "array<struct<start:bigint,stop:bigint>>"
    return (
        rows.toDF(*names, "data", "spans")
        .mapInArrow(work, f"{schema}, data {'string' if as_text else 'binary'}, spans {span_kind}")
        .toDF(*docs.columns, kept_out, spans_out)
    )


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = PASSAGE
) -> DataFrame:
    """`docs` without passages of `width` bytes or more that occur elsewhere before.

    One occurrence of each stays, so no passage leaves the corpus (see `remove_repeats`). The
    bytes that stay are text again; a character cut in two goes. A text of which nothing is left
    is empty, its row stays. Null stays null.
    """
    kept, gone = fresh(docs, "kept_text"), fresh(docs, "removed_spans")
    found = remove_repeats(
        docs, id_col, text_col, width, PASSAGE_ANCHOR, kept_out=kept, spans_out=gone, as_text=True, keep_first=True
    )
    text = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.col(kept))
    return found.withColumn(text_col, text).select(docs.columns)
