"""Comparing the members of buckets of any size, a bounded number in each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: index pairs made in one step
PAIRS = 1 << 18


def deal(
    members: DataFrame, payload: DataFrame, keys: list[str], node: str, block: int
) -> DataFrame:
    """The members of all buckets of two or more, so dealt out that any two of a bucket meet.

    `members` says which `node` is in which bucket (`keys`); `payload` has one row a node, which
    is joined to the members that have company only. A bucket of up to `block` members is one
    group. A larger one is cut into blocks by a hash of `node`, and every two blocks (`lo`, `hi`)
    are a group; `own` says which a row is of. No group holds more than about twice `block`
    rows. Rows come sorted by bucket and group.
    """
    sizes = members.groupBy(*keys).count().where("count > 1")
    sizes = cut_lineage(sizes.select(*keys, F.ceil(F.col("count") / block).cast("int").alias("parts")))
    dealt = members.select(*keys, node).join(sizes, keys)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "*", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi")
    ).drop("with", "parts")
    group = [*keys, "lo", "hi"]
    whole = dealt.join(payload, node)
    return whole.repartition(*group).sortWithinPartitions(*group, "own", node)


def _listed(column: pa.Array) -> list:
    """The values; of numbers by the way that is many times faster."""
    if column.null_count == 0 and pa.types.is_integer(column.type):
        return column.to_numpy().tolist()
    return column.to_pylist()


def _changes(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Rows whose keys may differ from those of the row before; the first always."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for name in keys:
        column = batch.column(name)
        if column.null_count:
            return list(range(batch.num_rows))
        values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new).tolist()


def gathered(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int
) -> Iterator[tuple[dict[str, list], list[tuple[int, int, int]]]]:
    """(columns, groups) of whole groups, at least `rows` rows at a time.

    A group is (start, middle, stop): members from two blocks are parted at `middle`, which is
    `stop` for a single block. Groups of one member, or of one block of two, are left out.
    """
    held: dict[str, list] = {}
    last, starts = None, []

    def groups():
        lo, hi, own = held["lo"], held["hi"], held["own"]
        for s, e in zip(starts, [*starts[1:], len(lo)]):
            if e - s < 2:
                continue
            if lo[s] == hi[s]:
                yield s, e, e
            else:
                middle = s + int(np.searchsorted(own[s:e], hi[s]))
                if s < middle < e:
                    yield s, middle, e

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: _listed(batch.column(n)) for n in batch.schema.names}
        held = held or {n: [] for n in columns}
        keyed = [columns[n] for n in [*keys, "lo", "hi"]]
        at = 0
        for i in _changes(batch, [*keys, "lo", "hi"]):
            if (key := tuple(c[i] for c in keyed)) == last:
                continue
            have = len(held["lo"]) + i - at
            if starts and have >= rows:
                for n in held:
                    held[n] += columns[n][at:i]
                at, have = i, 0
                yield held, list(groups())
                held, starts = {n: [] for n in columns}, []
            last = key
            starts.append(have)
        for n in held:
            held[n] += columns[n][at:]
    if starts:
        yield held, list(groups())


def gathered_pairs(
    groups: list[tuple[int, int, int]],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs of many groups, first < second and across its blocks if a group has two; in
    steps of bounded size."""
    if not groups:
        return
    start, middle, stop = np.array(groups).T
    size = middle - start
    rows = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    low = np.where(np.repeat(middle < stop, size), np.repeat(middle, size), rows + 1)
    many = np.repeat(stop, size) - low
    end = np.cumsum(many)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:upto]
        a = np.repeat(rows[at:upto], n)
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:upto], n)
        at = upto


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from every index over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root
