"""Near-duplicate vectors by binary codes of random rotations with correction factors."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .buckets import deal, gathered, gathered_pairs, local_roots
from .components import connected_components

THRESHOLD = 0.93
#: share of pairs exactly at the threshold that meet in some table; closer pairs meet more surely
RECALL = 0.997
#: standard deviations of the estimate; a pair is passed over only if both its estimates say so
SURE = 4.0
#: vectors of one bucket compared in one task; larger buckets are cut into pairs of blocks
BLOCK = 2048
#: larger groups are estimated as matrices, smaller ones pair by pair
SMALL = 48


@lru_cache(maxsize=64)
def rotation(dimension: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    noise = np.random.default_rng((dimension, number)).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(noise)
    return q * np.sign(np.diag(r))


def plan_tables(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a code, tables) for so many vectors.

    A rotated sign differs with the angle over pi. Bits grow with the logarithm of the vectors,
    so that buckets keep their size (most hold one vector, which goes no further), and the
    tables follow from the recall.
    """
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(26, max(8, round(math.log2(max(vectors, 2))) - 2))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def _unit(rows: np.ndarray) -> np.ndarray:
    # by the largest component first: squares of very large or small ones leave a double's range
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A code of `bits` signs for every vector and table."""
    n, d = unit.shape
    turns = -(-bits * tables // d)
    signs = np.concatenate([unit @ rotation(d, t).T > 0 for t in range(turns)], axis=1)
    signs = signs[:, : bits * tables].reshape(n, tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


class Sketch:
    """Unit vectors with their binary code, its correction factor and the spread of estimates."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        d = unit.shape[1]
        self.turned = (unit @ rotation(d, 0).T).astype(np.float32)
        self.code = np.where(self.turned > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(d))
        factor = np.einsum("ij,ij->i", self.code, self.turned)
        self.factor = np.maximum(factor, 1e-6)
        rest = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor
        self.bound = SURE * rest / math.sqrt(max(d - 1, 1)) + 1e-5

    def upper(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper confidence bounds of the inner products of the pairs (a[i], b[i])."""
        one = np.einsum("ij,ij->i", self.code[a], self.turned[b]) / self.factor[a] + self.bound[a]
        two = np.einsum("ij,ij->i", self.code[b], self.turned[a]) / self.factor[b] + self.bound[b]
        return np.maximum(one, two)

    def upper_block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one = self.code[a] @ self.turned[b].T / self.factor[a][:, None] + self.bound[a][:, None]
        two = self.turned[a] @ self.code[b].T / self.factor[b] + self.bound[b]
        return np.maximum(one, two)


def _links(sketch, code, table, groups, threshold):
    """Pairs of indices at or over the threshold that meet in no earlier table."""
    small = [g for g in groups if g[2] - g[0] <= SMALL]
    large = [g for g in groups if g[2] - g[0] > SMALL]

    def exact(a, b):
        near = np.einsum("ij,ij->i", sketch.unit[a], sketch.unit[b]) >= threshold
        a, b = a[near], b[near]
        first = np.arange(code.shape[1]) < table[a][:, None]
        fresh = ~((code[a] == code[b]) & first).any(axis=1)
        return a[fresh], b[fresh], a, b

    for a, b in gathered_pairs(small):
        go = sketch.upper(a, b) >= threshold
        yield exact(a[go], b[go])
    for start, middle, stop in large:
        right = np.arange(middle if middle < stop else start, stop)
        for at in range(start, middle, 256):
            left = np.arange(at, min(at + 256, middle))
            i, j = np.nonzero(sketch.upper_block(left, right) >= threshold)
            a, b = left[i], right[j]
            ahead = a < b
            yield exact(a[ahead], b[ahead])


def vector_links(classes: DataFrame, threshold: float, recall: float, block: int = BLOCK) -> DataFrame:
    """(node, links, other): links of a class found in one bucket, and a class it hangs under.

    `classes` has node, grp (only equal ones are compared), size (equal vectors), vector. Every
    vector goes to one bucket a table, and is sent to those that hold another one; there the
    binary codes estimate each inner product, and pairs that may reach the threshold are
    computed in double precision. A pair counts in the first table in which it meets. Each
    bucket sends one row a vector, not its pairs. A bucket of more than `block` vectors is dealt
    in blocks, and every two blocks meet in a task.
    """
    bits, tables = plan_tables(classes.count(), threshold, recall)

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}

    def spread(batches):
        for batch in batches:
            for d in set(batch.column("dim").to_pylist()):
                part = batch.filter(pc.equal(batch.column("dim"), d))
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                code = codes(_unit(flat.astype(np.float64).reshape(-1, d)), bits, tables)
                n = part.num_rows
                take = pa.array(np.repeat(np.arange(n), tables))
                columns = [part.column(c).take(take) for c in ("node", "grp", "dim")]
                columns += [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(code.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "grp", "dim", "tab", "code"])

    keys = ["grp", "dim", "tab", "code"]
    near = classes.select("node", "grp", "dim", "vector").mapInArrow(
        spread, f"node {kinds['node']}, grp {kinds['grp']}, dim int, tab int, code long"
    )
    dealt = deal(near, classes.select("node", "size", "vector"), keys, "node", block)

    def solve(rows, groups):
        dim = np.array(rows["dim"])
        for d in sorted({int(dim[s]) for s, _, _ in groups}):
            pick = np.flatnonzero(dim == d)
            place = np.cumsum(dim == d) - 1
            own = [
                (int(place[s]), int(place[s]) + m - s, int(place[s]) + e - s)
                for s, m, e in groups
                if dim[s] == d
            ]
            unit = _unit(np.array([rows["vector"][i] for i in pick], dtype=np.float64))
            code = codes(unit, bits, tables)
            size, table = np.array(rows["size"])[pick], np.array(rows["tab"])[pick]
            count, ends = np.zeros(len(pick)), []
            for a, b, all_a, all_b in _links(Sketch(unit), code, table, own, threshold):
                count += np.bincount(a, weights=size[b], minlength=len(pick))
                count += np.bincount(b, weights=size[a], minlength=len(pick))
                # a step sends on a forest of its links, not the links
                root = local_roots(len(pick), all_a, all_b)
                leaf = np.flatnonzero(root != np.arange(len(pick)))
                ends.append((leaf, root[leaf]))
            if not ends:
                continue
            root = local_roots(len(pick), *[np.concatenate(c) for c in zip(*ends)])
            keep = np.flatnonzero((count > 0) | (root != np.arange(len(pick))))
            if len(keep):
                yield pick[keep], count[keep].astype(np.int64), pick[root[keep]]

    def compare(batches):
        for rows, groups in gathered(batches, keys, 4 * block):
            for index, count, root in solve(rows, groups):
                node = np.array(rows["node"], dtype=object)
                columns = [pa.array(c, pa.string()) for c in (node[index], node[root])]
                columns.insert(1, pa.array(count))
                yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "other"])

    return dealt.mapInArrow(compare, f"node {kinds['node']}, links long, other {kinds['node']}")


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `table`, under those names.

    Two vectors link if their labels are equal and not null, their lengths are equal and their
    cosine is at least `threshold`. Vectors that are null, empty or zero or hold a null or
    non-finite component link with nothing and are their own component. Equal vectors are one
    class that counts as many as it has rows. Null ids are ignored in the smallest id; kept
    compares ids null-safely. Repeated rows stay; no rows give no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    rows = table.select(
        F.col(id_col).alias("vec"),
        F.col(label_col).alias("grp"),
        F.col(vector_col).alias("vector"),
        F.coalesce(fine & some & F.col(label_col).isNotNull(), F.lit(False)).alias("fine"),
    )
    node = F.concat(
        F.lpad(F.hex(F.xxhash64("grp", "vector")), 16, "0"),
        F.lpad(F.hex(F.xxhash64(F.lit("second"), "grp", "vector")), 16, "0"),
    )
    rows = rows.withColumn("node", F.when(F.col("fine"), node))
    classes = cut_lineage(
        rows.where("fine")
        .groupBy("node")
        .agg(
            F.first("grp").alias("grp"),
            F.count("*").alias("size"),
            F.first("vector").alias("vector"),
            F.min("vec").alias("first"),
        )
        .withColumn("dim", F.size("vector"))
    )
    found = cut_lineage(
        vector_links(classes.select("node", "grp", "size", "vector", "dim"), threshold, recall, block)
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    tops = classes.select("node", "size", "first").join(roots, "node", "left")
    tops = tops.withColumn("root", F.coalesce("root", "node"))
    least = tops.groupBy("root").agg(F.min("first").alias("component"))
    labels = cut_lineage(
        tops.join(least, "root")
        .join(counts, "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            "component",
        )
    )
    out = rows.select("vec", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec")).otherwise(F.col("component"))
    return out.select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec").eqNullSafe(component).alias("kept"),
    )
