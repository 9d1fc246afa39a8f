"""Product codes of vectors; codebooks are fitted on metric trees whose balls cache sums and counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .grid import digest, is_sound, matrix, squared, to_grid
from .metric_tree import LEAF, Tree, grow, owners

PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
#: vectors under one set of trees
BLOCK = 4096

TREE = (
    "array<struct<order:array<int>,start:array<int>,stop:array<int>,left:array<int>,right:array<int>,"
    "radius:array<double>,sums:array<bigint>>>"
)
_INTS = ("order", "start", "stop", "left", "right")


def part_bounds(dimension: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts; equal ones where `parts` divides the dimension."""
    cuts = [i * dimension // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _stored(tree: Tree) -> dict:
    return {
        **{n: getattr(tree, n).tolist() for n in _INTS},
        "radius": tree.radius.tolist(),
        "sums": tree.sums.ravel().tolist(),
    }


def _loaded(held: dict, width: int) -> Tree:
    read = {n: np.array(held[n], dtype=np.int64) for n in (*_INTS, "sums")}
    read["sums"] = read["sums"].reshape(len(read["start"]), width)
    return Tree(radius=np.array(held["radius"]), **read)


def tree_blocks(kept: DataFrame, dimension: int, parts: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(ids, labels, points, trees): blocks of vectors as they lie, with a tree for each part."""
    bounds = part_bounds(dimension, parts)
    kinds = [kept.schema[c].dataType.simpleString() for c in ("id", "label")]

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                points = matrix(batch.column("x"), dimension)
                trees = [_stored(grow(points[:, s:e], leaf)) for s, e in bounds]
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c)
                columns = [one(batch.column("id")), one(batch.column("label"))]
                columns += [pa.array([points.ravel().tolist()], pa.list_(pa.int32())), pa.array([trees], _tree_type())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "points", "trees"])

    return kept.select("id", "label", "x").mapInArrow(
        work, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, points array<int>, trees {TREE}"
    )


def _tree_type() -> pa.DataType:
    fields = [(n, pa.list_(pa.int32())) for n in _INTS]
    return pa.list_(pa.struct([*fields, ("radius", pa.list_(pa.float64())), ("sums", pa.list_(pa.int64()))]))


def _blocks(batches, dimension: int, bounds):
    """(row of the batch, batch, points, trees) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            flat = batch.column("points")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            held = batch.column("trees")[i].as_py()
            count = len(batch.column("ids")[i])
            trees = [_loaded(t, e - s) for t, (s, e) in zip(held, bounds)]
            yield i, batch, flat.reshape(count, dimension), trees


def _moved(blocks: DataFrame, books: list[np.ndarray], dimension: int) -> list[np.ndarray]:
    """The codebooks after a round; a task sends one row an entry in use."""
    bounds = part_bounds(dimension, len(books))
    widest = max(e - s for s, e in bounds)

    def work(batches):
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for _, _, points, trees in _blocks(batches, dimension, bounds):
            for p, ((s, e), tree) in enumerate(zip(bounds, trees)):
                (ball, own), (row, entry), _ = owners(tree, points[:, s:e], books[p])
                # balls owned whole give their cached sums
                np.add.at(count[p], own, tree.counts[ball])
                np.add.at(total[p], own, tree.sums[ball])
                np.add.at(count[p], entry, 1)
                np.add.at(total[p], entry, points[row, s:e])
        for p, (n, sums) in enumerate(zip(count, total)):
            used = np.flatnonzero(n)
            lists = [[*r, *[0] * (widest - len(r))] for r in sums[used].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()),
                 pa.array(n[used]), pa.array(lists, pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    sent = blocks.mapInArrow(work, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(widest)]
    out = [b.copy() for b in books]
    for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        book = out[r["part"]]
        book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
    return out


def _coded(blocks: DataFrame, books: list[np.ndarray], dimension: int, id_kind: str, label_kind: str) -> DataFrame:
    """(id, label, code, error) of every vector."""
    bounds = part_bounds(dimension, len(books))
    wide = max(2, len(f"{len(books[0]) - 1:x}"))
    names = np.array([f"{i:0{wide}x}" for i in range(len(books[0]))])

    def work(batches):
        for i, batch, points, trees in _blocks(batches, dimension, bounds):
            error = np.zeros(len(points), dtype=np.int64)
            code = np.zeros(len(points), dtype="U1")
            for (s, e), tree, book in zip(bounds, trees, books):
                (ball, own), (row, entry), _ = owners(tree, points[:, s:e], book)
                chosen = np.zeros(len(points), dtype=np.int64)
                n = tree.counts[ball]
                before = np.cumsum(n) - n
                inside = np.arange(int(n.sum())) - np.repeat(before, n) + np.repeat(tree.start[ball], n)
                chosen[tree.order[inside]] = np.repeat(own, n)
                chosen[row] = entry
                error += squared(points[:, s:e], book[chosen])
                code = np.char.add(code, names[chosen])
            columns = [batch.column("ids")[i].values, batch.column("labels")[i].values]
            columns += [pa.array(code.tolist(), pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    return blocks.mapInArrow(work, f"id {id_kind}, label {label_kind}, code string, error long")


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    scale: int = SCALE,
    rounds: int = ROUNDS,
    block: int = BLOCK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error, label_error, codebooks_sha256) of every sound vector, codebooks).

    Vectors that are null or hold null or non-finite components are left out; the others become
    whole numbers, floor(scale * x) (held within 2^27, so that errors fit 64 bits), cut into
    consecutive `parts` (equal ones where the number divides the dimension). The codebook of a
    part starts as that part of the vectors with the `entries` smallest ids (rows of one id in
    the order of their components, null ids last); fewer vectors give fewer entries. Each of
    `rounds` rounds assigns every part exactly, ties to the lower entry, and rounds means down;
    unused entries stay. `label_error` is the sum of errors over equal labels, nulls together,
    null where it doesn't fit 64 bits. Vectors must have one length: those of another length than
    the vector with the smallest id get no code and no error, and count nowhere. Repeated rows
    count as often as they occur; other columns are left out; an empty table gives no rows and
    empty codebooks.

    Trees are grown once over blocks of `block` vectors and written. A round is one pass; the
    driver gets `parts * entries` sums a round and nothing else.
    """
    spark = vectors.sparkSession
    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    sound = vectors.where(is_sound(F.col(vec_col)))
    sound = sound.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), to_grid(F.col(vec_col), scale).alias("x")
    )
    first = sound.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    dimension = len(first[0]["x"]) if first else 0
    kept = sound.where(F.size("x") == dimension)
    rows = kept.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), dimension)
    books = [start[:, s:e].copy() for s, e in part_bounds(dimension, parts)]
    if rows:
        blocks = cut_lineage(tree_blocks(kept, dimension, parts, block))
        for _ in range(rounds):
            books = _moved(blocks, books, dimension)
        coded = _coded(blocks, books, dimension, id_kind, label_kind)
    else:
        coded = spark.createDataFrame([], f"id {id_kind}, label {label_kind}, code string, error long")
    other = sound.where(F.size("x") != dimension)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"))]
    coded = cut_lineage(coded.unionByName(other.select("id", "label", *none)))
    # written, so that a label of many vectors can be split in the join
    totals = cut_lineage(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")))
    totals = totals.withColumnRenamed("label", "of")
    mark = digest(v for b in books for v in b.ravel())
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    out = both.withColumn("codebooks_sha256", F.lit(mark))
    return out.withColumnsRenamed({"id": id_col, "label": label_col}), books
