"""k-means on whole numbers; stored distances to fixed pivots spare distances to centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .grid import digest, is_sound, matrix, squared, to_grid

CLUSTERS, DIMENSION, SCALE, ROUNDS = 40, 64, 256, 5
#: fixed points to which every vector's distance is stored
PIVOTS = 16
#: what the start order hashes before the id
SALT = "2:"
#: exact distances made in one step
PAIRS = 1 << 17
#: share by which a bound is loosened, far above the error of double precision
SLACK = 1e-12


def choose_pivots(centres: np.ndarray, count: int) -> np.ndarray:
    """Rows of `centres` that lie far from each other, the first one first."""
    picked, gap = [], np.full(len(centres), np.inf)
    for _ in range(min(count, len(centres))):
        new = int(np.argmax(gap))
        picked.append(new)
        gap = np.minimum(gap, squared(centres, centres[new]).astype(float))
    return centres[picked]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of every point to every pivot."""
    out = np.empty((len(points), len(pivots)))
    for p, pivot in enumerate(pivots):
        out[:, p] = np.sqrt(squared(points, pivot).astype(float))
    return out


def nearest(points: np.ndarray, stored: np.ndarray, centres: np.ndarray, pivots: np.ndarray):
    """(centroid, squared distance, exact distances made) of each point; ties go to the lower number.

    |d(point, pivot) - d(centroid, pivot)| bounds the distance of a point and a centroid from
    below. The centroid with the least bound is measured first; then all whose bound is not above
    that distance.
    """
    between = pivot_distances(centres, pivots)
    bound = np.zeros((len(points), len(centres)))
    for p in range(len(pivots)):
        a, b = stored[:, p, None], between[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    guess = bound.argmin(axis=1)
    near = squared(points, centres[guess])
    open_ = bound * bound * (1 - SLACK) <= near[:, None].astype(float)
    open_[np.arange(len(points)), guess] = True
    row, centre = np.nonzero(open_)
    distance = np.empty(len(row), dtype=np.int64)
    for s in range(0, len(row), PAIRS):
        distance[s : s + PAIRS] = squared(points[row[s : s + PAIRS]], centres[centre[s : s + PAIRS]])
    first = np.searchsorted(row, np.arange(len(points)))
    least = np.minimum.reduceat(distance, first) if len(row) else distance
    best = np.flatnonzero(distance == least[row])
    keep = best[np.unique(row[best], return_index=True)[1]]
    return centre[keep].astype(np.int32), distance[keep], len(row)


def _start(kept: DataFrame, k: int, salt: str, dimension: int) -> np.ndarray:
    """The `k` vectors whose salted ids have the smallest digests, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.where("id IS NOT NULL").select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), dimension)


def _with_pivots(kept: DataFrame, kind: str, pivots: np.ndarray, dimension: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            stored = pivot_distances(matrix(batch.column("x"), dimension), pivots)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(stored.ravel()), len(pivots))
            columns = [batch.column("id"), batch.column("x"), flat.cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "pivots"])

    return kept.mapInArrow(work, f"id {kind}, x array<int>, pivots array<double>")


def _read(batch: pa.RecordBatch, dimension: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    stored = batch.column("pivots").flatten().to_numpy(zero_copy_only=False)
    return matrix(batch.column("x"), dimension), stored.reshape(batch.num_rows, pivots)


def _moved(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round; a task sends one row a centroid."""
    k, dimension = centres.shape

    def work(batches):
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimension), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points, stored = _read(batch, dimension, len(pivots))
            own, _, _ = nearest(points, stored, centres, pivots)
            order = np.argsort(own, kind="stable")
            which, first = np.unique(own[order], return_index=True)
            count += np.bincount(own, minlength=k)
            total[which] += np.add.reduceat(points[order], first, axis=0)
        used = np.flatnonzero(count)
        sums = pa.array(total[used].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), sums], names=["cluster", "n", "sums"]
        )

    parts = table.mapInArrow(work, "cluster int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimension)]
    out = centres.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimension)]
    return out


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = CLUSTERS,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    salt: str = SALT,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that is kept.

    Kept are vectors with `dimension` components, none null or non-finite; each becomes whole
    numbers, floor(scale * x) (held within 2^27, so that distances fit 64 bits). Centroids start
    as the `k` vectors whose ids have the smallest digests (rows of one id in the order of their
    components; vectors without id are assigned but start nothing); with fewer there are fewer
    centroids. After `rounds` rounds of exact assignment (ties to the lower number) and rounding
    means down, vectors are assigned once more. `distance` is squared; inertias are its sums, null
    where they don't fit 64 bits. Repeated rows count as often as they occur; other columns are
    left out; an empty table gives no rows.

    Distances to the pivots are computed once and written. A round is one pass; the driver gets
    `k` sums a round and nothing else.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    vector = F.col(vec_col)
    kept = vectors.where(is_sound(vector) & (F.size(vector) == dimension))
    kept = kept.select(F.col(id_col).alias("id"), to_grid(vector, scale).alias("x"))
    centres = _start(kept, k, salt, dimension)
    spark = vectors.sparkSession
    out = f"id {kind}, cluster int, distance long"
    if not len(centres):
        names = f"{out}, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
        return spark.createDataFrame([], names).withColumnRenamed("id", id_col)
    fixed = choose_pivots(centres, pivots)
    table = cut_lineage(_with_pivots(kept, kind, fixed, dimension))
    for _ in range(rounds):
        centres = _moved(table, centres, fixed)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points, stored = _read(batch, dimension, len(fixed))
            own, distance, _ = nearest(points, stored, centres, fixed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(own), pa.array(distance)], names=["id", "cluster", "distance"]
            )

    found = cut_lineage(table.mapInArrow(work, out))
    # one row a centroid
    sums = found.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia"))
    total = found.agg(F.expr("try_sum(distance)")).first()[0]
    means = [(i, total, [int(v) for v in c], digest(c)) for i, c in enumerate(centres)]
    known = spark.createDataFrame(means, "cluster int, inertia long, centroid array<long>, centroid_sha256 string")
    known = known.join(sums, "cluster").select("cluster", "cluster_inertia", *known.columns[1:])
    return found.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", *known.columns[1:]
    )
