"""Centroid clustering and vector codes against plain versions in whole numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import metric_tree
from rankweave.llm.clustering import choose_pivots, cluster_vectors, nearest, pivot_distances
from rankweave.llm.grid import LIMIT
from rankweave.llm.metric_tree import grow, owners
from rankweave.llm.vector_codes import compress_vectors, part_bounds

SCHEMA = "vec_id long, embedding array<float>, label int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [int(max(-LIMIT, min(LIMIT, math.floor(np.float64(np.float32(x)) * scale)))) for x in v]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def assign(points, centres):
    return [min((gap(p, c), i) for i, c in enumerate(centres)) for p in points]


def moved(points, found, centres):
    own = defaultdict(list)
    for p, (_, i) in zip(points, found):
        own[i].append(p)
    return [[sum(c) // len(own[i]) for c in zip(*own[i])] if own[i] else c for i, c in enumerate(centres)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_clusters(rows, k, dimension, scale, rounds):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if sound(v) and len(v) == dimension]
    order = sorted((sha(f"2:{i}"), p) for i, p in kept if i is not None)
    centres, points = [p for _, p in order[:k]], [p for _, p in kept]
    for _ in range(rounds):
        centres = moved(points, assign(points, centres), centres)
    found = assign(points, centres)
    total = Counter()
    for d, c in found:
        total[c] += d
    return [
        (i, c, d, total[c], sum(total.values()), sha(",".join(map(str, centres[c]))))
        for (i, _), (d, c) in zip(kept, found)
    ]


def plain_codes(rows, parts, entries, scale, rounds):
    kept = [(i, label, whole(v, scale)) for i, v, label in rows if sound(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dimension = len(first[0][2])
    other = [r for r in kept if len(r[2]) != dimension]
    kept = [r for r in kept if len(r[2]) == dimension]
    first = [r for r in first if len(r[2]) == dimension][:entries]
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for s, e in part_bounds(dimension, parts):
        points, book = [r[2][s:e] for r in kept], [r[2][s:e] for r in first]
        for _ in range(rounds):
            book = moved(points, assign(points, book), book)
        for n, (d, c) in enumerate(assign(points, book)):
            codes[n] += f"{c:02x}"
            errors[n] += d
        books += [v for b in book for v in b]
    total = Counter()
    for (_, label, _), e in zip(kept, errors):
        total[label] += e
    mark = sha(",".join(map(str, books)))
    out = [(i, label, c, e, total[label], mark) for (i, label, _), c, e in zip(kept, codes, errors)]
    labels = {r[1] for r in kept}
    return out + [(i, label, None, None, total[label] if label in labels else None, mark) for i, label, _ in other]


def vectors(seed, count, dimension):
    """Vectors around a few centres, with a large group of copies, ties and odd rows."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, dimension)) * 0.4
    out = []
    for i in range(count):
        v = middle[i % 5] + rng.normal(size=dimension) * 0.1
        out.append((i, np.round(v, 2).tolist(), None if i % 7 == 0 else i % 3))
    for i in range(count // 3):
        out.append((1000 + i, out[4][1], 2))
    out += [(7, out[7][1], 1), (7, out[9][1], None), (None, out[3][1], 0), (None, None, None), (2000, None, 1)]
    out += [(2001, [float("nan")] * dimension, 1), (2002, [None] * dimension, 1)]
    out += [(2003, [float("inf")] + [0.0] * (dimension - 1), 1), (2004, [0.5] * (dimension + 2), 9), (2005, [], 1)]
    out += [(2006, [3e38] + [-3e38] * (dimension - 1), 4), (2007, [0.0] * dimension, 4)]
    return out


def same(df, want):
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("k, pivots", [(6, 3), (40, 1), (500, 16)])
def test_clusters(spark, k, pivots):
    rows = vectors(1, 120, 8)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("taken")).repartition(5)
    got = cluster_vectors(table, k=k, dimension=8, rounds=3, pivots=pivots).drop("centroid")
    same(got, plain_clusters(rows, k, 8, 256, 3))


def test_centroid_column(spark):
    table = spark.createDataFrame(vectors(1, 40, 4), SCHEMA)
    for r in cluster_vectors(table, k=5, dimension=4, rounds=2).collect():
        assert sha(",".join(map(str, r["centroid"]))) == r["centroid_sha256"]


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    middle = rng.integers(-4000, 4000, size=(40, 16))
    points = middle[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, size=(2000, 16))
    pivots = choose_pivots(middle, 8)
    own, distance, made = nearest(points, pivot_distances(points, pivots), middle, pivots)
    every = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert made < 0.1 * every.size


@pytest.mark.parametrize("entries, block", [(16, 4096), (256, 50), (5, 7)])
def test_codes(spark, entries, block):
    rows = vectors(2, 150, 8)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("taken")).repartition(3)
    got, books = compress_vectors(table, entries=entries, block=block, rounds=3)
    same(got, plain_codes(rows, 4, entries, 1024, 3))
    assert [b.shape[1] for b in books] == [2, 2, 2, 2]


def test_uneven_parts(spark):
    rows = [r for r in vectors(3, 40, 6) if r[1] != []]
    got, _ = compress_vectors(spark.createDataFrame(rows, SCHEMA), parts=4, entries=9, rounds=2)
    same(got, plain_codes(rows, 4, 9, 1024, 2))


def test_nothing(spark):
    for rows in ([], [(1, None, 2), (2, [None], 1), (3, [float("nan")], None)]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert cluster_vectors(table).count() == 0
        codes, books = compress_vectors(table)
        assert codes.count() == 0 and all(b.size == 0 for b in books)
    empty = spark.createDataFrame([(1, [], 2), (2, [], 2)], SCHEMA)
    assert cluster_vectors(empty).count() == 0
    assert [tuple(r)[1:5] for r in compress_vectors(empty)[0].collect()] == [(2, "00000000", 0, 0)] * 2


@pytest.mark.parametrize("kind", ["clustered", "copies", "large", "line"])
def test_tree(kind):
    rng = np.random.default_rng(8)
    middle = rng.integers(-400, 400, size=(40, 6))
    points = middle[rng.integers(0, 40, 900)] + rng.integers(-9, 9, size=(900, 6))
    if kind == "copies":
        points[100:700] = points[5]
    if kind == "large":
        points = points + (LIMIT - 1000)
    if kind == "line":
        points = np.repeat(np.arange(900)[:, None] ** 2, 6, axis=1)
    tree = grow(points.astype(np.int64))
    assert sorted(tree.order.tolist()) == list(range(900))
    for n in range(len(tree.start)):
        rows = tree.order[tree.start[n] : tree.stop[n]]
        assert (tree.sums[n] == points[rows].sum(axis=0)).all()
        reach = np.sqrt(((points[rows] - points[rows].mean(axis=0)) ** 2).sum(axis=1)).max()
        assert reach <= tree.radius[n] * (1 + 1e-9) + 1e-6
        if tree.left[n] >= 0:
            left, right = tree.left[n], tree.right[n]
            assert tree.start[n] == tree.start[left] and tree.stop[left] == tree.start[right]
            assert tree.stop[right] == tree.stop[n]
        else:
            assert len(rows) <= metric_tree.LEAF or tree.radius[n] < 1e-6
    entries = middle if kind == "clustered" else points[rng.integers(0, 900, 64)]
    (ball, own), (row, entry), _ = owners(tree, points, entries)
    got = np.full(900, -1)
    for b, e in zip(ball, own):
        got[tree.order[tree.start[b] : tree.stop[b]]] = e
    got[row] = entry
    want = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (got == want).all()
    if kind == "clustered":
        assert len(row) < 90  # most points are owned through their balls
