"""Trees grown best-first from histograms of derivatives.

A pass over the rows sums the first and second derivative and the rows by (node, feature, bin), in
every task at first; the sums, whose number follows from leaves, features and bins alone, come to the
driver, which picks the splits. A pass covers every node that the best-first order may still reach, so
a tree takes about as many passes as it is deep, and has the leaves of one split at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .lazy import lists

#: bins of a feature
MAX_BINS = 255
#: sum of second derivatives that a leaf has at least
MIN_HESSIAN = 1e-3
#: added to the second derivatives of a category where categories are put in order
CATEGORY_SMOOTHING = 10.0
#: rows of a block, but for one whole set more
BLOCK_ROWS = 1 << 16
#: tasks whose sums the driver adds; of more, tasks do
SENT = 16


@dataclass
class Bins:
    """Edges of the numeric features, by place; the other features are codes below `sizes`."""

    edges: dict[int, np.ndarray]
    sizes: list[int]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)))

    def of(self, values: np.ndarray) -> np.ndarray:
        """Bin numbers of rows of feature values: up to and with an edge is below it."""
        out = np.empty(values.shape, dtype=np.int16)
        for i, size in enumerate(self.sizes):
            if i in self.edges:
                out[:, i] = np.searchsorted(self.edges[i], values[:, i], side="left")
            else:
                out[:, i] = np.clip(values[:, i], 0, size - 1)
        return out


def fit_bins(rows: DataFrame, categories: list[int | None], column: str = "x", most: int = MAX_BINS) -> Bins:
    """Bins of an array column: quantiles of the numeric features in one pass, codes of the others."""
    numeric = [i for i, size in enumerate(categories) if size is None]
    edges: dict[int, np.ndarray] = {}
    if numeric:
        shares = [i / most for i in range(1, most)]
        found = rows.agg(*[F.percentile_approx(F.col(column)[i], shares, 100 * most).alias(f"q{i}") for i in numeric]).first()
        edges = {i: np.unique(np.array(found[f"q{i}"] or [], dtype=float)) for i in numeric}
    return Bins(edges, [len(edges[i]) + 1 if size is None else size for i, size in enumerate(categories)])


@dataclass
class Tree:
    """Nodes by number; a row goes left where the node's mask holds for its bin of the feature."""

    feature: np.ndarray
    left: np.ndarray
    right: np.ndarray
    masks: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int32)
        open_ = np.arange(len(bins)) if self.left[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(open_):
            at = node[open_]
            goes = self.masks[at, bins[open_, self.feature[at]]]
            node[open_] = np.where(goes, self.left[at], self.right[at])
            open_ = open_[self.left[node[open_]] >= 0]
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class Split:
    gain: float
    feature: int
    mask: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]


@dataclass
class Node:
    sums: np.ndarray | None = None
    split: Split | None = None
    known: bool = False
    children: tuple[int, int] | None = None


@dataclass
class Growth:
    """How trees are grown."""

    num_leaves: int = 31
    min_child_samples: int = 20
    reg_lambda: float = 0.0
    max_depth: int = -1
    columns: list[int] = field(default_factory=list)


def leaf_value(sums: np.ndarray, reg_lambda: float) -> float:
    return float(-sums[0] / (sums[1] + reg_lambda)) if sums[1] + reg_lambda > 0 else 0.0


def _score(g, h, reg_lambda):
    return np.where(h + reg_lambda > 0, g * g / np.maximum(h + reg_lambda, 1e-300), 0.0)


def best_split(cells: np.ndarray, bins: Bins, growth: Growth) -> Split | None:
    """The split of most gain; of equal ones that of the first feature and the lowest bin.

    `cells` holds (g, h, rows) by bin of all features. Codes are put in the order of their mean
    derivative first, so that a cut is a set of categories.
    """
    best = None
    offsets = bins.offsets
    for f in growth.columns:
        own = cells[offsets[f] : offsets[f + 1]]
        order = np.arange(len(own))
        if f not in bins.edges:
            held = np.flatnonzero(own[:, 2] > 0)
            mean = own[held, 0] / (own[held, 1] + CATEGORY_SMOOTHING)
            order = held[np.argsort(mean, kind="stable")]
        if len(order) < 2:
            continue
        left = np.cumsum(own[order], axis=0)[:-1]
        total = own[order].sum(axis=0)
        right = total - left
        fits = (left[:, 2] >= growth.min_child_samples) & (right[:, 2] >= growth.min_child_samples)
        fits &= (left[:, 1] >= MIN_HESSIAN) & (right[:, 1] >= MIN_HESSIAN)
        if not fits.any():
            continue
        whole = _score(total[0], total[1], growth.reg_lambda)
        gain = _score(left[:, 0], left[:, 1], growth.reg_lambda) + _score(right[:, 0], right[:, 1], growth.reg_lambda) - whole
        gain = np.where(fits, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > 1e-12 and (best is None or gain[at] > best.gain * (1 + 1e-12)):
            mask = np.zeros(MAX_BINS + 1, dtype=bool)
            mask[order[: at + 1]] = True
            best = Split(float(gain[at]), f, mask, (left[at], right[at]))
    return best


def _assembled(nodes: list[Node], picked: set[int], reg_lambda: float) -> Tree:
    n = len(nodes)
    tree = Tree(
        np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32),
        np.zeros((n, MAX_BINS + 1), bool), np.zeros(n),
    )
    for i, node in enumerate(nodes):
        if i in picked:
            tree.feature[i], tree.masks[i] = node.split.feature, node.split.mask
            tree.left[i], tree.right[i] = node.children
        if node.sums is not None:
            tree.value[i] = leaf_value(node.sums, reg_lambda)
    return tree


def grow(histograms: Callable[[Tree, list[int]], dict[int, np.ndarray]], bins: Bins, growth: Growth) -> Tree:
    """The tree of `num_leaves` leaves at most, split best-first.

    `histograms(tree, nodes)` makes one pass: the cells of the rows that `tree` leads to each node.
    """
    nodes, depth = [Node()], [0]
    picked: list[int] = []
    while True:
        wanted = [i for i, n in enumerate(nodes) if not n.known]
        if wanted:
            # rows go down the tree as far as it was tried
            tried = {i for i, n in enumerate(nodes) if n.children}
            found = histograms(_assembled(nodes, tried, growth.reg_lambda), wanted)
            for i in wanted:
                cells = found.get(i, np.zeros((int(bins.offsets[-1]), 3)))
                if nodes[i].sums is None:
                    nodes[i].sums = cells[bins.offsets[0] : bins.offsets[1]].sum(axis=0)
                if growth.max_depth < 0 or depth[i] < growth.max_depth:
                    nodes[i].split = best_split(cells, bins, growth)
                nodes[i].known = True
        frontier, picked = [0], []
        while len(picked) < growth.num_leaves - 1:
            able = [i for i in frontier if nodes[i].known and nodes[i].split]
            if not able:
                break
            top = max(able, key=lambda i: (nodes[i].split.gain, -i))
            picked.append(top)
            node = nodes[top]
            if node.children is None:
                node.children = (len(nodes), len(nodes) + 1)
                for sums in node.split.sums:
                    # too few rows for two leaves: nothing to look at
                    whole = sums[2] < 2 * growth.min_child_samples
                    nodes.append(Node(sums=sums, known=bool(whole)))
                    depth.append(depth[top] + 1)
            frontier = [i for i in frontier if i != top] + list(node.children)
        if all(n.known for n in nodes):
            return _assembled(nodes, set(picked), growth.reg_lambda)


def derivatives(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss."""
    p = 1.0 / (1.0 + np.exp(-np.clip(score, -60.0, 60.0)))
    return p - label, p * (1.0 - p)


@dataclass
class Block:
    """Some rows: their bins, and by row the label, score, derivatives, what a share of the rows is
    drawn by, and whether a set begins; whole sets."""

    bins: np.ndarray
    label: np.ndarray | None = None
    score: np.ndarray | None = None
    g: np.ndarray | None = None
    h: np.ndarray | None = None
    drawn: np.ndarray | None = None
    begins: np.ndarray | None = None


@dataclass
class Blocks:
    """Rows of blocks. A pass over them is one job without a plan or an exchange of its own."""

    rdd: RDD

    def map(self, f: Callable[[Block], Block]) -> Blocks:
        return Blocks(self.rdd.map(f))

    def persist(self) -> Blocks:
        self.rdd.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.rdd.unpersist()


def _sent(held: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    own = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in names if n != "bins"}
    block = Block(np.concatenate([lists(b.column("bins")) for b in held]), **own)
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["block"])


def in_blocks(rows: DataFrame, keep: bool = True) -> Blocks:
    """The rows, whose columns are named as those of a `Block`; `keep` writes them first."""
    names = rows.columns

    def work(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= BLOCK_ROWS:
                # sets are not cut
                begin = np.flatnonzero(batch.column("begins").to_numpy(zero_copy_only=False)) if "begins" in names else [0]
                if len(begin):
                    cut = int(begin[0])
                    yield _sent([*held, batch.slice(0, cut)] if cut else held, names)
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield _sent(held, names)

    made = rows.mapInArrow(work, "block binary")
    return Blocks((cut_lineage(made) if keep else made).rdd.map(lambda row: pickle.loads(row[0])))


_XX = [np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _XX[1]
    x = (x ^ x >> np.uint64(29)) * _XX[2]
    return x ^ x >> np.uint64(32)


def xxhash64(seed: int, values: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column and a long one."""
    with np.errstate(over="ignore"):
        x = np.array([42], np.uint64) + _XX[4] + np.uint64(4) ^ np.array([seed & 0xFFFFFFFF], np.uint64) * _XX[0]
        x = _finished(_turned(x, 23) * _XX[1] + _XX[2])
        x = x + _XX[4] + np.uint64(8) ^ _turned(values.astype(np.int64).view(np.uint64) * _XX[1], 31) * _XX[0]
        return _finished(_turned(x, 27) * _XX[0] + _XX[3]).view(np.int64)


def with_log_loss(block: Block) -> Block:
    """The derivatives of the log loss at the score."""
    g, h = derivatives(block.score, block.label)
    return replace(block, g=g, h=h)


def moved(block: Block, trees: list[Tree], lr: float) -> Block:
    """The score moved by `trees`."""
    score = block.score
    for t in trees:
        score = score + lr * t.predict(block.bins)
    return replace(block, score=score)


def _both(a, b):
    """The sum of two tasks' cells."""
    cell = np.union1d(a[0], b[0])
    out = np.zeros((3, len(cell)))
    for own, sums in (a, b):
        out[:, np.searchsorted(cell, own)] += sums
    return cell, out


def pass_over(rows: Blocks, bins: Bins, sample: tuple[float, int] = (1.0, 0)):
    """The pass that `grow` asks for, over rows with `bins`, `g` and `h`.

    `sample` takes a share of the rows, by `drawn`.
    """
    share, seed = sample
    offsets, total = bins.offsets[:-1], int(bins.offsets[-1])
    parts = rows.rdd.getNumPartitions()

    def histograms(tree: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
        place = np.full(len(tree.left), -1)
        place[wanted] = np.arange(len(wanted))

        def work(blocks):
            cells = np.zeros((3, len(wanted) * total))
            for block in blocks:
                at = place[tree.leaves(block.bins)]
                used = at >= 0
                if share < 1:
                    used &= (xxhash64(seed, block.drawn) & ((1 << 30) - 1)) / (1 << 30) < share
                key = (at[used, None] * total + offsets + block.bins[used]).ravel()
                for i, v in enumerate((block.g, block.h, np.ones(len(used)))):
                    weight = np.repeat(v[used], block.bins.shape[1])
                    cells[i] += np.bincount(key, weights=weight, minlength=cells.shape[1])
            hit = np.flatnonzero(cells[2])
            yield hit, cells[:, hit]

        sent = rows.rdd.mapPartitions(work)
        # the driver gets the sums of so many tasks
        met = sent.collect() if parts <= SENT else [sent.treeReduce(_both, 2 if parts <= SENT**3 else 3)]
        out = np.zeros((3, len(wanted) * total))
        for cell, sums in met:
            out[:, cell] += sums
        return {w: out[:, i * total : (i + 1) * total].T for i, w in enumerate(wanted)}

    return histograms


def boosted(rows: DataFrame, trees: list[Tree], lr: float) -> DataFrame:
    """`rows` with the scores moved by `trees`."""
    if not trees:
        return rows
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = lists(batch.column("bins"))
            score = batch.column("score").to_numpy(zero_copy_only=False).astype(float)
            for t in trees:
                score = score + lr * t.predict(own)
            columns = [pa.array(score) if n == "score" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(work, kinds)


def binned(rows: DataFrame, bins: Bins, column: str = "x") -> DataFrame:
    """`rows` with the array of feature values replaced by `bins`."""
    kept = [c for c in rows.columns if c != column]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = bins.of(lists(batch.column(column)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1])
            columns = [*[batch.column(c) for c in kept], flat.cast(pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "bins"])

    return rows.mapInArrow(work, f"{kinds}, bins array<smallint>")
