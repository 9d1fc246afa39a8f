"""Metric trees of points, built middle-out from anchors, and their descent with shrinking lists of entries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .grid import squared

#: points of a ball that is not parted further
LEAF = 32
#: pairs of point and entry measured in one step
PAIRS = 1 << 17
#: share by which a bound is loosened, far above the error of double precision
SLACK = 1e-9


@dataclass
class Tree:
    """Balls over ranges of `order`; ball 0 holds all points, `left` is -1 for a leaf."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.stop - self.start

    @property
    def centres(self) -> np.ndarray:
        return self.sums / self.counts[:, None]


def anchors(points: np.ndarray, count: int) -> list[np.ndarray]:
    """Up to `count` groups of row numbers: each anchor owns the points nearest to it.

    The next anchor is the point farthest from the anchor with the widest group. It takes points
    only from anchors that lie near enough: a point nearer to its own than half the gap stays.
    """
    n = len(points)
    owner = np.zeros(n, dtype=np.int64)
    gap = np.sqrt(squared(points, points[0]).astype(float))
    places = [0]
    while len(places) < count:
        new = int(gap.argmax())
        if gap[new] == 0:
            break
        apart = np.sqrt(squared(points[places], points[new]).astype(float))
        open_ = np.flatnonzero(gap > apart[owner] / 2)
        own = np.sqrt(squared(points[open_], points[new]).astype(float))
        taken = own < gap[open_]
        gap[open_[taken]] = own[taken]
        owner[open_[taken]] = len(places)
        places.append(new)
    order = np.argsort(owner, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(g)]


def _merge_order(centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to merge, the pair with the smallest common ball first; new balls get the
    next numbers."""
    k = len(centres)
    total = 2 * k - 1
    c = np.zeros((total, centres.shape[1]))
    r, w = np.zeros(total), np.zeros(total)
    c[:k], r[:k], w[:k] = centres, radii, sizes
    cost = np.full((total, total), np.inf)

    def measure(i, others):
        apart = np.sqrt(((c[others] - c[i]) ** 2).sum(axis=1))
        cost[i, others] = np.maximum((apart + r[others] + r[i]) / 2, np.maximum(r[others], r[i]))

    for i in range(1, k):
        measure(i, np.arange(i))
    alive = np.zeros(total, dtype=bool)
    alive[:k] = True
    out = []
    for new in range(k, total):
        i, j = divmod(int(cost[:new, :new].argmin()), new)
        out.append((i, j))
        alive[[i, j]] = False
        cost[[i, j], :] = np.inf
        cost[:, [i, j]] = np.inf
        w[new] = w[i] + w[j]
        c[new] = (c[i] * w[i] + c[j] * w[j]) / w[new]
        r[new] = max(np.sqrt(((c[new] - c[m]) ** 2).sum()) + r[m] for m in (i, j))
        measure(new, np.flatnonzero(alive[:new]))
        alive[new] = True
    return out


def _shape(points: np.ndarray, rows: np.ndarray, leaf: int):
    """The tree over `rows` as nested pairs with arrays of rows as leaves."""
    if len(rows) <= leaf:
        return rows
    groups = anchors(points[rows], int(np.ceil(np.sqrt(len(rows)))))
    if len(groups) == 1:
        return rows
    groups = [rows[g] for g in groups]
    centres = np.array([points[g].mean(axis=0) for g in groups])
    radii = np.array([np.sqrt(((points[g] - m) ** 2).sum(axis=1)).max() for g, m in zip(groups, centres)])
    sizes = np.array([len(g) for g in groups])
    parts = [_shape(points, g, leaf) for g in groups]
    for i, j in _merge_order(centres, radii, sizes):
        parts.append((parts[i], parts[j]))
    return parts[-1]


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of at least one point: anchors first, merged upwards, each parted downwards."""
    order, nodes = [], []
    root = _shape(points, np.arange(len(points)), leaf)
    # depth first without recursion: (shape, parent, side)
    stack = [(root, -1, 0)]
    left, right, leaves = [], [], []
    while stack:
        shape, parent, side = stack.pop()
        number = len(nodes)
        nodes.append(number)
        left.append(-1)
        right.append(-1)
        if parent >= 0:
            (right if side else left)[parent] = number
        if isinstance(shape, tuple):
            stack.append((shape[1], number, 1))
            stack.append((shape[0], number, 0))
            leaves.append(None)
        else:
            leaves.append(shape)
    start, stop = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    at = 0
    for number, rows in enumerate(leaves):
        start[number] = at
        if rows is not None:
            order.append(rows)
            at += len(rows)
            stop[number] = at
    # children have higher numbers than their parents
    for number in reversed(range(len(nodes))):
        if left[number] >= 0:
            stop[number] = stop[right[number]]
    order = np.concatenate(order)
    sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
    np.cumsum(points[order], axis=0, out=sums[1:])
    sums = sums[stop] - sums[start]
    centres = sums / (stop - start)[:, None]
    radius = np.zeros(len(nodes))
    for number in nodes:
        own = points[order[start[number] : stop[number]]] - centres[number]
        radius[number] = np.sqrt((own * own).sum(axis=1).max())
    return Tree(order, start, stop, np.array(left), np.array(right), radius, sums)


def _first_least(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The place of the first least value of each segment."""
    sizes = np.diff(first, append=len(values))
    least = np.repeat(np.minimum.reduceat(values, first), sizes)
    hit = np.flatnonzero(values == least)
    return hit[np.searchsorted(hit, first)]


def owners(tree: Tree, points: np.ndarray, entries: np.ndarray):
    """(node, entry) of balls owned whole, (row, entry) of the other points, balls read.

    A ball hands its list of entries to its parts. An entry leaves the list when another one is
    nearer for every point of the ball: the difference of two squared distances is linear, so it
    is greatest at one edge of the ball. A ball with one entry left is owned whole and its points
    are not looked at. Ties go to the entry with the lower number, by exact distances.
    """
    keep = np.zeros(1, dtype=np.int64)
    if entries.shape[1]:
        # of equal entries the first one
        keep = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    values = entries[keep].astype(float)
    apart = np.sqrt(((values[:, None, :] - values[None, :, :]) ** 2).sum(axis=2))
    centres, counts = tree.centres, tree.counts
    # centres are rounded by their size, not by their distances
    rounding = 1e-13 * max(np.abs(values).max(initial=0), np.abs(centres).max(initial=0))
    node = np.zeros(len(keep), dtype=np.int64)
    entry = np.arange(len(keep))
    balls, points_of = [], []
    read = 0
    while len(node):
        first = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1))
        sizes = np.diff(first, append=len(node))
        read += len(first)
        far = ((centres[node] - values[entry]) ** 2).sum(axis=1)
        best = _first_least(far, first)
        near, chosen = np.repeat(far[best], sizes), np.repeat(entry[best], sizes)
        edge = 2 * tree.radius[node] * apart[entry, chosen]
        scale = SLACK * (far + near + edge + 1.0) + rounding * (np.sqrt(far) + np.sqrt(near) + 1.0)
        left = far - near <= edge + scale
        node, entry = node[left], entry[left]
        first = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1))
        sizes = np.diff(first, append=len(node))
        one = np.repeat(sizes == 1, sizes)
        balls.append((node[one], entry[one]))
        last = ~one & (tree.left[node] < 0)
        if last.any():
            points_of.append(_leaf_owners(tree, points, entries[keep], node[last], entry[last]))
        go = ~one & ~last
        node, entry = node[go], entry[go]
        first = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1)) if len(node) else node
        sizes = np.diff(first, append=len(node))
        # lists of the left parts, then of the right ones
        node = np.concatenate((tree.left[node], tree.right[node]))
        entry = np.concatenate((entry, entry))
    whole = [np.concatenate(c) if balls else np.zeros(0, np.int64) for c in zip(*balls)]
    rest = [np.concatenate(c) for c in zip(*points_of)] if points_of else [np.zeros(0, np.int64)] * 2
    assert counts[whole[0]].sum() + len(rest[0]) == len(points)
    return (whole[0], keep[whole[1]]), (rest[0], keep[rest[1]]), read


def _leaf_owners(tree: Tree, points, entries, node, entry) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of every point of leaves with several entries left, by exact distances."""
    first = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1))
    sizes = np.diff(first, append=len(node))
    leaf = node[first]
    # every point of a leaf against every entry of its list
    n = tree.stop[leaf] - tree.start[leaf]
    which = np.repeat(np.arange(len(leaf)), n)
    before = np.cumsum(n) - n
    row = tree.order[np.arange(int(n.sum())) - np.repeat(before, n) + np.repeat(tree.start[leaf], n)]
    rows, chosen = [], []
    wide = sizes[which]
    group = np.cumsum(wide) // PAIRS
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(row)]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        w = wide[s:e]
        begin = np.cumsum(w) - w
        listed = entry[np.arange(int(w.sum())) - np.repeat(begin, w) + np.repeat(first[which[s:e]], w)]
        gap = squared(np.repeat(points[row[s:e]], w, axis=0), entries[listed])
        rows.append(row[s:e])
        chosen.append(listed[_first_least(gap, begin)])
    return np.concatenate(rows), np.concatenate(chosen)
