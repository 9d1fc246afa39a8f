"""Histogram trees against growing them split by split over plain rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.models import histograms as hs
from rankweave.models import trees


def in_memory(bins, rows, g, h):
    """The pass of `grow` without Spark, and a count of passes."""
    passes = []

    def histograms(tree, wanted):
        passes.append(list(wanted))
        leaf = tree.leaves(rows)
        out = {}
        for w in wanted:
            cells = np.zeros((int(bins.offsets[-1]), 3))
            for i in np.flatnonzero(leaf == w):
                for f, b in enumerate(rows[i]):
                    cells[bins.offsets[f] + b] += (g[i], h[i], 1)
            out[w] = cells
        return out

    return histograms, passes


def plain_best(rows, g, h, own, least, lam, categorical):
    """(gain, feature, set of bins that go left) by trying every cut."""
    score = lambda i: g[i].sum() ** 2 / (h[i].sum() + lam)
    best = None
    for f in range(rows.shape[1]):
        found = sorted(set(rows[own, f]))
        if f in categorical:
            mean = {b: g[own][rows[own, f] == b].sum() / (h[own][rows[own, f] == b].sum() + 10) for b in found}
            found.sort(key=lambda b: (mean[b], b))
        for n in range(1, len(found)):
            left = own[np.isin(rows[own, f], found[:n])]
            right = own[~np.isin(rows[own, f], found[:n])]
            if min(len(left), len(right)) < least or min(h[left].sum(), h[right].sum()) < 1e-3:
                continue
            gain = score(left) + score(right) - score(own)
            if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-12)):
                best = (gain, left, right)
    return best


def plain_tree(rows, g, h, leaves, least, lam, categorical=()):
    """The leaf value of each row when the leaf of most gain is split first."""
    parts = [(np.arange(len(rows)), plain_best(rows, g, h, np.arange(len(rows)), least, lam, categorical))]
    while len(parts) < leaves:
        able = [i for i, (_, s) in enumerate(parts) if s]
        if not able:
            break
        top = max(able, key=lambda i: parts[i][1][0])
        _, (_, left, right) = parts.pop(top)
        parts += [(p, plain_best(rows, g, h, p, least, lam, categorical)) for p in (left, right)]
    out = np.zeros(len(rows))
    for own, _ in parts:
        out[own] = -g[own].sum() / (h[own].sum() + lam)
    return out, len(parts)


@pytest.mark.parametrize("leaves, least, lam, seed", [(7, 5, 0.0, 1), (12, 3, 2.5, 2), (31, 1, 0.1, 3), (2, 20, 0.0, 4)])
def test_best_first_growth(leaves, least, lam, seed):
    rng = np.random.default_rng(seed)
    rows = np.stack([rng.integers(0, 12, 300), rng.integers(0, 6, 300), rng.integers(0, 9, 300)], axis=1).astype(np.int16)
    g = np.where(rows[:, 0] > 6, 1.0, -0.5) * (1 + rows[:, 1] % 2) + rng.normal(size=300)
    h = rng.random(300) + 0.1
    bins = hs.Bins({0: np.arange(11.0), 2: np.arange(8.0)}, [12, 6, 9])
    histograms, passes = in_memory(bins, rows, g, h)
    tree = hs.grow(histograms, bins, hs.Growth(leaves, least, lam, columns=[0, 1, 2]))
    want, count = plain_tree(rows, g, h, leaves, least, lam, {1})
    assert tree.predict(rows) == pytest.approx(want)
    used = np.unique(tree.leaves(rows))
    assert len(used) == count <= leaves
    # a pass covers a level or more, not one split
    assert len(passes) <= max(2, count - 1)


def test_depth_is_bounded():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 20, (200, 1)).astype(np.int16)
    g, h = rng.normal(size=200), np.ones(200)
    bins = hs.Bins({0: np.arange(19.0)}, [20])
    histograms, _ = in_memory(bins, rows, g, h)
    tree = hs.grow(histograms, bins, hs.Growth(31, 1, 0.0, max_depth=2, columns=[0]))
    assert len(np.unique(tree.leaves(rows))) <= 4


def test_bins_take_edges_to_the_left():
    bins = hs.Bins({0: np.array([1.0, 2.0])}, [3, 4])
    assert bins.of(np.array([[1.0, 0], [1.5, 3], [2.0, 9], [7.0, -1]])).tolist() == [[0, 0], [1, 3], [1, 3], [2, 0]]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(9)
    out = []
    for split, n in (("train", 600), ("valid", 200)):
        for i in range(n):
            a, b, c = int(rng.integers(0, 15)), int(rng.integers(0, 5)), float(rng.integers(0, 30))
            p = 1 / (1 + math.exp(-(0.4 * (a % 3) - 0.5 * b + 0.05 * c)))
            out.append((split, i, f"u{i % 25}", f"t{b}", float(a), c, int(rng.random() < p)))
    return spark.createDataFrame(
        out, "split string, row_id long, user_id string, cat_tab string, a double, c double, long_view int"
    ).cache()


def test_boosting_equals_plain_boosting(frame):
    model = trees.fit_gbt(frame, ["cat_tab", "a", "c"], n_estimators=3, num_leaves=6, lr=0.3, min_child_samples=10, reg_lambda=1.0)
    rows = sorted(frame.where("split = 'train'").collect(), key=lambda r: r["row_id"])
    codes = {v: i for i, v in enumerate(dict.fromkeys(r["cat_tab"] for r in rows))}
    x = np.array([[codes[r["cat_tab"]], r["a"], r["c"]] for r in rows])
    y = np.array([r["long_view"] for r in rows], dtype=float)
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        g, h = hs.derivatives(score, y)
        values, leaves = plain_tree(x, g, h, 6, 10, 1.0, {0})
        assert leaves == 6
        score = score + 0.3 * values
    got = {r["row_id"]: r["score"] for r in model.score(frame).where("split = 'train'").collect()}
    assert [got[r["row_id"]] for r in rows] == pytest.approx((1 / (1 + np.exp(-score))).tolist())


def test_written_scores_change_nothing(frame, monkeypatch):
    args = dict(n_estimators=4, num_leaves=4, lr=0.2)
    scores = lambda: sorted(tuple(r) for r in trees.fit_gbt(frame, ["a", "c"], **args).score(frame).select("split", "row_id", "score").collect())
    whole = scores()
    monkeypatch.setattr(trees, "CHECKPOINT_ROUNDS", 2)
    assert [s[2] for s in scores()] == pytest.approx([s[2] for s in whole])


def test_samples_differ_by_seed(frame):
    fit = lambda seed: trees.fit_gbt(frame, ["cat_tab", "a", "c"], n_estimators=2, num_leaves=4, subsample=0.5, colsample=0.7, seed=seed)
    one, two = (fit(s).score(frame).agg(F.sum("score")).first()[0] for s in (1, 2))
    assert one != two


def test_no_rows(frame):
    with pytest.raises(RuntimeError):
        trees.fit_gbt(frame.where("split = 'valid'"), ["a"], n_estimators=1)


def test_parts_of_a_pass_follow_the_rows(frame):
    from rankweave.models import common

    session = frame.sparkSession
    before = session.conf.get("spark.sql.shuffle.partitions")
    session.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        # 800 rows are one part, whatever the shuffle width
        assert common.even(frame, frame).rdd.getNumPartitions() == 1
    finally:
        session.conf.set("spark.sql.shuffle.partitions", before)
    assert common.part_count(0, 12) == 1
    assert common.part_count(280_000, 12) == 12
    assert common.part_count(17_000_000, 12) == -(-17_000_000 // common.PART_ROWS)


def test_passes_over_ranking_gradients_follow_the_rows(frame, monkeypatch):
    """The windows below leave as many parts as the shuffle width."""
    seen, plain = [], trees.pass_over

    def spy(rows, *rest):
        seen.append(rows.rdd.getNumPartitions())
        return plain(rows, *rest)

    monkeypatch.setattr(trees, "pass_over", spy)
    session = frame.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        trees.fit_lambdarank(frame, ["cat_tab", "a", "c"], group_by="user", n_estimators=1, num_leaves=3)
    finally:
        session.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen == [1]
