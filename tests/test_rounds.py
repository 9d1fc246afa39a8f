"""Training in rounds against plain Adam, and against itself in shards."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave.models import fm, losses, rounds
from rankweave.models.lazy import LazyAdam, fading, train_shard
from rankweave.models.rounds import Rounds, current, dense_rows, start_rows


def dense_adam(values, batches, gradient, lr, l2, decay=0.0):
    """Every parameter moves at every step; one without rows has no gradient."""
    p, m, u = values.copy(), np.zeros_like(values), np.zeros_like(values)
    for t, pick in enumerate(batches, 1):
        g, touched = gradient(p, pick)
        g = np.where(touched[:, None], g + l2 * p, 0.0)
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        p = np.where(touched[:, None], p * (1 - lr * decay), p)
        p = p - lr * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
    return p


def test_catching_up_equals_every_step():
    rng = np.random.default_rng(1)
    for since, now in ((3, 4), (1, 40), (250, 251), (700, 3000), (70_000, 70_009)):
        p, m, u = rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.random((4, 3)) + 0.1
        lazy = LazyAdam(p.copy(), m.copy(), u.copy(), np.full(4, since), 0.01)
        lazy.catch_up(np.arange(4), now)
        for t in range(since + 1, now + 1):
            m, u = 0.9 * m, 0.999 * u
            p = p - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
        assert lazy.values == pytest.approx(p, rel=1e-6, abs=1e-7)
        assert lazy.first == pytest.approx(m) and lazy.second == pytest.approx(u)
    assert fading(np.array([5]), 5) == 0


def numeric_gradient(loss, values):
    out = np.zeros_like(values)
    for j in range(values.size):
        up, down = values.copy(), values.copy()
        up.flat[j] += 1e-6
        down.flat[j] -= 1e-6
        out.flat[j] = (loss(up) - loss(down)) / 2e-6
    return out


def point_loss(p, ids, label, bias):
    z = losses.fm_parts(p, ids)[0] + bias
    return np.mean(np.log1p(np.exp(z)) - label * z)


def test_gradients_are_derivatives():
    rng = np.random.default_rng(2)
    ids, p = rng.integers(0, 5, (7, 3)), rng.normal(size=(5, 4))
    label = rng.integers(0, 2, 7).astype(float)
    dense = np.array([0.3, 0.0, 0.0, 0.0])
    g, whole = losses.PointLoss().gradient(p, ids, dense, {"label": label}, rng)
    assert g == pytest.approx(numeric_gradient(lambda q: point_loss(q, ids, label, 0.3), p), abs=1e-6)
    want = numeric_gradient(lambda b: point_loss(p, ids, label, b[0]), np.array([0.3]))
    assert whole[0] == pytest.approx(want[0], abs=1e-6) and not whole[1:].any()

    pairs = rng.integers(0, 5, (6, 4))
    differ = lambda q: np.mean(np.log1p(np.exp(losses.fm_parts(q, pairs[:, 2:])[0] - losses.fm_parts(q, pairs[:, :2])[0])))
    g, whole = losses.PairLoss().gradient(p, pairs, np.zeros(0), {}, rng)
    assert g == pytest.approx(numeric_gradient(differ, p), abs=1e-6) and not whole.size

    tower = losses.Tower(3, 3, 2, 5, [1.0, 0.3])
    dense, numbers = tower.start(3), rng.normal(size=(7, 2))
    rows = {"numbers": numbers, "label": rng.integers(0, 2, (7, 2)).astype(float)}

    def cross_entropy(q, d):
        z, _ = tower.forward(q[ids], numbers, d)
        return np.mean((np.log1p(np.exp(z)) - rows["label"] * z) * [1.0, 0.3])

    g, whole = tower.gradient(p, ids, dense, rows, rng)
    assert g == pytest.approx(numeric_gradient(lambda q: cross_entropy(q, dense), p), abs=1e-6)
    assert whole == pytest.approx(numeric_gradient(lambda d: cross_entropy(p, d), dense), abs=1e-6)
    dropped = losses.Tower(3, 3, 2, 5, [1.0, 0.3], dropout=0.5).gradient(p, ids, dense, rows, np.random.default_rng(1))[0]
    assert not np.allclose(dropped, g)


def test_a_shard_without_rows_in_a_step_skips_it():
    rows = pa.table({"row_id": [1], "ids": pa.array([[0]], pa.list_(pa.int32())), "label": [1.0]})
    s = lambda v: pa.array([[v, 0.0], [v, 0.1]], pa.list_(pa.float64()))
    params = pa.table({"id": [-1, 0], "at": [0, 0], "p": s(0.5), "m": s(0.0), "u": s(0.0)})
    out = train_shard(losses.PointLoss(), 0.1, 0.0, 0.0, 0, 1, 7)(rows, params)
    late = train_shard(losses.PointLoss(), 0.1, 0.0, 0.0, 0, 5, 7)(rows, params)
    # one step, then only what its moments still move
    gap = np.array(late["s"].to_pylist()) - np.array(out["s"].to_pylist())
    assert abs(gap[1, 0]) == pytest.approx(0.1 * fading(np.array([1]), 5)[0] * 0.1 / 0.001**0.5, rel=1e-3)
    assert out["touched"].to_pylist() == [1, 1]


@pytest.mark.parametrize("round_steps, rows", [(64, 90), (2, 90)])
def test_rounds_are_sequential_adam(spark, monkeypatch, round_steps, rows):
    """One shard in any number of rounds, with mail over blocks and epochs, against all parameters
    moving at every step."""
    monkeypatch.setattr(rounds, "BLOCK", 2)
    rng = np.random.default_rng(3)
    ids = np.stack([rng.integers(0, 4, rows), 4 + rng.integers(0, 60, rows)], axis=1)
    label = rng.integers(0, 2, rows)
    table = [(i, ids[i].tolist(), float(label[i])) for i in range(rows)]
    df = spark.createDataFrame(table, "row_id long, ids array<int>, label double")
    plan = Rounds(df, ["ids"], 10, 1, 3, round_steps)
    assert plan.rounds == -(-(-(-rows // 10)) // round_steps) and plan.shards == 1
    start = start_rows(spark, 70, 3, 5, 0.1).unionByName(dense_rows(spark, [0.2], 3))
    plan.begin(start)
    lr, l2 = 0.05, 1e-3
    for epoch in range(2):
        plan.epoch(losses.PointLoss(), lr, l2, 0.0, epoch)
        after = plan.table()
    got = {r["id"]: list(r["p"]) for r in current(after, plan.taken, lr, 3).collect()}

    placed = {r["row_id"]: r["round"] for r in plan.rows.collect()}
    batches = []
    for epoch in range(2):
        for n in range(plan.rounds):
            own = np.array(sorted(i for i, r in placed.items() if r == n), dtype=int)
            low, high = (x * plan.steps // plan.rounds for x in (n, n + 1))
            order = np.random.default_rng((epoch, epoch * plan.steps + low, len(own))).permutation(len(own))
            batches += [own[o] for o in np.array_split(order, high - low)]

    def gradient(p, pick):
        touched = np.zeros(len(p), dtype=bool)
        if not len(pick):
            return np.zeros_like(p), touched
        touched[0] = True
        touched[1 + np.unique(ids[pick])] = True
        g, whole = losses.PointLoss().gradient(p[1:], ids[pick], p[0], {"label": label[pick]}, None)
        return np.concatenate(([whole], g)), touched

    first = {r["id"]: r["s"][:3] for r in start.collect()}
    want = dense_adam(np.array([first[i] for i in range(-1, 70)]), batches, gradient, lr, l2)
    assert sorted(got) == list(range(-1, 70))
    assert np.array([got[i] for i in range(-1, 70)]) == pytest.approx(want, abs=1e-4)


def test_no_rows(spark):
    none = spark.createDataFrame([], "row_id long, ids array<int>, label double")
    with pytest.raises(RuntimeError):
        Rounds(none, ["ids"], 10, 1, 3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for split, n in (("train", 20_000), ("valid", 3000)):
        for i in range(n):
            item, user = int(rng.zipf(1.3)) % 300, int(rng.integers(0, 100))
            out.append((split, i, f"u{user}", f"v{item}", int(rng.random() < 0.2 + (item * 7 % 10) / 20 + user / 400)))
    return spark.createDataFrame(
        out, "split string, row_id long, user_id string, cat_item string, long_view int"
    ).withColumn("cat_user", F.col("user_id")).cache()


def test_shards_rank_as_well_as_one(rows):
    """The same steps in 1 and in 4 shards, averaged every 8 steps."""
    args = dict(k=4, lr=0.02, epochs=1, batch_size=512)
    best = lambda **more: max(fm.fit_fm(rows, ["cat_item", "cat_user"], **args, **more).history)
    assert best(shard_batch=128, round_steps=8) == pytest.approx(best(), abs=0.01)


def test_a_round_reads_only_its_own(rows):
    """The plan of a round scans the rows, the mail and the visits of that round alone."""
    train = rows.where("split = 'train'").select("row_id", F.array(F.crc32("cat_item") % 50).alias("ids"), F.lit(1.0).alias("label"))
    plan = Rounds(train, ["ids"], 100, 1, 2, round_steps=50)
    assert plan.rounds == 4
    read = plan.rows.where("round = 2")
    assert len(read.inputFiles()) == len(plan.rows.inputFiles()) or "PartitionFilters: [isnotnull(round" in (
        read._jdf.queryExecution().executedPlan().toString()
    )
    assert read.select("round").distinct().count() == 1
