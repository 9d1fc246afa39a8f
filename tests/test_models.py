import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.evaluation import metrics as m
from rankweave.models import common, deep, fm, listwise, multitask, trees
from rankweave.operators import blend, sets

FEATURES = ["cat_item", "cat_tab", "numeric"]


@pytest.fixture(scope="module")
def data(spark):
    """Half of the items are liked; noise elsewhere."""
    rng = np.random.default_rng(0)
    out = []
    for split, users in (("train", 30), ("valid", 12), ("test", 12)):
        n = 0
        for u in range(users):
            for _ in range(8):
                item = int(rng.integers(0, 10))
                liked = 0.9 if item < 5 else 0.1
                out.append((split, n, f"u{u}", 20220408 + int(rng.integers(0, 3)), f"v{item}", f"t{item % 3}",
                            float(item) + float(rng.normal(0, 0.1)), int(rng.random() < liked), int(rng.random() < liked)))
                n += 1
    return spark.createDataFrame(
        out,
        "split string, row_id long, user_id string, date int, cat_item string, cat_tab string, numeric double,"
        " long_view int, is_click int",
    ).cache()


def check(data, pred, floor=0.6):
    """One finite score per row, and better than a constant."""
    got = pred.select("split", "row_id", "score").collect()
    assert len(got) == data.count() == len({(r[0], r[1]) for r in got})
    assert all(math.isfinite(r[2]) for r in got)
    constant = common.primary_of(data.withColumn("score", F.lit(0.0)))
    reached = common.primary_of(m.with_labels(pred.select("split", "row_id", "user_id", "score"), data))
    assert reached > max(floor, constant)
    return {(r[0], r[1]): r[2] for r in got}


def test_fm(data):
    args = dict(k=4, lr=0.1, epochs=4, numeric_bins=4, batch_size=32)
    model = fm.fit_fm(data, FEATURES, **args)
    scores = check(data, model.score(data))
    again = {(r["split"], r["row_id"]): r["score"] for r in fm.fit_fm(data, FEATURES, **args).score(data).collect()}
    assert again == pytest.approx(scores)
    # the primary is taken after every epoch, and patience counts epochs
    assert len(model.history) <= 4
    stopped = fm.fit_fm(data, FEATURES, k=4, lr=1e-12, epochs=8, numeric_bins=4, patience=1)
    assert len(stopped.history) <= 4


def test_fm_in_shards(data):
    model = fm.fit_fm(data, FEATURES, k=4, lr=0.1, epochs=6, numeric_bins=4, batch_size=32, shard_batch=8, round_steps=2)
    check(data, model.score(data))


def test_hashed_fm(data):
    check(data, fm.fit_fm(data, FEATURES, k=2, lr=0.1, epochs=6, batch_size=32, hashed=64).score(data))


def test_vocabularies_stay_exact(spark):
    """No size makes two values share a slot."""
    rows = [("train", i, f"u{i % 50}", f"v{i}", i % 2) for i in range(40_000)]
    df = spark.createDataFrame(rows, "split string, row_id long, user_id string, cat_item string, long_view int")
    df = df.unionByName(df.where("row_id < 300").withColumn("split", F.lit("valid")))
    model = fm.fit_fm(df, ["cat_item"], k=1, epochs=1, batch_size=1 << 14)
    assert model.encoder.hashed is None and model.encoder.dimension == 40_001
    assert model.params.count() == 40_002  # and the bias


def pair_setup(spark):
    rng = np.random.default_rng(1)
    k, dim = 3, 6
    params = [(i, float(rng.normal()), *map(float, rng.normal(size=k))) for i in range(dim)]
    table = spark.createDataFrame(params, "id long, w double, " + ", ".join(f"v{f} double" for f in range(k)))
    rows = spark.createDataFrame([(0, [0, 1]), (1, [2, 3]), (2, [0, 3])], "row_id long, ids array<int>")
    pairs = spark.createDataFrame([("a", 0, 1), ("b", 2, 1)], "pair_id string, pos_row long, neg_row long")
    return np.array([p[1:] for p in params]), table, rows, pairs, k, dim


def pair_loss(flat, ids, pairs, k):
    p = flat.reshape(-1, k + 1)

    def z(row):
        w, v = p[ids[row], 0], p[ids[row], 1:]
        return w.sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum()

    return sum(math.log1p(math.exp(-(z(a) - z(b)))) for a, b in pairs)


def test_pair_gradient_is_the_derivative(spark):
    start, table, rows, pairs, k, dim = pair_setup(spark)
    grads, _ = fm.pair_gradients(pairs, rows, table, dim, k)
    got = {r["id"]: [r["g_w"], *[r[f"g_v{f}"] for f in range(k)]] for r in grads.collect()}
    ids, ps, eps = {0: [0, 1], 1: [2, 3], 2: [0, 3]}, [(0, 1), (2, 1)], 1e-6
    for i in range(dim):
        for c in range(k + 1):
            up, down = start.copy(), start.copy()
            up[i, c] += eps
            down[i, c] -= eps
            want = (pair_loss(up.ravel(), ids, ps, k) - pair_loss(down.ravel(), ids, ps, k)) / (2 * eps)
            assert got.get(i, [0.0] * (k + 1))[c] == pytest.approx(want, abs=1e-6)


def test_fm_pairwise(data):
    model = fm.fit_fm_pairwise(
        data, FEATURES, k=4, lr=0.1, epochs=6, batch_size=32, numeric_bins=4, pairwise_epochs=2, pairwise_lr=0.01,
        pair_batch=16,
    )
    check(data, model.score(data))
    assert len(model.history) >= 2


def test_pairwise_learns_from_nothing(data):
    """Differences alone, from zero weights, rank as well as the labels allow."""
    base = fm.fit_fm(data, FEATURES, k=2, lr=1e-9, epochs=1, numeric_bins=4)
    model = fm.fit_fm_pairwise(data, FEATURES, base=base, pairwise_epochs=6, pairwise_lr=0.05, pair_batch=16)
    assert max(model.history) > model.history[0] + 0.05
    check(data, model.score(data))


def test_unordered_categories_are_split_as_sets(spark):
    """Odd codes are liked: no threshold on the code tells the classes apart."""
    rows = [(s, i, f"u{i // 24}", f"v{i % 24:02d}", (i % 24) % 2) for s in ("train", "valid") for i in range(960)]
    df = spark.createDataFrame(rows, "split string, row_id long, user_id string, cat_item string, long_view int")
    model = trees.fit_gbt(df, ["cat_item"], n_estimators=1, num_leaves=2, min_child_samples=1)
    assert common.primary_of(model.score(df)) > 0.99
    # beyond the limit, values are ordered by their label rate
    wide = df.withColumn("cat_item", F.concat("cat_item", F.col("row_id") % 5))
    prep = trees.fit_dense(wide, ["cat_item"], rate_label="long_view", most_sets=64)
    assert set(prep.rates) == {"cat_item"} and prep.largest == 0
    model = trees.fit_gbt(wide, ["cat_item"], n_estimators=1, num_leaves=2, min_child_samples=1)
    assert common.primary_of(model.score(wide)) > 0.99


def test_gbt(data):
    check(data, trees.fit_gbt(data, FEATURES, n_estimators=5, num_leaves=8, min_child_samples=5).score(data))


def brute_lambdas(scores, labels, top):
    """The published LambdaRank loop with gains 0 and 1, one set."""
    n = len(scores)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    ideal = sum(1 / math.log2(r + 2) for r in range(min(top, sum(labels))))
    g, h, total = [0.0] * n, [0.0] * n, 0.0
    for a in range(min(n - 1, top)):
        for b in range(a + 1, n):
            i, j = order[a], order[b]
            if labels[i] == labels[j]:
                continue
            high, low = (i, j) if labels[i] else (j, i)
            gap = scores[high] - scores[low]
            weight = abs(1 / math.log2(a + 2) - 1 / math.log2(b + 2)) / ideal
            if max(scores) != min(scores):
                weight /= 0.01 + abs(gap)
            p = 1 / (1 + math.exp(gap))
            g[high] -= p * weight
            g[low] += p * weight
            h[high] += p * (1 - p) * weight
            h[low] += p * (1 - p) * weight
            total += 2 * p * weight
    scale = math.log2(1 + total) / total if total > 0 else 1.0
    return [x * scale for x in g], [x * scale for x in h]


@pytest.mark.parametrize("top, hot_rows", [(30, None), (3, None), (3, 4)])
def test_lambdas_equal_the_pair_loop(spark, top, hot_rows):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    n = 0
    for u, size in enumerate((2, 9, 14)):
        scores = [float(x) for x in np.round(rng.normal(size=size), 1)]
        labels = [1, 0] + [int(x) for x in rng.integers(0, 2, size - 2)]
        g, h = brute_lambdas(scores, labels, top)
        for i in range(size):
            rows.append(("train", n, f"u{u}", scores[i], float(labels[i])))
            want[n] = (g[i], h[i])
            n += 1
    df = spark.createDataFrame(rows, "split string, row_id long, user_id string, score double, label double")
    keys = ["split", "user_id"]
    from rankweave.plans.ordering import find_hot

    hot = find_hot(df, keys, hot_rows) if hot_rows else None
    assert (hot is not None) == bool(hot_rows)
    for r in trees.lambdas(df, keys, truncation=top, hot=hot).collect():
        assert (r["g"], r["h"]) == pytest.approx(want[r["row_id"]], abs=1e-12)


@pytest.mark.parametrize("by", ["user", "user_date"])
def test_lambdarank(data, by):
    model = trees.fit_lambdarank(data, FEATURES, by, n_estimators=4, num_leaves=8, lr=0.3, min_child_samples=5)
    check(data, model.score(data))
    with pytest.raises(ValueError):
        trees.fit_lambdarank(data, FEATURES, "user_id")


NETWORK = dict(embedding_dim=4, hidden_dim=8, batch_size=32, epochs=4, lr=0.03)


def test_deepfm(data):
    model = deep.fit_deepfm(data, FEATURES, **NETWORK)
    check(data, model.score(data))
    assert len(model.history) <= 4 and model.dense.size >= model.tower.size
    stopped = deep.fit_deepfm(data, FEATURES, **{**NETWORK, "lr": 0.0, "patience": 1})
    assert len(stopped.history) == 2


def test_deepfm_without_categories_or_valid_rows(data):
    few = data.where("split <> 'valid'")
    model = deep.fit_deepfm(few, ["numeric"], **{**NETWORK, "epochs": 2})
    assert model.history == [] and model.score(data).count() == data.count()


def test_network_keeps_the_vocabulary_off_the_driver(spark):
    """A million values in a field: the driver gets the dense weights alone."""
    base = spark.range(1_000_000).select(
        F.lit("train").alias("split"), F.col("id").alias("row_id"), F.concat(F.lit("u"), F.col("id") % 500).alias("user_id"),
        F.concat(F.lit("v"), F.col("id")).alias("cat_item"), (F.col("id") % 3 == 0).cast("int").alias("long_view"),
    )
    df = base.unionByName(base.where("row_id < 2000").withColumn("split", F.lit("valid")))
    model = deep.fit_deepfm(df, ["cat_item"], embedding_dim=2, hidden_dim=2, epochs=1, batch_size=1 << 17, shard_batch=1 << 14)
    assert model.inputs.dimension == 1_000_001 and model.embeddings.count() == 1_000_001
    assert model.dense.size < 30


def test_multitask(data):
    model = multitask.fit_multitask(data, FEATURES, ["is_click"], **NETWORK)
    check(data, model.score(data))
    assert model.tower.weights == [1.0, 0.3]
    other = multitask.fit_multitask(data, FEATURES, ["is_click"], **NETWORK, seed=2)
    assert not np.allclose(model.dense, other.dense)
    from rankweave.evaluation.guards import LeakageError

    with pytest.raises(LeakageError):
        multitask.fit_multitask(data, FEATURES, ["long_view"])
    timed = data.withColumn("play_time_ms", F.lit(1500))
    with pytest.raises(ValueError):
        multitask.fit_multitask(timed, FEATURES, ["play_time_ms"])


def test_listwise_gradient(spark):
    rows = [("train", "a", 1, 0.2, 1, 1.0), ("train", "a", 2, -0.1, 0, 3.0), ("train", "b", 3, 0.5, 1, -1.0),
            ("train", "b", 4, 0.0, 1, 2.0), ("train", "b", 5, 1.0, 0, 0.5)]
    df = spark.createDataFrame(rows, "split string, user_id string, row_id long, score double, long_view int, x double")
    out = listwise.listwise_gradient(df, ["split", "user_id"], ["x"]).first()
    loss, grad = 0.0, 0.0
    for u in "ab":
        part = [r for r in rows if r[1] == u]
        e = np.exp([r[3] for r in part])
        p, t = e / e.sum(), np.array([r[4] for r in part]) / sum(r[4] for r in part)
        loss -= (t * np.log(p)).sum()
        grad += ((p - t) * [r[5] for r in part]).sum()
    assert out["loss"] == pytest.approx(loss) and out["g_x"] == pytest.approx(grad) and out["sets"] == pytest.approx(2)


def test_listwise(data):
    model = listwise.fit_listwise(
        data.withColumn("numeric", -F.col("numeric")), ["numeric"], epochs=5, lr=0.1, set_batch=8, shard_batch=4, round_steps=5
    )
    check(data, model.score(data.withColumn("numeric", -F.col("numeric"))))


def test_listwise_steps_do_not_depend_on_the_shards(spark, monkeypatch):
    """An epoch has as many steps as batches, whatever the rounds and shards."""
    rows = [("train", i, f"u{i // 4}", 20220410, int(i % 4 == 0), float(-(i % 4))) for i in range(1200)]
    rows += [("valid", i, f"u{i // 4}", 20220410, int(i % 4 == 0), float(-(i % 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "split string, row_id long, user_id string, date int, long_view int, x double")
    found = {}
    for name, args in (("one", dict(shard_batch=30)), ("rounds", dict(shard_batch=30, round_steps=3)),
                       ("shards", dict(shard_batch=10, round_steps=4))):
        model = listwise.fit_listwise(df, ["x"], epochs=1, set_batch=30, lr=0.01, **args)
        found[name] = model.weights["x"]
    # every step of Adam moves the weight by about its rate: ten steps
    assert all(v == pytest.approx(0.1, rel=0.1) for v in found.values()), found


def test_listwise_learns_at_its_defaults(spark):
    rng = np.random.default_rng(4)
    rows = []
    for split, users in (("train", 2500), ("valid", 50)):
        for u in range(users):
            for _ in range(4):
                x = float(rng.normal())
                rows.append((split, len(rows), f"u{u}", 20220410, int(x + rng.normal(0, 0.3) > 0), x))
    df = spark.createDataFrame(rows, "split string, row_id long, user_id string, date int, long_view int, x double")
    model = listwise.fit_listwise(df, ["x"], patience=20, lr=5e-3, epochs=12)
    assert model.losses[-1] < 0.9 * model.losses[0] and model.weights["x"] > 0


def test_listwise_scores_depend_on_the_set(spark):
    rows = [("test", i, u, 20220429, 0, x) for i, (u, x) in enumerate(
        [("u0", 1.0), ("u0", 2.0), ("u0", 3.0), ("u1", 1.0), ("u1", 9.0), ("u1", 9.0)])]
    df = spark.createDataFrame(rows, "split string, row_id long, user_id string, date int, long_view int, x double")
    names = listwise.input_names(["x"])
    model = listwise.ListwiseModel(["x"], {"x": 0.0}, {n: (0.0, 1.0) for n in names}, {n: 1.0 for n in names}, [])
    got = {r["row_id"]: r["score"] for r in model.score(df).collect()}
    assert len(got) == 6 and got[0] != got[3]


def test_capped_sets(spark):
    df = spark.createDataFrame([("train", i, "u", 1) for i in range(100)], "split string, row_id long, user_id string, date int")
    draw = lambda seed: {r["row_id"] for r in sets.cap_sets(df, "user_date", 48, seed).collect()}
    assert len(draw(1)) == 48 and draw(1) == draw(1) and draw(1) != draw(2)


def test_bag_job(data):
    fit = lambda df, seed: trees.fit_gbt(
        df, FEATURES, n_estimators=2, num_leaves=4, subsample=0.8, min_child_samples=5, seed=seed
    ).score(df)
    check(data, blend.bag(fit, data, [0, 1]))
    out = blend.confirm_seeds(fit, data, m.evaluate, seeds=(11, 29))
    assert sorted(r["seed"] for r in out.collect()) == [11, 29]
