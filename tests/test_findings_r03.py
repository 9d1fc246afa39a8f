"""Cases of the third round's findings."""

from collections import Counter

from pyspark.sql import functions as F

from rankweave.operators import joins
from rankweave.plans.keyed import key_counts


def test_key_counts_are_dealt_by_rows(spark):
    """the parts follow from the rows, not from the bytes of their keys."""
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("a"), (F.col("id") % 20_000 % 3).cast("string").alias("b"))
    got = key_counts(df, ["a", "b"], part_rows=4_000)
    assert got.rdd.getNumPartitions() >= 10
    assert got.where("copies = 2").count() == got.count() == 20_000


def test_key_counts_of_hot_and_null_keys(spark):
    keys = [None] * 700 + [7] * 900 + [*range(300)] * 2
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    got = {r["k"]: r["copies"] for r in key_counts(df, ["k"], part_rows=100).collect()}
    assert got == dict(Counter(keys))
    assert key_counts(df.limit(0), ["k"]).count() == 0
    found = joins.merge_violations(df, df.distinct(), ["k"]).collect()
    assert {(r["k"], r["side"]) for r in found} == {(k, "left") for k in set(keys)}


def test_small_parameters_score_rows_in_place(spark, monkeypatch):
    """F6, F7, F8, F10: no row is exploded or exchanged; the scores are those of the joins."""
    import numpy as np

    from rankweave.models import deep, fm
    from rankweave.models.losses import Tower

    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)] + [(-1, [0.3, 0.0, 0.0, 0.0])], "id long, p array<double>")
    ids = F.array(*[(F.col("row_id") * (f + 2) % 3 + 3 * f).cast("int") for f in range(3)])
    rows = spark.range(200).select(F.lit("test").alias("split"), F.col("id").alias("row_id"), F.col("id").alias("user_id"))
    rows = rows.select("*", ids.alias("ids"), F.array(F.col("row_id") / 100.0).alias("numbers"))

    class Encoder:
        dimension, fields = 9, ["a", "b", "c"]

    def values(df):
        assert df.count() == 200
        return np.array([r["score"] for r in df.orderBy("row_id").collect()])

    tower = Tower(3, 3, 1, 5, [1.0])
    near = table.where("id >= 0")
    for raw in (False, True):
        model = fm.FmModel(Encoder, fm.named(table, 3), 3, [], raw=raw)
        local = fm._scores(rows, model)
        assert "Exchange" not in local._jdf.queryExecution().toString()
        with monkeypatch.context() as m:
            m.setattr(fm, "BROADCAST_BYTES", 0)
            assert np.allclose(values(local), values(fm._scores(rows, model)))
    dense = tower.start(3)
    local = deep.network_scores(rows, near, tower, dense, 9)
    assert np.allclose(values(local), values(deep.network_scores(rows, near, tower, dense)))


def test_lambdas_take_one_exchange(spark):
    """rows are dealt once, and sets that go over several batches are those of the hot way."""
    from rankweave.models import trees
    from rankweave.plans.ordering import find_hot

    row = F.col("id")
    user = F.when(row % 3 == 0, "long").otherwise((row % 100).cast("string"))
    rows = spark.range(3_000).select(
        F.lit("train").alias("split"), user.alias("user_id"), row.alias("row_id"),
        (F.xxhash64("id") % 50 / 10.0).alias("score"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("double").alias("label"),
    )
    keys = ["split", "user_id"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = trees.lambdas(rows, keys, hot=None)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        found = {r["row_id"]: (r["g"], r["h"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hot = find_hot(rows, keys, 20)
    want = {r["row_id"]: (r["g"], r["h"]) for r in trees.lambdas(rows, keys, hot=hot).collect()}
    assert len(found) == len(want) == 3_000
    assert all(abs(x - y) < 1e-9 for n in want for x, y in zip(found[n], want[n]))
    assert trees.lambdas(rows.limit(0), keys, hot=None).count() == 0
