"""The findings of round 4: boosted trees fit all their trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.catalog import modelling
from rankweave.models import histograms as hs
from rankweave.models import trees
from rankweave.plans import ordering


@pytest.fixture(scope="module")
def frame(spark):
    row = F.col("id")
    value = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(97)) / 10.0
    return spark.range(900).select(
        F.when(row < 700, "train").otherwise("valid").alias("split"), row.alias("row_id"),
        F.concat(F.lit("u"), F.sqrt("id").cast("int")).alias("user_id"), F.lit(20240101).alias("date"),
        *[(value(n) if "cat_" not in c else value(n).cast("int").cast("string")).alias(c) for n, c in enumerate(modelling.FEATURES)],
        (value(0) + value(5) + value(50) > 14).cast("int").alias("long_view"),
    ).cache()


@pytest.mark.parametrize("name", ["gbt_binary", "lambdarank"])
def test_queries_fit_all_trees(spark, frame, monkeypatch, name):
    """the published 200, not a bench size."""
    grown = []

    def leaf(histograms, bins, growth):
        grown.append(growth)
        return hs.Tree(np.zeros(1, np.int32), np.array([-1], np.int32), np.array([-1], np.int32), np.zeros((1, 256), bool), np.zeros(1))

    monkeypatch.setattr(modelling, "model_frame", lambda spark, sf: frame)
    monkeypatch.setattr(trees, "grow", leaf)
    getattr(modelling, name)(spark, "")
    assert len(grown) == 200 and {g.num_leaves for g in grown} == {31}


def _scores(model, frame):
    return {(r["split"], r["row_id"]): r["score"] for r in model.score(frame).collect()}


def test_sets_too_large_for_a_task_change_nothing(frame, monkeypatch):
    """the way of the hot sets, by frames, against the blocks."""
    fit = lambda: trees.fit_lambdarank(frame, modelling.FEATURES, n_estimators=4, num_leaves=5, lr=0.3, min_child_samples=5, subsample=0.8)
    want = _scores(fit(), frame)
    monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 40)
    monkeypatch.setattr(trees, "CHECKPOINT_ROUNDS", 2)
    called, plain = [], trees._fitted_hot
    monkeypatch.setattr(trees, "_fitted_hot", lambda *a: called.append(1) or plain(*a))
    got = _scores(fit(), frame)
    assert called and len(got) == 900 and len(set(got.values())) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_parts_and_blocks_change_nothing(spark, frame, monkeypatch):
    fit = lambda: trees.fit_gbt(frame, modelling.FEATURES, n_estimators=3, num_leaves=6, lr=0.3, min_child_samples=5, subsample=0.7)
    want = _scores(fit(), frame)
    # more tasks than send their sums to the driver, of several blocks
    monkeypatch.setattr(hs, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hs, "SENT", 2)
    monkeypatch.setattr(trees, "even", lambda df, counted: df.repartition(9))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    try:
        got = _scores(fit(), frame)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_do_not_cut_sets(spark, monkeypatch):
    monkeypatch.setattr(hs, "BLOCK_ROWS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = spark.range(100).repartition(1).sortWithinPartitions("id").select(
        F.array(F.col("id").cast("short")).alias("bins"), F.col("id").isin(0, 3, 4, 40, 41, 70).alias("begins"),
    )
    try:
        found = hs.in_blocks(rows).rdd.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [b.bins.ravel().tolist() for b in found] == [list(range(*r)) for r in ((0, 40), (40, 70), (70, 100))]
    assert all(b.begins[0] for b in found)


def test_draws_are_those_of_spark(spark):
    values = [0, 1, -1, 2**62 + 12345, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for seed in (0, 7, -3):
        want = [r[0] for r in df.select(F.xxhash64(F.lit(seed), "v")).collect()]
        assert hs.xxhash64(seed, np.array(values)).tolist() == want
