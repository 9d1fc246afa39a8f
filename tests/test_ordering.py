"""Hot groups must give the same answers as ordinary ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.evaluation import experiments as ex, metrics as m
from rankweave.operators import blend, sets
from rankweave.plans import ordering as o
from rankweave.plans.quantiles import fit_quantiles, quantiles
from rankweave.sources.impressions import add_row_id

HOT = 5  # rows above which a test group counts as hot


@pytest.fixture(scope="module")
def skewed(spark):
    """One user with two thirds of the rows, half of them under one score; null users too."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        user = "hot" if i % 3 else (None if i % 7 == 0 else f"u{i % 40}")
        score = 0.5 if i % 2 else rng.choice([rng.random(), round(rng.random(), 1)])
        rows.append(("valid", i, user, 20240101 + i % 9, score, int(rng.random() < 0.4)))
    return spark.createDataFrame(
        rows, "split string, row_id long, user_id string, date int, score double, long_view int"
    ).cache()


def same(a, b, places=9):
    def plain(df):
        return sorted(
            tuple(round(v, places) if isinstance(v, float) else v for v in r)
            for r in map(tuple, df.select(sorted(df.columns)).collect())
        ) if not _has_null(df) else sorted(
            map(repr, (tuple(round(v, places) if isinstance(v, float) else v for v in r)
                       for r in map(tuple, df.select(sorted(df.columns)).collect())))
        )

    assert plain(a) == plain(b)


def _has_null(df):
    return any(v is None for r in df.collect() for v in r)


def test_hot_groups_are_found_and_bounded(skewed):
    found = o.find_hot(skewed, ["split", "user_id"], HOT)
    assert {r["user_id"] for r in found.collect()} >= {"hot"}
    assert o.find_hot(skewed, ["split", "user_id"]) is None


def test_peer_totals(skewed):
    rows = skewed.withColumn("one", F.lit(1)).select("user_id", "row_id", "score", "one", "long_view")
    args = (["user_id"], ["score"], ["one", "long_view"])
    same(o.peer_totals(rows, *args, min_rows=HOT), o.peer_totals(rows, *args))


def test_peer_totals_against_plain_counting(skewed):
    out = o.peer_totals(
        skewed.where("user_id = 'hot'").withColumn("one", F.lit(1)), ["user_id"], ["score"], ["one"], HOT
    ).collect()
    scores = [r["score"] for r in out]
    for r in out:
        assert r["one_before"] == sum(s < r["score"] for s in scores)
        assert r["one_peers"] == sum(s == r["score"] for s in scores)
        assert r["one_total"] == len(scores)


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_before(skewed, how):
    args = (["user_id"], ["row_id"], ["score"])
    rows = skewed.select("user_id", "row_id", "score")
    same(o.running_before(rows, *args, how=how, min_rows=HOT), o.running_before(rows, *args, how=how))


def test_group_totals(skewed):
    aggs = {"n": F.count(F.lit(1)), "top": F.max("score")}
    rows = skewed.select("user_id", "row_id", "score")
    same(o.group_totals(rows, ["user_id"], aggs, HOT), o.group_totals(rows, ["user_id"], aggs))


def test_metrics_and_ranks_do_not_depend_on_the_path(skewed):
    known = skewed.where("user_id is not null")
    same(m.evaluate(known, min_rows=HOT), m.evaluate(known))
    same(sets.percent_rank(known, min_rows=HOT), sets.percent_rank(known))
    same(sets.set_context(known, ["score"], "user", HOT), sets.set_context(known, ["score"], "user"))
    same(sets.listwise_targets(known, "user", min_rows=HOT), sets.listwise_targets(known, "user"))
    same(blend.rank_average([known, known], [2, 1], HOT), blend.rank_average([known, known], [2, 1]))


def test_joins_do_not_depend_on_the_path(skewed):
    from rankweave.operators.joins import drop_rejected

    known = skewed.where("user_id is not null")
    same(sets.mixed_sets(known, "user", min_rows=HOT), sets.mixed_sets(known, "user"))
    tried = skewed.select(F.col("user_id").alias("hypothesis_id"), "row_id")
    for refused in ("hot", "u1"):
        verdicts = skewed.where(F.col("user_id") == refused).select(
            F.col("user_id").alias("hypothesis_id"), F.lit(False).alias("accepted")
        )
        same(drop_rejected(tried, verdicts, min_rows=HOT), drop_rejected(tried, verdicts))
        assert drop_rejected(tried, verdicts, min_rows=HOT).where(F.col("hypothesis_id") == refused).count() == 0


def test_reports_do_not_depend_on_the_path(skewed):
    runs = skewed.where("user_id is not null").select(
        F.col("user_id").alias("run_id"), F.col("row_id").alias("iteration"), F.col("score").alias("primary")
    )
    same(ex.iteration_report(runs, 0.6, min_rows=HOT), ex.iteration_report(runs, 0.6))


def test_row_ids_are_dense_with_copies(spark):
    rows = [("train", 1, "a")] * 50 + [("train", i, "b") for i in range(100)] + [("test", 3, "c")] * 7
    df = spark.createDataFrame(rows, "split string, date int, user_id string")
    out = add_row_id(df, ["date"]).collect()
    for split, n in (("train", 150), ("test", 7)):
        ids = sorted(r["row_id"] for r in out if r["split"] == split)
        assert ids == list(range(n))
        dates = [r["date"] for r in sorted(out, key=lambda r: r["row_id"]) if r["split"] == split]
        assert dates == sorted(dates)


def test_row_ids_of_an_empty_log(spark):
    df = spark.createDataFrame([], "split string, date int")
    assert add_row_id(df, ["date"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(20, n), 1)
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "a double, b double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = fit_quantiles(df, ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(values, probs))
    assert np.allclose(got["b"], np.quantile(np.arange(n), probs))


def test_quantiles_skip_nulls_and_constants(spark):
    df = spark.createDataFrame([(None, 4.0), (1.0, 4.0), (3.0, 4.0)], "a double, b double")
    assert fit_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [4.0]}
    assert quantiles(df.where("a > 5"), ["a"], [0.5]).count() == 0


def test_top_rows_limit_below_the_exchange(skewed):
    out = sets.top_k_per_user(skewed, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
