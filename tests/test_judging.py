import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankweave.evaluation import analyses as an, experiments as ex, guards as g, metrics as m
from rankweave.functions.lineage import Lineage, tag
from rankweave.operators import blend
from rankweave.sources import submission as sub

PRED = "split string, row_id long, user_id string, long_view int, score double"


def pred(spark, data):
    return spark.createDataFrame([("valid", i, *r) for i, r in enumerate(data)], PRED)


def test_perfect_pair(spark):
    out = m.evaluate(pred(spark, [("u", 0, 0.1), ("u", 1, 0.9)])).first()
    assert (out["gauc"], out["ndcg5"], out["primary"]) == (1.0, 1.0, 1.0)


def test_one_class_users(spark):
    df = pred(spark, [("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.5), ("b", 0, 0.6), ("c", 1, 0.2)])
    out = m.evaluate(df).first()
    assert out["gauc"] == 1.0  # b and c are skipped
    assert out["ndcg5"] == pytest.approx(2 / 3)  # b scores 0 and counts


def test_ties_and_weighting(spark):
    df = pred(spark, [("a", 0, 0.5), ("a", 1, 0.5), ("b", 0, 0.1), ("b", 1, 0.9), ("b", 0, 0.2)])
    assert m.gauc(df).first()["gauc"] == pytest.approx((0.5 * 2 + 1.0 * 3) / 5)
    assert m.gauc(df, "uniform").first()["gauc"] == pytest.approx(0.75)
    with pytest.raises(ValueError):
        m.gauc(df, "rows")


def test_only_asked_splits_are_scored(spark):
    df = pred(spark, [("a", 0, 0.1), ("a", 1, 0.9)])
    both = df.unionByName(df.withColumn("split", F.lit("test")))
    assert [r["split"] for r in m.evaluate(both).collect()] == ["valid"]
    assert m.evaluate(both, ("train",)).count() == 0


def test_published_precision(spark):
    five = [(0.66735, 0.53570, 0.60152), (0.6674, 0.5357, 0.6016), (0.66745, 0.5357, 0.60168)]
    df = spark.createDataFrame([("valid", *r) for r in five], "split string, gauc double, ndcg5 double, primary double")
    mean = m.mean_metrics(df)
    assert all(r["ok"] for r in m.matches_baseline(mean).collect())
    off = mean.withColumn("gauc", F.col("gauc") + 0.0002)
    assert {r["metric"]: r["ok"] for r in m.matches_baseline(off).collect()}["gauc"] is False


def test_checkpoint_rule(spark):
    primaries = [0.5, 0.6, 0.600005, 0.59, 0.7, 0.1]
    df = spark.createDataFrame(list(enumerate(primaries)), "epoch int, primary double")
    out = rows(m.select_checkpoint(df, 2), "epoch")
    assert [r[2] for r in out] == [True, True, True, True, False, False]
    assert out[-1][4] == 1


def lineage_frame(spark, origin, name="f"):
    df = spark.createDataFrame([("train", 0, 1.0)], f"split string, row_id long, {name} double")
    return tag(df, {name: origin}) if origin else df


@pytest.mark.parametrize(
    "origin, rule",
    [
        (Lineage(("is_click",), "same_row"), "same_row_outcome"),
        (Lineage(("is_click",), "static"), "same_row_outcome"),
        (Lineage(("is_click",), "strictly_earlier"), None),
        (Lineage(("video_id",), "same_row"), None),
        (None, "missing_lineage"),
        (Lineage(("video_id",), "strictly_earlier", "randomized", 20220428), "randomized_after_cutoff"),
        (Lineage(("video_id",), "strictly_earlier", "randomized"), "randomized_after_cutoff"),
        (Lineage(("video_id",), "strictly_earlier", "randomized", 20220421), None),
    ],
)
def test_lineage_guard(spark, origin, rule):
    df = lineage_frame(spark, origin)
    assert [r["rule"] for r in g.check_lineage(df).collect()] == ([rule] if rule else [])
    if rule:
        with pytest.raises(g.LeakageError):
            g.require_lineage(df)


def test_outcome_name_is_refused_without_sources(spark):
    df = lineage_frame(spark, Lineage((), "same_row"), "play_time_ms")
    assert g.check_lineage(df).first()["rule"] == "same_row_outcome"


def test_tripwire_and_labels(spark):
    df = spark.createDataFrame([("valid", 0.81), ("test", 0.9), ("valid", 0.8)], "split string, primary double")
    assert rows(g.check_metrics(df)) == [("valid", 0.81)]
    with pytest.raises(g.LeakageError):
        g.require_metrics(df)
    assert g.require_auxiliary(["is_click", "play_time_ms"]) == ["is_click", "play_time_ms"]
    with pytest.raises(g.LeakageError):
        g.require_auxiliary(["long_view"])


def test_bag_and_rank_average(spark):
    base = spark.createDataFrame([("valid", i, "u") for i in range(4)], "split string, row_id long, user_id string")
    preds = [base.withColumn("score", F.col("row_id") + float(k)) for k in (1, 2, 3)]
    assert [r[3] for r in rows(blend.seed_bag(preds), "row_id")] == [2.0, 3.0, 4.0, 5.0]
    assert [r[3] for r in rows(blend.rank_average(preds), "row_id")] == [0.25, 0.5, 0.75, 1.0]
    for bad in ([1], [1, 1, float("nan")], [0, 0, 0]):
        with pytest.raises(ValueError):
            blend.seed_bag(preds, bad)
    for seeds in ([1], [1, 1], list(range(9))):
        with pytest.raises(ValueError):
            blend.bag(lambda df, seed: df, base, seeds)


@pytest.mark.parametrize(
    "score", [0.1, 1 / 3, 0.0, -2.5, 123456789.123456, 1e-5, 1.5e-7, 1e12, 123456789012345.0, 0.0001, 999999999999.4, 100.0]
)
def test_score_text(spark, score):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(sub.score_text(F.col("s"))).first()[0] == f"{score:.12g}"


def test_submission_round_trip(spark, tmp_path):
    imp = spark.createDataFrame(
        [("test", i, f"u{i % 3}", f"v{i}", i / 7) for i in range(20)],
        "split string, row_id long, user_id string, video_id string, score double",
    )
    path = sub.write_submission(imp, imp, str(tmp_path))
    back = sub.read_submission(spark, path)
    assert back.count() == 20 and sub.validate_submission(back, imp).count() == 0
    found = {r["problem"] for r in sub.validate_submission(back.where("row_id <> 3"), imp).collect()}
    assert found == {"missing_row", "not_contiguous"}
    twice = sub.validate_submission(back.unionByName(back.where("row_id = 3")), imp).collect()
    assert ("repeated_row") in {r["problem"] for r in twice}
    with pytest.raises(ValueError):
        sub.write_submission(imp, imp, str(tmp_path), filename="a/b.csv")
    with pytest.raises(ValueError):
        sub.write_submission(imp, imp, str(tmp_path), split="train")
    with pytest.raises(ValueError):
        sub.write_submission(imp.where("row_id > 0"), imp, str(tmp_path))
    with pytest.raises(ValueError):
        sub.write_submission(imp.withColumn("score", F.lit(float("nan"))), imp, str(tmp_path))


def decide(spark, base, candidate, seeds=None):
    cand = spark.createDataFrame([("c", candidate)], "candidate string, primary double")
    runs = None
    if seeds is not None:
        runs = spark.createDataFrame([("c", i, s) for i, s in enumerate(seeds)], "candidate string, seed int, score double")
    return ex.significance(base, cand, runs).first()


def test_significance(spark):
    assert not decide(spark, 0.6, 0.6016)["accepted"]
    assert decide(spark, 0.6, 0.60161)["accepted"]
    ok = decide(spark, 0.6, 0.6005, [0.6005, 0.6002, 0.5999])
    assert ok["accepted"] and ok["improving_seeds"] == 2 and ok["seeds"] == 3
    assert not decide(spark, 0.6, 0.6005, [0.6009, 0.5999, 0.5998])["accepted"]
    assert decide(spark, 0.6, 0.7, [0.5])["reason"] == "delta_above_two_sigma"
    with pytest.raises(Exception):
        decide(spark, 0.6, 0.6005, [0.61, 0.62])


def test_arms(spark):
    obs = lambda data: spark.createDataFrame(data, "arm string, delta double")
    nxt = lambda df: [r["arm"] for r in df.where("next").collect()]
    assert nxt(ex.arm_scores(["model", "features"], obs([("model", 0.1)]))) == ["features"]
    out = ex.arm_scores(["model", "features"], obs([("model", 0.02), ("features", 0.001), ("other", 9.0)]))
    assert nxt(out) == ["model"]
    bound = 0.02 + 0.25 * math.sqrt(math.log(2) / 1)
    assert {r["arm"]: r["ucb"] for r in out.collect()}["model"] == pytest.approx(bound)
    assert nxt(ex.arm_scores(["a", "b"], obs([("a", 0.1), ("b", 0.1)]))) == ["a"]
    with pytest.raises(ValueError):
        ex.arm_scores([], obs([("a", 0.1)]))


def test_stops(spark):
    def stop(deltas, max_iter=50, wall=1000.0, elapsed=1.0):
        df = spark.createDataFrame(
            [("r", i, d, elapsed) for i, d in enumerate(deltas)], "run_id string, seq int, delta double, elapsed_s double"
        )
        return ex.stop_reason(df, max_iter, wall).first()["stop_reason"]

    assert stop([0.1] * 4, max_iter=4) == "iteration_cap"
    assert stop([0.001] * 4, elapsed=1000.0) == "wall_clock_cap"
    assert stop([0.1, 0.002, 0.001, -0.1]) == "converged"
    assert stop([0.001, 0.001]) is None
    assert stop([0.001, 0.1, 0.001]) is None


def test_candidate_order_and_memory(spark):
    df = spark.createDataFrame([("multitask", 0.01), ("hyperparameters", 0.005), ("listwise", 0.02)], "name string, effect double")
    assert [r[0] for r in ex.order_candidates(df).collect()] == ["listwise", "multitask", "hyperparameters"]
    out = spark.createDataFrame([(i, f"h_{i:03d}", i % 2 == 0) for i in range(12)], "seq int, hypothesis_id string, accepted boolean")
    last = ex.last_outcomes(out, 10).collect()
    assert last[0]["hypothesis_id"] == "h_002" and len(last) == 10
    ids = {r[0] for r in ex.rejected_ids(out).collect()}
    assert "h_011" in ids and "h_010" not in ids


def test_ablation_table(spark):
    df = spark.createDataFrame(
        [(0, "raw", 0.53, None), (1, "side", 0.60, None), (2, "data", None, "ValueError")],
        "position int, node string, score_without double, error string",
    )
    table = ex.removal_costs(df, 0.605)
    got = {r["node"]: r for r in table.collect()}
    assert got["raw"]["removal_cost"] == pytest.approx(0.075)
    assert got["data"]["status"] == "not_ablatable:ValueError" and got["data"]["score_without"] == 0.605
    assert ex.limiting_node(table).first()["node"] == "raw"


def test_leave_one_out_reports_failures(spark):
    base = spark.createDataFrame([("train", 0)], "split string, row_id long")
    bundles = {n: base.withColumn(n, F.lit(1.0)) for n in ("a", "b")}

    def fit(parts):
        names = [c for p in parts for c in p.columns]
        if "b" not in names:
            raise RuntimeError("needs b")
        return names

    score = lambda names: 0.5 if "a" in names else 0.4
    out = ex.leave_one_out(bundles, fit, score, lambda b: base.withColumn("z", F.lit(0.0)), 0.5)
    got = {r["node"]: (round(r["removal_cost"], 6), r["status"]) for r in out.collect()}
    assert got == {"a": (0.1, "scored"), "b": (0.0, "not_ablatable:RuntimeError")}


def test_attainable_range(spark):
    df = spark.createDataFrame(
        [("valid", i, f"u{i % 4}", 0 if i % 4 == 0 else int(i % 3 == 0)) for i in range(48)],
        "split string, row_id long, user_id string, long_view int",
    )
    got = {r["kind"]: r for r in an.attainable_range(df, splits=("valid",)).collect()}
    assert got["perfect"]["gauc"] == 1.0 and got["perfect"]["ndcg5"] == 0.75
    assert got["constant"]["gauc"] == 0.5
    assert got["perfect"]["primary"] >= max(got["random"]["primary"], got["constant"]["primary"])
