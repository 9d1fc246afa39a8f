import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankweave.functions import lineage as ln, scalars as sc
from rankweave.operators import builder, encoders, history as h, joins, rowwise, sets
from rankweave.schemas import USER_CATEGORICAL, USER_NUMERIC, VIDEO_CATEGORICAL, VIDEO_NUMERIC
from rankweave.sources import impressions as src


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def pop(spark):
    hist = frame(spark, [(1, "a", 1), (2, "a", 0)], "date int, video_id string, long_view int")
    tgt = frame(
        spark, [("valid", i, i + 1, "a") for i in range(3)], "split string, row_id long, date int, video_id string"
    )
    return hist, tgt


def test_counts_are_strictly_earlier(pop):
    out = rows(h.item_popularity(*pop), "row_id")
    assert [r[2] for r in out] == [0.0, 1.0, 2.0]
    assert [r[3] for r in out] == [0.0, 1.0, 0.5]


def test_same_day_labels_do_not_count(spark):
    hist = frame(spark, [(1, "a", 0), (1, "a", 1), (2, "a", 0)], "date int, video_id string, long_view int")
    tgt = frame(spark, [("valid", 0, 1, "a")], "split string, row_id long, date int, video_id string")
    assert rows(h.item_popularity(hist, tgt)) == [("valid", 0, 0.0, 0.0)]


def test_unknown_key_gets_the_prior_and_null_is_a_key(spark):
    hist = frame(spark, [(1, "a", 1), (1, None, 0)], "date int, video_id string, long_view int")
    tgt = frame(
        spark, [("t", 0, 2, "z"), ("t", 1, 2, None)], "split string, row_id long, date int, video_id string"
    )
    out = rows(h.item_popularity(hist, tgt, 2.0), "row_id")
    assert out[0][2:] == (0.0, 0.5)
    assert out[1][2:] == (1.0, pytest.approx(1 / 3))


def test_user_history_gives_zero_without_rows(spark):
    hist = frame(spark, [(20240101, 5, 1), (20240103, 5, 0)], "date int, user_id int, long_view int")
    tgt = frame(
        spark,
        [("t", 0, 20240104, "5"), ("t", 1, 20240120, "5"), ("t", 2, 20240104, "6")],
        "split string, row_id long, date int, user_id string",
    )
    out = rows(h.user_history(hist, tgt, (1, 7)), "row_id")
    assert out[0][2:] == (1.0, 0.0, 2.0, 0.5)
    assert out[1][2:] == (0.0, 0.0, 0.0, 0.0)
    assert out[2][2:] == (0.0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def decay(spark):
    cols = "date int, user_id string, author_id string, long_view int, duration_ms long"
    hist = frame(spark, [(20220408, "u0", "a", 1, 1000), (20220409, "u0", "a", 0, 1000)], cols)
    tgt = frame(
        spark,
        [("t", i, 20220408 + i, "u0", "a", 1000) for i in range(3)],
        "split string, row_id long, date int, user_id string, author_id string, duration_ms long",
    )
    return hist, tgt


def test_decay_is_causal_and_prefers_recent(decay):
    def run(half):
        return [r[2:] for r in rows(h.decayed_affinity(*decay, half_life_days=half, alpha=0.0, centered=False), "row_id")]

    week = run(7.0)
    assert week[0][1] == 0.0
    assert week[1][0] == pytest.approx(1.0)
    assert 0.0 < week[2][0] < 1.0
    assert run(0.5)[2][0] < week[2][0]


def test_centered_lift_cancels_with_one_author(spark, decay):
    hist, tgt = decay
    last = tgt.where("row_id = 2")
    assert rows(h.decayed_affinity(hist, last, alpha=5.0))[0][2] == pytest.approx(0.0, abs=1e-9)


def test_decay_over_long_gaps_equals_the_direct_sum(spark):
    days = [0, 1, 2, 255, 256, 257, 300, 511, 512, 513, 900, 1500]
    data = [("k", d, 1 + d % 3, d % 2) for d in days]
    df = frame(spark, data, "key string, _day int, impressions long, positives long")
    for half in (0.001, 0.3, 1.0, 7.0):
        out = {r["_day"]: r for r in h.decayed_state(df, ["key"], half).collect()}
        for d in days:
            want = sum(n * 2.0 ** (-(d - e) / half) for _, e, n, _ in data if e < d)
            assert out[d]["weight"] == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_bad_parameters_are_refused(decay):
    with pytest.raises(ValueError):
        h.decayed_affinity(*decay, half_life_days=0)
    with pytest.raises(ValueError):
        h.decayed_affinity(*decay, attribute="user_id")
    with pytest.raises(ValueError):
        h.user_attribute_affinity(*decay, attribute="video_id")


def side_tables(spark):
    users = frame(spark, [(1,), (2,)], "user_id int")
    users = users.select(
        "user_id",
        *[F.lit("full_active" if c == "user_active_degree" else "x").alias(c) for c in USER_CATEGORICAL],
        *[F.lit("-3" if c == "fans_user_num" else "7").alias(c) for c in USER_NUMERIC],
    )
    videos = frame(spark, [(10,)], "video_id int").select(
        "video_id",
        *[F.lit("NORMAL").alias(c) for c in VIDEO_CATEGORICAL],
        *[F.lit("0" if c == "server_width" else "720").alias(c) for c in VIDEO_NUMERIC],
    )
    return users, videos


def test_static_side_keeps_rows_and_fills_misses(spark):
    users, videos = side_tables(spark)
    imp = frame(
        spark, [("train", 0, "1", "10", 1), ("train", 1, "99", "99", 0)],
        "split string, row_id long, user_id string, video_id string, long_view int",
    )
    out = joins.static_side(imp, users, videos, checked=True)
    got = {r["row_id"]: r for r in out.collect()}
    assert [got[i]["cat_su_user_active_degree"] for i in (0, 1)] == ["full_active", "UNK"]
    assert [got[i]["cat_sv_video_type"] for i in (0, 1)] == ["NORMAL", "UNK"]
    assert got[0]["su_log_fans_user_num"] == 0.0 and got[1]["su_log_fans_user_num"] is None
    assert got[0]["sv_aspect_ratio"] is None
    assert "long_view" not in out.columns and len(out.columns) == 2 + 29 + 8
    table = {r["feature"]: r for r in ln.lineage_table(out).collect()}
    assert all(r["scope"] == "static" and r["source_log"] == "side_file" for r in table.values())
    with pytest.raises(ValueError):
        joins.static_side(imp, users.unionByName(users), videos, checked=True)


def test_lineage_survives_joins(spark, pop):
    out = h.item_popularity(*pop)
    other = rowwise.constant_feature(pop[1])
    merged = encoders.merge_features(out, other, check_rows=True)
    table = {r["feature"]: r["scope"] for r in ln.lineage_table(merged).collect()}
    assert table == {
        "item_pop_impressions": "strictly_earlier", "item_pop_rate": "strictly_earlier", "ablation_constant": "static",
    }
    with pytest.raises(ValueError):
        encoders.merge_features(out, out)


def test_bucket_sides(spark):
    df = frame(spark, [(x,) for x in (0.5, 1.0, 1.5, 2.0)], "x double")
    side = lambda s: [r[0] for r in df.select(sc.bucketize(F.col("x"), [1.0, 1.0, 2.0], s)).collect()]
    assert side("left") == [0, 0, 2, 2]
    assert side("right") == [0, 1, 1, 2]


def test_numeric_coercion(spark):
    df = frame(spark, [("1.5",), ("inf",), ("-Infinity",), ("nan",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(sc.to_numeric(F.col("x"))).collect()] == [1.5] + [None] * 5


def fm_frame(spark):
    data = []
    for split, n in (("train", 32), ("valid", 8), ("test", 8)):
        for i in range(n):
            data.append((split, i, f"v{i % 5}", i / max(n - 1, 1)))
    return frame(spark, data, "split string, row_id long, cat_item string, numeric double")


def test_fm_ids(spark):
    enc = encoders.fit_sparse(fm_frame(spark), ["cat_item", "numeric"], numeric_bins=4)
    out = enc.transform(fm_frame(spark)).where("split = 'train'").collect()
    assert len({r["ids"][0] for r in out}) == 5 and len({r["ids"][1] for r in out}) == 4
    assert enc.dimension == 6 + 4 and min(r["ids"][1] for r in out) == 6
    unseen = enc.transform(frame(spark, [("test", 0, "new", None)], "split string, row_id long, cat_item string, numeric double"))
    assert unseen.first()["ids"][0] == 5
    wide = enc.one_hot(enc.transform(fm_frame(spark)))
    for r in wide.where("split = 'train'").collect():
        assert r["features"].size == 10 and sorted(r["features"].toArray().nonzero()[0]) == sorted(r["ids"])
    with pytest.raises(ValueError):
        encoders.fit_sparse(fm_frame(spark), ["numeric"], numeric_bins=1)
    with pytest.raises(ValueError):
        encoders.fit_sparse(fm_frame(spark), [])


def test_hashed_ids_stay_in_their_field(spark):
    enc = encoders.fit_sparse(fm_frame(spark), ["cat_item", "numeric"], numeric_bins=4, hashed=16)
    out = enc.transform(fm_frame(spark)).collect()
    assert enc.dimension == 20
    assert all(0 <= r["ids"][0] < 16 <= r["ids"][1] < 20 for r in out)


def test_vocabulary_order_and_unseen(spark):
    df = frame(spark, [("train", 0, "b"), ("train", 1, "a"), ("train", 2, "b"), ("test", 0, "z"), ("test", 1, None)],
               "split string, row_id long, c string")
    vocab = encoders.fit_vocab(df.where("split = 'train'"), ["c"])
    first = {(r["split"], r["row_id"]): r["c_code"] for r in encoders.encode(df, vocab, ["c"]).collect()}
    assert first == {("train", 0): 1, ("train", 1): 2, ("train", 2): 1, ("test", 0): 0, ("test", 1): 0}
    last = encoders.encode(df, vocab, ["c"], "last").where("split = 'test'").collect()
    assert {r["c_code"] for r in last} == {2}


def test_median_of_nothing_is_zero(spark):
    df = frame(spark, [("inf", "x"), ("3", "y"), ("5", "z")], "a string, b string")
    assert encoders.fit_median(df, ["a", "b"]) == {"a": 4.0, "b": 0.0}


def test_reindex_refuses_copies(spark, pop):
    tgt = pop[1]
    built = tgt.select("split", "row_id", F.lit(1).alias("x"))
    assert joins.reindex(built.where("row_id < 2"), tgt).where("x is null").count() == 1
    with pytest.raises(ValueError):
        joins.reindex(built.unionByName(built), tgt)


def test_group_sizes(spark):
    data = [("train", i, u, d) for i, (u, d) in enumerate(
        [("u0", 8), ("u0", 8), ("u0", 9), ("u1", 8), ("u1", 9)])]
    df = frame(spark, data, "split string, row_id long, user_id string, date int")
    assert sorted(r["rows"] for r in sets.group_sizes(df, "user").collect()) == [2, 3]
    assert sorted(r["rows"] for r in sets.group_sizes(df, "user_date").collect()) == [1, 1, 1, 2]
    with pytest.raises(ValueError):
        sets.group_sizes(df, "user_id")


def test_pairs_cycle_through_the_smaller_class(spark):
    data = [("train", i, "u", int(i == 0)) for i in range(10)] + [("train", 20 + i, "one", 1) for i in range(3)]
    df = frame(spark, data, "split string, row_id long, user_id string, long_view int")
    out = sets.same_user_pairs(df, 4, seed=1).collect()
    assert len(out) == 4 and {r["pos_row"] for r in out} == {0}
    assert len({r["neg_row"] for r in out}) == 4 and {r["user_id"] for r in out} == {"u"}
    few = sets.same_user_pairs(df, 40, seed=1).collect()
    assert len(few) == 9


def test_builder_contract(spark, pop):
    hist, tgt = pop
    seen = []

    def build(past, day):
        seen.append(past.count())
        return day.select("split", "row_id", F.lit(float(past.count())).alias("n"))

    out = builder.apply_builder(hist, tgt, build, "strictly_earlier", ["date", "long_view"])
    assert seen == [0, 1, 2] and [r[2] for r in rows(out, "row_id")] == [0.0, 1.0, 2.0]
    part = lambda past, day: day.where("date < 3").select("split", "row_id", F.lit(1.0).alias("n"))
    assert [r[2] for r in rows(builder.apply_builder(hist, tgt, part, "strictly_earlier", ["date"]), "row_id")] == [1.0, 1.0, None]
    with pytest.raises(ValueError):
        builder.apply_builder(hist, tgt, part, "static", ["date"])
    twice = lambda past, day: part(past, day).unionByName(part(past, day))
    with pytest.raises(ValueError):
        builder.apply_builder(hist, tgt, twice, "strictly_earlier", ["date"])
    with pytest.raises(TypeError):
        builder.apply_builder(hist, tgt, lambda past, day: [1], "static", ["date"])
    from rankweave.evaluation.guards import LeakageError

    leak = lambda past, day: day.select("split", "row_id", F.lit(1.0).alias("n"))
    with pytest.raises(LeakageError):
        builder.apply_builder(hist, tgt, leak, "same_row", ["is_click"])


def test_csv_is_read_by_name(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("extra,video_id,date,user_id,long_view\nq,7,20220408,u,1\nq,8,20220509,u,0\nq,9,20220430,w,0\n")
    out = src.load_impressions(
        spark, [str(path)], columns=["date", "user_id", "video_id", "long_view"], order_cols=["date"]
    )
    assert rows(out.select("split", "row_id", "video_id")) == [("test", 0, "9"), ("train", 0, "7")]
    with pytest.raises(ValueError):
        src.load_impressions(spark, [str(path)], columns=["date", "tab"])


def test_randomized_log_stops_at_training(spark):
    df = frame(spark, [(20220420,), (20220421,), (20220422,)], "date int")
    assert src.admit(df, "randomized").count() == 2
    assert src.admit(df).count() == 3


def test_expected_split_counts(spark):
    df = frame(spark, [("train",), ("train",), ("valid",)], "split string")
    out = rows(src.split_counts(df, {"train": 2, "valid": 2, "test": 0}))
    assert out == [("test", 0, 0, True), ("train", 2, 2, True), ("valid", 1, 2, False)]
