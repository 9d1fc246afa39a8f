"""Bounds that used to change answers, and inputs that used to be misread."""

import json
import pytest
from pyspark.sql import functions as F

from rankweave.evaluation import guards as g
from rankweave.functions.lineage import Lineage, tag
from rankweave.operators import history as h, sets
from rankweave.plans import ordering as o
from rankweave.session import shared_dir
from rankweave.sources import impressions as src

LOG = "split string, row_id long, user_id string, date int"


def test_decay_carries_over_empty_blocks(spark):
    """A positive many blocks back still counts, as far as a double can hold it."""
    days = [(0, 3, 2), (300, 1, 0), (600, 4, 0), (900, 1, 0), (1100, 0, 0)]
    df = spark.createDataFrame([("k", d, i, p) for d, i, p in days], "k string, _day int, impressions long, positives long")
    got = {r["_day"]: r for r in h.decayed_state(df, ["k"], 1.0).collect()}
    for n, (day, _, _) in enumerate(days):
        before = days[:n]
        weight = sum(i * 2.0 ** (d - day) for d, i, _ in before)
        weighted = sum(p * 2.0 ** (d - day) for d, _, p in before)
        assert got[day]["weight"] == pytest.approx(weight, rel=1e-9)
        assert got[day]["weighted"] == pytest.approx(weighted, rel=1e-9)
    assert 0 < got[900]["weighted"] == pytest.approx(2 * 2.0**-900)


def test_first_rows_beyond_the_group_limit(spark):
    rows = spark.range(5000).select(
        F.lit("train").alias("split"), F.col("id").alias("row_id"), F.lit("u").alias("user_id"), F.lit(1).alias("date")
    )
    for k in (1, 1000, 1001, 3000):
        kept = o.top_rows(rows, ["user_id"], [F.col("row_id").desc()], k)
        assert sorted(r["row_id"] for r in kept.collect()) == list(range(5000 - k, 5000))
        assert kept.columns == [*rows.columns, "rank"]
    wide = sets.cap_sets(rows, "user_date", 2500, 3)
    assert wide.count() == 2500 and wide.columns == rows.columns


def test_a_large_group_is_hot_at_any_share(spark):
    """The limit is rows in a task: it doesn't grow with the table around the group."""
    rows = spark.range(3000).select(
        F.lit("train").alias("split"), F.when(F.col("id") < 60, "big").otherwise(F.col("id").cast("string")).alias("user_id")
    )
    found = o.find_hot(rows, ["split", "user_id"], 50)
    assert [r["user_id"] for r in found.collect()] == ["big"]


def test_files_of_another_order_are_not_misread(spark, tmp_path):
    for name, text in (("a", "user_id,video_id,date\nu1,v1,20220408\n"), ("b", "date,video_id,user_id\n20220409,v2,u2\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
        (tmp_path / f"both-{name}.csv").write_text(text)
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField(n, t()) for n, t in
                         (("date", IntegerType), ("user_id", StringType), ("video_id", StringType))])
    paths = [str(tmp_path / n) for n in "ab"]
    out = src.load_impressions(spark, paths, schema, order_cols=["date"])
    assert sorted((r["user_id"], r["video_id"]) for r in out.collect()) == [("u1", "v1"), ("u2", "v2")]
    with pytest.raises(Exception):
        src.scan_csv(spark, str(tmp_path / "both-*.csv"), schema).collect()


def test_load_log(spark, tmp_path):
    """The opening example: files to features."""
    from rankweave.models.fm import fit_fm
    from rankweave.operators import rowwise
    from rankweave.evaluation.metrics import evaluate

    names = ["date", "user_id", "video_id", "hourmin", "time_ms", "long_view", "tab"]
    rows = [(20220408 + d, f"u{u}", f"v{(u + i + d) % 5}", 1200, i, int((u + i + d) % 5 < 2), "1")
            for d in (0, 5, 14, 15) for u in range(6) for i in range(4)]
    for part, keep in (("a", lambda r: r[0] < 20220415), ("b", lambda r: r[0] >= 20220415)):
        order = names if part == "a" else names[::-1]
        lines = [",".join(order)] + [",".join(str(r[names.index(n)]) for n in order) for r in rows if keep(r)]
        (tmp_path / f"{part}.csv").write_text("\n".join(lines) + "\n")
    videos = spark.createDataFrame([(f"v{i}", f"a{i % 2}", 1000 * (i + 1), "t" if i else None) for i in range(4)],
                                   "video_id string, author_id string, duration_ms long, tag string")
    log = src.load_log(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], videos,
                       order_cols=["date", "time_ms"], columns=names)
    got = log.collect()
    assert len(got) == len(rows) and {r["tag"] for r in got} == {"t", "UNK"}
    assert {r["duration_ms"] for r in got if r["video_id"] == "v4"} == {None}
    src.load_log(spark, [str(tmp_path / "a.csv")], videos, order_cols=["date", "time_ms"], columns=names,
                 check=log.where("split = 'train'"))
    with pytest.raises(ValueError):
        src.load_log(spark, [str(tmp_path / "a.csv")], videos, order_cols=["date", "time_ms"], columns=names,
                     check=log.where("split = 'train'").withColumn("user_id", F.lit("x")))
    rows_ = h.item_popularity(log.where("split = 'train'"), log, smoothing=20, append=True)
    rows_ = rowwise.duration_hinge(rows_, append=True)
    model = fit_fm(rows_, ["item_pop_rate", "cat_dur_band"], epochs=1)
    assert evaluate(model.score(rows_), ("valid",)).count() == 1


def test_rejections_are_recorded_before_they_raise(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, 1.0)], "split string, row_id long, x double")
    path = str(tmp_path / "log")
    with pytest.raises(g.LeakageError) as caught:
        g.require_lineage(df, log=path, node_id="n7")
    assert caught.value.rejections[0]["reason"].startswith("x: ")
    (record,) = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert record["event"] == "leakage_rejection" and record["layer"] == "static" and record["node_id"] == "n7"
    assert record["reason"].startswith("x: ") and record["feature"] == "x" and record["details"]["rule"] == "missing_lineage"
    fine = tag(df, {"x": Lineage(("x",), "same_row")})
    assert g.require_lineage(fine, log=path) is fine
    metrics = spark.createDataFrame([("valid", 0.99)], "split string, primary double")
    with pytest.raises(g.LeakageError):
        g.require_metrics(metrics, log=str(tmp_path / "metrics"), node_id="n8")
    (record,) = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "metrics")).collect()]
    assert record["layer"] == "empirical" and "0.99" in record["reason"]


def test_first_iteration_needs_the_starting_score(spark):
    from rankweave.evaluation import experiments as ex

    runs = spark.createDataFrame([("a", 1, 0.40, 0.6016), ("a", 2, 0.61, 0.6016), ("b", 1, 0.40, None)],
                                 "run_id string, iteration int, primary double, start double")
    accepted = lambda **k: {(r["run_id"], r["iteration"]): r["accepted"] for r in ex.iteration_report(runs, 0.6, **k).collect()}
    assert accepted(initial="start") == {("a", 1): False, ("a", 2): True, ("b", 1): True}
    assert accepted(initial=0.5) == {("a", 1): False, ("a", 2): True, ("b", 1): False}
    assert accepted() == {("a", 1): True, ("a", 2): True, ("b", 1): True}


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_work_folder_of_one_machine_is_refused_on_a_cluster():
    from types import SimpleNamespace

    def session(master, warehouse, named=None):
        conf = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": named}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf[key] or default), sparkContext=context)

    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077", "file:/home/me/warehouse"))
    assert shared_dir(session("spark://host:7077", "hdfs://name/warehouse/")) == "hdfs://name/warehouse/_work"
    assert shared_dir(session("yarn", "file:/home", "s3a://bucket/work")) == "s3a://bucket/work"
    assert shared_dir(session("local[8]", "file:/tmp/w")) == "file:/tmp/w/_work"


def test_keyed_builder_takes_batches_of_keys(spark, capsys):
    """One call of pandas a batch, not one a key; a builder that spoils its days spoils no others."""
    from rankweave.operators.builder import apply_keyed_builder

    kinds = "split string, row_id long, date int, user_id string, long_view int"
    seen = [("train", i, 20240101 + i % 3, [None, "a", "b"][i % 2], i % 2) for i in range(12)]
    asked = seen + [("valid", 0, 20240104, "a", 0), ("valid", 1, 20240104, None, 0), ("valid", 2, 20240104, "z", 1)]

    def build(past, day):
        n = int(past["impressions"].sum())
        assert (past["date"] < day).all() and past["date"].is_monotonic_increasing
        past["impressions"] = -1
        past.loc[:, "positives"] = -1
        return {"n": n, "half": n / 2 if n else None}

    out = apply_keyed_builder(
        spark.createDataFrame(seen, kinds), spark.createDataFrame(asked, kinds), build, ["user_id"],
        "n long, half double", ["date", "user_id", "long_view"],
    )
    got = {(r["split"], r["row_id"]): (r["n"], r["half"]) for r in out.collect()}
    for split, row, day, user, _ in asked:
        n = sum(1 for r in seen if r[3] == user and r[2] < day)
        assert got[split, row] == (n, n / 2 if n else None)
    capsys.readouterr()
    out.explain()
    assert "CoGroups" not in capsys.readouterr().out
