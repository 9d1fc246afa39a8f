"""Views that read the star-schema tables as impression logs, side tables and run logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import USER_CATEGORICAL, USER_NUMERIC
from .impressions import split_of

EVENT_SPLITS = {
    "train": (20240101, 20240114),
    "valid": (20240115, 20240121),
    "test": (20240122, 20240130),
}
LINE_SPLITS = {
    "train": (19950101, 19991231),
    "valid": (20000101, 20001231),
    "test": (20010101, 20011231),
}
EVENT_START = 20240101


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _midnight(day: int, plus: int = 0) -> str:
    return (dt.datetime.strptime(str(day), "%Y%m%d") + dt.timedelta(days=plus)).isoformat(sep=" ")


def _int_date(ts):
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def _between(ts: str, splits):
    """Range on the raw timestamp, so the scan can skip row groups. The splits of a view
    follow each other without gaps, so no other date filter is needed."""
    low = min(pair[0] for pair in splits.values())
    high = max(pair[1] for pair in splits.values())
    return (F.col(ts) >= F.lit(_midnight(low)).cast("timestamp_ntz")) & (
        F.col(ts) < F.lit(_midnight(high, 1)).cast("timestamp_ntz")
    )


def _only(splits, names):
    return splits if names is None else {n: splits[n] for n in splits if n in names}


def event_impressions(
    spark: SparkSession, sf_dir: str, splits=EVENT_SPLITS, only: tuple[str, ...] | None = None
) -> DataFrame:
    """``events`` as impressions. ``row_id`` is the event id: unique, though not dense.

    ``only`` keeps some (adjacent) splits, by a narrower range on the scan.
    """
    splits = _only(splits, only)
    ts = F.col("ts")
    k = F.get_json_object("props", "$.k")
    number = k.cast("int")
    seconds = F.date_part(F.lit("SECOND"), ts)
    is_type = lambda *names: F.col("event_type").isin(*names).cast("int")
    rows = (
        table(spark, sf_dir, "events")
        .where(_between("ts", splits))
        .select(
            F.col("event_id").alias("row_id"),
            _int_date(ts).alias("date"),
            (F.hour(ts) * 100 + F.minute(ts)).cast("int").alias("hourmin"),
            (
                F.unix_date(F.to_date(ts)).cast("long") * 86_400_000
                + F.hour(ts) * 3_600_000
                + F.minute(ts) * 60_000
                + F.floor(seconds * 1000)
            ).cast("long").alias("time_ms"),
            F.col("user_id").cast("string").alias("user_id"),
            k.alias("video_id"),
            (number % 10).cast("string").alias("author_id"),
            (F.col("event_id") % 4).cast("string").alias("tab"),
            F.when(number >= 95, "UNK").otherwise((number % 7).cast("string")).alias("tag"),
            F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
            is_type("purchase", "click").alias("long_view"),
            is_type("click").alias("is_click"),
            is_type("signup").alias("is_like"),
            is_type("view").alias("is_follow"),
        )
    )
    return rows.withColumn("split", split_of(F.col("date"), splits))


def line_impressions(
    spark: SparkSession, sf_dir: str, splits=LINE_SPLITS, only: tuple[str, ...] | None = None
) -> DataFrame:
    """``lineitem`` with its order as a larger impression log; it has no row key."""
    splits = _only(splits, only)
    lines = table(spark, sf_dir, "lineitem").where(_between("l_shipdate", splits))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        _int_date(F.col("l_shipdate")).alias("date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("video_id"),
        F.col("l_suppkey").cast("string").alias("author_id"),
        F.col("o_orderpriority").alias("tab"),
        (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
        (F.col("l_returnflag") == "R").cast("int").alias("long_view"),
    )
    return rows.withColumn("split", split_of(F.col("date"), splits))


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` in the shape of the user side table, under even user ids: users with an odd
    one have no profile."""
    c = table(spark, sf_dir, "customer")
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    derived = {
        "user_active_degree": F.col("c_mktsegment"),
        "follow_user_num_range": F.concat(F.lit("r"), (key % 4).cast("string")),
        "fans_user_num_range": F.concat(F.lit("f"), (key % 3).cast("string")),
        "friend_user_num_range": F.concat(F.lit("n"), F.col("c_nationkey").cast("string")),
        "register_days_range": F.concat(F.lit("d"), (key % 6).cast("string")),
        **{f"onehot_feat{i}": ((key + i) % (i + 2)).cast("string") for i in range(18)},
        "is_live_streamer": (key % 2).cast("string"),
        "is_video_author": (F.col("c_nationkey") % 2).cast("string"),
        "follow_user_num": F.floor(bal).cast("long").cast("string"),
        "fans_user_num": (key * 7).cast("string"),
        "friend_user_num": (5 - key).cast("string"),
        "register_days": F.when(F.col("c_nationkey") < 5, "n/a").otherwise((key + 30).cast("string")),
    }
    return c.select(
        (key * 2).cast("string").alias("user_id"),
        *[derived[n].alias(n) for n in (*USER_CATEGORICAL, *USER_NUMERIC)],
    )


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` in the shape of the video side table, under even video ids."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") * 2).cast("string").alias("video_id"),
        F.col("p_type").alias("video_type"),
        F.col("p_brand").alias("upload_type"),
        (F.col("p_partkey") % 3).cast("string").alias("music_type"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("upload_dt"),
        (F.col("p_size") % 5).cast("string").alias("server_width"),
        F.col("p_size").cast("string").alias("server_height"),
        F.floor(F.col("p_retailprice")).cast("long").cast("string").alias("video_duration"),
        F.col("p_brand").alias("tag"),
    )


def event_scores(df: DataFrame, name: str = "score", salt: int = 7) -> DataFrame:
    """A fixed pseudo-score per impression, coarse enough to have ties."""
    mixed = (
        ((F.col("row_id") % 1009) * 613 + (F.col("duration_ms") % 1009) * 271 + salt * 97) % 1009
        + 120 * F.col("is_click")
    )
    return df.withColumn(name, mixed.cast("double") / 1009.0)


def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as experiment outcomes: one tested idea per event, per user as run."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("h_"), F.get_json_object("props", "$.k")).alias("hypothesis_id"),
        F.col("event_type").isin("purchase", "click").alias("accepted"),
        F.col("event_type").alias("arm"),
        ((F.round(F.col("value") * 100).cast("long") - 5000) / F.lit(1000000.0)).alias("delta"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
