"""Queries on sources, row features and encoders."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.scalars import bucketize, log_clip, safe_ratio, to_numeric
from ..operators import encoders, rowwise
from ..plans.quantiles import interior, quantiles
from ..session import work_path
from ..sources import impressions as src
from ..sources.run_logs import load_run_log
from ..sources.tables import (
    EVENT_SPLITS,
    EVENT_START,
    event_impressions,
    line_impressions,
    part_profiles,
    table,
)
from .registry import IMP, LINES, OUTCOMES, query, sql_bucket

R6 = lambda c, name: F.round(c, 6).alias(name)


# --- sources ---


def _as_log(spark, sf):
    """Events in the schema of the log files, as two CSV files like the published ones."""
    imp = event_impressions(spark, sf)
    zero = F.lit(0)
    log = imp.select(
        "split", "date", "user_id", "video_id", "hourmin", "time_ms", "is_click", "is_like",
        "is_follow", zero.alias("is_comment"), zero.alias("is_forward"), zero.alias("is_hate"),
        zero.alias("is_profile_enter"), "long_view", F.col("duration_ms").alias("play_time_ms"),
        zero.alias("profile_stay_time"), zero.alias("comment_stay_time"), F.lit("x").alias("unused"),
    )
    paths = []
    for name, part in (("early", F.col("split") == "train"), ("late", F.col("split") != "train")):
        path = work_path(spark, f"log-{name}")
        # the second file has its columns in another order
        order = sorted(log.columns) if name == "late" else log.columns
        log.where(part).select(*[c for c in order if c != "split"]).write.csv(path, header=True)
        paths.append(path)
    return paths


@query(
    "load_log",
    IMP + ", v AS (SELECT video_id, min(author_id) AS author_id, max(duration_ms) AS duration_ms, CASE WHEN"
    " CAST(video_id AS INTEGER) % 5 > 0 THEN max(tag) END AS tag FROM imp GROUP BY video_id)"
    " SELECT split, date, imp.user_id, video_id, hourmin, time_ms, long_view, v.author_id, v.duration_ms,"
    " coalesce(v.tag,'UNK') AS tag, row_number() OVER"
    " (PARTITION BY split ORDER BY date, time_ms, imp.user_id, video_id, hourmin, long_view) - 1 AS row_id"
    " FROM imp JOIN v USING (video_id)",
)
def load_log(spark, sf):
    columns = ["date", "user_id", "video_id", "hourmin", "time_ms", "long_view"]
    imp = event_impressions(spark, sf)
    lacking = F.col("video_id").cast("int") % 5 == 0
    videos = imp.groupBy("video_id").agg(
        F.min("author_id").alias("author_id"), F.max("duration_ms").alias("duration_ms"), F.max("tag").alias("tag")
    ).withColumn("tag", F.when(~lacking, F.col("tag")))
    return src.load_log(
        spark, _as_log(spark, sf), videos, ["date", "time_ms"], splits=EVENT_SPLITS, columns=columns,
        details=("author_id", "duration_ms"),
    )


@query(
    "load_csv_impressions",
    IMP + " SELECT split, date, user_id, video_id, hourmin, time_ms, long_view, row_number() OVER"
    " (PARTITION BY split ORDER BY date, time_ms, user_id, video_id, hourmin, long_view) - 1 AS row_id FROM imp",
)
def load_csv_impressions(spark, sf):
    columns = ["date", "user_id", "video_id", "hourmin", "time_ms", "long_view"]
    return src.load_impressions(
        spark, _as_log(spark, sf), splits=EVENT_SPLITS, columns=columns, order_cols=["date", "time_ms"]
    )


@query(
    "csv_column_pruning",
    IMP + " SELECT date, count(*) AS rows, CAST(sum(long_view) AS BIGINT) AS positives FROM imp GROUP BY date",
)
def csv_column_pruning(spark, sf):
    logs = src.load_impressions(spark, _as_log(spark, sf), splits=EVENT_SPLITS, columns=["date", "long_view"])
    return logs.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("long_view").alias("positives"))


@query(
    "union_logs",
    IMP + " SELECT row_id, date, user_id, video_id FROM imp WHERE split='train'"
    " UNION ALL SELECT row_id, date, user_id, video_id FROM imp WHERE split<>'train'",
)
def union_logs(spark, sf):
    imp = event_impressions(spark, sf).select("split", "row_id", "date", "user_id", "video_id")
    early = imp.where("split = 'train'").drop("split")
    late = imp.where("split <> 'train'").select("video_id", "user_id", "date", "row_id")
    return src.union_logs(early, late)


@query("split_assignment", LINES + " SELECT split, date, count(*) AS rows FROM lines GROUP BY ALL")
def split_assignment(spark, sf):
    return line_impressions(spark, sf).groupBy("split", "date").agg(F.count(F.lit(1)).alias("rows"))


_LINE_ORDER = "date, order_id, line_no, user_id, video_id, author_id, tab, duration_ms, long_view"


@query(
    "dense_row_ids",
    LINES + f" SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_LINE_ORDER}) - 1 AS row_id FROM lines",
)
def dense_row_ids(spark, sf):
    return src.add_row_id(line_impressions(spark, sf), ["date", "order_id", "line_no"])


@query(
    "dense_row_ids_unique_key",
    IMP + " SELECT split, row_id AS event_id, user_id, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1"
    " AS row_id FROM imp",
)
def dense_row_ids_unique_key(spark, sf):
    imp = event_impressions(spark, sf).select("split", F.col("row_id").alias("event_id"), "user_id")
    return src.add_row_id(imp, ["event_id"], unique=True)


@query(
    "reconcile_copies",
    IMP + ", b AS (SELECT split, row_id, user_id, CASE WHEN is_like=1 THEN author_id ELSE video_id END AS video_id"
    " FROM imp WHERE tag <> 'UNK')"
    " SELECT split, row_id, a.user_id AS user_id_a, a.video_id AS video_id_a, b.user_id AS user_id_b,"
    " b.video_id AS video_id_b, CASE WHEN a.user_id IS NULL THEN 'only_b' WHEN b.user_id IS NULL THEN 'only_a'"
    " ELSE 'differs' END AS problem FROM (SELECT split,row_id,user_id,video_id FROM imp) a"
    " FULL JOIN b USING (split,row_id)"
    " WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.video_id <> b.video_id OR a.user_id <> b.user_id",
)
def reconcile_copies(spark, sf):
    imp = event_impressions(spark, sf)
    other = imp.where("tag <> 'UNK'").withColumn(
        "video_id", F.when(F.col("is_like") == 1, F.col("author_id")).otherwise(F.col("video_id"))
    )
    return src.reconcile(imp, other)


@query(
    "tag_lookup",
    IMP + ", dim AS (SELECT CAST(p_partkey*2 AS VARCHAR) AS video_id, p_brand AS brand, p_type AS kind FROM part"
    ") SELECT split, row_id, video_id, coalesce(brand,'UNK') AS brand,"
    " coalesce(kind,'UNK') AS kind FROM imp LEFT JOIN dim USING (video_id)",
)
def tag_lookup(spark, sf):
    dim = table(spark, sf, "part").select(
        (F.col("p_partkey") * 2).alias("video_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")
    )
    rows = event_impressions(spark, sf).select("split", "row_id", "video_id")
    return src.lookup(rows, dim, "video_id", ["brand", "kind"], checked=True)


@query(
    "randomized_log_gate",
    IMP + " SELECT split, row_id, date FROM imp WHERE date <= 20240114",
)
def randomized_log_gate(spark, sf):
    return src.admit(event_impressions(spark, sf), "randomized", 20240114).select("split", "row_id", "date")


@query(
    "split_counts",
    LINES + " SELECT split, count(*) AS rows FROM lines GROUP BY split",
)
def split_counts(spark, sf):
    return src.split_counts(line_impressions(spark, sf))


def run_log_records(spark, sf):
    """One nested run-log record per event; the user is the run."""
    e = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("int")
    primary = cents / F.lit(100000.0)
    is_error = F.col("event_type") == "error"
    event = lambda kind: F.struct(
        F.lit(kind).alias("event"),
        F.concat(F.lit("n"), (k % 7).cast("string")).alias("node_id"),
        F.col("event_type").alias("reason"),
    )
    part = lambda cut: F.struct(
        (primary - cut).alias("score_without"), cut.alias("removal_cost"), F.lit("scored").alias("status")
    )
    no_events = F.expr("array()").cast("array<struct<event:string,node_id:string,reason:string>>")
    return e.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").cast("int").alias("iteration"),
        (F.col("event_id") % 5).cast("int").alias("inner_attempt"),
        F.struct(
            F.concat(F.lit("h_"), k.cast("string")).alias("id"),
            F.col("event_type").alias("target_node"),
            (k / F.lit(1000.0)).alias("expected_delta"),
        ).alias("hypothesis"),
        F.when(is_error, F.array(F.lit("invalid"), F.lit("repeat"))).otherwise(
            F.expr("array()").cast("array<string>")
        ).alias("proposal_rejections"),
        F.create_map(
            F.lit("raw"), part(k / F.lit(1000.0)), F.lit("side"), part((k % 7) / F.lit(1000.0))
        ).alias("ablation_table"),
        F.when(~is_error, F.struct((primary + 0.1).alias("gauc"), (primary - 0.1).alias("ndcg5"), primary.alias("primary"))).alias("metrics"),
        (~is_error).alias("executed"),
        F.col("event_type").isin("purchase", "click").alias("accepted"),
        F.when(is_error, F.array(event("retry"), event("repair"))).when(
            F.col("event_type") == "view", F.array(event("retry"))
        ).otherwise(no_events).alias("recovery_events"),
        (cents / F.lit(100.0)).alias("wall_clock_s"),
        F.struct((k * 11).cast("long").alias("in"), (k * 3).cast("long").alias("out")).alias("tokens"),
    )


@query(
    "run_log_scan",
    OUTCOMES + ", e AS (SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events)"
    " SELECT run_id, CAST(seq AS INTEGER) AS iteration, hypothesis_id, arm AS target_node,"
    " CASE WHEN arm<>'error' THEN round(cents/100000.0,6) END AS primary_score, accepted,"
    " CAST(CASE WHEN arm='error' THEN 2 ELSE 0 END AS INTEGER) AS rejections,"
    " CAST(k*11 AS BIGINT) AS tokens_in"
    " FROM outcomes JOIN e ON e.event_id=outcomes.seq",
)
def run_log_scan(spark, sf):
    path = work_path(spark, "run-log")
    run_log_records(spark, sf).write.json(path)
    log = load_run_log(spark, path)
    return log.select(
        "run_id",
        "iteration",
        F.col("hypothesis.id").alias("hypothesis_id"),
        "hypothesis.target_node",
        R6(F.col("metrics.primary"), "primary_score"),
        "accepted",
        F.coalesce(F.size("proposal_rejections"), F.lit(0)).alias("rejections"),
        F.col("tokens.in").alias("tokens_in"),
    )


# --- row features ---

_EDGES = ", ed AS (SELECT quantile_cont(duration_ms, [{probs}]) AS e FROM imp WHERE split='train')"


def _edge_cte(n):
    return _EDGES.format(probs=",".join(str(p) for p in interior(n)))


@query(
    "raw_categorical",
    IMP + _edge_cte(10) + " SELECT split, row_id, user_id AS cat_user_id, video_id AS cat_video_id,"
    " author_id AS cat_author_id, tab AS cat_tab, CAST(" + sql_bucket("duration_ms", "ed.e")
    + " AS VARCHAR) AS cat_dur_bucket FROM imp, ed",
)
def raw_categorical(spark, sf):
    return rowwise.raw_categorical(event_impressions(spark, sf))


@query(
    "video_duration",
    IMP + _edge_cte(7) + " SELECT split, row_id, round(ln(1+duration_ms),6) AS video_duration_log_ms, CAST("
    + sql_bucket("duration_ms", "ed.e") + " AS VARCHAR) AS cat_video_duration_bucket FROM imp, ed",
)
def video_duration(spark, sf):
    out = rowwise.video_duration(event_impressions(spark, sf), buckets=7)
    return out.withColumn("video_duration_log_ms", F.round("video_duration_log_ms", 6))


@query(
    "temporal",
    IMP + " SELECT split, row_id, CAST(date_diff('day', DATE '2024-01-01', CAST(strptime(CAST(date AS VARCHAR),"
    "'%Y%m%d') AS DATE)) AS DOUBLE) AS temporal_day_index, CAST(isodow(CAST(strptime(CAST(date AS VARCHAR),"
    "'%Y%m%d') AS DATE)) - 1 AS VARCHAR) AS cat_temporal_weekday, CAST(hourmin // 100 AS VARCHAR)"
    " AS cat_temporal_hour FROM imp",
)
def temporal(spark, sf):
    return rowwise.temporal(event_impressions(spark, sf), EVENT_START)


_REGIME = "CASE WHEN duration_ms <= 18000 THEN 'short' ELSE 'long' END"


@query(
    "duration_hinge",
    IMP + " SELECT split, row_id, round(least(duration_ms,25000)/1000.0,6) AS dur_hinge_below_s,"
    " round(ln(1+greatest(duration_ms-25000,0)/1000.0),6) AS dur_hinge_above_log_s,"
    " round((least(duration_ms,25000)/1000.0)/greatest(duration_ms/1000.0,1e-6),6) AS dur_hinge_ratio,"
    " CASE WHEN duration_ms <= 25000 THEN 'short' ELSE 'long' END AS cat_dur_regime, CAST("
    + sql_bucket("duration_ms/1000.0", "[7.0,12.0,18.0,30.0,60.0]") + " AS VARCHAR) AS cat_dur_band FROM imp",
)
def duration_hinge(spark, sf):
    out = rowwise.duration_hinge(event_impressions(spark, sf), 25000)
    names = ["dur_hinge_below_s", "dur_hinge_above_log_s", "dur_hinge_ratio"]
    return out.withColumns({n: F.round(n, 6) for n in names})


@query(
    "attribute_columns",
    IMP + _edge_cte(10) + " SELECT split, row_id, CAST(" + sql_bucket("duration_ms", "ed.e")
    + f" AS VARCHAR) AS duration_bucket, {_REGIME} AS duration_regime, tab, tag, author_id, video_id FROM imp, ed",
)
def attribute_columns(spark, sf):
    imp = event_impressions(spark, sf)
    edges = rowwise.duration_edges(imp)
    names = ["duration_bucket", "duration_regime", "tab", "tag", "author_id", "video_id"]
    return imp.select("split", "row_id", *[rowwise.attribute_column(n, edges).alias(n) for n in names])


@query("constant_feature", IMP + " SELECT split, row_id, CAST(0 AS DOUBLE) AS ablation_constant FROM imp")
def constant_feature(spark, sf):
    return rowwise.constant_feature(event_impressions(spark, sf))


@query("constant_score", IMP + " SELECT split, row_id, user_id, CAST(0 AS DOUBLE) AS score FROM imp")
def constant_score(spark, sf):
    return rowwise.constant_score(event_impressions(spark, sf))


@query(
    "numeric_coercion",
    "SELECT event_id, CASE WHEN event_type IN ('purchase','click') THEN value END AS number FROM events",
)
def numeric_coercion(spark, sf):
    text = (
        F.when(F.col("event_type") == "error", "NaN")
        .when(F.col("event_type") == "view", "-Infinity")
        .when(F.col("event_type") == "signup", F.concat(F.lit("#"), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", to_numeric(text).alias("number"))


@query(
    "log_clip",
    "SELECT c_custkey, CASE WHEN c_nationkey >= 5 THEN round(ln(1+greatest(c_acctbal,0)),6) END AS value FROM customer",
)
def log_clip_query(spark, sf):
    balance = F.when(F.col("c_nationkey") >= 5, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", R6(log_clip(balance), "value"))


@query(
    "safe_ratio",
    "SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0),6) AS ratio FROM part",
)
def safe_ratio_query(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", R6(safe_ratio(F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")), "ratio")
    )


# --- encoders ---


@query(
    "quantile_edges",
    "SELECT field, prob, round(value,6) AS value FROM (SELECT 'price' AS field, unnest(CAST([0.1,0.25,0.5,0.9] AS DOUBLE[])) AS prob,"
    " unnest(quantile_cont(l_extendedprice,[0.1,0.25,0.5,0.9])) AS value FROM lineitem UNION ALL"
    " SELECT 'quantity', unnest(CAST([0.1,0.25,0.5,0.9] AS DOUBLE[])), unnest(quantile_cont(l_quantity,[0.1,0.25,0.5,0.9])) FROM lineitem)",
)
def quantile_edges(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")
    )
    out = quantiles(lines, ["price", "quantity"], [0.1, 0.25, 0.5, 0.9])
    return out.withColumn("value", F.round("value", 6))


@query(
    "train_quantile_edges",
    IMP + f" SELECT 'duration_ms' AS field, unnest(CAST({interior(10)} AS DOUBLE[])) AS prob,"
    f" round(unnest(quantile_cont(duration_ms, {interior(10)})),6) AS value FROM hist",
)
def train_quantile_edges(spark, sf):
    out = encoders.quantile_edges(event_impressions(spark, sf), "duration_ms", 10)
    return out.withColumn("value", F.round("value", 6))


@query(
    "bucketize_left",
    "SELECT l_orderkey, l_linenumber, l_quantity, CAST(" + sql_bucket("l_quantity", "[1.0,10.0,25.0,25.0,40.0]")
    + " AS INTEGER) AS bucket FROM lineitem",
)
def bucketize_left(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        bucketize(F.col("l_quantity"), [1.0, 10.0, 25.0, 25.0, 40.0], "left").alias("bucket"),
    )


@query(
    "bucketize_right",
    "SELECT l_orderkey, l_linenumber, l_quantity, CAST(" + sql_bucket("l_quantity", "[1.0,10.0,25.0,40.0]", "<=")
    + " AS INTEGER) AS bucket FROM lineitem",
)
def bucketize_right(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        bucketize(F.col("l_quantity"), [1.0, 10.0, 25.0, 25.0, 40.0], "right").alias("bucket"),
    )


def _vocab_cte(column, name):
    return (
        f", {name} AS (SELECT {column}, row_number() OVER (ORDER BY min(row_id)) - 1 AS code"
        f" FROM hist GROUP BY {column})"
    )


@query(
    "vocabulary_codes",
    IMP + _vocab_cte("user_id", "vu") + _vocab_cte("video_id", "vv")
    + " SELECT split, row_id, CAST(coalesce(vu.code+1,0) AS BIGINT) AS user_id_code,"
    " CAST(coalesce(vv.code+1,0) AS BIGINT) AS video_id_code FROM imp LEFT JOIN vu USING (user_id)"
    " LEFT JOIN vv USING (video_id)",
)
def vocabulary_codes(spark, sf):
    imp = event_impressions(spark, sf).select("split", "row_id", "user_id", "video_id")
    vocab = encoders.fit_vocab(imp.where("split = 'train'"), ["user_id", "video_id"])
    return encoders.encode(imp, vocab, ["user_id", "video_id"], "first").drop("user_id", "video_id")


@query(
    "vocabulary_codes_unseen_last",
    LINES + ", v AS (SELECT video_id, row_number() OVER (ORDER BY min(CAST(video_id AS BIGINT))) - 1 AS code"
    " FROM lhist GROUP BY video_id)"
    " SELECT split, date, order_id, line_no, video_id, CAST(coalesce(v.code, (SELECT count(*) FROM v)) AS BIGINT)"
    " AS video_id_code FROM lines LEFT JOIN v USING (video_id)",
)
def vocabulary_codes_unseen_last(spark, sf):
    lines = line_impressions(spark, sf).select("split", "date", "order_id", "line_no", "video_id")
    train = lines.where("split = 'train'").withColumn("at", F.col("video_id").cast("long"))
    vocab = encoders.fit_vocab(train, ["video_id"], order="at")
    return encoders.encode(lines, vocab, ["video_id"], "last")


_SIDE_SIZE = (
    ", pv AS (SELECT CAST(p_partkey*2 AS VARCHAR) AS video_id, CAST(p_size AS DOUBLE) AS size,"
    " floor(p_retailprice) AS price FROM part)"
)


@query(
    "median_imputation",
    IMP + _SIDE_SIZE + ", j AS (SELECT split, row_id, size, price FROM imp LEFT JOIN pv USING (video_id)),"
    " m AS (SELECT median(size) AS ms, median(price) AS mp FROM j WHERE split='train')"
    " SELECT split, row_id, coalesce(size,ms) AS size, coalesce(price,mp) AS price FROM j, m",
)
def median_imputation(spark, sf):
    parts = part_profiles(spark, sf).select(
        "video_id", F.col("server_height").alias("size"), F.col("video_duration").alias("price")
    )
    rows = src.lookup(
        event_impressions(spark, sf).select("split", "row_id", "video_id"), parts, "video_id",
        ["size", "price"], default=None,
    ).drop("video_id")
    return encoders.impute(rows, encoders.fit_median(rows.where("split = 'train'"), ["size", "price"]))


@query(
    "merge_features",
    IMP + _edge_cte(10) + " SELECT split, row_id, round(ln(1+duration_ms),6) AS video_duration_log_ms, CAST("
    + sql_bucket("duration_ms", "ed.e") + " AS VARCHAR) AS cat_video_duration_bucket,"
    " CAST(0 AS DOUBLE) AS ablation_constant, CAST(hourmin // 100 AS VARCHAR) AS cat_temporal_hour FROM imp, ed",
)
def merge_features(spark, sf):
    imp = event_impressions(spark, sf)
    merged = encoders.merge_features(
        rowwise.video_duration(imp),
        rowwise.constant_feature(imp),
        rowwise.temporal(imp, EVENT_START).select("split", "row_id", "cat_temporal_hour"),
        check_rows=True,
    )
    return merged.withColumn("video_duration_log_ms", F.round("video_duration_log_ms", 6))


def _small_features(spark, sf):
    imp = rowwise.temporal(event_impressions(spark, sf), EVENT_START, append=True)
    return imp.select(
        "split", "row_id", "user_id", "long_view", F.col("video_id").alias("cat_video_id"),
        F.col("tab").alias("cat_tab"), "temporal_day_index", (F.col("duration_ms") / 1000.0).alias("seconds"),
    )


_SMALL = (
    ", f AS (SELECT split, row_id, video_id AS cat_video_id, tab AS cat_tab, CAST(date % 100 - 1 AS DOUBLE)"
    " AS temporal_day_index, duration_ms/1000.0 AS seconds FROM imp)"
    ", v1 AS (SELECT cat_video_id, row_number() OVER (ORDER BY min(row_id)) - 1 AS c1 FROM f WHERE split='train' GROUP BY 1)"
    ", v2 AS (SELECT cat_tab, row_number() OVER (ORDER BY min(row_id)) - 1 AS c2 FROM f WHERE split='train' GROUP BY 1)"
)
_SMALL_NAMES = ["cat_video_id", "cat_tab", "temporal_day_index", "seconds"]


@query(
    "dense_matrix",
    IMP + _SMALL + " SELECT split, row_id, CAST(coalesce(c1+1,0) AS DOUBLE) AS x0, CAST(coalesce(c2+1,0) AS DOUBLE) AS x1,"
    " temporal_day_index AS x2, round(seconds,6) AS x3 FROM f LEFT JOIN v1 USING (cat_video_id) LEFT JOIN v2 USING (cat_tab)",
)
def dense_matrix(spark, sf):
    out = encoders.assemble(_small_features(spark, sf), _SMALL_NAMES)
    wide = out.select("split", "row_id", vector_to_array("features").alias("x"))
    return wide.select("split", "row_id", *[R6(F.col("x")[i], f"x{i}") for i in range(4)])


@query(
    "fm_encode",
    IMP + _SMALL + ", e3 AS (SELECT list_distinct(quantile_cont(temporal_day_index, "
    + str(interior(8)) + ")) AS e FROM f WHERE split='train'), e4 AS (SELECT list_distinct(quantile_cont(seconds, "
    + str(interior(8)) + ")) AS e FROM f WHERE split='train'), n AS (SELECT (SELECT count(*) FROM v1) AS n1,"
    " (SELECT count(*) FROM v2) AS n2)"
    " SELECT split, row_id, CAST(coalesce(c1,n1) AS INTEGER) AS id0, CAST(n1+1+coalesce(c2,n2) AS INTEGER) AS id1,"
    " CAST(n1+n2+2+" + sql_bucket("temporal_day_index", "e3.e", "<=") + " AS INTEGER) AS id2,"
    " CAST(n1+n2+2+len(e3.e)+1+" + sql_bucket("seconds", "e4.e", "<=") + " AS INTEGER) AS id3"
    " FROM f LEFT JOIN v1 USING (cat_video_id) LEFT JOIN v2 USING (cat_tab), e3, e4, n",
)
def fm_encode(spark, sf):
    out = encoders.fm_encode(_small_features(spark, sf), _SMALL_NAMES, numeric_bins=8)
    return out.select("split", "row_id", *[F.col("ids")[i].alias(f"id{i}") for i in range(4)])
