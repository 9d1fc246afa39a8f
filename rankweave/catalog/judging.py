"""Queries on metrics, guards, submissions, experiment tables and analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluation import analyses as an, experiments as ex, guards, metrics as m
from ..operators import history as h
from ..plans.ordering import find_hot
from ..session import cut_lineage, work_path
from ..sources import impressions as src, submission as sub
from ..sources.run_logs import parse_run_log
from ..sources.tables import (
    customer_profiles,
    event_impressions,
    event_outcomes,
    event_scores,
    line_impressions,
    table,
)
from .features import _avg_rank, _halves, _rate_sql, _rounded, event_lineage
from .loading import run_log_records
from .registry import IMP, LINES, OUTCOMES, query, sql_score

# --- metrics ---


def _metric_sql(src_cte, weighting="impressions", extra="", keys="split", tail=None, rnd=6):
    """GAUC, nDCG@5 and primary of a CTE (split, user_id, row_id, score, long_view[, kind])."""
    by = f"{keys}, user_id"
    weight = "n" if weighting == "impressions" else "1"
    ideal = "list_sum(list_transform(range(1, least(5,p)::BIGINT+1), lambda i: 1/log2(i+1)))"
    return (
        f", rk AS (SELECT *, {_avg_rank('score', by)} AS ar, row_number() OVER (PARTITION BY {by}"
        f" ORDER BY score DESC, row_id) AS rn FROM {src_cte}),"
        f" us AS (SELECT {by}, count(*) AS n, sum(long_view) AS p, sum(CASE WHEN long_view=1 THEN ar END) AS rs,"
        f" coalesce(sum(CASE WHEN rn<=5 THEN long_view/log2(rn+1) END),0) AS dcg FROM rk GROUP BY ALL),"
        f" ua AS (SELECT *, CASE WHEN p>0 AND p<n THEN (rs-p*(p+1)/2.0)/(p*(n-p)) END AS auc,"
        f" CASE WHEN p>0 THEN dcg/{ideal} ELSE 0 END AS nd FROM us),"
        f" mt AS (SELECT {keys}, sum(auc*{weight})/sum(CASE WHEN auc IS NOT NULL THEN {weight} END) AS gauc,"
        f" avg(nd) AS ndcg5 FROM ua GROUP BY {keys})"
        + (
            tail
            or f" SELECT {keys}, round(gauc,{rnd}) AS gauc, round(ndcg5,{rnd}) AS ndcg5,"
            f" round((gauc+ndcg5)/2,{rnd}) AS primary_score FROM mt"
        )
    )


_SC = IMP + f", sc AS (SELECT split, row_id, user_id, long_view, {sql_score()} AS score FROM imp)"


def _scored(spark, sf):
    rows = event_scores(event_impressions(spark, sf))
    return rows.select("split", "row_id", "user_id", "long_view", "score")


def _metric_columns(df):
    return _rounded(df, "gauc", "ndcg5", "primary").withColumnRenamed("primary", "primary_score")


ALL = ("train", "valid", "test")


@query("gauc", _SC + _metric_sql("sc", tail=" SELECT split, round(gauc,6) AS gauc FROM mt"))
def gauc(spark, sf):
    return _rounded(m.gauc(_scored(spark, sf)), "gauc")


@query("gauc_uniform", _SC + _metric_sql("sc", "uniform", tail=" SELECT split, round(gauc,6) AS gauc FROM mt"))
def gauc_uniform(spark, sf):
    return _rounded(m.gauc(_scored(spark, sf), "uniform"), "gauc")


@query("ndcg_at_5", _SC + _metric_sql("sc", tail=" SELECT split, round(ndcg5,6) AS ndcg5 FROM mt"))
def ndcg_at_5(spark, sf):
    return _rounded(m.ndcg_at(_scored(spark, sf), 5), "ndcg5")


@query("evaluate_all_splits", _SC + _metric_sql("sc"))
def evaluate_all_splits(spark, sf):
    return _metric_columns(m.evaluate(_scored(spark, sf), ALL))


@query("evaluate_valid_only", _SC + ", vd AS (SELECT * FROM sc WHERE split='valid')" + _metric_sql("vd"))
def evaluate_valid_only(spark, sf):
    return _metric_columns(m.evaluate(_scored(spark, sf)))


@query(
    "popularity_ranking",
    IMP + ", pop AS (SELECT * FROM (" + _rate_sql(["video_id"], "item_pop", 20.0).lstrip(", ").join(["WITH ", ""])
    + ")), pp AS (SELECT split, row_id, user_id, long_view, item_pop_rate AS score FROM imp JOIN pop USING (split,row_id))"
    + _metric_sql("pp"),
)
def popularity_ranking(spark, sf):
    """The smoothed earlier long-view rate of the video as its score."""
    hist, imp = _halves(spark, sf)
    pred = h.item_popularity(hist, imp, 20.0, append=True).select(
        "split", "row_id", "user_id", "long_view", F.round("item_pop_rate", 6).alias("score")
    )
    # the scored rows are those of the log, which is cheaper to count
    return _metric_columns(m.evaluate(pred, ALL, hot=find_hot(imp.select(*m.USER), m.USER)))


@query(
    "mean_metrics",
    _SC + ", w AS (SELECT split, row_id, user_id || '/' || seed AS user_id, long_view, score, seed FROM sc,"
    " (SELECT unnest([0,1,2]) AS seed) WHERE true)"
    + _metric_sql(
        "(SELECT split, row_id, user_id, long_view, CASE seed WHEN 0 THEN score WHEN 1 THEN -score ELSE score*score-score END"
        " AS score, seed FROM w)", keys="split, seed",
        tail=" SELECT split, round(avg(gauc),6) AS gauc, round(avg(ndcg5),6) AS ndcg5,"
        " round(avg((gauc+ndcg5)/2),6) AS primary_score, count(*) AS observations FROM mt GROUP BY split",
    ),
)
def mean_metrics(spark, sf):
    rows = _scored(spark, sf)
    s = F.col("score")
    runs = [m.evaluate(rows.withColumn("score", x), ALL) for x in (s, -s, s * s - s)]
    return _metric_columns(m.mean_metrics(src.union_logs(*runs)))


@query(
    "baseline_precision",
    _SC + _metric_sql(
        "sc",
        tail=", l AS (SELECT split, 'gauc' AS metric, gauc AS value FROM mt UNION ALL SELECT split, 'ndcg5', ndcg5 FROM mt"
        " UNION ALL SELECT split, 'primary', (gauc+ndcg5)/2 FROM mt) SELECT split, metric, round(value,6) AS value,"
        " CASE metric WHEN 'gauc' THEN 0.6674 WHEN 'ndcg5' THEN 0.5357 ELSE 0.6016 END::DOUBLE AS expected,"
        " round(value,4) = round(CASE metric WHEN 'gauc' THEN 0.6674 WHEN 'ndcg5' THEN 0.5357 ELSE 0.6016 END::DOUBLE,4)"
        " AS ok FROM l WHERE split='valid'",
    ),
)
def baseline_precision(spark, sf):
    return _rounded(m.matches_baseline(m.evaluate(_scored(spark, sf))), "value")


_EPOCHS = (
    IMP + ", ep AS (SELECT user_id, date AS epoch, sum(long_view)/count(*) AS score FROM imp GROUP BY ALL)"
)


@query(
    "checkpoint_selection",
    _EPOCHS + ", lists AS (SELECT user_id, list({'e': epoch, 'p': score} ORDER BY epoch) AS l FROM ep GROUP BY user_id),"
    " pre AS (SELECT user_id, i, list_reduce(list_transform(l[1:i], lambda x: {'bar': x.p, 'kept': x.e::BIGINT, 'streak': 0,"
    " 'stopped': false}), lambda a, x: CASE WHEN a.stopped THEN a WHEN x.bar > a.bar + 1e-5 THEN x"
    " ELSE {'bar': a.bar, 'kept': a.kept, 'streak': a.streak+1, 'stopped': a.streak+1 >= 4} END) AS s, l[i].e AS epoch,"
    " l[i].p AS p FROM (SELECT user_id, l, unnest(range(1, len(l)+1)) AS i FROM lists))"
    " SELECT user_id, epoch, round(p,6) AS score, NOT coalesce(lag(s.stopped) OVER (PARTITION BY user_id ORDER BY i), false)"
    " AS trained, CAST(s.streak AS INTEGER) AS bad_streak, s.kept AS kept_epoch FROM pre",
)
def checkpoint_selection(spark, sf):
    epochs = event_impressions(spark, sf).groupBy("user_id", F.col("date").alias("epoch")).agg(
        (F.sum("long_view") / F.count(F.lit(1))).alias("primary")
    )
    out = m.select_checkpoint(epochs, 4, by=["user_id"])
    return _rounded(out.withColumnRenamed("primary", "score"), "score")


# --- guards ---

_LINEAGE_SQL = (
    "WITH l AS (SELECT 'f_' || event_id AS feature, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k,"
    " CASE event_type WHEN 'click' THEN 'is_click' WHEN 'view' THEN 'duration_ms' WHEN 'signup' THEN 'is_follow'"
    " WHEN 'purchase' THEN 'long_view' ELSE 'video_id' END AS source FROM events),"
    " q AS (SELECT *, source IN ('is_click','is_follow','long_view') AS bad,"
    " CASE WHEN k < 90 THEN 20220421 + k % 3 END AS md FROM l)"
    " SELECT feature, 'missing_lineage' AS rule, CASE WHEN bad THEN source ELSE feature END AS sources,"
    " CAST(md AS INTEGER) AS max_source_date FROM q WHERE k < 3 UNION ALL"
    " SELECT feature, 'same_row_outcome', source, md FROM q WHERE k >= 3 AND bad AND NOT (k >= 40 AND k < 80) UNION ALL"
    " SELECT feature, 'randomized_after_cutoff', CASE WHEN bad THEN source ELSE feature END, md FROM q"
    " WHERE k >= 3 AND k % 2 = 1 AND (md IS NULL OR md > 20220421)"
)


@query("lineage_guard", _LINEAGE_SQL)
def lineage_guard(spark, sf):
    return guards.lineage_rejections(event_lineage(spark, sf))


@query(
    "rejection_log",
    "SELECT rule, event, layer, node_id, CASE rule WHEN 'missing_lineage' THEN 'no lineage is declared'"
    " WHEN 'same_row_outcome' THEN 'reads outcomes of its own row' ELSE 'reads randomized rows past the cutoff' END"
    " AS reason, count(*) AS rejections FROM (SELECT rule, 'leakage_rejection' AS event, 'static' AS layer,"
    f" 'node_1' AS node_id FROM ({{_LINEAGE_SQL}})) GROUP BY ALL".format(_LINEAGE_SQL=_LINEAGE_SQL),
)
def rejection_log(spark, sf):
    path = work_path(spark, "rejections")
    found = guards.lineage_rejections(event_lineage(spark, sf))
    guards.append_rejections(found.where("rule <> 'missing_lineage'"), path, "node_1")
    guards.append_rejections(found.where("rule = 'missing_lineage'"), path, "node_1")
    log = spark.read.schema(
        "event string, layer string, node_id string, reason string, details struct<rule: string>"
    ).json(path)
    kinds = ["event", "layer", "node_id", F.split("reason", ": ")[1].alias("reason")]
    return log.groupBy(F.col("details.rule").alias("rule"), *kinds).agg(F.count(F.lit(1)).alias("rejections"))


@query(
    "metric_tripwire",
    IMP + " SELECT split, user_id, round(sum(long_view)/count(*),6) AS primary_score FROM imp WHERE split='valid'"
    " GROUP BY ALL HAVING sum(long_view)/count(*) > 0.5",
)
def metric_tripwire(spark, sf):
    rows = event_impressions(spark, sf).groupBy("split", "user_id").agg(
        (F.sum("long_view") / F.count(F.lit(1))).alias("primary")
    )
    return _rounded(guards.check_metrics(rows, 0.5).withColumnRenamed("primary", "primary_score"), "primary_score")


@query(
    "auxiliary_label_guard",
    "SELECT DISTINCT CASE event_type WHEN 'error' THEN 'rating' ELSE event_type END AS name FROM events"
    " WHERE event_type <> 'click'",
)
def auxiliary_label_guard(spark, sf):
    asked = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "rating").otherwise(F.col("event_type")).alias("name")
    )
    return guards.check_auxiliary(asked)


@query(
    "task_labels",
    IMP + " SELECT split, row_id, task, CAST(label AS INTEGER) AS label, weight FROM (SELECT split, row_id, 'long_view' AS task,"
    " long_view AS label, 1.0::DOUBLE AS weight FROM imp UNION ALL SELECT split, row_id, 'is_click', is_click, 0.3::DOUBLE"
    " FROM imp UNION ALL SELECT split, row_id, 'is_like', is_like, 0.3::DOUBLE FROM imp)",
)
def task_labels(spark, sf):
    from ..models.multitask import task_labels as build

    return build(event_impressions(spark, sf), ["is_click", "is_like"])


# --- submissions ---


def _numbered(spark, sf):
    rows = event_scores(event_impressions(spark, sf)).select(
        "split", F.col("row_id").alias("event_id"), "user_id", "video_id", "score"
    )
    return src.add_row_id(rows, ["event_id"], unique=True)


_NUM = (
    IMP + ", nm AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY row_id)-1 AS row_id, user_id, video_id,"
    f" {sql_score()} AS score FROM imp)"
)


@query(
    "submission_file",
    _NUM + " SELECT row_id, user_id, video_id, printf('%.12g', score) AS score FROM nm WHERE split='test'",
)
def submission_file(spark, sf):
    rows = cut_lineage(_numbered(spark, sf))
    path = sub.write_submission(rows, rows, work_path(spark, "submit"))
    return sub.read_submission(spark, path)


@query(
    "submission_check",
    _NUM + ", t AS (SELECT * FROM nm WHERE split='test'), g AS (SELECT row_id, user_id, CASE WHEN video_id='7' THEN 'x'"
    " ELSE video_id END AS video_id, CASE WHEN user_id='3' THEN 'NaN' WHEN user_id='5' THEN 'high' ELSE 'ok' END AS s"
    " FROM t WHERE video_id <> '11')"
    " SELECT row_id, 'missing_row' AS problem FROM t WHERE video_id='11' UNION ALL"
    " SELECT row_id, 'video_differs' FROM g WHERE video_id='x' UNION ALL"
    " SELECT row_id, 'not_finite' FROM g WHERE s='NaN' UNION ALL SELECT row_id, 'not_a_number' FROM g WHERE s='high'"
    " UNION ALL SELECT NULL, 'not_contiguous' FROM g HAVING min(row_id) <> 0 OR max(row_id) <> count(*)-1",
)
def submission_check(spark, sf):
    rows = cut_lineage(_numbered(spark, sf))
    damaged = rows.where("split = 'test' and video_id <> '11'").select(
        "row_id",
        "user_id",
        F.when(F.col("video_id") == "7", "x").otherwise(F.col("video_id")).alias("video_id"),
        F.when(F.col("user_id") == "3", "NaN").when(F.col("user_id") == "5", "high")
        .otherwise(F.col("score").cast("string")).alias("score"),
    )
    return sub.validate_submission(damaged, rows)


@query("metrics_file", _SC + _metric_sql("sc"))
def metrics_file(spark, sf):
    path = work_path(spark, "metrics")
    sub.write_metrics(_metric_columns(m.evaluate(_scored(spark, sf), ALL)), path)
    return spark.read.schema("split string, gauc double, ndcg5 double, primary_score double").json(path)


# --- experiment tables ---

_USERS3 = (
    OUTCOMES + ", c AS (SELECT run_id AS candidate, sum(cents)/count(*)/10000.0 AS score,"
    " max(cents)/40000.0 AS base FROM outcomes GROUP BY 1),"
    " s AS (SELECT run_id AS candidate, seq % 3 AS seed, sum(cents)/count(*)/10000.0 AS score FROM outcomes GROUP BY ALL)"
)


@query(
    "significance",
    _USERS3 + ", f AS (SELECT c.candidate, any_value(c.score) AS score, any_value(c.base) AS base, avg(s.score) AS mean,"
    " count(*) FILTER (s.score > c.base) AS up FROM c JOIN s USING (candidate)"
    " GROUP BY c.candidate), r AS (SELECT *, score-base-0.0016 > 1e-12 AS clear FROM f)"
    " SELECT candidate, round(score,6) AS score, round(score-base,6)+0.0 AS raw_delta,"
    " CASE WHEN clear THEN 'delta_above_two_sigma' WHEN mean > base AND up >= 2 THEN 'confirmed_by_three_seed_rerun'"
    " ELSE 'not_significant' END AS reason, CAST(CASE WHEN clear THEN 1 ELSE 3 END AS INTEGER) AS seeds,"
    " CASE WHEN NOT clear THEN round(mean,6) END AS seed_mean, CASE WHEN NOT clear THEN up END AS improving_seeds,"
    " clear OR (mean > base AND up >= 2) AS accepted FROM r",
)
def significance(spark, sf):
    o = event_outcomes(spark, sf)
    mean = F.sum("cents") / F.count(F.lit(1)) / F.lit(10000.0)
    # the remainder of the number stands for the seed of a re-run
    runs = o.groupBy(F.col("run_id").alias("candidate"), (F.col("seq") % 3).alias("seed")).agg(mean.alias("score"))
    candidates = o.groupBy(F.col("run_id").alias("candidate")).agg(
        mean.alias("primary"), (F.max("cents") / F.lit(40000.0)).alias("incumbent")
    )
    out = ex.significance("incumbent", candidates, runs).withColumnRenamed("primary", "score")
    return _rounded(out, "score", "raw_delta", "seed_mean")


_ARMS = ["view", "click", "purchase", "share", "error"]


def _arm_sql(by):
    keys = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM outcomes), " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f", a AS (SELECT {keys}arm, position FROM {groups}(SELECT unnest(['view','click','purchase','share','error']) AS arm,"
        " unnest([0,1,2,3,4]) AS position)),"
        f" s AS (SELECT {keys}arm, avg(delta) AS mean, count(*) AS n FROM outcomes WHERE arm <> 'signup' GROUP BY ALL),"
        f" f AS (SELECT {keys}arm, position, mean, coalesce(n,0) AS n FROM a LEFT JOIN s USING ({keys}arm)),"
        f" t AS (SELECT *, sum(n) OVER ({part}) AS total FROM f),"
        " u AS (SELECT *, CASE WHEN n>0 THEN mean+0.25*sqrt(ln(greatest(total,2))/n) END AS ucb FROM t)"
        f" SELECT {keys}arm, CAST(position AS INTEGER) AS position, n, round(mean,6)+0.0 AS mean, round(ucb,6)+0.0 AS ucb,"
        f" row_number() OVER ({part}ORDER BY n>0, CASE WHEN n>0 THEN -ucb END, position)=1 AS next FROM u"
    )


@query("arm_scores", OUTCOMES + _arm_sql(""))
def arm_scores(spark, sf):
    return _rounded(ex.arm_scores(_ARMS, event_outcomes(spark, sf)), "mean", "ucb")


@query("arm_scores_per_run", OUTCOMES + _arm_sql("run_id"))
def arm_scores_per_run(spark, sf):
    return _rounded(ex.arm_scores(_ARMS, event_outcomes(spark, sf), by=("run_id",)), "mean", "ucb")


@query(
    "stop_reason",
    OUTCOMES + ", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS b FROM outcomes)"
    " SELECT run_id, count(*) AS iterations, max(cents)/1.0 AS elapsed_s, CASE WHEN count(*) >= 80 THEN 'iteration_cap'"
    " WHEN max(cents) >= 30000 THEN 'wall_clock_cap' WHEN bool_and(delta <= 0.002) FILTER (b<=3) AND count(*)>=3"
    " THEN 'converged' END AS stop_reason FROM r GROUP BY run_id",
)
def stop_reason(spark, sf):
    deltas = event_outcomes(spark, sf).select("run_id", "seq", "delta", F.col("cents").cast("double").alias("elapsed_s"))
    return ex.stop_reason(deltas, 80, 30000.0)


_ABL = (
    OUTCOMES + ", a AS (SELECT run_id, arm AS node, CASE WHEN arm='error' THEN NULL ELSE sum(cents)/count(*)/10000.0 END"
    " AS sw, max(cents)/20000.0 AS base, list_position(['view','click','purchase','signup','error'], arm)::INTEGER AS position"
    " FROM outcomes GROUP BY run_id, arm),"
    " k AS (SELECT run_id, node, position, coalesce(sw,base) AS score_without, CASE WHEN sw IS NULL THEN 0 ELSE base-sw END"
    " AS removal_cost, CASE WHEN sw IS NULL THEN 'not_ablatable:ValueError' ELSE 'scored' END AS status FROM a)"
)


def _ablations(spark, sf):
    o = event_outcomes(spark, sf).groupBy("run_id", F.col("arm").alias("node")).agg(
        F.when(F.first("arm") != "error", F.sum("cents") / F.count(F.lit(1)) / F.lit(10000.0)).alias("score_without"),
        F.when(F.first("arm") == "error", "ValueError").alias("error"),
        (F.max("cents") / F.lit(20000.0)).alias("incumbent"),
    )
    order = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")])
    rows = o.withColumn("position", F.array_position(order, F.col("node")).cast("int"))
    return ex.removal_costs(rows, "incumbent").drop("incumbent")


@query(
    "removal_costs",
    _ABL + " SELECT run_id, node, position, round(score_without,9) AS score_without, round(removal_cost,9)+0.0 AS"
    " removal_cost, status FROM k",
)
def removal_costs(spark, sf):
    return _rounded(_ablations(spark, sf), "score_without", "removal_cost", places=9)


@query(
    "limiting_node",
    _ABL + " SELECT run_id, node, round(removal_cost,9)+0.0 AS removal_cost FROM k QUALIFY row_number() OVER"
    " (PARTITION BY run_id ORDER BY removal_cost DESC, position) = 1",
)
def limiting_node(spark, sf):
    return _rounded(ex.limiting_node(_ablations(spark, sf), by=("run_id",)), "removal_cost", places=9)


@query(
    "distinct_scores",
    OUTCOMES + " SELECT run_id, count(DISTINCT round(delta,6)) AS distinct_scores FROM outcomes GROUP BY run_id",
)
def distinct_scores(spark, sf):
    return ex.distinct_scores(event_outcomes(spark, sf), "delta")


@query(
    "rejected_ids",
    OUTCOMES + " SELECT DISTINCT run_id || ':' || hypothesis_id AS hypothesis_id FROM outcomes WHERE NOT accepted",
)
def rejected_ids(spark, sf):
    ideas = F.concat_ws(":", "run_id", "hypothesis_id")
    return ex.rejected_ids(event_outcomes(spark, sf).withColumn("hypothesis_id", ideas))


@query(
    "iteration_report",
    OUTCOMES + ", i AS (SELECT run_id, CASE WHEN CAST(run_id AS BIGINT) % 3 > 0 THEN (CAST(run_id AS BIGINT) % 7)/100.0"
    " ELSE -1 END AS start FROM (SELECT DISTINCT run_id FROM outcomes)),"
    " r AS (SELECT run_id, seq AS iteration, cents/100000.0 AS p, greatest(start, max(cents/100000.0) OVER (PARTITION BY"
    " run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS b FROM outcomes JOIN i USING (run_id))"
    " SELECT run_id, iteration, round(p,6) AS score, round(p-0.03,6)+0.0 AS vs_baseline, round(b,6) AS best_before,"
    " p > b AS accepted FROM r",
)
def iteration_report(spark, sf):
    runs = event_outcomes(spark, sf).select(
        "run_id", F.col("seq").alias("iteration"), (F.col("cents") / F.lit(100000.0)).alias("primary")
    )
    # a third of the runs has no starting score
    run = F.col("run_id").cast("long")
    runs = runs.withColumn("start", F.when(run % 3 > 0, (run % 7) / F.lit(100.0)))
    out = ex.iteration_report(runs, 0.03, initial="start").withColumnRenamed("primary", "score")
    return _rounded(out, "score", "vs_baseline", "best_before")


_LOG = (
    OUTCOMES + ", e AS (SELECT event_id, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events),"
    " lg AS (SELECT o.*, k, k*11 AS tin, k*3 AS tout, cents/100.0 AS wall FROM outcomes o JOIN e ON e.event_id=o.seq)"
)


@query(
    "resource_rollup",
    _LOG + " SELECT run_id, count(*) AS iterations, count(*) FILTER (arm<>'error') AS executed_iterations,"
    " count(*) FILTER (accepted) AS accepted_iterations, CAST(sum(CASE WHEN arm='error' THEN 2 ELSE 0 END) AS BIGINT) AS"
    " rejected_proposals, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, (sum(tin)+sum(tout))::BIGINT AS"
    " tokens_total, round(sum(wall),4) AS wall_clock_s FROM lg GROUP BY run_id",
)
def resource_rollup(spark, sf):
    return _rounded(ex.resource_rollup(run_log_records(spark, sf)), "wall_clock_s", places=4)


@query(
    "cumulative_resources",
    _LOG + " SELECT run_id, CAST(seq AS INTEGER) AS iteration, sum(tin) OVER w::BIGINT AS tokens_in, sum(tout) OVER w::BIGINT"
    " AS tokens_out, round(sum(wall) OVER w,4) AS wall_clock_s FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY seq)",
)
def cumulative_resources(spark, sf):
    return _rounded(ex.cumulative_resources(run_log_records(spark, sf)), "wall_clock_s", places=4)


@query(
    "recovery_events",
    _LOG + " SELECT run_id, CAST(seq AS INTEGER) AS iteration, ev AS event, CASE WHEN ev IS NOT NULL THEN 'n' || (k % 7) END"
    " AS node_id, CASE WHEN ev IS NOT NULL THEN arm END AS reason FROM (SELECT *, unnest(CASE arm WHEN 'error' THEN"
    " ['retry','repair'] WHEN 'view' THEN ['retry'] ELSE [NULL] END) AS ev FROM lg)",
)
def recovery_events(spark, sf):
    text = run_log_records(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    return ex.recovery_events(parse_run_log(text))


@query(
    "ablation_rows",
    _LOG + " SELECT run_id, CAST(seq AS INTEGER) AS iteration, node, round(cents/100000.0-c,6)+0.0 AS score_without,"
    " c AS removal_cost, 'scored' AS status FROM (SELECT *, 'raw' AS node, k/1000.0 AS c FROM lg UNION ALL"
    " SELECT *, 'side', (k%7)/1000.0 FROM lg)",
)
def ablation_rows(spark, sf):
    return _rounded(ex.ablation_rows(run_log_records(spark, sf)), "score_without")


@query(
    "compare_runs",
    OUTCOMES + ", r AS (SELECT run_id, seq, cents/100000.0 AS p FROM outcomes)"
    " SELECT run_id, round(arg_min(p,seq),6) AS seed_primary, round(max(p),6) AS best_primary,"
    " min(CASE WHEN p=mx THEN seq END) AS best_iteration, count(*) AS iterations, round(max(p)-arg_min(p,seq),6)+0.0 AS gain"
    " FROM (SELECT *, max(p) OVER (PARTITION BY run_id) AS mx FROM r) GROUP BY run_id",
)
def compare_runs(spark, sf):
    runs = event_outcomes(spark, sf).select(
        "run_id", F.col("seq").alias("iteration"), (F.col("cents") / F.lit(100000.0)).alias("primary")
    )
    return _rounded(ex.compare_runs(runs), "seed_primary", "best_primary", "gain")


@query(
    "latest_iteration",
    OUTCOMES + " SELECT run_id, max(seq) AS seq, arg_max(hypothesis_id, seq) AS hypothesis_id, arg_max(accepted, seq) AS"
    " accepted, arg_max(arm, seq) AS arm FROM outcomes GROUP BY run_id",
)
def latest_iteration(spark, sf):
    o = event_outcomes(spark, sf).select("run_id", "seq", "hypothesis_id", "accepted", "arm")
    return ex.latest_iteration(o, order="seq")


# --- analyses ---


@query(
    "label_rule_agreement",
    LINES + ", p AS (SELECT lines.*, duration_ms*author_id::INTEGER/60.0 AS played FROM lines)"
    " SELECT split, h AS threshold_s, round(avg(((played >= least(duration_ms, h*1000))::INTEGER = long_view)::INTEGER),6)"
    " AS agreement FROM p, (SELECT unnest(CAST([15,18,20] AS DOUBLE[])) AS h) GROUP BY ALL",
)
def label_rule_agreement(spark, sf):
    lines = line_impressions(spark, sf).withColumn(
        "play_time_ms", F.col("duration_ms") * F.col("author_id").cast("int") / F.lit(60.0)
    )
    return _rounded(an.label_rule_agreement(lines, [15, 18, 20]), "agreement")


_MIX = (
    " SELECT split, count(*) AS users, round(avg((hi=0)::INTEGER),6) AS no_positive, round(avg((lo=1)::INTEGER),6) AS"
    " all_positive FROM (SELECT split, user_id, max(long_view) AS hi, min(long_view) AS lo FROM {t} GROUP BY ALL) GROUP BY split"
)


@query("user_label_mix", LINES + _MIX.format(t="lines"))
def user_label_mix(spark, sf):
    return _rounded(an.user_label_mix(line_impressions(spark, sf)), "no_positive", "all_positive")


@query(
    "attainable_range",
    IMP + ", kk AS (SELECT split, row_id, user_id, long_view, kind, CASE kind WHEN 'perfect' THEN long_view WHEN 'constant'"
    " THEN 0 ELSE ('0x' || substr(md5('0:' || row_id),1,8))::BIGINT/4294967296.0 END AS score FROM imp,"
    " (SELECT unnest(['perfect','constant','random']) AS kind))" + _metric_sql("kk", keys="split, kind"),
)
def attainable_range(spark, sf):
    return _metric_columns(an.attainable_range(event_impressions(spark, sf)))


@query(
    "within_user_variation",
    LINES + ", u AS (SELECT split, user_id, min(tab)<>max(tab) AS a, min(duration_ms)<>max(duration_ms) AS b,"
    " min(long_view)<>max(long_view) AS c FROM lines GROUP BY ALL) SELECT split, feature, round(avg(v::INTEGER),6) AS share"
    " FROM (SELECT split, 'tab' AS feature, a AS v FROM u UNION ALL SELECT split, 'duration_ms', b FROM u"
    " UNION ALL SELECT split, 'long_view', c FROM u) GROUP BY ALL",
)
def within_user_variation(spark, sf):
    return _rounded(
        an.within_user_variation(line_impressions(spark, sf), ["tab", "duration_ms", "long_view"]), "share"
    )


@query(
    "mean_set_size",
    IMP + " SELECT split, count(*) AS sets, round(avg(n),6) AS mean_size FROM (SELECT split, user_id, date, count(*) AS n"
    " FROM imp GROUP BY ALL) GROUP BY split",
)
def mean_set_size(spark, sf):
    return _rounded(an.mean_set_size(event_impressions(spark, sf), "user_date"), "mean_size")


@query(
    "score_correlation",
    IMP + f" SELECT split, round(corr({sql_score(7)}, {sql_score(31)}),6) AS correlation, count(*) AS rows FROM imp GROUP BY split",
)
def score_correlation(spark, sf):
    imp = event_impressions(spark, sf)
    return _rounded(
        an.score_correlation(event_scores(imp, salt=7), event_scores(imp, salt=31)), "correlation"
    )


@query(
    "aux_label_profile",
    IMP + " SELECT split, target, round(avg(v),6) AS prevalence, round(corr(v,long_view),6) AS correlation FROM"
    " (SELECT split, long_view, 'is_click' AS target, is_click AS v FROM imp UNION ALL SELECT split, long_view, 'is_like',"
    " is_like FROM imp UNION ALL SELECT split, long_view, 'is_follow', is_follow FROM imp) GROUP BY ALL",
)
def aux_label_profile(spark, sf):
    out = an.aux_label_profile(event_impressions(spark, sf), ["is_click", "is_like", "is_follow"])
    return _rounded(out, "prevalence", "correlation")


@query(
    "side_coverage",
    LINES + ", d AS (SELECT CAST(c_custkey*2 AS VARCHAR) AS user_id FROM customer),"
    " k AS (SELECT split, user_id, count(*) AS n FROM lines GROUP BY ALL)"
    " SELECT split, sum(n)::BIGINT AS rows, round(sum(CASE WHEN d.user_id IS NOT NULL THEN n ELSE 0 END)/sum(n),6) AS"
    " row_coverage, count(*) AS distinct_keys, round(avg((d.user_id IS NOT NULL)::INTEGER),6) AS key_coverage"
    " FROM k LEFT JOIN d USING (user_id) GROUP BY split",
)
def side_coverage(spark, sf):
    out = an.side_coverage(line_impressions(spark, sf), customer_profiles(spark, sf), "user_id")
    return _rounded(out, "row_coverage", "key_coverage")


@query(
    "paired_deltas",
    OUTCOMES + ", s AS (SELECT run_id AS seed, arm AS bundle, sum(cents)/count(*) AS score FROM outcomes GROUP BY ALL),"
    " b AS (SELECT run_id AS seed, sum(cents)/count(*) AS base FROM outcomes GROUP BY ALL)"
    " SELECT bundle, round(avg(score-base),5)+0.0 AS paired_delta, count(*) FILTER (score-base > 0) AS seeds_improved,"
    " count(*) AS seeds FROM s JOIN b USING (seed) GROUP BY bundle",
)
def paired_deltas(spark, sf):
    o = event_outcomes(spark, sf)
    mean = (F.sum("cents") / F.count(F.lit(1))).alias("score")
    seeds = o.groupBy(F.col("run_id").alias("seed"), F.col("arm").alias("bundle")).agg(mean)
    base = o.groupBy(F.col("run_id").alias("seed")).agg(mean)
    return _rounded(an.paired_deltas(seeds, base), "paired_delta", places=5)
