"""Queries on joins, history features, ranking sets and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluation import experiments as ex
from ..operators import blend, history as h, joins, sets
from ..plans.keyed import distinct_rows
from ..schemas import (
    SAME_ROW_OUTCOMES,
    USER_CATEGORICAL,
    USER_LOG_NUMERIC,
    USER_NUMERIC,
    VIDEO_CATEGORICAL,
)
from ..sources.tables import (
    customer_profiles,
    event_impressions,
    event_outcomes,
    event_scores,
    line_impressions,
    part_profiles,
    table,
)
from .registry import IMP, LINES, OUTCOMES, query, sql_day, sql_score


def _halves(spark, sf):
    return event_impressions(spark, sf, only=("train",)), event_impressions(spark, sf)


def _line_halves(spark, sf):
    return line_impressions(spark, sf, only=("train",)), line_impressions(spark, sf)


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


# --- daily aggregates ---


@query(
    "daily_counts",
    LINES + " SELECT date, author_id, tab, CAST(sum(long_view) AS BIGINT) AS positives, count(*) AS impressions"
    " FROM lines GROUP BY ALL",
)
def daily_counts(spark, sf):
    return h.daily_counts(line_impressions(spark, sf), ["author_id", "tab"])


_PRIOR_SQL = (
    " SELECT date, coalesce(sum(n) OVER w,0)::BIGINT AS past_impressions, coalesce(sum(p) OVER w,0)::BIGINT"
    " AS past_positives, round(coalesce(sum(p) OVER w / nullif(sum(n) OVER w,0),0),6) AS prior FROM"
    " (SELECT date, count(*) AS n, sum(long_view) AS p FROM {t} GROUP BY date)"
    " WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)


@query("daily_prior", LINES + _PRIOR_SQL.format(t="lines"))
def daily_prior(spark, sf):
    return _rounded(h.daily_prior(line_impressions(spark, sf)), "prior")


# --- history ---


def _rate_sql(keys, prefix, smoothing, tgt="imp", hst="hist", extra="", out="row_id"):
    """Strictly earlier counts by a plain inequality join of daily tables."""
    ks = ", ".join(keys)
    on = " AND ".join(f"d.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)
    back = " AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)
    return (
        f"{extra}, d AS (SELECT {ks}, date, count(*) AS n, sum(long_view) AS p FROM {hst} GROUP BY ALL),"
        f" a AS (SELECT DISTINCT {ks}, date FROM {tgt}),"
        f" s AS (SELECT {', '.join('a.' + k for k in keys)}, a.date, coalesce(sum(d.n),0) AS n, coalesce(sum(d.p),0) AS p"
        f" FROM a LEFT JOIN d ON {on} AND d.date < a.date GROUP BY ALL),"
        f" g AS (SELECT t.date, coalesce(sum(q.p)/nullif(sum(q.n),0),0) AS prior FROM (SELECT DISTINCT date FROM {tgt}) t"
        f" LEFT JOIN (SELECT date, sum(n) AS n, sum(p) AS p FROM d GROUP BY date) q ON q.date < t.date GROUP BY t.date)"
        f" SELECT t.split, t.{out}, CAST(s.n AS DOUBLE) AS {prefix}_impressions,"
        f" round(CASE WHEN s.n+{smoothing} > 0 THEN (s.p+{smoothing}*g.prior)/(s.n+{smoothing}) ELSE g.prior END,6)"
        f" AS {prefix}_rate FROM {tgt} t JOIN s ON {back} AND t.date=s.date JOIN g ON g.date=t.date"
    )


@query("expanding_rate", IMP + _rate_sql(["author_id", "tab"], "author_tab", 5.0))
def expanding_rate(spark, sf):
    hist, imp = _halves(spark, sf)
    return _rounded(h.expanding_rate(hist, imp, ["author_id", "tab"], "author_tab", 5.0), "author_tab_rate")


@query("item_popularity", IMP + _rate_sql(["video_id"], "item_pop", 20.0))
def item_popularity(spark, sf):
    hist, imp = _halves(spark, sf)
    return _rounded(h.item_popularity(hist, imp, 20.0), "item_pop_rate")


@query("user_category_affinity", IMP + _rate_sql(["user_id", "tag"], "user_category_affinity", 0.0))
def user_category_affinity(spark, sf):
    hist, imp = _halves(spark, sf)
    return _rounded(h.user_category_affinity(hist, imp), "user_category_affinity_rate")


_BUCKET = (
    ", ed AS (SELECT quantile_cont(duration_ms, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM hist),"
    " impb AS (SELECT imp.*, CAST(len(list_filter(ed.e, lambda x: x < duration_ms)) AS VARCHAR) AS attr,"
    " CASE WHEN duration_ms <= 18000 THEN 'short' ELSE 'long' END AS regime FROM imp, ed),"
    " histb AS (SELECT * FROM impb WHERE split='train')"
)


@query(
    "user_attribute_affinity",
    IMP + _rate_sql(["user_id", "attr"], "user_duration_bucket_affinity", 3.0, "impb", "histb", _BUCKET),
)
def user_attribute_affinity(spark, sf):
    hist, imp = _halves(spark, sf)
    return _rounded(
        h.user_attribute_affinity(hist, imp, "duration_bucket", smoothing=3.0),
        "user_duration_bucket_affinity_rate",
    )


@query(
    "user_regime_affinity",
    IMP + _rate_sql(["user_id", "regime"], "user_duration_regime_affinity", 10.0, "impb", "histb", _BUCKET),
)
def user_regime_affinity(spark, sf):
    hist, imp = _halves(spark, sf)
    return _rounded(
        h.user_attribute_affinity(hist, imp, "duration_regime", smoothing=10.0),
        "user_duration_regime_affinity_rate",
    )


def _window_sql(w):
    d, t = sql_day("d.date"), sql_day("t.date")
    return (
        f"(SELECT t.split, t.row_id, count(d.date) AS n, coalesce(sum(d.long_view),0) AS p FROM imp t LEFT JOIN hist d"
        f" ON d.user_id=t.user_id AND {d} >= {t} - {w} AND d.date < t.date GROUP BY ALL) w{w}"
    )


@query(
    "user_history",
    IMP + " SELECT split, row_id, CAST(w1.n AS DOUBLE) AS user_history_1d_impressions,"
    " round(coalesce(w1.p/nullif(w1.n,0),0),6) AS user_history_1d_rate, CAST(w7.n AS DOUBLE) AS"
    " user_history_7d_impressions, round(coalesce(w7.p/nullif(w7.n,0),0),6) AS user_history_7d_rate FROM "
    + _window_sql(1) + " JOIN " + _window_sql(7) + " USING (split,row_id)",
)
def user_history(spark, sf):
    hist, imp = _halves(spark, sf)
    return _rounded(h.user_history(hist, imp, (1, 7)), "user_history_1d_rate", "user_history_7d_rate")


@query(
    "range_window",
    LINES + ", d AS (SELECT author_id, date, " + sql_day() + " AS day, count(*) AS n, CAST(sum(long_view) AS BIGINT) AS p"
    " FROM lhist GROUP BY ALL), a AS (SELECT DISTINCT author_id, date, " + sql_day() + " AS day FROM lines)"
    " SELECT a.author_id, a.date, coalesce(sum(d.n),0)::BIGINT AS impressions_30d, coalesce(sum(d.p),0)::BIGINT"
    " AS positives_30d FROM a LEFT JOIN d ON d.author_id=a.author_id AND d.day BETWEEN a.day-30 AND a.day-1"
    " GROUP BY a.author_id, a.date",
)
def range_window(spark, sf):
    hist, lines = _line_halves(spark, sf)
    return h.range_window(hist, lines, ["author_id"], (30,))


@query(
    "asof_strict",
    LINES + ", d AS (SELECT author_id, tab, date, count(*) AS n, sum(long_view) AS p FROM lhist GROUP BY ALL),"
    " c AS (SELECT author_id, tab, date, sum(n) OVER w AS n, sum(p) OVER w AS p FROM d"
    " WINDOW w AS (PARTITION BY author_id, tab ORDER BY date))"
    " SELECT t.date, t.order_id, t.line_no, t.author_id, t.tab, coalesce(c.n,0)::BIGINT AS past_impressions,"
    " coalesce(c.p,0)::BIGINT AS past_positives FROM lines t ASOF LEFT JOIN c ON t.author_id=c.author_id"
    " AND t.tab=c.tab AND t.date > c.date",
)
def asof_strict(spark, sf):
    hist, lines = _line_halves(spark, sf)
    out = h.asof_strict(lines, hist, ["author_id", "tab"])
    return out.select("date", "order_id", "line_no", "author_id", "tab", "past_impressions", "past_positives")


@query(
    "theta_decay",
    LINES + ", d AS (SELECT author_id, " + sql_day() + " AS day, count(*) AS n, sum(long_view) AS p"
    " FROM lhist GROUP BY ALL), a AS (SELECT DISTINCT author_id, date, " + sql_day() + " AS day FROM lines)"
    " SELECT a.author_id, a.date, round(coalesce(sum(d.n*pow(2.0,-(a.day-d.day)/3.0)),0),6) AS weight,"
    " round(coalesce(sum(d.p*pow(2.0,-(a.day-d.day)/3.0)),0),6) AS weighted FROM a LEFT JOIN d"
    " ON d.author_id=a.author_id AND d.day < a.day GROUP BY a.author_id, a.date",
)
def theta_decay(spark, sf):
    # 1,800 days at a half-life of 3: three anchor blocks
    hist, lines = _line_halves(spark, sf)
    return _rounded(h.theta_decay(hist, lines, ["author_id"], 3.0), "weight", "weighted")


def _decay_sql(attr, prefix, half, alpha, centered, tgt="imp", hst="hist", extra=""):
    def decayed(name, keys):
        cols = "".join(f"a.{k}, " for k in keys)
        picked = ", ".join([*keys, "day"])
        on = " AND ".join([*(f"d.{k}=a.{k}" for k in keys), "d.day < a.day"])
        return (
            f", {name} AS (SELECT {cols}a.day, coalesce(sum(d.n*pow(2.0,-(a.day-d.day)/{half})),0) AS w,"
            f" coalesce(sum(d.p*pow(2.0,-(a.day-d.day)/{half})),0) AS y FROM (SELECT DISTINCT {picked} FROM t) a"
            f" LEFT JOIN (SELECT {picked}, count(*) AS n, sum(long_view) AS p FROM ht GROUP BY ALL) d ON {on}"
            f" GROUP BY {cols}a.day)"
        )

    logit = lambda x: (
        f"(ln(least(greatest({x},1e-6),1-1e-6)/(1-least(greatest({x},1e-6),1-1e-6))))"
    )
    value = f"{logit('rate')}-{logit('base')}" if centered else "rate"
    return (
        f"{extra}, t AS (SELECT split, row_id, long_view, user_id AS u, {attr} AS att, {sql_day()} AS day FROM {tgt}),"
        f" ht AS (SELECT * FROM t WHERE split='train')"
        + decayed("pr", ["u", "att"]) + decayed("ar", ["att"]) + decayed("ur", ["u"]) + decayed("gr", [])
        + f", r AS (SELECT t.split, t.row_id, pr.w AS w, CASE WHEN ar.w>0 THEN ar.y/ar.w WHEN gr.w>0 THEN gr.y/gr.w"
        f" ELSE 0 END AS prior, CASE WHEN gr.w>0 THEN gr.y/gr.w ELSE 0 END AS overall, pr.y AS y, ur.w AS uw, ur.y AS uy"
        f" FROM t JOIN pr USING (u,att,day) JOIN ar USING (att,day) JOIN ur USING (u,day) JOIN gr USING (day)),"
        f" q AS (SELECT split, row_id, w, CASE WHEN w+{alpha}>0 THEN (y+{alpha}*prior)/(w+{alpha}) ELSE prior END AS rate,"
        f" CASE WHEN uw+{alpha}>0 THEN (uy+{alpha}*overall)/(uw+{alpha}) ELSE overall END AS base FROM r)"
        f" SELECT split, row_id, round({value},5)+0.0 AS {prefix}_{'lift' if centered else 'rate'},"
        f" round(w,5)+0.0 AS {prefix}_weight FROM q"
    )


@query("decayed_affinity", IMP + _decay_sql("author_id", "decay_author_id_h7", 7.0, 20.0, True))
def decayed_affinity(spark, sf):
    hist, imp = _halves(spark, sf)
    out = h.decayed_affinity(hist, imp)
    return _rounded(out, "decay_author_id_h7_lift", "decay_author_id_h7_weight", places=5)


@query("decayed_tag_rate", IMP + _decay_sql("tag", "decay_tag_h2_5", 2.5, 4.0, False))
def decayed_tag_rate(spark, sf):
    hist, imp = _halves(spark, sf)
    out = h.decayed_affinity(hist, imp, "tag", half_life_days=2.5, alpha=4.0, centered=False)
    out = out.toDF(*[c.replace("h2.5", "h2_5") for c in out.columns])
    return _rounded(out, "decay_tag_h2_5_rate", "decay_tag_h2_5_weight", places=5)


@query(
    "decayed_bucket_lift",
    IMP + _decay_sql("attr", "decay_duration_bucket_h3", 3.0, 8.0, True, "impb", "histb", _BUCKET),
)
def decayed_bucket_lift(spark, sf):
    hist, imp = _halves(spark, sf)
    out = h.decayed_affinity(hist, imp, "duration_bucket", half_life_days=3.0, alpha=8.0)
    return _rounded(out, "decay_duration_bucket_h3_lift", "decay_duration_bucket_h3_weight", places=5)


@query(
    "alignment_check",
    IMP + " SELECT split, row_id, CASE WHEN tag='UNK' THEN 'missing' ELSE 'duplicated' END AS problem FROM imp"
    " WHERE tag='UNK' OR is_click=1",
)
def alignment_check(spark, sf):
    imp = event_impressions(spark, sf).select("split", "row_id", "tag", "is_click")
    kept = imp.where("tag <> 'UNK'")
    return h.check_alignment(kept.unionByName(kept.where("is_click = 1")), imp)


# --- joins ---

_CUST = (
    ", cu AS (SELECT CAST(c_custkey*2 AS VARCHAR) AS user_id, c_mktsegment AS user_active_degree,"
    " 'r' || (c_custkey % 4) AS follow_user_num_range, 'f' || (c_custkey % 3) AS fans_user_num_range,"
    " 'n' || c_nationkey AS friend_user_num_range, 'd' || (c_custkey % 6) AS register_days_range, "
    + ", ".join(f"CAST((c_custkey+{i}) % {i + 2} AS VARCHAR) AS onehot_feat{i}" for i in range(18))
    + ", CAST(c_custkey % 2 AS DOUBLE) AS is_live_streamer, CAST(c_nationkey % 2 AS DOUBLE) AS is_video_author,"
    " floor(c_acctbal) AS follow_user_num, CAST(c_custkey*7 AS DOUBLE) AS fans_user_num,"
    " CAST(5-c_custkey AS DOUBLE) AS friend_user_num, CASE WHEN c_nationkey >= 5 THEN c_custkey+30.0::DOUBLE END"
    " AS register_days FROM customer)"
    ", pa AS (SELECT CAST(p_partkey*2 AS VARCHAR) AS video_id, p_type AS video_type, p_brand AS upload_type,"
    " CAST(p_partkey % 3 AS VARCHAR) AS music_type, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR),2,'0') AS upload_dt,"
    " CAST(p_size % 5 AS DOUBLE) AS server_width, CAST(p_size AS DOUBLE) AS server_height,"
    " floor(p_retailprice) AS video_duration FROM part)"
)


def _user_number(name):
    if name in USER_LOG_NUMERIC:
        return f"CASE WHEN {name} IS NOT NULL THEN round(ln(1+greatest({name},0)),6) END AS su_log_{name}"
    return f"{name} AS su_{name}"


@query(
    "static_side",
    IMP + _CUST + " SELECT split, row_id, "
    + ", ".join(f"coalesce({c},'UNK') AS cat_su_{c}" for c in USER_CATEGORICAL) + ", "
    + ", ".join(_user_number(c) for c in USER_NUMERIC) + ", "
    + ", ".join(f"coalesce({c},'UNK') AS cat_sv_{c}" for c in VIDEO_CATEGORICAL)
    + ", server_width AS sv_server_width, server_height AS sv_server_height,"
    " CASE WHEN video_duration IS NOT NULL THEN round(ln(1+greatest(video_duration,0)),6) END AS sv_log_video_duration,"
    " round(server_height/nullif(server_width,0),6) AS sv_aspect_ratio"
    " FROM imp LEFT JOIN cu USING (user_id) LEFT JOIN pa USING (video_id)",
)
def static_side(spark, sf):
    out = joins.static_side(
        event_impressions(spark, sf), customer_profiles(spark, sf), part_profiles(spark, sf), checked=True
    )
    logs = [f"su_log_{c}" for c in USER_LOG_NUMERIC] + ["sv_log_video_duration", "sv_aspect_ratio"]
    return out.withColumns({n: F.round(n, 6) for n in logs})


@query(
    "one_to_one_merge",
    IMP + " SELECT split, row_id, user_id, duration_ms FROM imp",
)
def one_to_one_merge(spark, sf):
    imp = event_impressions(spark, sf)
    left = imp.select("split", "row_id", "user_id")
    right = imp.select("split", "row_id", "duration_ms")
    return joins.merge_one_to_one(left, right, checked=True)


@query(
    "merge_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies, 'left' AS side FROM lineitem GROUP BY ALL HAVING count(*)>1",
)
def merge_violations(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf, "lineitem").select(*keys)
    return joins.merge_violations(lines, distinct_rows(lines), keys)


@query(
    "reindex",
    IMP + " SELECT split, row_id, CASE WHEN is_follow=1 THEN duration_ms END AS duration_ms FROM imp",
)
def reindex(spark, sf):
    imp = event_impressions(spark, sf)
    built = imp.where("is_follow = 1").select("split", "row_id", "duration_ms")
    return joins.reindex(built, imp)


@query(
    "drop_rejected",
    OUTCOMES + ", q AS (SELECT run_id, run_id || ':' || hypothesis_id AS hypothesis_id, seq, accepted FROM outcomes)"
    " SELECT run_id, hypothesis_id, seq FROM q o WHERE NOT EXISTS (SELECT 1 FROM q r WHERE"
    " NOT r.accepted AND r.hypothesis_id=o.hypothesis_id)",
)
def drop_rejected(spark, sf):
    # an idea belongs to the run that had it
    o = event_outcomes(spark, sf).withColumn("hypothesis_id", F.concat_ws(":", "run_id", "hypothesis_id"))
    return joins.drop_rejected(o, o).select("run_id", "hypothesis_id", "seq")


# --- set operations ---


@query(
    "union_all",
    IMP + " SELECT date, user_id, video_id FROM imp UNION ALL SELECT CAST(strftime(l_shipdate,'%Y%m%d') AS INTEGER),"
    " CAST(o_custkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
)
def union_all(spark, sf):
    names = ["date", "user_id", "video_id"]
    return joins.union_all(
        event_impressions(spark, sf).select(*names), line_impressions(spark, sf).select(*names)
    )


@query(
    "unknown_names",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS name FROM events WHERE CAST(user_id AS VARCHAR) NOT IN"
    " (SELECT CAST(c_custkey*2 AS VARCHAR) FROM customer)",
)
def unknown_names(spark, sf):
    asked = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"))
    return joins.unknown_names(asked, customer_profiles(spark, sf).select(F.col("user_id").alias("name")))


_SOURCE = (
    "CASE event_type WHEN 'click' THEN 'is_click' WHEN 'view' THEN 'duration_ms' WHEN 'signup' THEN 'is_follow'"
    " WHEN 'purchase' THEN 'long_view' ELSE 'video_id' END"
)


def event_lineage(spark, sf):
    """A lineage table with one declared feature column per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    source = (
        F.when(kind == "click", "is_click").when(kind == "view", "duration_ms")
        .when(kind == "signup", "is_follow").when(kind == "purchase", "long_view").otherwise("video_id")
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("feature"),
        (k >= 3).alias("has_lineage"),
        F.array(source, F.lit("date")).alias("sources"),
        F.when(k < 40, "same_row").when(k < 80, "strictly_earlier").otherwise("static").alias("scope"),
        F.when(k % 2 == 0, "standard").otherwise("randomized").alias("source_log"),
        F.when(k < 90, (F.lit(20220421) + k % 3).cast("int")).alias("max_source_date"),
        source.alias("source"),
    )


@query(
    "forbidden_sources",
    f"SELECT 'f_' || event_id AS feature, {_SOURCE} AS source FROM events WHERE {_SOURCE} IN ("
    + ",".join(f"'{n}'" for n in SAME_ROW_OUTCOMES) + ")",
)
def forbidden_sources(spark, sf):
    names = spark.createDataFrame([(n,) for n in SAME_ROW_OUTCOMES], "source string")
    return joins.forbidden_sources(event_lineage(spark, sf).select("feature", "source"), names)


# --- ranking sets ---


@query(
    "group_sizes",
    IMP + " SELECT split, user_id, date, count(*) AS rows FROM imp GROUP BY ALL",
)
def group_sizes(spark, sf):
    return sets.group_sizes(event_impressions(spark, sf), "user_date")


@query(
    "mixed_sets",
    IMP + " SELECT split, row_id, user_id, date, long_view FROM imp JOIN (SELECT split, user_id, date FROM imp"
    " GROUP BY ALL HAVING sum(long_view) > 0 AND sum(long_view) < count(*)) USING (split, user_id, date)",
)
def mixed_sets(spark, sf):
    imp = event_impressions(spark, sf).select("split", "row_id", "user_id", "date", "long_view")
    return sets.mixed_sets(imp, "user_date")


_SCORED = IMP + f", sc AS (SELECT *, {sql_score()} AS score FROM imp)"
_AVG_RANK = "(rank() OVER ({p} ORDER BY {s}) + (count(*) OVER ({p}, {s}) - 1)/2.0)"


def _avg_rank(score, keys="split, user_id"):
    return (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {score}) +"
        f" (count(*) OVER (PARTITION BY {keys}, {score}) - 1)/2.0)"
    )


def _pct(score):
    return f"{_avg_rank(score)}/count(*) OVER (PARTITION BY split, user_id)"


@query(
    "percent_rank",
    _SCORED + f" SELECT split, row_id, user_id, round({_pct('score')},6) AS pct_rank FROM sc",
)
def percent_rank(spark, sf):
    pred = event_scores(event_impressions(spark, sf)).select("split", "row_id", "user_id", "score")
    return _rounded(sets.percent_rank(pred), "pct_rank").drop("score")


def _set_sql(keys):
    return (
        f" SELECT split, row_id, count(*) OVER (PARTITION BY {keys}) AS set_size,"
        f" round(score-avg(score) OVER (PARTITION BY {keys}),6)+0.0 AS score_set_dev,"
        f" {_avg_rank('score', keys)} AS score_set_rank,"
        f" round(duration_ms-avg(duration_ms) OVER (PARTITION BY {keys}),6)+0.0 AS duration_ms_set_dev,"
        f" {_avg_rank('duration_ms', keys)} AS duration_ms_set_rank FROM sc"
    )


@query("set_context", _SCORED + _set_sql("split, user_id, date"))
def set_context(spark, sf):
    rows = event_scores(event_impressions(spark, sf))
    out = sets.set_context(rows, ["score", "duration_ms"], "user_date")
    return _rounded(out, "score_set_dev", "duration_ms_set_dev")


@query(
    "capped_sets",
    IMP + " SELECT split, row_id, user_id FROM imp QUALIFY row_number() OVER (PARTITION BY split, user_id"
    " ORDER BY md5('3:' || row_id), row_id) <= 20",
)
def capped_sets(spark, sf):
    imp = event_impressions(spark, sf).select("split", "row_id", "user_id")
    return sets.cap_sets(imp, "user", 20, seed=3)


_PAIRS = (
    ", o AS (SELECT user_id, row_id, long_view AS y, row_number() OVER (PARTITION BY user_id, long_view"
    " ORDER BY md5('5:' || row_id), row_id) - 1 AS j, count(*) OVER (PARTITION BY user_id, long_view) AS c FROM hist),"
    " u AS (SELECT user_id, sum(long_view) AS p, count(*)-sum(long_view) AS q FROM hist GROUP BY user_id"
    " HAVING sum(long_view)>0 AND sum(long_view)<count(*)),"
    " g AS (SELECT user_id, unnest(range(least(4, greatest(p,q))::BIGINT)) AS pair, p, q FROM u)"
    " SELECT 'train' AS split, g.user_id, CAST(pair AS INTEGER) AS pair, a.row_id AS pos_row, b.row_id AS neg_row FROM g"
    " JOIN o a ON a.user_id=g.user_id AND a.y=1 AND a.j = pair % least(p,4)"
    " JOIN o b ON b.user_id=g.user_id AND b.y=0 AND b.j = pair % least(q,4)"
)


@query("same_user_pairs", IMP + _PAIRS)
def same_user_pairs(spark, sf):
    return sets.same_user_pairs(_halves(spark, sf)[0], 4, seed=5)


@query(
    "listwise_targets",
    _SCORED + " SELECT split, row_id, round(long_view/greatest(sum(long_view) OVER w,1e-9),6) AS target,"
    " round(exp(score)/sum(exp(score)) OVER w,6) AS softmax FROM sc WINDOW w AS (PARTITION BY split, user_id, date)",
)
def listwise_targets(spark, sf):
    rows = event_scores(event_impressions(spark, sf))
    return _rounded(sets.listwise_targets(rows), "target", "softmax")


# --- sorts and limits ---


@query(
    "stable_sort",
    _SCORED + " SELECT split, row_id, user_id, round(score,6) AS score FROM sc",
)
def stable_sort(spark, sf):
    rows = event_scores(event_impressions(spark, sf)).select("split", "row_id", "user_id", "score")
    return sets.stable_sort(_rounded(rows, "score"), ["split", "user_id", "score"], ["row_id"])


@query(
    "top_k_per_user",
    _SCORED + " SELECT split, user_id, row_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY split, user_id ORDER BY score DESC, row_id) AS r FROM sc) WHERE r <= 5",
)
def top_k_per_user(spark, sf):
    rows = event_scores(event_impressions(spark, sf)).select("split", "row_id", "user_id", "score")
    return sets.top_k_per_user(rows, 5).drop("score")


@query(
    "last_outcomes",
    OUTCOMES + " SELECT seq, hypothesis_id, accepted, arm FROM outcomes ORDER BY seq DESC LIMIT 10",
)
def last_outcomes(spark, sf):
    return ex.last_outcomes(event_outcomes(spark, sf), 10).select("seq", "hypothesis_id", "accepted", "arm")


@query(
    "candidate_order",
    OUTCOMES + " SELECT hypothesis_id AS name, CAST(max(cents) AS DOUBLE) AS effect FROM outcomes GROUP BY 1",
)
def candidate_order(spark, sf):
    found = event_outcomes(spark, sf).groupBy(F.col("hypothesis_id").alias("name")).agg(
        F.max("cents").cast("double").alias("effect")
    )
    return ex.order_candidates(found)


# --- blends ---

_BLEND = IMP + f", sc AS (SELECT split, row_id, user_id, {sql_score(7)} AS a, {sql_score(31)} AS b FROM imp)"


def _two_scores(spark, sf):
    imp = event_impressions(spark, sf)
    return [
        event_scores(imp, salt=s).select("split", "row_id", "user_id", "score") for s in (7, 31)
    ]


@query(
    "seed_bag",
    _BLEND + " SELECT split, row_id, user_id, round((a*0.65::DOUBLE+b*0.35::DOUBLE)/1.0::DOUBLE,5) AS score FROM sc",
)
def seed_bag(spark, sf):
    return _rounded(blend.seed_bag(_two_scores(spark, sf), [0.65, 0.35]), "score", places=5)


@query(
    "rank_average",
    _BLEND + f" SELECT split, row_id, user_id, round(({_pct('a')}*0.65::DOUBLE+{_pct('b')}*0.35::DOUBLE)/1.0::DOUBLE,9) AS score FROM sc",
)
def rank_average(spark, sf):
    return _rounded(blend.rank_average(_two_scores(spark, sf), [0.65, 0.35]), "score", places=9)
