"""Queries that fit models on the impression log, and user-written builders."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ..evaluation import analyses as an, experiments as ex, metrics as m
from ..functions.lineage import SAME_ROW, STRICTLY_EARLIER
from ..models import common, deep, fm, listwise, multitask, trees
from ..operators import blend, builder, history as h, rowwise, sets
from ..plans.ordering import find_hot
from ..schemas import CONFIRM_SEEDS
from ..session import cut_lineage
from ..sources.tables import EVENT_START, event_impressions, event_scores
from .features import _halves, _rate_sql, _rounded
from .judging import _metric_columns, _metric_sql
from .registry import IMP, query, sql_score

FEATURES = ["cat_video_id", "cat_author_id", "cat_tab", "cat_dur_bucket", "cat_tag", "item_pop_rate", "log_duration"]
NUMERIC = ["item_pop_rate", "log_duration", "temporal_day_index"]


def model_frame(spark, sf):
    """Impressions with row features and item popularity appended, written once."""
    hist, imp = _halves(spark, sf)
    rows = h.item_popularity(hist, imp, 20.0, append=True)
    rows = rowwise.raw_categorical(rows, rowwise.duration_edges(imp), append=True)
    rows = rowwise.temporal(rows, EVENT_START, append=True)
    rows = rows.withColumns(
        {"cat_tag": F.col("tag"), "log_duration": F.log1p(F.col("duration_ms").cast("double"))}
    )
    return cut_lineage(rows)


_SCORE = ["split", "row_id", "user_id", "score"]


@query("fm_baseline")
def fm_baseline(spark, sf):
    rows = model_frame(spark, sf)
    return fm.fit_fm(rows, FEATURES).score(rows).select(*_SCORE)


@query("fm_pairwise")
def fm_pairwise(spark, sf):
    rows = model_frame(spark, sf)
    return fm.fit_fm_pairwise(rows, FEATURES).score(rows).select(*_SCORE)


@query("gbt_binary")
def gbt_binary(spark, sf):
    rows = model_frame(spark, sf)
    return trees.fit_gbt(rows, FEATURES).score(rows).select(*_SCORE)


@query("lambdarank")
def lambdarank(spark, sf):
    rows = model_frame(spark, sf)
    return trees.fit_lambdarank(rows, FEATURES, group_by="user_date").score(rows).select(*_SCORE)


_CUTS = ["tab", "author_id", "video_id"]


@query(
    "gbt_root_split",
    IMP + ", base AS (SELECT avg(long_view) AS p FROM imp WHERE split = 'train'), long AS (SELECT unnest([0, 1, 2]) AS f,"
    " unnest([CAST(tab AS DOUBLE), CAST(author_id AS DOUBLE), CAST(video_id AS DOUBLE)]) AS x, p - long_view AS g,"
    " p * (1 - p) AS h FROM imp, base WHERE split = 'train'), bins AS (SELECT f, x, sum(g) AS g, sum(h) AS h, count(*) AS n"
    " FROM long GROUP BY f, x), cuts AS (SELECT f, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,"
    " sum(g) OVER (PARTITION BY f) AS ga, sum(h) OVER (PARTITION BY f) AS ha, sum(n) OVER (PARTITION BY f) AS na FROM bins"
    " WINDOW w AS (PARTITION BY f ORDER BY x)), best AS (SELECT *, gl*gl/(hl+1) + (ga-gl)*(ga-gl)/(ha-hl+1) AS gain"
    " FROM cuts WHERE nl >= 20 AND na - nl >= 20 ORDER BY round(gain, 9) DESC, f, x LIMIT 1)"
    " SELECT CAST(f AS INTEGER) AS feature, x AS threshold, 'left' AS side, CAST(nl AS BIGINT) AS n,"
    " round(-gl/(hl+1), 6) + 0.0 AS value FROM best UNION ALL"
    " SELECT CAST(f AS INTEGER), x, 'right', CAST(na - nl AS BIGINT), round(-(ga-gl)/(ha-hl+1), 6) + 0.0 FROM best",
)
def gbt_root_split(spark, sf):
    """The first split of the boosted trees under log loss, and the Newton steps of its two leaves."""
    imp = event_impressions(spark, sf).where("split = 'train'")
    rows = imp.withColumns({f"x{i}": F.col(c).cast("double") for i, c in enumerate(_CUTS)})
    model = trees.fit_gbt(rows, ["x0", "x1", "x2"], n_estimators=1, num_leaves=2, lr=1.0, reg_lambda=1.0)
    feature, threshold = model.root()
    logit = F.log(F.col("score") / (1.0 - F.col("score"))) - F.lit(model.base)
    sides = model.score(rows).join(rows.select("split", "row_id", f"x{feature}"), ["split", "row_id"])
    side = F.when(F.col(f"x{feature}") <= threshold, "left").otherwise("right").alias("side")
    found = sides.groupBy(side).agg(F.count(F.lit(1)).alias("n"), F.avg(logit).alias("value"))
    return _rounded(
        found.select(F.lit(feature).alias("feature"), F.lit(threshold).alias("threshold"), "side", "n", "value"), "value"
    )


@query("deep_fm")
def deep_fm(spark, sf):
    rows = model_frame(spark, sf)
    return deep.fit_deepfm(rows, FEATURES).score(rows).select(*_SCORE)


@query("multitask")
def multitask_scores(spark, sf):
    rows = model_frame(spark, sf)
    # the auxiliaries that these tables have
    model = multitask.fit_multitask(rows, FEATURES, ["is_click", "is_like", "is_follow"])
    return model.score(rows).select(*_SCORE)


@query("listwise")
def listwise_scores(spark, sf):
    rows = model_frame(spark, sf)
    return listwise.fit_listwise(rows, NUMERIC).score(rows).select(*_SCORE)


# --- the steps of the models on fixed parameters ---

_FIELDS = 3
_K = 2


def _id_rows(df):
    """Three fields in one id space: video (100), tab (4), author (10)."""
    ids = [F.col("video_id").cast("int"), F.col("tab").cast("int") + 100, F.col("author_id").cast("int") + 104]
    return df.select("split", "row_id", "user_id", "long_view", F.array(*ids).alias("ids"))


def _parameters(spark, dimension=114):
    value = lambda a, b: ((F.col("id") * a + b) % 17 - 8) / F.lit(20.0)
    return spark.range(dimension).select(
        "id", value(5, 1).alias("w"), *[value(7 + f, 3 * f).alias(f"v{f}") for f in range(_K)]
    )


_FM_SQL = (
    IMP + ", par AS (SELECT id, ((id*5+1)%17-8)/20.0 AS w, ((id*7+0)%17-8)/20.0 AS v0, ((id*8+3)%17-8)/20.0 AS v1"
    " FROM range(114) t(id)), ids AS (SELECT split, row_id, user_id, long_view, unnest([CAST(video_id AS INTEGER),"
    " CAST(tab AS INTEGER)+100, CAST(author_id AS INTEGER)+104]) AS id FROM imp), z AS (SELECT split, row_id,"
    " any_value(user_id) AS user_id, any_value(long_view) AS long_view, sum(w) + 0.5*(sum(v0)*sum(v0) + sum(v1)*sum(v1)"
    " - sum(v0*v0) - sum(v1*v1)) AS z, sum(v0) AS s0, sum(v1) AS s1 FROM ids JOIN par USING (id) GROUP BY split, row_id)"
)


@query("fm_logits", _FM_SQL + " SELECT split, row_id, round(z, 6) + 0.0 AS z FROM z")
def fm_logits(spark, sf):
    rows = _id_rows(event_impressions(spark, sf))
    return _rounded(fm.fm_logits(rows, ["split", "row_id"], _parameters(spark), 114, _K).select("split", "row_id", "z"), "z")


@query(
    "pair_gradients",
    _FM_SQL + ", pairs AS (SELECT p.row_id AS a, n.row_id AS b, 1/(1+exp(p.z-n.z)) AS g FROM z p JOIN z n ON"
    " n.row_id = p.row_id + 1 WHERE p.split='train' AND n.split='train' AND p.long_view=1 AND n.long_view=0),"
    " back AS (SELECT a AS row_id, -g AS f FROM pairs UNION ALL SELECT b, g FROM pairs)"
    " SELECT id, round(sum(f),6)+0.0 AS g_w, round(sum(f*(s0-v0)),6)+0.0 AS g_v0, round(sum(f*(s1-v1)),6)+0.0 AS g_v1"
    " FROM back JOIN z ON z.row_id=back.row_id AND z.split='train' JOIN ids ON ids.row_id=back.row_id AND"
    " ids.split='train' JOIN par USING (id) GROUP BY id",
)
def pair_gradients(spark, sf):
    train = _id_rows(event_impressions(spark, sf)).where("split = 'train'")
    after = train.select((F.col("row_id") - 1).alias("pos_row"), F.col("row_id").alias("neg_row"), F.col("long_view").alias("y"))
    pairs = train.where("long_view = 1").select(F.col("row_id").alias("pos_row")).join(after.where("y = 0"), "pos_row")
    pairs = pairs.select(F.col("pos_row").cast("string").alias("pair_id"), "pos_row", "neg_row")
    grads, _ = fm.pair_gradients(pairs, train.select("row_id", "ids"), _parameters(spark), 114, _K)
    return _rounded(grads, "g_w", "g_v0", "g_v1")


@query(
    "listwise_gradient",
    IMP + ", m AS (SELECT user_id, date FROM imp WHERE split='train' GROUP BY ALL HAVING min(long_view) < max(long_view)),"
    " s AS (SELECT imp.*, count(*) OVER w AS n, sum(long_view) OVER w AS y FROM imp SEMI JOIN m USING (user_id, date)"
    " WHERE split='train' WINDOW w AS (PARTITION BY user_id, date))"
    " SELECT round(sum(-(long_view::DOUBLE/y)*(-ln(n))),4) AS loss, round(sum(1.0/n),4) AS sets,"
    " round(sum((1.0/n - long_view::DOUBLE/y)*ln(1+duration_ms)),4) AS g_x FROM s",
)
def listwise_gradient(spark, sf):
    """The first step of the listwise fit, at zero weights."""
    train = event_impressions(spark, sf).where("split = 'train'")
    rows = sets.mixed_sets(train, "user_date").withColumns(
        {"score": F.lit(0.0), "x": F.log1p(F.col("duration_ms").cast("double"))}
    )
    out = listwise.listwise_gradient(rows, sets.set_keys("user_date"), ["x"], hot=None)
    return _rounded(out, "loss", "sets", "g_x", places=4)


@query(
    "lambdarank_gradients",
    IMP + f", sc AS (SELECT split, row_id, user_id, long_view AS y, {sql_score()} AS s FROM imp), mx AS (SELECT split, user_id,"
    " sum(y) AS pos, max(s) AS hi, min(s) AS lo FROM sc GROUP BY ALL HAVING min(y) < max(y)),"
    " pl AS (SELECT sc.*, pos, hi, lo, row_number() OVER (PARTITION BY split, user_id ORDER BY s DESC, row_id) - 1 AS p"
    " FROM sc JOIN mx USING (split, user_id)), idl AS (SELECT n, sum(1/log2(r+2)) AS best FROM range(1,31) a(n),"
    " range(30) b(r) WHERE r < n GROUP BY n), pr AS (SELECT a.split, a.user_id, a.row_id AS ra, b.row_id AS rb,"
    " CASE WHEN a.y > b.y THEN 1.0 ELSE -1.0 END AS up, 1/(1+exp(CASE WHEN a.y > b.y THEN a.s-b.s ELSE b.s-a.s END)) AS q,"
    " abs(1/log2(a.p+2)-1/log2(b.p+2))/best / CASE WHEN a.hi <> a.lo THEN 0.01+abs(a.s-b.s) ELSE 1 END AS w"
    " FROM pl a JOIN pl b ON a.split=b.split AND a.user_id=b.user_id AND a.p < b.p AND a.p < 30 AND a.y <> b.y"
    " JOIN idl ON idl.n = least(30, a.pos)),"
    " al AS (SELECT split, user_id, sum(2*q*w) AS t FROM pr GROUP BY ALL), ea AS (SELECT split, user_id, ra AS row_id,"
    " -q*w*up AS g, q*(1-q)*w AS h FROM pr UNION ALL SELECT split, user_id, rb, q*w*up, q*(1-q)*w FROM pr)"
    " SELECT pl.split, pl.row_id, round(coalesce(sum(g),0)*max(CASE WHEN t > 0 THEN log2(1+t)/t ELSE 1 END),6)+0.0 AS g,"
    " round(coalesce(sum(h),0)*max(CASE WHEN t > 0 THEN log2(1+t)/t ELSE 1 END),6)+0.0 AS h"
    " FROM pl LEFT JOIN ea USING (split, user_id, row_id) LEFT JOIN al ON al.split=pl.split AND al.user_id=pl.user_id"
    " GROUP BY pl.split, pl.row_id",
)
def lambdarank_gradients(spark, sf):
    scored = event_scores(event_impressions(spark, sf))
    hot = find_hot(scored, ["split", "user_id"])
    rows = sets.mixed_sets(scored, "user", hot=hot).select(
        "split", "user_id", "row_id", "score", F.col("long_view").cast("double").alias("label")
    )
    out = trees.lambdas(rows, ["split", "user_id"], hot=hot).select("split", "row_id", "g", "h")
    return _rounded(out, "g", "h")


# --- bags, confirmations and ablations of a model that SQL can state ---


def _popularity_fit(weight=0.1):
    """Scores every row by its video's train rate, and a little by a seeded hash."""

    def fit(rows, seed):
        train = rows.where("split = 'train'")
        rate = train.groupBy("video_id").agg((F.sum("long_view") / F.count(F.lit(1))).alias("rate"))
        noise = an.hash_score(seed) * weight
        scored = rows.join(rate, "video_id", "left").withColumn("score", F.coalesce("rate", F.lit(0.0)) + noise)
        return scored.select("split", "row_id", "user_id", "long_view", "score")

    return fit


def _fit_sql(seed, name, weight=0.1):
    return (
        f", {name} AS (SELECT split, row_id, user_id, long_view, coalesce(rate,0) +"
        f" ('0x' || substr(md5('{seed}:' || row_id),1,8))::BIGINT/4294967296.0*{weight} AS score FROM imp LEFT JOIN"
        " (SELECT video_id, sum(long_view)/count(*) AS rate FROM imp WHERE split='train' GROUP BY 1) USING (video_id))"
    )


_SEEDS = (3, 5, 8)
_THREE = IMP + "".join(_fit_sql(s, f"f{s}") for s in _SEEDS)


def _blend_sql(value):
    parts = " UNION ALL ".join(f"SELECT split, row_id, user_id, {value} AS v FROM f{s}" for s in _SEEDS)
    return f" SELECT split, row_id, user_id, round(avg(v),6) AS score FROM ({parts}) GROUP BY ALL"


@query("seed_bag_job", _THREE + _blend_sql("score"))
def seed_bag_job(spark, sf):
    return _rounded(blend.bag(_popularity_fit(), event_impressions(spark, sf), list(_SEEDS)), "score")


_OF_USER = "PARTITION BY split, user_id"


@query(
    "rank_bag_job",
    _THREE + _blend_sql(
        f"(rank() OVER ({_OF_USER} ORDER BY score) + (count(*) OVER ({_OF_USER}, score) - 1)/2.0)"
        f" / count(*) OVER ({_OF_USER})"
    ),
)
def rank_bag_job(spark, sf):
    out = blend.bag(_popularity_fit(), event_impressions(spark, sf), list(_SEEDS), "rank_average")
    return _rounded(out, "score")


@query(
    "seed_confirmation",
    IMP + "".join(_fit_sql(s, f"f{s}") for s in CONFIRM_SEEDS) + ", cf AS ("
    + " UNION ALL ".join(f"SELECT {s} AS seed, * FROM f{s} WHERE split='valid'" for s in CONFIRM_SEEDS)
    + ")" + _metric_sql("cf", keys="seed, split"),
)
def seed_confirmation(spark, sf):
    out = blend.confirm_seeds(_popularity_fit(), event_impressions(spark, sf), m.evaluate)
    return _metric_columns(out)


@query(
    "batch_scoring",
    IMP + " SELECT split, row_id, user_id, round(0.25*CAST(tab AS INTEGER) - 0.5*is_like + ln(1+duration_ms)/10,6) AS score"
    " FROM imp",
)
def batch_scoring(spark, sf):
    """Scores of all splits under a transformer with given weights."""
    given = "0.25D * CAST(tab AS INT) - 0.5D * is_like + ln(1 + duration_ms) / 10"
    model = SQLTransformer(statement=f"SELECT *, {given} AS prediction FROM __THIS__")
    return _rounded(common.score(model, event_impressions(spark, sf), raw=True).select(*_SCORE), "score")


_PARTS = {"duration": "ln(1+duration_ms)", "hour": "CAST(hourmin AS DOUBLE)/100", "tab": "CAST(tab AS DOUBLE)"}


@query(
    "leave_one_out",
    IMP + ", ab AS ("
    + " UNION ALL ".join(
        f"SELECT '{without}' AS kind, split, row_id, user_id, long_view, "
        + " + ".join(sql for name, sql in _PARTS.items() if name != without) + " AS score FROM imp WHERE split='valid'"
        for without in ["none", *_PARTS]
    )
    + ")" + _metric_sql(
        "ab", keys="kind, split",
        tail=" SELECT kind AS node, round((gauc+ndcg5)/2,6) AS score_without, round((SELECT (gauc+ndcg5)/2 FROM mt WHERE"
        " kind='none') - (gauc+ndcg5)/2,6)+0.0 AS removal_cost, 'scored' AS status FROM mt WHERE kind <> 'none'",
    ),
)
def leave_one_out(spark, sf):
    """Removal costs under a fit that adds its features up."""
    from ..operators.encoders import merge_features

    rows = event_impressions(spark, sf)
    keys = ["split", "row_id"]
    values = {
        "duration": F.log1p(F.col("duration_ms").cast("double")),
        "hour": F.col("hourmin").cast("double") / 100,
        "tab": F.col("tab").cast("double"),
    }
    bundles = {name: rows.select(*keys, value.alias(f"x_{name}")) for name, value in values.items()}
    labels = rows.select(*keys, "user_id", "long_view")

    def neutral(bundle):
        name = next(c for c in bundle.columns if c not in keys)
        return rowwise.constant_feature(bundle).withColumnRenamed("ablation_constant", name)

    def fit(parts):
        total = reduce(add, [F.col(f"x_{name}") for name in values])
        merged = merge_features(*parts).join(labels, keys)
        return merged.select(*keys, "user_id", "long_view", total.alias("score"))

    incumbent = common.primary_of(fit(list(bundles.values())))
    out = ex.leave_one_out(bundles, fit, common.primary_of, neutral, incumbent).drop("position")
    return _rounded(out, "score_without", "removal_cost")


# --- user-written builders ---


@query("generated_feature", IMP + _rate_sql(["video_id"], "gen", 20.0))
def generated_feature(spark, sf):
    """Item popularity once more, as a user would write it: called once per date."""
    hist, imp = _halves(spark, sf)
    days = cut_lineage(h.daily_counts(hist, ["video_id"]))

    def build(past, rows):
        item = past.groupBy("video_id").agg(F.sum("impressions").alias("n"), F.sum("positives").alias("p"))
        prior = past.agg(
            F.coalesce(F.try_divide(F.sum("positives"), F.sum("impressions")), F.lit(0.0))
        ).scalar()
        n, p = F.coalesce("n", F.lit(0)).cast("double"), F.coalesce("p", F.lit(0))
        return rows.select("split", "row_id", "video_id").join(item, "video_id", "left").select(
            "split", "row_id", n.alias("gen_impressions"), ((p + 20.0 * prior) / (n + 20.0)).alias("gen_rate")
        )

    out = builder.apply_builder(
        days, cut_lineage(imp), build, STRICTLY_EARLIER, ["date", "video_id", "long_view"]
    )
    return _rounded(out, "gen_rate")


@query(
    "generated_feature_same_row",
    IMP + " SELECT split, row_id, CAST(hourmin % 100 AS DOUBLE) AS minute FROM imp",
)
def generated_feature_same_row(spark, sf):
    imp = event_impressions(spark, sf)
    build = lambda past, rows: rows.select(
        "split", "row_id", (F.col("hourmin") % 100).cast("double").alias("minute")
    )
    return builder.apply_builder(imp.where("split = 'train'"), imp, build, SAME_ROW, ["hourmin"])


@query("generated_keyed_feature", IMP + _rate_sql(["user_id", "tag"], "keyed", 20.0).replace("g.prior", "0.5"))
def generated_keyed_feature(spark, sf):
    hist, imp = _halves(spark, sf)

    def build(past, day, context):
        n, p = float(past["impressions"].sum()), float(past["positives"].sum())
        s = context.params["smoothing"]
        return {"keyed_impressions": n, "keyed_rate": (p + s / 2) / (n + s)}

    out = builder.apply_keyed_builder(
        hist, imp, build, ["user_id", "tag"], "keyed_impressions double, keyed_rate double",
        ["date", "user_id", "tag", "long_view"], context=builder.BuildContext({"smoothing": 20.0}),
    )
    return _rounded(out, "keyed_rate")


@query(
    "generated_measure",
    IMP + ", d AS (SELECT user_id, date, sum(duration_ms) AS w, count(*) AS n FROM hist GROUP BY ALL)"
    " SELECT split, row_id, round(coalesce((SELECT sum(w)/sum(n) FROM d WHERE d.user_id=imp.user_id AND d.date < imp.date),"
    " 0),4) AS mean_watched FROM imp",
)
def generated_measure(spark, sf):
    """The user's earlier mean of a column that is no outcome count."""
    hist, imp = _halves(spark, sf)

    def build(past, day):
        return {"mean_watched": float(past["watched"].sum()) / max(1.0, float(past["impressions"].sum()))}

    out = builder.apply_keyed_builder(
        hist, imp, build, ["user_id"], "mean_watched double", ["date", "user_id", "duration_ms"],
        measures={"watched": F.sum("duration_ms")},
    )
    return _rounded(out, "mean_watched", places=4)
