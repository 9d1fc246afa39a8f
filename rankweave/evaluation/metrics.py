"""Within-user ranking metrics."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.ordering import FIND, find_hot, peer_totals, prefix_totals, split_hot, top_rows
from ..schemas import BASELINE_VALID, GAIN_EPS, KEYS
from ..session import cut_lineage

USER = ["split", "user_id"]


def with_labels(pred: DataFrame, labels: DataFrame, label: str = "long_view") -> DataFrame:
    """Predictions joined to the labels of their rows."""
    return pred.join(labels.select(*KEYS, label), list(KEYS))


def user_auc(
    pred: DataFrame, score: str = "score", label: str = "long_view",
    min_rows: int | None = None, hot=FIND,
) -> DataFrame:
    """Per user: rows, positives and AUC with averaged ties (null for one-class users)."""
    y = F.col(label).cast("long")
    lean = pred.select(*USER, F.col(score).alias("_s"), y.alias("_pos"), (1 - y).alias("_neg"))
    cold, warm = split_hot(lean, USER, hot, min_rows, keep=False)

    def sums_of(placed, peers):
        won = F.col("_neg_before") + F.col(peers) / 2.0
        return placed.groupBy(*USER).agg(
            F.sum("_pos").alias("positives"),
            F.sum("_neg").alias("negatives"),
            F.sum(F.when(F.col("_pos") > 0, F.col("_pos") * won)).alias("_won"),
        )

    sums = sums_of(peer_totals(cold, USER, ["_s"], ["_neg"], hot=None), "_neg_peers")
    if warm is not None:
        # a hot user's rows are only ever needed as counts per distinct score
        tied = warm.groupBy("_hot", *USER, "_s").agg(
            F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
        )
        placed = prefix_totals(cut_lineage(tied), ["_hot"], ["_s"], ["_neg"])
        sums = sums.unionByName(sums_of(placed, "_neg"))
    return sums.select(
        *USER,
        (F.col("positives") + F.col("negatives")).alias("rows"),
        "positives",
        F.try_divide(
            F.col("_won"), (F.col("positives") * F.col("negatives")).cast("double")
        ).alias("auc"),
    )


def _gauc(weighting: str):
    if weighting not in ("impressions", "uniform"):
        raise ValueError("weighting must be impressions or uniform")
    weight = F.when(F.col("auc").isNotNull(), F.col("rows") if weighting == "impressions" else F.lit(1))
    return F.try_divide(F.sum(F.col("auc") * weight), F.sum(weight).cast("double"))


def gauc(
    pred: DataFrame, weighting: str = "impressions", score: str = "score",
    label: str = "long_view", min_rows: int | None = None,
) -> DataFrame:
    """Weighted mean of user AUCs; one-class users are skipped."""
    return user_auc(pred, score, label, min_rows).groupBy("split").agg(
        _gauc(weighting).alias("gauc")
    )


def user_dcg(pred: DataFrame, k: int = 5, score: str = "score", label: str = "long_view") -> DataFrame:
    """Per user: discounted gain of the best ``k`` rows; equal scores by row number."""
    lean = pred.select(*USER, "row_id", F.col(score).alias("_s"), F.col(label).alias("_y"))
    best = top_rows(lean, USER, [F.col("_s").desc(), F.col("row_id").asc()], k)
    return best.groupBy(*USER).agg(F.sum(F.col("_y") / F.log2(F.col("rank") + 1.0)).alias("dcg"))


def _user_metrics(pred: DataFrame, k: int, score: str, label: str) -> DataFrame:
    """The columns of ``user_auc`` and ``user_dcg`` of ordinary users: one exchange serves both."""
    y = F.col(label).cast("long")
    lean = pred.where(reduce(and_, [F.col(c).isNotNull() for c in USER])).select(
        *USER, "row_id", F.col(score).alias("_s"), F.col(label).alias("_y"), y.alias("_pos"), (1 - y).alias("_neg")
    )
    own = W.partitionBy(*USER)
    best = own.orderBy(F.col("_s").desc(), F.col("row_id").asc())
    placed = lean.select(
        "*",
        F.sum("_neg").over(own.orderBy("_s").rangeBetween(W.unboundedPreceding, W.currentRow)).alias("_upto"),
        F.sum("_neg").over(W.partitionBy(*USER, "_s")).alias("_peers"),
        F.row_number().over(best).alias("_place"),
    )
    won = F.col("_upto") - F.col("_peers") / 2.0
    sums = placed.groupBy(*USER).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.sum(F.when(F.col("_pos") > 0, F.col("_pos") * won)).alias("_won"),
        F.sum(F.when(F.col("_place") <= k, F.col("_y") / F.log2(F.col("_place") + 1.0))).alias("dcg"),
    )
    pairs = (F.col("positives") * F.col("negatives")).cast("double")
    return sums.select(
        *USER, (F.col("positives") + F.col("negatives")).alias("rows"), "positives", "dcg",
        F.try_divide(F.col("_won"), pairs).alias("auc"),
    )


def _ndcg(k: int):
    ideal, total = [], 0.0
    for place in range(1, k + 1):
        total += 1.0 / math.log2(place + 1)
        ideal.append(F.lit(total))
    best = F.element_at(F.array(*ideal), F.least(F.lit(k), F.col("positives")).cast("int"))
    return F.avg(F.when(F.col("positives") > 0, F.col("dcg") / best).otherwise(F.lit(0.0)))


def ndcg_at(pred: DataFrame, k: int = 5, score: str = "score", label: str = "long_view") -> DataFrame:
    """Mean nDCG over all users; a user without a positive scores 0."""
    totals = pred.groupBy(*USER).agg(F.sum(F.col(label).cast("long")).alias("positives"))
    both = totals.join(user_dcg(pred, k, score, label), USER)
    return both.groupBy("split").agg(_ndcg(k).alias(f"ndcg{k}"))


def evaluate(
    pred: DataFrame,
    splits: tuple[str, ...] = ("valid",),
    weighting: str = "impressions",
    labels: DataFrame | None = None,
    score: str = "score",
    label: str = "long_view",
    min_rows: int | None = None,
    hot=FIND,
) -> DataFrame:
    """GAUC, nDCG@5 and their mean, for the asked splits only.

    The split filter comes first, so other splits are neither read nor scored. A caller that
    scores the same rows many times passes their ``hot`` users once found.
    """
    kept = pred.where(F.col("split").isin(*splits))
    if labels is not None:
        kept = with_labels(kept, labels.where(F.col("split").isin(*splits)), label)
    if isinstance(hot, str):
        hot = find_hot(kept, USER, min_rows)
    if hot is None:
        users = _user_metrics(kept, 5, score, label)
    else:
        users = user_auc(kept, score, label, min_rows, hot).join(user_dcg(kept, 5, score, label), USER)
    return users.groupBy("split").agg(
        _gauc(weighting).alias("gauc"), _ndcg(5).alias("ndcg5")
    ).select("split", "gauc", "ndcg5", ((F.col("gauc") + F.col("ndcg5")) / 2).alias("primary"))


def mean_metrics(df: DataFrame, by: str = "split") -> DataFrame:
    """Mean of each metric over repeated observations."""
    return df.groupBy(by).agg(
        *[F.avg(c).alias(c) for c in ("gauc", "ndcg5", "primary")],
        F.count(F.lit(1)).alias("observations"),
    )


def matches_baseline(
    df: DataFrame, expected: dict[str, dict[str, float]] | None = None, places: int = 4
) -> DataFrame:
    """Each metric against its published value at the published precision."""
    expected = expected or {"valid": BASELINE_VALID}
    rows = [(s, m, float(v)) for s, ms in expected.items() for m, v in ms.items()]
    want = df.sparkSession.createDataFrame(rows, "split string, metric string, expected double")
    long = df.unpivot("split", ["gauc", "ndcg5", "primary"], "metric", "value")
    return want.join(long, ["split", "metric"]).select(
        "split",
        "metric",
        "value",
        "expected",
        (F.round("value", places) == F.round("expected", places)).alias("ok"),
    )


def select_checkpoint(history: DataFrame, patience: int, by: list[str] = []) -> DataFrame:
    """Adds to an epoch table ``(epoch, primary)``: gain flag, bad streak, whether training
    had stopped before the epoch, and the kept epoch.

    An epoch gains when it beats every earlier one by more than 1e-5; training stops at the
    first epoch whose streak of non-gains reaches ``patience``. One row per epoch.
    """
    start = F.struct(
        F.lit(float("-inf")).alias("bar"),
        F.lit(-1).cast("long").alias("kept"),
        F.lit(0).alias("streak"),
        F.lit(False).alias("stopped"),
        F.array().cast("array<struct<epoch:bigint,primary:double,trained:boolean,streak:int,kept:bigint>>").alias("rows"),
    )

    def fold(a, e):
        gain = ~a["stopped"] & (e["primary"] > a["bar"] + GAIN_EPS)
        kept = F.when(gain, e["epoch"].cast("long")).otherwise(a["kept"])
        streak = F.when(a["stopped"], a["streak"]).when(gain, 0).otherwise(a["streak"] + 1)
        row = F.struct(
            e["epoch"].cast("long").alias("epoch"),
            e["primary"].cast("double").alias("primary"),
            (~a["stopped"]).alias("trained"),
            streak.alias("streak"),
            kept.alias("kept"),
        )
        return F.struct(
            F.when(gain, e["primary"]).otherwise(a["bar"]).alias("bar"),
            kept.alias("kept"),
            streak.alias("streak"),
            (a["stopped"] | (~gain & (streak >= patience))).alias("stopped"),
            F.concat(a["rows"], F.array(row)).alias("rows"),
        )

    # only gains move the bar; one fold over a group's epochs, which are as many as a fit has
    epochs = F.array_sort(F.collect_list(F.struct("epoch", F.col("primary").cast("double").alias("primary"))))
    folded = history.groupBy(*by).agg(F.aggregate(epochs, start, fold)["rows"].alias("_rows"))
    kind = history.schema["epoch"].dataType
    return folded.select(*by, F.explode("_rows").alias("r")).select(
        *by,
        F.col("r.epoch").cast(kind).alias("epoch"),
        "r.primary",
        "r.trained",
        F.col("r.streak").alias("bad_streak"),
        F.col("r.kept").alias("kept_epoch"),
    )
