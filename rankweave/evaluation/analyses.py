"""Descriptive analyses of an impression log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.sets import group_sizes
from ..plans.ordering import find_hot
from ..schemas import KEYS
from .metrics import USER, evaluate


def _rows(df: DataFrame, keys: list[str], parts: list[tuple]) -> DataFrame:
    """Wide one-row aggregates turned into one row per entry."""
    return df.select(*keys, F.explode(F.array(*parts)).alias("_e")).select(*keys, "_e.*")


def label_rule_agreement(
    df: DataFrame, thresholds_s: list[float], label: str = "long_view",
    played: str = "play_time_ms", duration: str = "duration_ms",
) -> DataFrame:
    """Share of rows whose label equals ``played >= min(duration, h)``, per split and
    threshold in seconds. All thresholds are measured in one pass."""
    def share(h):
        rule = F.col(played) >= F.least(F.col(duration).cast("double"), F.lit(float(h) * 1000))
        return F.avg((rule.cast("int") == F.col(label).cast("int")).cast("double"))

    wide = df.groupBy("split").agg(*[share(h).alias(f"_{i}") for i, h in enumerate(thresholds_s)])
    return _rows(
        wide,
        ["split"],
        [
            F.struct(F.lit(float(h)).alias("threshold_s"), F.col(f"_{i}").alias("agreement"))
            for i, h in enumerate(thresholds_s)
        ],
    )


def user_label_mix(df: DataFrame, label: str = "long_view") -> DataFrame:
    """Per split: users, share without a positive, share with nothing but positives."""
    users = df.groupBy("split", "user_id").agg(F.max(label).alias("hi"), F.min(label).alias("lo"))
    return users.groupBy("split").agg(
        F.count(F.lit(1)).alias("users"),
        F.avg((F.col("hi") == 0).cast("double")).alias("no_positive"),
        F.avg((F.col("lo") == 1).cast("double")).alias("all_positive"),
    )


def hash_score(seed: int = 0):
    """A fixed pseudo-random score of a row, the same on every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def attainable_range(
    df: DataFrame, label: str = "long_view", splits=("train", "valid", "test"), seed: int = 0,
    min_rows: int | None = None,
) -> DataFrame:
    """Metrics of the perfect, the constant and a random score."""
    kinds = {
        "perfect": F.col(label).cast("double"),
        "constant": F.lit(0.0),
        "random": hash_score(seed),
    }
    lean = df.select(*KEYS, "user_id", label)
    hot = find_hot(lean.where(F.col("split").isin(*splits)), USER, min_rows)  # the same rows thrice
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            evaluate(lean.withColumn("score", s), splits, label=label, min_rows=min_rows, hot=hot)
            .withColumn("kind", F.lit(kind))
            for kind, s in kinds.items()
        ],
    )


def within_user_variation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per split and column: share of users for whom the column takes more than one value."""
    users = df.groupBy("split", "user_id").agg(
        *[(F.min(c) != F.max(c)).alias(f"_{i}") for i, c in enumerate(cols)]
    )
    wide = users.groupBy("split").agg(
        *[F.avg(F.coalesce(F.col(f"_{i}"), F.lit(False)).cast("double")).alias(f"_{i}") for i in range(len(cols))]
    )
    return _rows(
        wide,
        ["split"],
        [F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("share")) for i, c in enumerate(cols)],
    )


def mean_set_size(df: DataFrame, by: str = "user") -> DataFrame:
    """Per split: ranking sets and their mean size."""
    return group_sizes(df, by).groupBy("split").agg(
        F.count(F.lit(1)).alias("sets"), F.avg("rows").alias("mean_size")
    )


def score_correlation(a: DataFrame, b: DataFrame, score: str = "score") -> DataFrame:
    """Per split: correlation of two predictions of the same rows."""
    both = a.select(*KEYS, F.col(score).alias("_a")).join(
        b.select(*KEYS, F.col(score).alias("_b")), list(KEYS)
    )
    return both.groupBy("split").agg(F.corr("_a", "_b").alias("correlation"), F.count(F.lit(1)).alias("rows"))


def aux_label_profile(df: DataFrame, targets: list[str], label: str = "long_view") -> DataFrame:
    """Per split and auxiliary label: prevalence and correlation with the label."""
    wide = df.groupBy("split").agg(
        *[
            c
            for i, t in enumerate(targets)
            for c in (
                F.avg(F.col(t).cast("double")).alias(f"_p{i}"),
                F.corr(F.col(t).cast("double"), F.col(label).cast("double")).alias(f"_c{i}"),
            )
        ]
    )
    return _rows(
        wide,
        ["split"],
        [
            F.struct(
                F.lit(t).alias("target"),
                F.col(f"_p{i}").alias("prevalence"),
                F.col(f"_c{i}").alias("correlation"),
            )
            for i, t in enumerate(targets)
        ],
    )


def side_coverage(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Per split: share of rows and of distinct keys that the side table knows.

    Keys are counted before the lookup, so the join sees one row per key and split.
    """
    keys = df.groupBy("split", F.col(key).cast("string").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    known = dim.select(F.col(key).cast("string").alias("_dim")).distinct().withColumn("_hit", F.lit(1))
    found = keys.join(known, F.col("_key") == F.col("_dim"), "left").withColumn(
        "_hit", F.coalesce("_hit", F.lit(0))
    )
    return found.groupBy("split").agg(
        F.sum("_n").alias("rows"),
        (F.sum(F.col("_n") * F.col("_hit")) / F.sum("_n")).alias("row_coverage"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.avg(F.col("_hit").cast("double")).alias("key_coverage"),
    )


def paired_deltas(
    seed_scores: DataFrame, incumbent: DataFrame, by: str = "bundle"
) -> DataFrame:
    """Per added bundle: mean gain over the incumbent under the same seed, and how many
    seeds improved."""
    base = incumbent.select("seed", F.col("score").alias("_base"))
    delta = F.col("score") - F.col("_base")
    return seed_scores.join(base, "seed").groupBy(by).agg(
        F.avg(delta).alias("paired_delta"),
        F.count_if(delta > 0).alias("seeds_improved"),
        F.count(F.lit(1)).alias("seeds"),
    )
