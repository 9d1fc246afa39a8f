"""Ranking sets: a user's rows, or a user's rows of one day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordering import FIND, find_hot, group_totals, peer_totals, top_rows
from ..schemas import KEYS


def set_keys(by: str) -> list[str]:
    if by == "user":
        return ["split", "user_id"]
    if by == "user_date":
        return ["split", "user_id", "date"]
    raise ValueError(f"rows are set side by side by user or user_date, not by {by!r}")


def group_sizes(df: DataFrame, by: str = "user") -> DataFrame:
    """Rows per ranking set."""
    return df.groupBy(*set_keys(by)).agg(F.count(F.lit(1)).alias("rows"))


def mixed_sets(
    df: DataFrame, by: str = "user", label: str = "long_view", min_rows: int | None = None, hot=FIND
) -> DataFrame:
    """Rows of sets that hold both labels."""
    counts = {"_p": F.sum(F.col(label).cast("long")), "_n": F.count(F.lit(1))}
    sized = group_totals(df, set_keys(by), counts, min_rows, hot)
    return sized.where((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).select(*df.columns)


def percent_rank(
    pred: DataFrame, score: str = "score", group=("split", "user_id"), name: str = "pct_rank",
    min_rows: int | None = None, hot=FIND,
) -> DataFrame:
    """Rank within the group over the group size, ties averaged.

    (SQL ``percent_rank`` is another formula.)
    """
    ranked = peer_totals(
        pred.withColumn("_one", F.lit(1)), list(group), [score], ["_one"], min_rows, hot
    )
    mean_rank = F.col("_one_before") + (F.col("_one_peers") + 1) / 2.0
    return ranked.select(*pred.columns, (mean_rank / F.col("_one_total")).alias(name))


def set_context(df: DataFrame, cols: list[str], by: str = "user", min_rows: int | None = None) -> DataFrame:
    """Per row and column: deviation from the set mean, average rank in the set; and set size."""
    keys = set_keys(by)
    lean = df.select(*dict.fromkeys([*KEYS, *keys, *cols])).withColumn("_one", F.lit(1))
    hot = find_hot(lean, keys, min_rows)
    out = group_totals(
        lean,
        keys,
        {"set_size": F.count(F.lit(1)), **{f"_mean_{c}": F.avg(c) for c in cols}},
        hot=hot,
    )
    for c in cols:
        out = peer_totals(out, keys, [c], ["_one"], hot=hot)
        out = out.withColumn(
            f"{c}_set_rank", F.col("_one_before") + (F.col("_one_peers") + 1) / 2.0
        ).drop("_one_before", "_one_peers", "_one_total")
    return out.select(
        *KEYS,
        "set_size",
        *[
            col
            for c in cols
            for col in (
                (F.col(c) - F.col(f"_mean_{c}")).alias(f"{c}_set_dev"),
                F.col(f"{c}_set_rank"),
            )
        ],
    )


def draw_key(seed: int, row: str = "row_id") -> Column:
    """A fixed pseudo-random order of rows for a seed, the same on every engine and retry."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))


def cap_sets(df: DataFrame, by: str = "user_date", max_set_size: int = 48, seed: int = 0) -> DataFrame:
    """A fixed random draw of at most ``max_set_size`` rows of each set.

    The group limit runs before the exchange, so a huge set ships few rows.
    """
    order = [draw_key(seed), F.col("row_id")]
    return top_rows(df, set_keys(by), order, max_set_size, "_place").drop("_place")


def same_user_pairs(
    df: DataFrame, n: int = 4, seed: int = 0, label: str = "long_view", by: str = "user",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Positive-negative row pairs of one user: ``min(n, max(positives, negatives))`` each.

    Pair ``j`` takes the ``j``-th row of each class in the seeded order, cycling through a
    class with fewer rows. Only the first ``n`` rows of a class are ever needed, so each
    class is cut to ``n`` before any exchange. The columns ``carry`` of both rows come along, as
    ``pos_`` and ``neg_`` columns, so that no rows are joined afterwards.
    """
    keys = set_keys(by)
    lean = df.select(*keys, "row_id", F.col(label).cast("int").alias("_y"), *carry)
    sizes = lean.groupBy(*keys).agg(
        F.sum("_y").cast("long").alias("_p"), F.count(F.lit(1)).alias("_n")
    ).where((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).select(
        *keys, "_p", (F.col("_n") - F.col("_p")).alias("_q")
    )
    drawn = top_rows(
        lean, [*keys, "_y"], [draw_key(seed), F.col("row_id")], n, "_place"
    ).groupBy(*keys).agg(  # at most 2n rows per group
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_y") == y, F.struct("_place", "row_id", *carry)))),
                lambda s: F.struct(*[s[c].alias(c) for c in ("row_id", *carry)]),
            ).alias(side)
            for y, side in ((1, "_pos"), (0, "_neg"))
        ]
    )
    count = F.least(F.lit(n), F.greatest("_p", "_q")).cast("int")
    at = lambda side: F.element_at(F.col(side), (F.col("pair") % F.size(side) + 1).cast("int"))
    return (
        sizes.join(drawn, keys)
        .withColumn("pair", F.explode(F.sequence(F.lit(0), count - 1)))
        .select(*keys, "pair", at("_pos").alias("_a"), at("_neg").alias("_b"))
        .select(
            *keys, "pair", F.col("_a.row_id").alias("pos_row"), F.col("_b.row_id").alias("neg_row"),
            *[F.col(f"{s}.{c}").alias(f"{side}_{c}") for c in carry for s, side in (("_a", "pos"), ("_b", "neg"))],
        )
    )


def listwise_targets(
    df: DataFrame, by: str = "user_date", score: str = "score", label: str = "long_view",
    min_rows: int | None = None,
) -> DataFrame:
    """Per row: label over the set's label sum, and softmax of the score within the set."""
    keys = set_keys(by)
    lean = df.select(*dict.fromkeys([*KEYS, *keys, label, score]))
    hot = find_hot(lean, keys, min_rows)
    peak = group_totals(
        lean,
        keys,
        {"_peak": F.max(score), "_labels": F.sum(F.col(label).cast("double"))},
        hot=hot,
    ).withColumn("_e", F.exp(F.col(score) - F.col("_peak")))
    mass = group_totals(peak, keys, {"_mass": F.sum("_e")}, hot=hot)
    return mass.select(
        *KEYS,
        (F.col(label) / F.greatest(F.col("_labels"), F.lit(1e-9))).alias("target"),
        (F.col("_e") / F.col("_mass")).alias("softmax"),
    )


def top_k_per_user(pred: DataFrame, k: int = 5, score: str = "score") -> DataFrame:
    """The ``k`` best rows of each user; equal scores by row number."""
    return top_rows(pred, ["split", "user_id"], [F.col(score).desc(), F.col("row_id").asc()], k)


def stable_sort(df: DataFrame, cols: list[str], tie_cols: list[str]) -> DataFrame:
    """Total order: sort columns, then the tie columns (Spark's sort is not stable by itself)."""
    return df.orderBy(*cols, *tie_cols)
