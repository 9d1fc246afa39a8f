"""Order-dependent work on groups of any size.

A plain window puts a whole group into one task, and adaptive execution does not split
windows. So groups with more rows than a task should hold ("hot") are found first by a
counting job. All others take one plain window. A hot group is
cut into ranges of its order key; each range is summed in its own task and the range
totals, one row per range, are carried forward. The answer is exact either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage, range_count

HASH_SPACE = 1 << 32
SAMPLES_PER_RANGE = 16
MIN_HOT_ROWS = 1_000_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of two aliased frames; Spark plans it as an equi join."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys],
    )


def _key(order: list[str]) -> Column:
    """The order key as one comparable value (nulls first, as in a sort)."""
    if len(order) == 1:
        return F.col(f"`{order[0]}`")
    return F.struct(*[F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(order)])


def range_bounds(df: DataFrame, order: list[str], ranges: int) -> Column:
    """Scalar subquery: ``ranges - 1`` increasing order keys that cut the rows evenly.

    The keys come from a sample chosen by the hash of the key, so a re-run of a lost
    task picks the same ones, and equal keys are kept once, so the sample stays near
    ``ranges * SAMPLES_PER_RANGE`` keys whatever the data.
    """
    rows = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    share = F.lit(float(HASH_SPACE * ranges * SAMPLES_PER_RANGE)) / rows
    sample = df.where(
        F.pmod(F.xxhash64(*[F.col(name) for name in order]), F.lit(HASH_SPACE)) < share
    ).agg(F.sort_array(F.collect_set(_key(order))).alias("keys"))
    picked = F.transform(
        F.sequence(F.lit(1), F.lit(ranges - 1)),
        lambda i: F.element_at("keys", (F.floor(i * F.size("keys") / ranges) + 1).cast("int")),
    )
    return sample.select(F.when(F.size("keys") > 0, picked).alias("bounds")).scalar()


def with_range(
    df: DataFrame, order: list[str], name: str, ranges: int, sample_from: DataFrame | None = None
) -> DataFrame:
    """Adds the range number of each row by binary search over the bounds.

    One projection per halving step, so that the search is compiled with its stage.
    """
    bounds = range_bounds(df if sample_from is None else sample_from, order, ranges)
    out = df.withColumn("_bounds", bounds).withColumn(name, F.lit(0))
    step = ranges // 2
    while step:
        ahead = F.col(name) + step
        out = out.withColumn(
            name,
            F.when(F.element_at("_bounds", ahead) < _key(order), ahead).otherwise(F.col(name)),
        )
        step //= 2
    return out.drop("_bounds")


COMBINE = {
    # how two parts of a running value meet, and its value over no rows
    "sum": (F.sum, lambda a, b: a + b, lambda c: F.coalesce(c, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b), lambda c: c),
}


def prefix_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    weights: list[str],
    ranges: int | None = None,
    how: str = "sum",
    sample_from: DataFrame | None = None,
) -> DataFrame:
    """Adds ``{w}_before``: the sum (or maximum) of ``w`` over earlier rows of the group.

    ``(group, order)`` must be unique and ``group`` without nulls. Few huge groups are fine:
    no task gets more than one range of one group. When ``df`` is an aggregate, the range
    bounds can be sampled from the rows below it (``sample_from``), which spares running the
    aggregate again; with many copies of a key the ranges get coarser.
    """
    fold, meet, empty = COMBINE[how]
    ranges = ranges or range_count(df.sparkSession)
    cut = with_range(df, order, "_range", ranges, sample_from)
    key = [*group, "_range"]
    in_range = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*key)
        .agg(*[fold(w).alias(f"_{w}") for w in weights])
        .select(*key, *[empty(fold(f"_{w}").over(across)).alias(f"_{w}_carry") for w in weights])
    )
    local = cut.select(
        "*", *[empty(fold(w).over(in_range)).alias(f"_{w}_local") for w in weights]
    )
    # plain equality on the window's own keys: the rows are not exchanged again
    joined = local.join(carried, key)
    return joined.select(
        *[F.col(f"`{name}`") for name in df.columns],
        *[meet(F.col(f"_{w}_local"), F.col(f"_{w}_carry")).alias(f"{w}_before") for w in weights],
    )


def find_hot(df: DataFrame, group: list[str], min_rows: int | None = None) -> DataFrame | None:
    """Keys of groups with more than ``min_rows`` rows, numbered as ``_hot``; or None.

    Runs one counting job now, like a sort samples its input: the plan depends on the
    outcome. The limit is rows in a task, whatever the input: a million rows yield at most one
    hot key, so the keys are few next to the data.
    """
    limit = MIN_HOT_ROWS if min_rows is None else min_rows
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    keys = counts.where(F.col("_rows") > limit).select(*group)
    numbered = [(*key, i) for i, key in enumerate(keys.collect())]
    if not numbered:
        return None
    return df.sparkSession.createDataFrame(
        numbered, StructType([*keys.schema.fields, StructField("_hot", IntegerType())])
    )


FIND = "find"


def split_hot(
    df: DataFrame, group: list[str], hot, min_rows: int | None = None, keep: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups with their number ``_hot`` (None when
    there are none).

    Hot rows are checkpointed: most callers read them several times, and nested calls
    would otherwise multiply the plan. A caller that only aggregates them says ``keep=False``.
    """
    if isinstance(hot, str):
        hot = find_hot(df, group, min_rows)
    if hot is None:
        return df, None
    rows, keys = df.alias("l"), F.broadcast(hot).alias("h")  # at most range_count keys
    match = _same("l", "h", group)
    warm = rows.join(keys, match).select("l.*", "h._hot")
    return rows.join(keys, match, "left_anti"), cut_lineage(warm) if keep else warm


def running_before(
    df: DataFrame,
    group: list[str],
    order: list[str],
    weights: list[str],
    how: str = "sum",
    min_rows: int | None = None,
    hot=FIND,
) -> DataFrame:
    """:func:`prefix_totals` for many groups. ``(group, order)`` must be unique."""
    fold, _, empty = COMBINE[how]
    cold_rows, hot_rows = split_hot(df, group, hot, min_rows)
    frame = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    cold = cold_rows.select(
        "*", *[empty(fold(w).over(frame)).alias(f"{w}_before") for w in weights]
    )
    if hot_rows is None:
        return cold
    return cold.unionByName(
        prefix_totals(hot_rows, ["_hot"], order, weights, how=how).drop("_hot")
    )


def peer_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    weights: list[str],
    min_rows: int | None = None,
    hot=FIND,
) -> DataFrame:
    """Adds, for each weight, ``{w}_before`` (sum over rows of the group with a smaller order
    key), ``{w}_peers`` (same key, the row itself included) and ``{w}_total``.

    Ordinary groups use one exchange. Hot groups are collapsed to one row per distinct key
    (map-side first, so a constant score is no problem) and go through
    :func:`prefix_totals`.
    """
    cold_rows, hot_rows = split_hot(df, group, hot, min_rows)
    upto = W.partitionBy(*group).orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow)
    same, whole = W.partitionBy(*group, *order), W.partitionBy(*group)
    cold = cold_rows.select(
        "*",
        *[(F.sum(w).over(upto) - F.sum(w).over(same)).alias(f"{w}_before") for w in weights],
        *[F.sum(w).over(same).alias(f"{w}_peers") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
    )
    if hot_rows is None:
        return cold
    collapsed = hot_rows.groupBy("_hot", *order).agg(
        *[F.sum(w).alias(f"{w}_peers") for w in weights]
    )
    placed = prefix_totals(
        collapsed, ["_hot"], order, [f"{w}_peers" for w in weights], sample_from=hot_rows
    )
    totals = collapsed.groupBy("_hot").agg(*[F.sum(f"{w}_peers").alias(f"{w}_total") for w in weights])
    warm = (
        hot_rows.alias("l")
        .join(placed.alias("p"), (F.col("l._hot") == F.col("p._hot")) & _same("l", "p", order))
        .join(F.broadcast(totals).alias("t"), F.col("l._hot") == F.col("t._hot"))  # one row per hot group
        .select(
            *[F.col(f"l.`{name}`") for name in df.columns],
            *[F.col(f"p.{w}_peers_before").alias(f"{w}_before") for w in weights],
            *[F.col(f"p.{w}_peers") for w in weights],
            *[F.col(f"t.{w}_total") for w in weights],
        )
    )
    return cold.unionByName(warm)


def group_totals(
    df: DataFrame,
    group: list[str],
    aggs: dict[str, Column],
    min_rows: int | None = None,
    hot=FIND,
) -> DataFrame:
    """Group aggregates beside each row.

    Ordinary groups use a window, which later steps on the same keys share an exchange
    with; hot groups are aggregated map-side and looked up by broadcast.
    """
    cold_rows, hot_rows = split_hot(df, group, hot, min_rows)
    whole = W.partitionBy(*group)
    cold = cold_rows.select("*", *[agg.over(whole).alias(name) for name, agg in aggs.items()])
    if hot_rows is None:
        return cold
    totals = hot_rows.groupBy("_hot").agg(*[agg.alias(name) for name, agg in aggs.items()])
    warm = hot_rows.join(F.broadcast(totals), "_hot").drop("_hot")  # one row per hot group
    return cold.unionByName(warm)


def join_groups(
    df: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    min_rows: int | None = None,
    hot=FIND,
) -> DataFrame:
    """Join to an aggregate with one row per key.

    Adaptive execution cannot split a skewed join whose other side is an aggregate on the
    same keys (it shares that exchange), so hot keys are joined by broadcast of their rows.
    """
    if isinstance(hot, str):
        hot = find_hot(df, keys, min_rows)
    cold, warm = split_hot(df, keys, hot, keep=False)
    plain = cold.join(right, keys, how)
    if warm is None:
        return plain
    few = right.join(F.broadcast(hot.select(*keys)), keys, "left_semi")  # one row per hot key
    return plain.unionByName(warm.drop("_hot").join(F.broadcast(few), keys, how))


def top_rows(
    df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group.

    Spark puts a partial group limit below the exchange, so a task sends at most ``k``
    rows of any group and a hot group never travels whole. It does so up to the ``k`` of its
    ``windowGroupLimitThreshold``; for a larger one the rows of a group are first cut to ``k``
    in each of many parts, found by a hash.
    """
    session = df.sparkSession
    own = W.partitionBy(*group).orderBy(*order)
    if k > int(session.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(range_count(session)))
        cut = W.partitionBy(*group, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_cut", F.row_number().over(cut))
        df = df.where(F.col("_cut") <= k).drop("_part", "_cut")
    return df.withColumn(name, F.row_number().over(own)).where(F.col(name) <= k)
