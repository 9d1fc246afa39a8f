"""Causal history features: only rows of strictly earlier dates count.

Every operator first reduces history to one row per key and day (combined map-side), so
the windows below see at most one row per day of any key, however hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import STRICTLY_EARLIER, Lineage, tag
from ..functions.scalars import day_number, logit
from ..schemas import DECAY_ATTRIBUTES, KEYS, USER_ATTRIBUTES
from .rowwise import attribute_column, duration_edges

BLOCK_HALF_LIVES = 256
#: blocks that can still weigh: 5 * 256 half-lives are beyond a double's range
CARRIED_BLOCKS = 5


def daily_counts(
    df: DataFrame, keys: list[str], label: str = "long_view", date: str = "date",
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Positives and rows per day and key set, with any other aggregates; null keys are a group
    of their own."""
    return df.groupBy(date, *keys).agg(
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"),
        F.count(label).alias("impressions"),
        *[value.alias(name) for name, value in (measures or {}).items()],
    )


def daily_prior(df: DataFrame, label: str = "long_view", date: str = "date") -> DataFrame:
    """Per day: rows, positives and their rate over all strictly earlier days (0 if none).

    The un-partitioned window runs over one row per day.
    """
    return _running_prior(daily_counts(df, [], label, date), date)


def _running_prior(daily: DataFrame, date: str) -> DataFrame:
    before = W.orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    past = daily.select(
        date,
        F.coalesce(F.sum("impressions").over(before), F.lit(0)).alias("past_impressions"),
        F.coalesce(F.sum("positives").over(before), F.lit(0)).alias("past_positives"),
    )
    return past.withColumn(
        "prior",
        F.when(F.col("past_impressions") > 0, F.col("past_positives") / F.col("past_impressions"))
        .otherwise(F.lit(0.0)),
    )


def timeline(
    history: DataFrame, target: DataFrame, keys: list[str], label: str = "long_view", date: str = "date"
) -> DataFrame:
    """One row per key and day that history has or the target asks for.

    Asked days enter as zero rows of the same aggregate: one exchange serves both sides.
    """
    seen = history.select(
        *keys, date, F.col(label).cast("long").alias("_p"), F.col(label).isNotNull().cast("long").alias("_n")
    )
    asked = target.select(*keys, date, F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_n"))
    return seen.unionByName(asked).groupBy(*keys, date).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"),
    )


def _attach(
    target: DataFrame, state: DataFrame, keys: list[str], columns: list[str], date: str = "date"
) -> DataFrame:
    """Null-safe lookup of per-(key, day) state; the state side is unique."""
    # days are never null, so they compare plainly
    on = reduce(
        lambda a, b: a & b,
        [
            F.col(f"t.{k}") == F.col(f"s.{k}") if k in (date, "_day") else F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
            for k in keys
        ],
    )
    return target.alias("t").join(state.alias("s"), on, "left").select(
        *[F.col(f"t.`{n}`") for n in target.columns], *[F.col(f"s.`{n}`") for n in columns]
    )


def _finish(df: DataFrame, target: DataFrame, names: list[str], sources, append: bool) -> DataFrame:
    out = df.select(*[F.col(f"`{n}`") for n in [*(target.columns if append else KEYS), *names]])
    return tag(out, {n: Lineage(tuple(sources), STRICTLY_EARLIER) for n in names})


def past_state(
    history: DataFrame, target: DataFrame, keys: list[str], label: str = "long_view", date: str = "date"
) -> DataFrame:
    """Per key and asked day: impressions and positives of strictly earlier days."""
    days = timeline(history, target, keys, label, date)
    before = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    return days.select(
        *keys,
        date,
        F.coalesce(F.sum("impressions").over(before), F.lit(0)).alias("past_impressions"),
        F.coalesce(F.sum("positives").over(before), F.lit(0)).alias("past_positives"),
    )


def asof_strict(
    target: DataFrame, history: DataFrame, keys: list[str], label: str = "long_view", date: str = "date"
) -> DataFrame:
    """Backward as-of lookup with strict ``<``: the cumulative state before the row's day."""
    state = past_state(history, target, keys, label, date)
    return _attach(target, state, [*keys, date], ["past_impressions", "past_positives"], date)


def expanding_rate(
    history: DataFrame,
    target: DataFrame,
    keys: list[str],
    prefix: str,
    smoothing: float = 0.0,
    label: str = "long_view",
    date: str = "date",
    sources: tuple[str, ...] | None = None,
    append: bool = False,
) -> DataFrame:
    """Count and smoothed rate of a key over strictly earlier days.

    ``rate = (p + s * prior) / (n + s)`` with the global rate before that day as prior; the
    prior itself when ``n + s`` is 0.
    """
    days = timeline(history, target, keys, label, date)
    before = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    past = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0)).cast("double")
    prior = _running_prior(
        days.groupBy(date).agg(
            F.sum("impressions").alias("impressions"), F.sum("positives").alias("positives")
        ),
        date,
    ).select(F.col(date).alias("_day"), "prior")
    state = (
        days.select(*keys, date, past("impressions").alias("n"), past("positives").alias("p"))
        .join(F.broadcast(prior), F.col(date) == F.col("_day"))  # one row per day
        .drop("_day")
    )
    weight = F.col("n") + F.lit(float(smoothing))
    names = [f"{prefix}_impressions", f"{prefix}_rate"]
    rated = state.select(
        *keys,
        date,
        F.col("n").alias(names[0]),
        F.when(weight > 0, (F.col("p") + F.lit(float(smoothing)) * F.col("prior")) / weight)
        .otherwise(F.col("prior"))
        .alias(names[1]),
    )
    out = _attach(target, rated, [*keys, date], names, date)
    return _finish(out, target, names, sources or (date, *keys, label), append)


def item_popularity(history, target, smoothing: float = 0.0, append: bool = False) -> DataFrame:
    return expanding_rate(history, target, ["video_id"], "item_pop", smoothing, append=append)


def user_category_affinity(history, target, smoothing: float = 0.0, append: bool = False) -> DataFrame:
    return expanding_rate(
        history, target, ["user_id", "tag"], "user_category_affinity", smoothing, append=append
    )


def _edges_for(attribute, allowed, history, buckets, edges):
    if attribute not in allowed:
        raise ValueError(f"{attribute!r} is none of the attributes {list(allowed)}")
    if attribute == "duration_bucket" and edges is None:
        return duration_edges(history, buckets)
    return edges


def _attribute_sources(attribute: str) -> tuple[str, ...]:
    base = "duration_ms" if attribute in ("duration_bucket", "duration_regime") else attribute
    return ("date", "user_id", base, "long_view")


def user_attribute_affinity(
    history: DataFrame,
    target: DataFrame,
    attribute: str = "duration_bucket",
    buckets: int = 10,
    smoothing: float = 0.0,
    edges: list[float] | None = None,
    append: bool = False,
) -> DataFrame:
    """The user's earlier rate on rows with this row's attribute value."""
    edges = _edges_for(attribute, USER_ATTRIBUTES, history, buckets, edges)
    value = attribute_column(attribute, edges)
    out = expanding_rate(
        history.withColumn("_attribute", value),
        target.withColumn("_attribute", value),
        ["user_id", "_attribute"],
        f"user_{attribute}_affinity",
        smoothing,
        sources=_attribute_sources(attribute),
        append=append,
    )
    return out.drop("_attribute")


def range_window(
    history: DataFrame,
    target: DataFrame,
    keys: list[str],
    windows: tuple[int, ...],
    label: str = "long_view",
    date: str = "date",
) -> DataFrame:
    """Per key and asked day, for each width ``w``: sums over ``day - w <= d < day``.

    All widths share one sort.
    """
    days = timeline(history, target, keys, label, date).withColumn("_day", day_number(F.col(date)))
    columns = []
    for w in windows:
        frame = W.partitionBy(*keys).orderBy("_day").rangeBetween(-int(w), -1)
        columns += [
            F.coalesce(F.sum("impressions").over(frame), F.lit(0)).alias(f"impressions_{w}d"),
            F.coalesce(F.sum("positives").over(frame), F.lit(0)).alias(f"positives_{w}d"),
        ]
    return days.select(*keys, date, *columns)


def user_history(
    history: DataFrame, target: DataFrame, windows: tuple[int, ...] = (1, 7), append: bool = False
) -> DataFrame:
    """The user's count and rate over the last days; 0 when there is no earlier row."""
    as_text = lambda df: df.withColumn("user_id", F.col("user_id").cast("string"))
    state = range_window(as_text(history), as_text(target), ["user_id"], windows)
    columns, names = [], []
    for w in windows:
        n, p = F.col(f"impressions_{w}d"), F.col(f"positives_{w}d")
        names += [f"user_history_{w}d_impressions", f"user_history_{w}d_rate"]
        columns += [
            n.cast("double").alias(names[-2]),
            F.when(n > 0, p / n).otherwise(F.lit(0.0)).alias(names[-1]),
        ]
    state = state.select("user_id", "date", *columns)
    out = _attach(as_text(target), state, ["user_id", "date"], names)
    return _finish(out, target, names, ("date", "user_id", "long_view"), append)


def decayed_state(
    days: DataFrame, keys: list[str], half_life: float, day: str = "_day"
) -> DataFrame:
    """Decayed sums of ``impressions`` and ``positives`` over strictly earlier days.

    ``days`` has one row per key and day. Weights ``2^((d - a) / h)`` relative to an anchor
    ``a`` turn the decay into a running sum. Anchors sit 256 half-lives apart, so no power
    overflows at any half-life. The totals of the five blocks before carry over, each with its
    own weight; what is older weighs less than 2^-1280, which a double cannot hold. Work is
    linear in the days of a key.
    """
    h = float(half_life)
    span = max(1, int(BLOCK_HALF_LIVES * h))
    cut = days.withColumn("_block", F.floor(F.col(day) / span).cast("long"))
    since = (F.col(day) - F.col("_block") * span) / h
    grow = F.pow(F.lit(2.0), since)
    cut = cut.withColumns({"_w": F.col("impressions") * grow, "_y": F.col("positives") * grow})
    # all windows share one exchange on the keys and one sort by block and day
    block = W.partitionBy(*keys, "_block").orderBy(day)
    inside = block.rowsBetween(W.unboundedPreceding, -1)
    upto = block.rowsBetween(W.unboundedPreceding, W.currentRow)
    along = W.partitionBy(*keys).orderBy(day)
    earlier = W.partitionBy(*keys).orderBy("_block").rangeBetween(-CARRIED_BLOCKS, -1)
    total = lambda name, frame: F.coalesce(F.sum(name).over(frame), F.lit(0.0))
    cut = cut.select(
        *days.columns,
        "_block",
        total("_w", inside).alias("_lw"),
        total("_y", inside).alias("_ly"),
        total("_w", upto).alias("_bw"),
        total("_y", upto).alias("_by"),
    )
    # the last day of a block carries that block's totals: one entry a block
    last = ~F.coalesce(F.lead("_block").over(along) == F.col("_block"), F.lit(False))
    cut = cut.withColumn("_end", F.when(last, F.struct("_block", "_bw", "_by")))
    cut = cut.withColumn("_past", F.collect_list("_end").over(earlier))

    def carried(field: str) -> Column:
        def one(entry):
            gap = (F.col("_block") - entry["_block"]) * span / h
            # 2^-gap times a sum of up to 2^256: in steps, to stay in range
            part = F.pow(F.lit(2.0), -gap / 4)
            return entry[field] * part * part * part * part

        return F.aggregate("_past", F.lit(0.0), lambda total, entry: total + one(entry))

    shrink = F.pow(F.lit(2.0), -since)
    return cut.select(
        *days.columns,
        ((F.col("_lw") + carried("_bw")) * shrink).alias("weight"),
        ((F.col("_ly") + carried("_by")) * shrink).alias("weighted"),
    )


def theta_decay(
    history: DataFrame, target: DataFrame, keys: list[str], half_life: float,
    label: str = "long_view", date: str = "date",
) -> DataFrame:
    """Sum over strictly earlier days with weight ``2^(-(t - d) / half_life)``, per key and
    asked day: the decayed inequality join, as running sums."""
    days = timeline(history, target, keys, label, date).withColumn("_day", day_number(F.col(date)))
    return decayed_state(days, keys, half_life).select(*keys, date, "weight", "weighted")


def decayed_affinity(
    history: DataFrame,
    target: DataFrame,
    attribute: str = "author_id",
    half_life_days: float = 7.0,
    alpha: float = 20.0,
    centered: bool = True,
    buckets: int = 10,
    edges: list[float] | None = None,
    append: bool = False,
) -> DataFrame:
    """Decayed, shrunk rate of a user on an attribute; centered, its logit lift over the
    user's own decayed rate."""
    edges = _edges_for(attribute, DECAY_ATTRIBUTES, history, buckets, edges)
    if half_life_days <= 0:
        raise ValueError(f"weights cannot halve every {half_life_days} days")
    value = attribute_column(attribute, edges)
    user = F.col("user_id").cast("string")
    shape = lambda df: df.withColumns({"_user": user, "_attr": value})
    hist, tgt = shape(history), shape(target)
    pair_days = timeline(hist, tgt, ["_user", "_attr"]).withColumn("_day", day_number(F.col("date")))

    def rolled(keys):
        days = pair_days.groupBy(*keys, "_day").agg(
            F.sum("impressions").alias("impressions"), F.sum("positives").alias("positives")
        )
        return decayed_state(days, keys, half_life_days).drop("impressions", "positives")

    pair = decayed_state(pair_days, ["_user", "_attr"], half_life_days)
    by_attr = rolled(["_attr"]).toDF("_attr", "_day", "aw", "ay")
    everything = rolled([]).toDF("_day", "gw", "gy")
    state = (
        _attach(pair, by_attr, ["_attr", "_day"], ["aw", "ay"])
        .join(F.broadcast(everything), "_day")  # one row per day
    )
    if centered:
        by_user = rolled(["_user"]).toDF("_user", "_day", "uw", "uy")
        state = _attach(state, by_user, ["_user", "_day"], ["uw", "uy"])
    a = F.lit(float(alpha))
    overall = F.when(F.col("gw") > 0, F.col("gy") / F.col("gw")).otherwise(F.lit(0.0))
    prior = F.when(F.col("aw") > 0, F.col("ay") / F.col("aw")).otherwise(overall)
    mass = F.col("weight") + a
    rate = F.when(mass > 0, (F.col("weighted") + a * prior) / mass).otherwise(prior)
    if centered:
        own = F.col("uw") + a
        base = F.when(own > 0, (F.col("uy") + a * overall) / own).otherwise(overall)
        rate = logit(rate) - logit(base)
    prefix = f"decay_{attribute}_h{half_life_days:g}"
    names = [f"{prefix}_{'lift' if centered else 'rate'}", f"{prefix}_weight"]
    ready = state.select(
        "_user", "_attr", "date", rate.alias(names[0]), F.col("weight").alias(names[1])
    )
    out = _attach(tgt, ready, ["_user", "_attr", "date"], names)
    return _finish(out, target, names, _attribute_sources(attribute), append)


def check_alignment(built: DataFrame, target: DataFrame, keys=KEYS) -> DataFrame:
    """Violations of "exactly one output row per target row"."""
    keys = list(keys)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(target, "wanted").join(count(built, "got"), keys, "full_outer")
    problem = (
        F.when(F.col("got").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unknown")
        .when(F.col("got") > F.col("wanted"), "duplicated")
        .when(F.col("got") < F.col("wanted"), "dropped")
    )
    return both.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


