"""A scorer that sees a whole ranking set, trained with a listwise softmax loss."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from ..operators.encoders import fit_median, impute
from ..operators.sets import cap_sets, mixed_sets, set_context, set_keys
from ..plans.ordering import group_totals
from ..schemas import KEYS
from ..session import cut_lineage, work_path
from .common import PREDICTION, Stopper, hot_users, predictions, primary_of, train_rows
from .local import listwise_round
from .rounds import ROUND_STEPS, shard_count, steps_between

#: sets of a batch that one shard takes
SHARD_BATCH = 16


def inputs(df: DataFrame, features: list[str], by: str) -> DataFrame:
    """Numeric features with their deviation from the set mean and their rank share in the
    set: the part of the score that depends on the competing rows."""
    context = set_context(df, features, by)
    shares = [(F.col(f"{c}_set_rank") / F.col("set_size")).alias(f"{c}_set_share") for c in features]
    devs = [f"{c}_set_dev" for c in features]
    return df.join(context.select(*KEYS, *devs, *shares), list(KEYS))


def input_names(features: list[str]) -> list[str]:
    return [n for c in features for n in (c, f"{c}_set_dev", f"{c}_set_share")]


@dataclass
class ListwiseModel:
    features: list[str]
    medians: dict[str, float]
    scale: dict[str, tuple[float, float]]
    weights: dict[str, float]
    history: list[float]
    losses: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Sets are scored as the metric ranks them: all rows of a user in a split."""
        rows = inputs(impute(df, self.medians), self.features, "user")
        return predictions(rows, _linear(self.scale, self.weights))


def _scaled(name: str, scale):
    mean, spread = scale[name]
    return (F.col(name) - F.lit(mean)) / F.lit(spread)


def _linear(scale, weights):
    return reduce(add, [F.lit(w) * _scaled(n, scale) for n, w in weights.items()])


def listwise_gradient(
    rows: DataFrame, keys: list[str], names: list[str], score: str = "score",
    label: str = "long_view", hot=None,
) -> DataFrame:
    """One row: loss and gradient, summed over sets, of ``-sum(target * log_softmax)``, and
    the number of sets. Two group aggregates and one global sum per epoch."""
    peak = group_totals(
        rows, keys, {"_peak": F.max(score), "_labels": F.sum(F.col(label).cast("double"))}, hot=hot
    ).withColumn("_e", F.exp(F.col(score) - F.col("_peak")))
    mass = group_totals(peak, keys, {"_mass": F.sum("_e"), "_size": F.count(F.lit(1))}, hot=hot)
    target = F.col(label) / F.greatest(F.col("_labels"), F.lit(1e-9))
    pull = F.col("_e") / F.col("_mass") - target
    loss = -target * (F.col(score) - F.col("_peak") - F.log("_mass"))
    return mass.agg(
        F.sum(loss).alias("loss"),
        F.sum(1.0 / F.col("_size")).alias("sets"),
        *[F.sum(pull * F.col(n)).alias(f"g_{n}") for n in names],
    )


def fit_listwise(
    df: DataFrame,
    features: list[str],
    train_group: str = "user_date",
    epochs: int = 20,
    patience: int = 3,
    lr: float = 1e-3,
    weight_decay: float = 1e-6,
    max_set_size: int = 48,
    set_batch: int = 256,
    clip: float = 5.0,
    seed: int = 0,
    round_steps: int = ROUND_STEPS,
    shard_batch: int = SHARD_BATCH,
) -> ListwiseModel:
    """Linear scorer on set-aware inputs. Mixed sets only; sets above ``max_set_size`` are
    drawn anew each epoch.

    An epoch has ``sets / set_batch`` Adam steps, one after the other, with gradients clipped at
    norm ``clip``, at any size: the sets are dealt into rounds of ``round_steps`` steps and
    each round into ``set_batch / shard_batch`` shards, every shard its part of a batch; after a
    round the weights, a handful of numbers, are averaged by the sets of each shard.
    """
    keys = set_keys(train_group)
    names = input_names(features)
    medians = fit_median(train_rows(df), features)
    lean = impute(df.select(*dict.fromkeys([*PREDICTION, "date", *features])), medians)
    train = inputs(mixed_sets(train_rows(lean), train_group), features, train_group)
    stats = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(*keys).alias("sets"),
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
    ).first()
    if not stats["n"]:
        raise RuntimeError(f"no train set by {keys} has rows of both outcomes")
    scale = {n: (float(stats[f"m_{n}"]), float(stats[f"s_{n}"]) or 1.0) for n in names}
    scaled = lambda frame, kept: frame.select(*kept, *[_scaled(n, scale).alias(n) for n in names])
    train = cut_lineage(scaled(train, [*dict.fromkeys([*keys, "row_id", "long_view"])]))
    valid = inputs(lean.where(F.col("split") == "valid"), features, "user")
    valid = cut_lineage(scaled(valid, PREDICTION))
    plain = {n: (0.0, 1.0) for n in names}
    total = -(-stats["sets"] // set_batch)
    rounds, shards = -(-total // round_steps), shard_count(set_batch, shard_batch)
    state = {p: [0.0] * len(names) for p in "wmu"}
    stop, hot, losses = Stopper(patience), hot_users(valid), []
    group = F.xxhash64(*keys)
    dealt = lambda name, parts: F.pmod(F.xxhash64(F.lit(name), *keys), F.lit(parts)).cast("int").alias(name)
    mean = lambda p, i: F.sum(F.element_at(p, i + 1) * F.col("sets")) / F.sum("sets")
    for epoch in range(1, epochs + 1):
        drawn = cap_sets(train, train_group, max_set_size, seed * 1009 + epoch)
        rows = drawn.select(
            dealt("round", rounds), dealt("shard", shards), group.alias("set"), "row_id",
            F.col("long_view").cast("double").alias("label"), F.array(*names).alias("x"),
        )
        if rounds > 1:
            # a round reads its own folder only
            path = work_path(df.sparkSession, "sets")
            rows.write.partitionBy("round").parquet(path)
            rows = df.sparkSession.read.parquet(path)
        lost, seen = 0.0, 0
        for n in range(rounds):
            before, after = steps_between(n, total, rounds)
            run = listwise_round(
                *[state[p] for p in "wmu"], lr, weight_decay, after - before, (epoch - 1) * total + before, clip,
                seed * 1009 + epoch,
            )
            own = rows.where(F.col("round") == n).drop("round").repartition(shards, "shard")
            parts = own.groupBy("shard").applyInArrow(
                run, "w array<double>, m array<double>, u array<double>, sets long, loss double"
            )
            row = parts.agg(
                F.sum("loss").alias("loss"),
                F.sum("sets").alias("sets"),
                *[mean(p, i).alias(f"{p}{i}") for p in "wmu" for i in range(len(names))],
            ).first()
            if row["sets"]:
                state = {p: [row[f"{p}{i}"] for i in range(len(names))] for p in "wmu"}
                lost, seen = lost + row["loss"], seen + row["sets"]
        losses.append(lost / seen)
        weights = dict(zip(names, state["w"]))
        primary = primary_of(predictions(valid, _linear(plain, weights)), hot=hot)
        if stop.offer(primary, weights):
            break
    return ListwiseModel(list(features), medians, scale, stop.state, stop.seen, losses)
