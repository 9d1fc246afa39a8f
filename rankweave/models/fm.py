"""Factorization machines: pointwise fit, and pairwise fine-tuning on same-user pairs.

Parameters are a table ``(id, w, v0..)`` of any length; see ``rounds`` for how it is trained.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.encoders import SparseEncoder, fit_sparse
from ..operators.sets import same_user_pairs
from ..session import cut_lineage
from .common import PREDICTION, Stopper, even, hot_users, predictions, primary_of, train_rows
from .lazy import BROADCAST_BYTES, array_of, lists
from .losses import PairLoss, PointLoss, fm_parts
from .rounds import ROUND_STEPS, SHARD_BATCH, Rounds, current, dense_rows, start_rows

#: spread of the factors at the start
INIT_SPREAD = 0.01
BIAS = -1


def _factors(k):
    return [f"v{f}" for f in range(k)]


def _lookup(exploded: DataFrame, params: DataFrame, dimension: int, k: int) -> DataFrame:
    """Parameters of each id: broadcast while their exact size is small, else a shuffle join."""
    small = dimension * (k + 2) * 8 <= BROADCAST_BYTES
    return exploded.join(F.broadcast(params) if small else params, "id")


def fm_logits(
    rows: DataFrame, key: list[str], params: DataFrame, dimension: int, k: int, ids: str = "ids"
) -> DataFrame:
    """Per key: the factor sums and the FM logit without bias, by one aggregate over the
    row's fields (``0.5 * sum((sum v)^2 - sum v^2) + sum w``)."""
    wide = _lookup(rows.select(*key, F.explode(ids).alias("id")), params, dimension, k)
    sums = wide.groupBy(*key).agg(
        F.sum("w").alias("_w"),
        *[F.sum(v).alias(f"s_{v}") for v in _factors(k)],
        F.sum(reduce(add, [F.col(v) * F.col(v) for v in _factors(k)])).alias("_sq"),
    )
    square = reduce(add, [F.col(f"s_{v}") * F.col(f"s_{v}") for v in _factors(k)])
    return sums.withColumn("z", F.col("_w") + 0.5 * (square - F.col("_sq"))).drop("_w", "_sq")


def pair_gradients(
    pairs: DataFrame, rows: DataFrame, params: DataFrame, dimension: int, k: int
) -> tuple[DataFrame, DataFrame]:
    """Gradients of ``mean log(1 + exp(-(z_pos - z_neg)))`` per parameter id, and the
    per-pair margins.

    ``pairs``: ``(pair_id, pos_row, neg_row)``; ``rows``: ``(row_id, ids)``. Joins and sums
    only: the gradient of an id combines map-side, so an id found in every row is harmless.
    """
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("sign"), F.col("pos_row").alias("row_id")),
                F.struct(F.lit(-1.0).alias("sign"), F.col("neg_row").alias("row_id")),
            )
        ).alias("s"),
    ).select("pair_id", "s.*")
    known = sides.join(rows, "row_id").select("pair_id", "sign", "ids")
    logits = fm_logits(known, ["pair_id", "sign"], params, dimension, k)
    margins = logits.groupBy("pair_id").agg(F.sum(F.col("sign") * F.col("z")).alias("margin"))
    held = F.least(F.greatest(F.col("margin"), F.lit(-60.0)), F.lit(60.0))
    pull = margins.select("pair_id", (-1.0 / (1.0 + F.exp(held))).alias("g"))
    back = (
        known.select("pair_id", "sign", F.explode("ids").alias("id"))
        .join(logits.drop("z"), ["pair_id", "sign"])
        .join(pull, "pair_id")
    )
    wide = _lookup(back, params, dimension, k)
    force = F.col("sign") * F.col("g")
    grads = wide.groupBy("id").agg(
        F.sum(force).alias("g_w"),
        *[F.sum(force * (F.col(f"s_{v}") - F.col(v))).alias(f"g_{v}") for v in _factors(k)],
    )
    return grads, margins


def named(values: DataFrame, k: int) -> DataFrame:
    """(id, w, v0..) from (id, p)."""
    return values.select("id", F.col("p")[0].alias("w"), *[F.col("p")[i + 1].alias(v) for i, v in enumerate(_factors(k))])


@dataclass
class FmModel:
    """Parameters by id; the bias is the weight of id -1, whose factors are 0."""

    encoder: SparseEncoder
    params: DataFrame
    k: int
    history: list[float]
    raw: bool = False

    def score(self, df: DataFrame) -> DataFrame:
        """Probabilities, or logits of a model trained on differences."""
        kept = [c for c in PREDICTION if c in df.columns]
        return _scores(self.encoder.transform(df).select(*kept, "ids"), self)


def _scores(rows: DataFrame, model: FmModel) -> DataFrame:
    """Scores of id rows. Parameters that are small enough to be broadcast are, as one array, and a row
    is scored where it is; of others, each row gathers its own."""
    kept = [c for c in PREDICTION if c in rows.columns]
    if model.encoder.fields and model.encoder.dimension * (model.k + 2) * 8 <= BROADCAST_BYTES:
        return _local_scores(rows.select(*kept, "ids"), model)
    rows = rows.withColumn("ids", F.concat("ids", F.array(F.lit(BIAS))))
    logits = fm_logits(rows, kept, model.params, model.encoder.dimension, model.k)
    z = F.col("z")
    return predictions(logits, z if model.raw else 1.0 / (1.0 + F.exp(-z)))


def _local_scores(rows: DataFrame, model: FmModel) -> DataFrame:
    kept = [c for c in rows.columns if c != "ids"]
    held = array_of(model.params.select("id", F.array("w", *_factors(model.k)).alias("p")), model.encoder.dimension + 1, model.k + 1)
    shared, raw = rows.sparkSession.sparkContext.broadcast(held), model.raw

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            params = shared.value
            z = fm_parts(params, lists(batch.column("ids")))[0] + params[BIAS, 0]
            columns = [batch.column(c) for c in kept] + [pa.array(z if raw else 1.0 / (1.0 + np.exp(-z)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return predictions(rows.mapInArrow(work, f"{kinds}, score double"), F.col("score"))


def _encoded(df: DataFrame, enc: SparseEncoder, features: list[str]) -> DataFrame:
    """The id rows of train and valid, spread evenly; other splits are scored later."""
    kept = df.select(*[c for c in PREDICTION if c in df.columns], *features)
    kept = kept.where(F.col("split").isin("train", "valid"))
    return even(enc.transform(kept).select(*[c for c in PREDICTION if c in kept.columns], "ids"), kept).persist()


def fit_fm(
    df: DataFrame,
    features: list[str],
    k: int = 16,
    lr: float = 0.001,
    l2: float = 1e-6,
    epochs: int = 40,
    batch_size: int = 8192,
    patience: int = 4,
    seed: int = 0,
    numeric_bins: int = 32,
    hashed: int | None = None,
    encoder: SparseEncoder | None = None,
    round_steps: int = ROUND_STEPS,
    shard_batch: int = SHARD_BATCH,
) -> FmModel:
    """Log-loss FM with mini-batch Adam on one-hot fields.

    Every epoch is one pass with steps of ``batch_size`` rows, followed by the valid primary;
    the best epoch is kept, and ``patience`` epochs without a gain end the fit. Vocabularies
    are exact at any size unless the caller asks for ``hashed`` slots a field. A batch is shared
    by ``batch_size / shard_batch`` shards, whose parameters are averaged every ``round_steps``
    steps (see ``rounds``); a batch of fewer than two parts is plain sequential Adam. L2 is
    charged when a row touches a parameter.
    """
    enc = encoder or fit_sparse(df, features, numeric_bins, hashed)
    rows = _encoded(df, enc, features)
    train = train_rows(rows).select("row_id", "ids", F.col("long_view").cast("double").alias("label"))
    valid = rows.where(F.col("split") == "valid")
    spark = df.sparkSession
    stop = Stopper(patience)
    try:
        plan = Rounds(train, ["ids"], batch_size, 1, k + 1, round_steps, shard_batch)
        start = start_rows(spark, enc.dimension, k + 1, seed, INIT_SPREAD)
        plan.begin(start.unionByName(dense_rows(spark, [0.0], k + 1)))
        hot = hot_users(valid)
        for epoch in range(epochs):
            plan.epoch(PointLoss(), lr, l2, 0.0, seed * 1009 + epoch)
            params = cut_lineage(named(current(plan.table(), plan.taken, lr, k + 1), k))
            model = FmModel(enc, params, k, [])
            if stop.offer(primary_of(_scores(valid, model), hot=hot), model):
                break
    finally:
        rows.unpersist()
    return FmModel(enc, stop.state.params, k, stop.seen)


def fit_fm_pairwise(
    df: DataFrame,
    features: list[str],
    base: FmModel | None = None,
    pairwise_lr: float = 2e-4,
    pairwise_epochs: int = 6,
    pairwise_patience: int = 2,
    pairs_per_user: int = 4,
    pair_batch: int = 4096,
    l2: float = 1e-6,
    seed: int = 0,
    k: int = 16,
    round_steps: int = ROUND_STEPS,
    shard_batch: int = SHARD_BATCH,
    **fm,
) -> FmModel:
    """A pointwise fit, then Adam steps on the logit difference of same-user pairs.

    Fresh pairs are drawn each epoch, with the ids of both rows, and taken in steps of
    ``pair_batch``; the bias cancels in a difference and stays. The best valid primary is kept.
    """
    base = base or fit_fm(
        df, features, k=k, l2=l2, seed=seed, round_steps=round_steps, shard_batch=shard_batch, **fm
    )
    k, enc = base.k, base.encoder
    width = k + 1
    rows = _encoded(df, enc, features)
    train, valid = train_rows(rows), rows.where(F.col("split") == "valid")
    values = F.array("w", *_factors(k), *[F.lit(0.0)] * (2 * width))
    table = base.params.select("id", F.lit(0).cast("long").alias("at"), values.alias("s"))
    stop, hot, taken = Stopper(pairwise_patience), hot_users(valid), 0
    start = FmModel(enc, base.params, k, [], raw=True)
    stop.offer(primary_of(_scores(valid, start), hot=hot), start)
    try:
        for epoch in range(pairwise_epochs):
            drawn = same_user_pairs(train, pairs_per_user, seed=seed * 1009 + epoch, carry=("ids",))
            pairs = cut_lineage(
                drawn.select(
                    F.xxhash64("pos_row", "neg_row").alias("row_id"),
                    F.col("pos_ids").alias("ids"), F.col("neg_ids").alias("other"),
                )
            )
            if pairs.isEmpty():
                raise RuntimeError(f"none of the {train.select('user_id').distinct().count()} train users has rows of both outcomes")
            plan = Rounds(pairs, ["ids", "other"], pair_batch, 0, width, round_steps, shard_batch)
            plan.begin(table)
            plan.epoch(PairLoss(), pairwise_lr, l2, 0.0, seed * 1009 + epoch, taken)
            taken += plan.steps
            table = plan.table()
            params = cut_lineage(named(current(table, taken, pairwise_lr, width), k))
            model = FmModel(enc, params, k, [], raw=True)
            if stop.offer(primary_of(_scores(valid, model), hot=hot), model):
                break
    finally:
        rows.unpersist()
    return FmModel(enc, stop.state.params, k, stop.seen, raw=True)
