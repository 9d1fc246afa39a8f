"""Networks on embedded ids, for one label or several, trained on a table of parameters.

Embeddings are rows of the table by id, whatever the vocabulary; the dense weights, whose number
follows from the fields and the hidden layer alone, are a few more of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import to_numeric
from ..operators.encoders import SparseEncoder, fit_median, fit_sparse, split_kinds
from ..session import cut_lineage
from .common import PREDICTION, Stopper, even, hot_users, predictions, primary_of, train_rows
from .lazy import BROADCAST_BYTES, array_of, lists
from .losses import Tower, sigmoid
from .rounds import ROUND_STEPS, SHARD_BATCH, Rounds, current, dense_rows, start_rows

#: spread of the embeddings at the start
INIT_SPREAD = 0.01


@dataclass
class Inputs:
    """Ids of the categorical fields, and scaled numbers: train medians for gaps, then train mean
    and spread."""

    encoder: SparseEncoder | None
    numeric: list[str]
    medians: dict[str, float]
    scale: dict[str, tuple[float, float]]

    @property
    def dimension(self) -> int:
        return self.encoder.dimension if self.encoder else 0

    @property
    def fields(self) -> int:
        return len(self.encoder.fields) if self.encoder else 0

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        numbers = []
        for name in self.numeric:
            mean, spread = self.scale[name]
            value = F.coalesce(to_numeric(F.col(name)), F.lit(self.medians[name]))
            numbers.append((value - F.lit(mean)) / F.lit(spread))
        numbers = F.array(*numbers) if numbers else F.array().cast("array<double>")
        out = df.withColumn("_numbers", numbers)
        if self.encoder:
            out = self.encoder.transform(out, "_ids")
        else:
            out = out.withColumn("_ids", F.array().cast("array<int>"))
        return out.select(*keep, F.col("_ids").alias("ids"), F.col("_numbers").alias("numbers"))


def fit_inputs(df: DataFrame, features: list[str], hashed: int | None = None) -> Inputs:
    """Vocabularies, medians and scales of the train rows."""
    if not features:
        raise ValueError(f"no feature column was named; the frame has {df.columns}")
    categorical, numeric = split_kinds(df, features)
    encoder = fit_sparse(df, categorical, hashed=hashed) if categorical else None
    medians, scale = {}, {}
    if numeric:
        train = train_rows(df)
        medians = fit_median(train, numeric)
        filled = train.select(*[F.coalesce(to_numeric(F.col(c)), F.lit(medians[c])).alias(c) for c in numeric])
        row = filled.agg(
            *[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]
        ).first()
        scale = {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in numeric}
    return Inputs(encoder, numeric, medians, scale)


@dataclass
class NetworkModel:
    """A fitted network: its embeddings are a table (id, p), its dense weights one array."""

    inputs: Inputs
    tower: Tower
    embeddings: DataFrame
    dense: np.ndarray
    history: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Probabilities of the first task."""
        kept = [c for c in PREDICTION if c in df.columns]
        rows = self.inputs.transform(df, kept)
        return network_scores(rows, self.embeddings, self.tower, self.dense, self.inputs.dimension)


def network_scores(
    rows: DataFrame, embeddings: DataFrame, tower: Tower, dense: np.ndarray, dimension: int | None = None
) -> DataFrame:
    """Probabilities of the first task for rows of ids and numbers, in batches.

    Embeddings of a known `dimension` that are small enough to be broadcast are, as one array; else
    each row gathers its own by one join and one exchange.
    """
    kept = [c for c in PREDICTION if c in rows.columns]
    width = 1 + tower.factors
    shared = None
    if tower.fields and dimension is not None and dimension * width * 8 <= BROADCAST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast(array_of(embeddings, dimension, width))
        rows = rows.select(*kept, "numbers", F.col("ids").alias("own"))
    elif tower.fields:
        wide = rows.select(*kept, "numbers", F.posexplode("ids").alias("place", "id")).join(embeddings, "id")
        own = F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda s: s["p"])
        rows = wide.groupBy(*kept).agg(F.first("numbers").alias("numbers"), F.flatten(own).alias("own"))
    else:
        rows = rows.select(*kept, "numbers", F.array().cast("array<double>").alias("own"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            own = lists(batch.column("own"))
            own = own.reshape(n, tower.fields, width) if shared is None else shared.value[own]
            numbers = lists(batch.column("numbers")).reshape(n, tower.numbers)
            z, _ = tower.forward(own, numbers, dense)
            columns = [batch.column(c) for c in kept] + [pa.array(sigmoid(z[:, 0]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score"])

    return predictions(rows.mapInArrow(work, f"{kinds}, score double"), F.col("score"))


def fit_network(
    df: DataFrame,
    features: list[str],
    labels: list[str],
    weights: list[float],
    embedding_dim: int = 16,
    hidden_dim: int = 64,
    dropout: float = 0.1,
    batch_size: int = 8192,
    epochs: int = 3,
    lr: float = 1e-3,
    weight_decay: float = 1e-6,
    patience: int = 3,
    seed: int = 0,
    hashed: int | None = None,
    round_steps: int = ROUND_STEPS,
    shard_batch: int = SHARD_BATCH,
) -> NetworkModel:
    """Cross entropy of all labels by their weights, with mini-batch Adam and decoupled decay.

    Every epoch is one pass with steps of ``batch_size`` rows, followed by the valid primary of
    the first label; the best epoch is kept, and ``patience`` epochs without a gain end the fit.
    Without valid rows the last epoch is kept. Batches are shared by shards as in ``rounds``.
    """
    spark = df.sparkSession
    inputs = fit_inputs(df, features, hashed)
    tower = Tower(inputs.fields, embedding_dim, len(inputs.numeric), hidden_dim, list(weights), dropout)
    width = 1 + embedding_dim
    keep = list(dict.fromkeys([*[c for c in PREDICTION if c in df.columns], *labels]))
    kept = df.where(F.col("split").isin("train", "valid"))
    rows = even(inputs.transform(kept, keep), kept).persist()
    try:
        train = train_rows(rows).select(
            "row_id", "ids", "numbers", F.array(*[F.col(c).cast("double") for c in labels]).alias("labels")
        )
        valid = rows.where(F.col("split") == "valid").select(*[c for c in keep if c in PREDICTION], "ids", "numbers")
        start = dense_rows(spark, tower.start(seed), width)
        plan = Rounds(train, ["ids"], batch_size, -(-tower.size // width), width, round_steps, shard_batch)
        plan.begin(start_rows(spark, inputs.dimension, width, seed, INIT_SPREAD).unionByName(start))
        judged, hot, stop = not valid.isEmpty(), hot_users(valid), Stopper(patience)
        for epoch in range(epochs):
            plan.epoch(tower, lr, 0.0, weight_decay, seed * 1009 + epoch)
            table = cut_lineage(current(plan.table(), plan.taken, lr, width))
            # as many values as the fields and the hidden layer ask for, whatever the vocabulary
            held = {r["id"]: r["p"] for r in table.where("id < 0").collect()}
            dense = np.concatenate([held[-1 - n] for n in range(len(held))])
            model = NetworkModel(inputs, tower, table.where("id >= 0"), dense)
            primary = primary_of(network_scores(valid, model.embeddings, tower, dense, inputs.dimension), hot=hot) if judged else epoch
            if stop.offer(primary, model):
                break
    finally:
        rows.unpersist()
    stop.state.history = stop.seen if judged else []
    return stop.state


def fit_deepfm(df: DataFrame, features: list[str], **options) -> NetworkModel:
    """A hidden layer over the embeddings and numbers of a row, the factorization term over the same
    embeddings, and linear terms, trained together; options as for ``fit_network``."""
    return fit_network(df, features, ["long_view"], [1.0], **options)
