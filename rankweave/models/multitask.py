"""Several labels of one row, learned together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..evaluation.guards import require_auxiliary
from ..schemas import AUXILIARY_LABELS, KEYS
from .common import train_rows
from .deep import NetworkModel, fit_network


def task_labels(
    df: DataFrame,
    targets: list[str] = list(AUXILIARY_LABELS),
    weight: float = 0.3,
    label: str = "long_view",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row and task: the label with weight 1, each auxiliary with ``weight``.

    Auxiliary names outside the allow-list are refused.
    """
    require_auxiliary(list(targets))
    long = df.unpivot([*KEYS, *keep], [label, *targets], "task", "label")
    return long.withColumn(
        "weight", F.when(F.col("task") == label, F.lit(1.0)).otherwise(F.lit(float(weight)))
    )


def fit_multitask(
    df: DataFrame,
    features: list[str],
    auxiliary_targets: list[str] = list(AUXILIARY_LABELS),
    auxiliary_weight: float = 0.3,
    label: str = "long_view",
    **options,
) -> NetworkModel:
    """One network with a head a task: the tasks share embeddings and hidden layer, and the loss
    weighs the auxiliaries by ``auxiliary_weight``; scores are those of ``label``.

    Auxiliary names outside the allow-list are refused. Only 0/1 labels can be trained on; other
    allowed outcomes are refused, not dropped. Other options as for ``fit_network``.
    """
    names = require_auxiliary(list(auxiliary_targets))
    if names:
        span = train_rows(df).agg(*[F.max(~F.col(n).isin(0, 1)).alias(n) for n in names]).first()
        bad = [n for n in names if span[n]]
        if bad:
            raise ValueError(f"auxiliary labels must be 0/1, but {bad} hold other values")
    weights = [1.0] + [float(auxiliary_weight)] * len(names)
    return fit_network(df, features, [label, *names], weights, **options)
