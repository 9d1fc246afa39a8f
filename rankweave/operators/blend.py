"""Blending scores of several models."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from ..plans.ordering import find_hot
from ..schemas import CONFIRM_SEEDS, KEYS
from .sets import percent_rank


def checked_weights(n: int, weights=None) -> list[float]:
    values = [1.0] * n if weights is None else [float(w) for w in weights]
    if n == 0 or len(values) != n or not all(math.isfinite(w) for w in values) or sum(values) <= 0:
        raise ValueError("weights must be finite, match the inputs and have a positive sum")
    return values


def weighted_mean(df: DataFrame, columns: list[str], weights: list[float]):
    total = sum(weights)
    return reduce(add, [F.col(c) * F.lit(w) for c, w in zip(columns, weights)]) / F.lit(total)


def align(preds: list[DataFrame], score: str = "score") -> DataFrame:
    """Scores of all predictions side by side, matched by ``(split, row_id)``."""
    first = preds[0].select(*KEYS, "user_id", F.col(score).alias("_s0"))
    rest = [p.select(*KEYS, F.col(score).alias(f"_s{i}")) for i, p in enumerate(preds[1:], 1)]
    return reduce(lambda a, b: a.join(b, list(KEYS)), rest, first)


def seed_bag(preds: list[DataFrame], weights=None) -> DataFrame:
    """Weighted mean of raw scores; the inputs must share a scale."""
    w = checked_weights(len(preds), weights)
    names = [f"_s{i}" for i in range(len(preds))]
    wide = align(preds)
    return wide.select(*KEYS, "user_id", weighted_mean(wide, names, w).alias("score"))


def rank_average(preds: list[DataFrame], weights=None, min_rows: int | None = None) -> DataFrame:
    """Weighted mean of within-user percent ranks; scales may differ."""
    w = checked_weights(len(preds), weights)
    wide = align(preds)
    hot = find_hot(preds[0], ["split", "user_id"], min_rows)  # same rows in every input
    names = []
    for i in range(len(preds)):
        wide = percent_rank(wide, f"_s{i}", name=f"_r{i}", hot=hot)
        names.append(f"_r{i}")
    return wide.select(*KEYS, "user_id", weighted_mean(wide, names, w).alias("score"))


BLENDS = {"seed_bag": seed_bag, "rank_average": rank_average}


def bag(fit, df: DataFrame, seeds, blend: str = "seed_bag") -> DataFrame:
    """Blend of one model fitted under two to eight distinct seeds.

    ``fit(df, seed)`` returns predictions.
    """
    seeds = list(seeds)
    if not 2 <= len(seeds) <= 8 or len(set(seeds)) != len(seeds):
        raise ValueError("bagging takes 2 to 8 distinct seeds")
    if blend not in BLENDS:
        raise ValueError(f"unknown blend {blend!r}")
    return BLENDS[blend]([fit(df, seed) for seed in seeds])


def confirm_seeds(fit, df: DataFrame, evaluate, seeds=CONFIRM_SEEDS, split: str = "valid") -> DataFrame:
    """Metrics of a model re-fitted under the confirmation seeds, one row per seed."""
    rows = [
        evaluate(fit(df, seed), splits=(split,)).withColumn("seed", F.lit(int(seed))) for seed in seeds
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)
