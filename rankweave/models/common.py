"""Shared pieces of the models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..evaluation.metrics import USER, evaluate
from ..plans.ordering import FIND, find_hot
from ..schemas import GAIN_EPS, KEYS

PREDICTION = [*KEYS, "user_id", "long_view"]
#: rows that a task of a pass should hold
PART_ROWS = 1 << 17
#: with fewer, starting a task costs more than its rows
LEAST_PART_ROWS = 1 << 12


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def score(model, df: DataFrame, raw: bool = False) -> DataFrame:
    """Scores of every row of every split under a fitted model: the probability of a
    positive, or the plain prediction when ``raw``."""
    return predictions(model.transform(df), F.col("prediction") if raw else probability())


def probability(column: str = "probability"):
    return vector_to_array(F.col(column))[1]


def part_count(rows: int, cores: int) -> int:
    """Parts of a frame that many passes read: by its rows, and one a core where these are enough."""
    return max(1, -(-rows // PART_ROWS), min(cores, rows // LEAST_PART_ROWS))


def parts_of(df: DataFrame) -> int:
    """Counts the rows: the parts for many passes over them."""
    return part_count(df.count(), df.sparkSession.sparkContext.defaultParallelism)


def even(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Spreads training rows evenly: one exchange before many passes, so that no pass waits for an
    uneven part. The parts follow from the rows of ``counted``, which ``df`` has as well, not from
    the session's shuffle width: a pass over many parts of a few rows is all overhead."""
    return df.repartition(parts_of(counted))


def predictions(df: DataFrame, value) -> DataFrame:
    kept = [c for c in PREDICTION if c in df.columns]
    return df.select(*kept, value.cast("double").alias("score"))


def hot_users(df: DataFrame) -> DataFrame | None:
    """Hot users of a frame, for repeated evaluation of the same rows."""
    return find_hot(df, USER)


def primary_of(pred: DataFrame, split: str = "valid", hot=FIND) -> float:
    """The primary metric of one split, as a number (-inf if the split has no mixed user)."""
    row = evaluate(pred, (split,), hot=hot).first()
    return float("-inf") if row is None or row["primary"] is None else float(row["primary"])


class Stopper:
    """Keeps the best checkpoint; says when ``patience`` checkpoints in a row brought no gain
    above 1e-5."""

    def __init__(self, patience: int):
        self.patience, self.best, self.state, self.streak = patience, float("-inf"), None, 0
        self.seen: list[float] = []

    def offer(self, primary: float, state) -> bool:
        """Returns True when training should stop."""
        self.seen.append(primary)
        if self.state is None or primary > self.best + GAIN_EPS:
            self.best, self.state, self.streak = primary, state, 0
            return False
        self.streak += 1
        return self.streak >= self.patience
