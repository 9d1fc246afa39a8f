"""Features of a single row. None of them shuffles.

Each function returns ``(split, row_id, features...)``; with ``append=True`` it adds the
features to the frame instead, so a chain of operators needs no joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import SAME_ROW, STATIC, Lineage, tag
from ..functions.scalars import bucketize, date_of, duration_regime
from ..plans.quantiles import fit_quantiles, interior
from ..schemas import DURATION_BANDS_S, HINGE_MS, KEYS, TRAIN_START


def emit(
    df: DataFrame, columns: dict[str, Column], lineage: dict[str, Lineage], append: bool
) -> DataFrame:
    categorical = [name for name in columns if name.startswith("cat_")]
    out = df.withColumns(columns) if append else df.select(
        *KEYS, *[c.alias(name) for name, c in columns.items()]
    )
    return tag(out, {n: l for n, l in lineage.items() if n in columns}, categorical)


def duration_edges(df: DataFrame, buckets: int = 10, accuracy: int | None = None) -> list[float]:
    """Duration quantile edges of the train split."""
    train = df.where(F.col("split") == "train")
    return fit_quantiles(train, ["duration_ms"], interior(buckets), accuracy)["duration_ms"]


def raw_categorical(df: DataFrame, edges: list[float] | None = None, append: bool = False) -> DataFrame:
    edges = duration_edges(df) if edges is None else edges
    text = lambda name: F.col(name).cast("string")
    columns = {
        "cat_user_id": text("user_id"),
        "cat_video_id": text("video_id"),
        "cat_author_id": text("author_id"),
        "cat_tab": text("tab"),
        "cat_dur_bucket": bucketize(F.col("duration_ms").cast("double"), edges).cast("string"),
    }
    return emit(
        df,
        columns,
        {
            "cat_user_id": Lineage(("user_id",), SAME_ROW),
            "cat_video_id": Lineage(("video_id",), SAME_ROW),
            "cat_author_id": Lineage(("author_id",), STATIC),
            "cat_tab": Lineage(("tab",), SAME_ROW),
            "cat_dur_bucket": Lineage(("duration_ms",), STATIC),
        },
        append,
    )


def video_duration(
    df: DataFrame, buckets: int = 10, edges: list[float] | None = None, append: bool = False
) -> DataFrame:
    edges = duration_edges(df, buckets) if edges is None else edges
    duration = F.col("duration_ms").cast("double")
    origin = Lineage(("duration_ms",), STATIC)
    return emit(
        df,
        {
            "video_duration_log_ms": F.log1p(duration),
            "cat_video_duration_bucket": bucketize(duration, edges).cast("string"),
        },
        {"video_duration_log_ms": origin, "cat_video_duration_bucket": origin},
        append,
    )


def temporal(df: DataFrame, start_date: int = TRAIN_START, append: bool = False) -> DataFrame:
    """Days since the start of training, weekday (Monday is 0) and hour."""
    day = date_of(F.col("date"))
    return emit(
        df,
        {
            "temporal_day_index": F.datediff(day, date_of(F.lit(start_date))).cast("double"),
            "cat_temporal_weekday": F.weekday(day).cast("string"),
            "cat_temporal_hour": F.floor(F.col("hourmin") / 100).cast("string"),
        },
        {
            "temporal_day_index": Lineage(("date",), SAME_ROW),
            "cat_temporal_weekday": Lineage(("date",), SAME_ROW),
            "cat_temporal_hour": Lineage(("hourmin",), SAME_ROW),
        },
        append,
    )


def duration_hinge(df: DataFrame, hinge_ms: float = HINGE_MS, append: bool = False) -> DataFrame:
    """Duration below and above the point where the label rule changes."""
    duration = F.col("duration_ms").cast("double")
    hinge = F.lit(float(hinge_ms))
    seconds = duration / 1000.0
    below = F.least(duration, hinge) / 1000.0
    above = F.greatest(duration - hinge, F.lit(0.0)) / 1000.0
    columns = {
        "dur_hinge_below_s": below,
        "dur_hinge_above_log_s": F.log1p(above),
        "dur_hinge_ratio": below / F.greatest(seconds, F.lit(1e-6)),
        "cat_dur_regime": duration_regime(duration, hinge_ms),
        "cat_dur_band": bucketize(seconds, DURATION_BANDS_S).cast("string"),
    }
    return emit(df, columns, {n: Lineage(("duration_ms",), STATIC) for n in columns}, append)


def attribute_column(attribute: str, edges: list[float] | None = None) -> Column:
    """A row's value of an affinity attribute, as text."""
    if attribute == "duration_bucket":
        if edges is None:
            raise ValueError("duration_bucket needs fitted edges")
        return bucketize(F.col("duration_ms").cast("double"), edges).cast("string")
    if attribute == "duration_regime":
        # always the fixed hinge, whatever hinge the duration features use
        return duration_regime(F.col("duration_ms").cast("double"), HINGE_MS)
    return F.col(attribute).cast("string")


def constant_feature(df: DataFrame, append: bool = False) -> DataFrame:
    """Stand-in for a feature bundle in ablations."""
    return emit(
        df, {"ablation_constant": F.lit(0.0)}, {"ablation_constant": Lineage((), STATIC)}, append
    )


def constant_score(df: DataFrame) -> DataFrame:
    """Stand-in for a model in ablations."""
    return df.select(*KEYS, "user_id", F.lit(0.0).alias("score"))
