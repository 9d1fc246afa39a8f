"""Lookups and joins on rows and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import SIDE_FILE, STATIC, Lineage, tag
from ..functions.scalars import log_clip, safe_ratio, to_numeric
from ..plans.keyed import key_counts
from ..plans.ordering import join_groups
from ..schemas import (
    KEYS,
    USER_CATEGORICAL,
    USER_LOG_NUMERIC,
    USER_NUMERIC,
    VIDEO_CATEGORICAL,
    VIDEO_NUMERIC,
)
from ..sources.impressions import require_unique


def static_side(
    df: DataFrame, users: DataFrame, videos: DataFrame, checked: bool = False, append: bool = False
) -> DataFrame:
    """User and video side columns by key; a miss gives ``UNK`` or null, never a lost row.

    Values are shaped on the side tables, before the join, so each entity is parsed once and
    not once per impression. Counts are log-compressed; the frame ratio is height over width.
    """
    if checked:
        require_unique(users, ["user_id"], "user table")
        require_unique(videos, ["video_id"], "video table")
    number = lambda name: to_numeric(F.col(name))
    user_cols = {f"cat_su_{c}": F.col(c).cast("string") for c in USER_CATEGORICAL}
    for c in USER_NUMERIC:
        if c in USER_LOG_NUMERIC:
            user_cols[f"su_log_{c}"] = log_clip(number(c))
        else:
            user_cols[f"su_{c}"] = number(c)
    video_cols = {f"cat_sv_{c}": F.col(c).cast("string") for c in VIDEO_CATEGORICAL}
    for c in VIDEO_NUMERIC:
        if c == "video_duration":
            video_cols["sv_log_video_duration"] = log_clip(number(c))
        else:
            video_cols[f"sv_{c}"] = number(c)
    video_cols["sv_aspect_ratio"] = safe_ratio(number("server_height"), number("server_width"))

    u = users.select(F.col("user_id").cast("string").alias("_u"), *[c.alias(n) for n, c in user_cols.items()])
    v = videos.select(F.col("video_id").cast("string").alias("_v"), *[c.alias(n) for n, c in video_cols.items()])
    joined = df.join(u, F.col("user_id").cast("string") == F.col("_u"), "left").join(
        v, F.col("video_id").cast("string") == F.col("_v"), "left"
    )
    names = [*user_cols, *video_cols]
    categorical = [n for n in names if n.startswith("cat_")]
    out = joined.select(
        *(df.columns if append else KEYS),
        *[
            F.coalesce(F.col(n), F.lit("UNK")).alias(n) if n in categorical else F.col(n)
            for n in names
        ],
    )
    user_origin = Lineage(("user_side_table",), STATIC, SIDE_FILE)
    video_origin = Lineage(("video_side_table",), STATIC, SIDE_FILE)
    return tag(
        out, {n: user_origin if n in user_cols else video_origin for n in names}, categorical
    )


def merge_one_to_one(a: DataFrame, b: DataFrame, keys=KEYS, checked: bool = False) -> DataFrame:
    """Inner join of two frames that are unique on the keys (verified when ``checked``)."""
    keys = list(keys)
    if checked:
        require_unique(a, keys, "left side")
        require_unique(b, keys, "right side")
    return a.join(b, keys)


def merge_violations(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Keys that break a one-to-one merge, with the side and the number of copies.

    A task holds a bounded number of keys (see ``key_counts``).
    """
    keys = list(keys)
    left, right = (
        key_counts(df.select(*keys), keys).where("copies > 1").withColumn("side", F.lit(side))
        for df, side in ((a, "left"), (b, "right"))
    )
    return left.unionByName(right)


def reindex(built: DataFrame, target: DataFrame, keys=KEYS, checked: bool = True) -> DataFrame:
    """Exactly the target's rows, null where nothing was built; duplicate keys are refused."""
    keys = list(keys)
    if checked:
        require_unique(built, keys, "built frame")
    return target.select(*keys).join(built, keys, "left")


def drop_rejected(
    candidates: DataFrame, outcomes: DataFrame, key: str = "hypothesis_id", min_rows: int | None = None
) -> DataFrame:
    """Candidates whose id was never rejected."""
    refused = outcomes.where(~F.coalesce(F.col("accepted"), F.lit(False))).select(key).distinct()
    return join_groups(candidates, refused, [key], "left_anti", min_rows)


def unknown_names(requested: DataFrame, allowed: DataFrame, column: str = "name") -> DataFrame:
    """Requested names that are not allowed, once each."""
    return requested.select(column).distinct().join(allowed.select(column), column, "left_anti")


def forbidden_sources(
    lineage: DataFrame, forbidden: DataFrame, column: str = "source"
) -> DataFrame:
    """Lineage rows whose source is on the forbidden list."""
    return lineage.join(forbidden.select(column), column, "left_semi")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
