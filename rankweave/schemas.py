"""Fixed names, date ranges and schemas of the impression logs."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: date splits (inclusive, YYYYMMDD) ---
SPLITS = {
    "train": (20220408, 20220421),
    "valid": (20220422, 20220428),
    "test": (20220429, 20220508),
}
TRAIN_START = 20220408
TRAIN_END = 20220421

# --- fixed values: outcome names ---
AUXILIARY_LABELS = (
    "is_click",
    "is_like",
    "is_follow",
    "is_comment",
    "is_forward",
    "is_hate",
    "is_profile_enter",
)
SAME_ROW_OUTCOMES = (
    "click",
    "is_click",
    "is_like",
    "is_follow",
    "is_comment",
    "is_forward",
    "is_hate",
    "long_view",
    "play_time",
    "play_time_ms",
    "profile_stay_time",
    "comment_stay_time",
    "is_profile_enter",
)
AUXILIARY_ALLOWED = tuple(name for name in SAME_ROW_OUTCOMES if name != "long_view")

# --- fixed values: side-table columns ---
USER_CATEGORICAL = (
    "user_active_degree",
    "follow_user_num_range",
    "fans_user_num_range",
    "friend_user_num_range",
    "register_days_range",
    *(f"onehot_feat{i}" for i in range(18)),
)
USER_NUMERIC = (
    "is_live_streamer",
    "is_video_author",
    "follow_user_num",
    "fans_user_num",
    "friend_user_num",
    "register_days",
)
USER_LOG_NUMERIC = ("follow_user_num", "fans_user_num", "friend_user_num", "register_days")
VIDEO_CATEGORICAL = ("video_type", "upload_type", "music_type", "upload_dt")
VIDEO_NUMERIC = ("server_width", "server_height", "video_duration")

# --- fixed values: feature and decision constants ---
HINGE_MS = 18_000
DURATION_BANDS_S = (7.0, 12.0, 18.0, 30.0, 60.0)
USER_ATTRIBUTES = ("duration_bucket", "duration_regime", "tab", "tag", "author_id")
DECAY_ATTRIBUTES = ("author_id", "tag", "tab", "duration_regime", "duration_bucket", "video_id")
SEED_STD = 0.0008
ACCEPT_DELTA = 2 * SEED_STD
CONFIRM_SEEDS = (11, 29, 47)
PRIMARY_TRIPWIRE = 0.80
GAIN_EPS = 1e-5
BASELINE_VALID = {"gauc": 0.6674, "ndcg5": 0.5357, "primary": 0.6016}

KEYS = ("split", "row_id")


def _fields(names, dtype):
    return [T.StructField(name, dtype, True) for name in names]


LOG_SCHEMA = T.StructType(
    [
        T.StructField("date", T.IntegerType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("hourmin", T.IntegerType()),
        T.StructField("time_ms", T.LongType()),
        *_fields(AUXILIARY_LABELS, T.IntegerType()),
        T.StructField("long_view", T.IntegerType()),
        T.StructField("play_time_ms", T.LongType()),
        T.StructField("profile_stay_time", T.LongType()),
        T.StructField("comment_stay_time", T.LongType()),
    ]
)

#: a log with the exposure's tab and the video's length beside the outcomes
READY_SCHEMA = T.StructType(
    [*LOG_SCHEMA.fields, T.StructField("tab", T.StringType()), T.StructField("duration_ms", T.LongType())]
)

USER_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        *_fields(USER_CATEGORICAL, T.StringType()),
        *_fields(USER_NUMERIC, T.StringType()),
    ]
)

VIDEO_SCHEMA = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        *_fields(VIDEO_CATEGORICAL, T.StringType()),
        *_fields(VIDEO_NUMERIC, T.StringType()),
        T.StructField("tag", T.StringType()),
    ]
)

SUBMISSION_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)

_METRICS = T.StructType(
    [
        T.StructField("gauc", T.DoubleType()),
        T.StructField("ndcg5", T.DoubleType()),
        T.StructField("primary", T.DoubleType()),
    ]
)
_ABLATION = T.StructType(
    [
        T.StructField("score_without", T.DoubleType()),
        T.StructField("removal_cost", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("outer_iteration", T.IntegerType()),
        T.StructField("inner_attempt", T.IntegerType()),
        T.StructField("focus_target", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField(
            "hypothesis",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("target_node", T.StringType()),
                    T.StructField("expected_delta", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("proposal_rejections", T.ArrayType(T.StringType())),
        T.StructField("proposal_attempts", T.IntegerType()),
        T.StructField("ablation_table", T.MapType(T.StringType(), _ABLATION)),
        T.StructField("metrics", _METRICS),
        T.StructField("delta_vs_incumbent", T.DoubleType()),
        T.StructField("executed", T.BooleanType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField(
            "recovery_events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("event", T.StringType()),
                        T.StructField("node_id", T.StringType()),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("wall_clock_s", T.DoubleType()),
        T.StructField(
            "tokens",
            T.StructType(
                [T.StructField("in", T.LongType()), T.StructField("out", T.LongType())]
            ),
        ),
    ]
)
