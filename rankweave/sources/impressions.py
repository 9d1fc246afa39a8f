"""Impression logs: reading, joining files, date splits, row numbers, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.keyed import key_counts
from ..plans.numbering import numbered
from ..schemas import LOG_SCHEMA, READY_SCHEMA, SPLITS, TRAIN_END, USER_SCHEMA, VIDEO_SCHEMA


def scan_csv(
    spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None
) -> DataFrame:
    """CSV with a header, read by column name under declared types; nothing is inferred.

    CSV schemas bind by position, so the header gives the order and files may hold more
    columns than the schema names. All files under one path share an order: each one's own
    header is compared with it when it is read, and a file that differs raises instead of being
    misread; such files are read as paths of their own. Only the asked columns are parsed; bad
    text raises.
    """
    wanted = columns or schema.fieldNames()
    header = spark.read.csv(path, header=True).columns
    missing = sorted(set(wanted) - set(header))
    if missing:
        raise ValueError(f"{path} has columns {header} but not {missing}")
    types = {field.name: field.dataType for field in schema.fields}
    full = StructType([StructField(name, types.get(name, StringType())) for name in header])
    read = spark.read.schema(full).options(header=True, mode="FAILFAST", enforceSchema=False)
    return read.csv(path).select(*wanted)


def union_logs(*logs: DataFrame) -> DataFrame:
    """UNION ALL of logs, matched by column name."""
    if not logs:
        raise ValueError("at least one log is required")
    return reduce(lambda a, b: a.unionByName(b), logs)


def split_of(date: Column, splits=SPLITS) -> Column:
    """Split name of an integer date; null outside every range."""
    named = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(splits.items())):
        named = F.when(date.between(low, high), F.lit(name)).otherwise(named)
    return named


def assign_split(df: DataFrame, splits=SPLITS, date: str = "date") -> DataFrame:
    """Adds ``split``. Rows outside all ranges go, by a range filter a scan can push down."""
    inside = reduce(
        lambda a, b: a | b, [F.col(date).between(low, high) for low, high in splits.values()]
    )
    return df.where(inside).withColumn("split", split_of(F.col(date), splits))


def add_row_id(
    df: DataFrame, order_cols: list[str], unique: bool = False, group: tuple[str, ...] = ("split",)
) -> DataFrame:
    """Dense ``row_id`` from 0 within each split, in the order of ``order_cols``.

    Spark has no file order, so the caller names one. Unless ``unique`` says that the order
    columns identify a row, remaining columns break ties and exact copies are counted first and
    numbered apart; copies are interchangeable. ``group`` holds no nulls.

    Rows are range-sorted and written once (see ``numbered``).
    """
    group = list(group)
    order = [c for c in order_cols if c not in group]
    rows = df
    if not unique:
        order = order + [c for c in df.columns if c not in order and c not in group] + ["_copy"]
        counted = key_counts(df, df.columns, "_copies")
        rows = counted.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    placed = numbered(rows, group, order, "row_id", df.columns)
    return placed.select("row_id", *[F.col(f"`{c}`") for c in df.columns])


def load_impressions(
    spark: SparkSession,
    paths: list[str],
    schema: StructType = LOG_SCHEMA,
    splits=SPLITS,
    columns: list[str] | None = None,
    order_cols: list[str] | None = None,
    unique: bool = False,
    source_log: str = "standard",
    max_date: int | None = None,
) -> DataFrame:
    """Reads log files, keeps the asked columns, assigns splits and numbers rows.

    A randomized-exposure log is admitted only up to ``max_date`` (the end of training by
    default). Row numbers are given when ``order_cols`` is.
    """
    logs = [scan_csv(spark, path, schema, columns) for path in paths]
    frame = admit(union_logs(*logs), source_log, max_date)
    frame = assign_split(frame, splits)
    return add_row_id(frame, order_cols, unique) if order_cols else frame


def load_log(
    spark: SparkSession,
    paths: list[str],
    videos: DataFrame,
    order_cols: list[str],
    splits=SPLITS,
    schema: StructType = READY_SCHEMA,
    columns: list[str] | None = None,
    details: tuple[str, ...] = ("author_id", "tab", "duration_ms"),
    check: DataFrame | None = None,
    check_columns: tuple[str, ...] = ("user_id", "video_id"),
    **source,
) -> DataFrame:
    """Logs ready for use: rows numbered within their split, with the columns of the video table.

    ``videos`` has one row per ``video_id``; those of the ``details`` that the logs lack are
    looked up in it, and the ``tag`` (misses: null, and ``UNK`` for the tag). With ``check``, another copy of the same rows, a row on which
    ``check_columns`` differ, or that one of them lacks, raises.
    """
    rows = load_impressions(spark, paths, schema, splits, columns, order_cols, **source)
    held = [c for c in details if c not in rows.columns and c in videos.columns]
    missing = sorted(set(details) - set(rows.columns) - set(held))
    if missing:
        raise ValueError(f"neither the logs nor the video table have {missing}")
    rows = lookup(rows, videos, "video_id", held, default=None, checked=True) if held else rows
    if "tag" in videos.columns and "tag" not in rows.columns:
        rows = lookup(rows, videos, "video_id", ["tag"])
    if check is not None:
        found = reconcile(rows, check, columns=check_columns).limit(3).collect()
        if found:
            raise ValueError(f"the two copies of the log differ, e.g. {[r.asDict() for r in found]}")
    return rows


def admit(
    df: DataFrame, source_log: str = "standard", max_date: int | None = None, date: str = "date"
) -> DataFrame:
    """Date gate of a log by its origin."""
    if source_log not in ("standard", "randomized"):
        raise ValueError(f"unknown source log {source_log!r}")
    if source_log == "randomized":
        return df.where(F.col(date) <= (TRAIN_END if max_date is None else max_date))
    return df if max_date is None else df.where(F.col(date) <= max_date)


def load_users(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, USER_SCHEMA)


def load_videos(spark: SparkSession, path: str, more: tuple[str, ...] = ("author_id",)) -> DataFrame:
    """The video side table, with ``more`` of its columns as text."""
    return scan_csv(spark, path, VIDEO_SCHEMA, [*more, *VIDEO_SCHEMA.fieldNames()])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    found = duplicate_keys(df, keys).limit(3).collect()
    if found:
        raise ValueError(f"{what} has duplicate keys, e.g. {[r.asDict() for r in found]}")


def lookup(
    df: DataFrame, dim: DataFrame, key: str, cols: list[str], default: str | None = "UNK",
    checked: bool = False,
) -> DataFrame:
    """Left lookup of ``cols`` by ``key``; misses and nulls become ``default``.

    The dimension must be unique on the key (checked when ``checked``). No broadcast is
    forced: Spark broadcasts it when its size is under the session limit.
    """
    if checked:
        require_unique(dim, [key], "lookup table")
    small = dim.select(F.col(key).cast("string").alias("_key"), *cols)
    joined = df.join(small, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")
    if default is None:
        return joined
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(default)) for c in cols})


def reconcile(
    a: DataFrame, b: DataFrame, keys=("split", "row_id"), columns=("user_id", "video_id")
) -> DataFrame:
    """Rows on which two copies of a log disagree, or that only one of them has."""
    keys, columns = list(keys), list(columns)
    left = a.select(*keys, *[F.col(c).cast("string").alias(f"{c}_a") for c in columns], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).cast("string").alias(f"{c}_b") for c in columns], F.lit(True).alias("in_b"))
    both = left.join(right, keys, "full_outer")
    differs = reduce(
        lambda x, y: x | y, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in columns]
    )
    problem = (
        F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("differs")
    )
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | differs).select(
        *keys, *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns], problem.alias("problem")
    )


def split_counts(df: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Rows per split; with ``expected``, also whether each count is as expected."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    if expected is None:
        return counts
    want = df.sparkSession.createDataFrame(list(expected.items()), "split string, expected long")
    return want.join(counts, "split", "full_outer").select(
        "split",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "expected",
        F.col("expected").eqNullSafe(F.coalesce("rows", F.lit(0))).alias("ok"),
    )
