"""Ranked submissions and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import INF
from ..schemas import SUBMISSION_SCHEMA

HEADER = ("row_id", "user_id", "video_id", "score")


def score_text(score):
    """Shortest of 12 significant digits, like C's ``%.12g``.

    Twelve significant digits are 11 decimals in scientific form; trailing zeros go. Plain
    notation is used for exponents from -5 to 11, scientific outside.
    """
    sci = F.format_string("%.11e", score)
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(.*)e", 1), r"\.?0+$", "")
    power = F.regexp_extract(sci, r"e(.*)$", 1).cast("int")
    plain = F.when(power == -4, F.format_string("%.15f", score))
    for e in range(-3, 12):
        plain = plain.when(power == e, F.format_string(f"%.{11 - e}f", score))
    trimmed = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(score == 0, F.lit("0")).when(
        power.between(-4, 11), trimmed
    ).otherwise(
        F.concat(
            mantissa,
            F.when(power < 0, "e-").otherwise("e+"),
            F.lpad(F.abs(power).cast("string"), 2, "0"),
        )
    )


def write_submission(
    pred: DataFrame, impressions: DataFrame, path: str, split: str = "test",
    filename: str = "submission.csv",
) -> str:
    """Writes the split as a CSV folder sorted by ``row_id`` (range-partitioned parts, in
    order) after checking that every row has one finite score. Returns its path."""
    if "/" in filename or "\\" in filename or filename in ("", ".", ".."):
        raise ValueError(f"{filename!r} is a path; the file is named without folders and lies in {path!r}")
    if split not in ("valid", "test"):
        raise ValueError(f"rows of split {split!r} are not ranked for submission, only those of valid and test")
    wanted = impressions.where(F.col("split") == split).select(
        F.col("row_id").cast("long").alias("row_id"), "user_id", "video_id", F.lit(True).alias("_want")
    )
    scored = pred.where(F.col("split") == split).groupBy("row_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col("score").cast("double")).alias("_s"),
    )
    both = wanted.join(scored, "row_id", "full_outer").persist()
    try:
        bad = F.col("_want").isNull() | F.col("_n").isNull() | (F.col("_n") != 1) | _not_finite(F.col("_s"))
        if both.where(bad).limit(1).collect():
            raise ValueError(f"scores of split {split!r} do not cover its impressions one by one with finite numbers")
        out = f"{path.rstrip('/')}/{filename}"
        ranked = both.select("row_id", "user_id", "video_id", score_text(F.col("_s")).alias("score"))
        ranked.orderBy("row_id").write.mode("overwrite").csv(out, header=True)
    finally:
        both.unpersist()
    return out


def _not_finite(score):
    value = score.cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == INF)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.csv(path, header=True).columns
    if tuple(header) != HEADER:
        raise ValueError(f"submission header must be {','.join(HEADER)}")
    return spark.read.schema(SUBMISSION_SCHEMA).csv(path, header=True)


def validate_submission(sub: DataFrame, impressions: DataFrame, split: str = "test") -> DataFrame:
    """Violations ``(row_id, problem)``; ``row_id`` is null for findings on the whole file."""
    missing = set(HEADER) - set(sub.columns)
    if missing:
        raise ValueError(f"submission lacks columns {sorted(missing)}")
    want = impressions.where(F.col("split") == split).select(
        F.col("row_id").cast("long").alias("row_id"),
        F.col("user_id").cast("string").alias("_u"),
        F.col("video_id").cast("string").alias("_v"),
        F.lit(True).alias("_want"),
    )
    got = sub.select(
        "row_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("video_id").cast("string").alias("video_id"),
        F.col("score").try_cast("double").alias("_s"),
        F.col("score").alias("_text"),
        F.lit(True).alias("_got"),
    )
    both = got.join(want, "row_id", "full_outer")
    problems = F.filter(
        F.array(
            F.when(F.col("_got").isNull(), F.lit("missing_row")),
            F.when(F.col("_want").isNull(), F.lit("unknown_row")),
            F.when(F.col("_want") & F.col("_got") & ~F.col("user_id").eqNullSafe(F.col("_u")), F.lit("user_differs")),
            F.when(F.col("_want") & F.col("_got") & ~F.col("video_id").eqNullSafe(F.col("_v")), F.lit("video_differs")),
            F.when(F.col("_got") & F.col("_s").isNull(), F.lit("not_a_number")),
            F.when(F.isnan("_s") | (F.abs(F.col("_s")) == INF), F.lit("not_finite")),
        ),
        lambda p: p.isNotNull(),
    )
    by_row = both.select("row_id", F.explode(problems).alias("problem"))
    repeated = sub.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "row_id", F.lit("repeated_row").alias("problem")
    )
    shape = sub.agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high")
    ).where((F.col("n") > 0) & ((F.col("low") != 0) | (F.col("high") != F.col("n") - 1))).select(
        F.lit(None).cast("long").alias("row_id"), F.lit("not_contiguous").alias("problem")
    )
    return by_row.unionByName(repeated).unionByName(shape)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric or summary rows as JSON lines."""
    df.write.mode("overwrite").json(path)
