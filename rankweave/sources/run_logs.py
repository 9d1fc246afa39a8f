"""Experiment logs kept as JSON lines with nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import RUN_LOG_SCHEMA


def load_run_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nested run-log records under the declared schema; no inference pass."""
    return spark.read.schema(RUN_LOG_SCHEMA).json(path)


def parse_run_log(df: DataFrame, column: str = "value") -> DataFrame:
    """The same records from a column of JSON text."""
    return df.select(F.from_json(F.col(column), RUN_LOG_SCHEMA).alias("r")).select("r.*")
