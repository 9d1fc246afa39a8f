"""Column lineage kept in schema metadata.

Metadata survives select, alias and join but not expressions, so every operator attaches
it to its finished columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

SAME_ROW = "same_row"
STRICTLY_EARLIER = "strictly_earlier"
STATIC = "static"
SCOPES = (SAME_ROW, STRICTLY_EARLIER, STATIC)
STANDARD = "standard"
RANDOMIZED = "randomized"
SIDE_FILE = "side_file"
SOURCE_LOGS = (STANDARD, RANDOMIZED, SIDE_FILE)


@dataclass(frozen=True)
class Lineage:
    sources: tuple[str, ...]
    scope: str
    source_log: str = STANDARD
    max_source_date: int | None = None

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ValueError(f"unknown temporal scope {self.scope!r}")
        if self.source_log not in SOURCE_LOGS:
            raise ValueError(f"unknown source log {self.source_log!r}")


def tag(df: DataFrame, lineage: dict[str, Lineage], categorical=()) -> DataFrame:
    """Attaches lineage (and the categorical flag) to finished columns."""

    def column(name):
        if name not in lineage:
            return F.col(f"`{name}`")
        origin = lineage[name]
        return F.col(f"`{name}`").alias(
            name,
            metadata={
                "lineage": json.dumps(
                    {
                        "sources": sorted(origin.sources),
                        "scope": origin.scope,
                        "source_log": origin.source_log,
                        "max_source_date": origin.max_source_date,
                    }
                ),
                "categorical": name in categorical,
            },
        )

    return df.select(*[column(name) for name in df.columns])


def feature_columns(df: DataFrame, keys=("split", "row_id")) -> list[str]:
    return [name for name in df.columns if name not in keys]


def is_categorical(df: DataFrame, name: str) -> bool:
    """By flag where an operator set one, else by the ``cat_`` prefix."""
    flag = df.schema[name].metadata.get("categorical")
    return name.startswith("cat_") if flag is None else bool(flag)


def lineage_table(df: DataFrame, keys=("split", "row_id")) -> DataFrame:
    """One row per feature column, read from the schema alone."""
    rows = []
    for name in feature_columns(df, keys):
        text = df.schema[name].metadata.get("lineage")
        found = json.loads(text) if text else {}
        rows.append(
            (
                name,
                bool(text),
                found.get("sources", []),
                found.get("scope"),
                found.get("source_log"),
                found.get("max_source_date"),
            )
        )
    return df.sparkSession.createDataFrame(
        rows,
        "feature string, has_lineage boolean, sources array<string>, scope string,"
        " source_log string, max_source_date int",
    )
