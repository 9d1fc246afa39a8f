"""Pieces that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

#: words are separated by these ASCII characters
ASCII_SPACE = "\\x20\\x09-\\x0D"


def text_key(text: Column, name: str = "key") -> list[Column]:
    """128 bits that stand for a text (null as empty): two hashes with independent seeds.

    Rows are tied together by what they say, not by an id that may be null or repeat.
    """
    whole = F.coalesce(text, F.lit(""))
    return [
        F.xxhash64(whole).alias(f"{name}1"),
        F.xxhash64(F.lit("second"), whole).alias(f"{name}2"),
    ]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of `column`; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        group = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // size
        starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield batch.slice(s, e - s)


def with_columns(
    batch: pa.RecordBatch, drop: tuple[str, ...], new: dict[str, pa.Array]
) -> pa.RecordBatch:
    """The batch without some columns and with new ones at the end."""
    kept = [(n, batch.column(n)) for n in batch.schema.names if n not in drop]
    both = [*kept, *new.items()]
    return pa.RecordBatch.from_arrays([c for _, c in both], names=[n for n, _ in both])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def sortable(df: DataFrame, name: str) -> Column:
    """A column to sort by: itself, or its JSON where its type has no order (maps, variants)."""

    def ordered(kind) -> bool:
        if isinstance(kind, ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return not isinstance(kind, (MapType, VariantType))

    column = F.col(f"`{name}`")
    return column if ordered(df.schema[name].dataType) else F.to_json(F.struct(column.alias("c")))
