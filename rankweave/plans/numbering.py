"""Dense numbers of rows in an order, by one range sort that is written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

#: below the number of its part, a row's place has so many bits
PLACE_BITS = 33


def _named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns of ``rows`` by default) and ``name``, a row's number from 0 within its
    group in the order given. ``group`` holds no nulls, ``(group, order)`` is unique.

    Rows are range-sorted and written once, each with its place in its part. A part's rows of a
    group start where the parts before it end: one offset for each part and group it holds.
    """
    keys = _named([*group, *order])
    keep = rows.columns if keep is None else keep
    held = list(dict.fromkeys([*keep, *group]))
    place = F.monotonically_increasing_id().alias("_place")
    written = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*_named(held), place))
    written = written.withColumn("_part", F.shiftright("_place", PLACE_BITS))
    parts = written.groupBy(*_named(group), "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*_named(group)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    # one row a part and group
    offsets = F.broadcast(parts.select(*_named(group), "_part", shift.alias("_shift")))
    out = written.join(offsets, [*group, "_part"])
    return out.select(*_named(keep), (F.col("_place") + F.col("_shift")).alias(name))
