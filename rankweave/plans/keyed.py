"""Counts by keys of any number, of which a task holds a bounded part.

A plain aggregate's exchange is read in parts by bytes, and keys of a few bytes take many times
that in a hash map. So the rows are counted first, by hashes of their keys, and dealt into as many
parts as they ask for. A bucket of hashes with more rows than a part should hold has a hot key (or
the chance neighbours of one): such rows take the plain aggregate, which combines them before the
exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: rows of a part
PART_ROWS = 1 << 19
HASHES = 1 << 16


def key_counts(df: DataFrame, keys: list[str], name: str = "copies", part_rows: int = PART_ROWS) -> DataFrame:
    """``keys`` and ``name``, the rows of each key. Runs one counting job now."""
    named = [F.col(f"`{k}`") for k in keys]
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), *named), F.lit(HASHES))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    large = F.filter("all", lambda b: b["_rows"] > part_rows)
    found = sizes.agg(
        F.sum("_rows").alias("rows"), F.collect_list(F.struct("_bucket", "_rows")).alias("all")
    ).select("rows", large.alias("large")).first()
    rows = found["rows"] or 0
    parts = max(1, -(-rows // part_rows))
    # of very many rows every bucket holds many
    hot = [b["_bucket"] for b in found["large"] if b["_rows"] > 8 * rows / HASHES]
    count = F.count(F.lit(1)).alias(name)
    if not hot:
        return df.repartition(parts, *named).groupBy(*named).agg(count)
    few = bucket.isin(hot)
    cold = df.where(~few).repartition(parts, *named).groupBy(*named).agg(count)
    return cold.unionByName(df.where(few).groupBy(*named).agg(count))


def distinct_rows(df: DataFrame) -> DataFrame:
    return key_counts(df, df.columns, "_copies").drop("_copies")
