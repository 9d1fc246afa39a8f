"""Vectors as whole numbers, and exact arithmetic on them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: components are held between -LIMIT and LIMIT, so that squared distances fit 64 bits
LIMIT = 1 << 27


def is_sound(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    held = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), held), F.lit(False))


def to_grid(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; beyond `LIMIT` it is `LIMIT`."""
    bounded = lambda x: F.least(F.greatest(x * float(scale), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(bounded(x)).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def digest(numbers) -> str:
    """The lowercase digest of whole numbers in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(n)) for n in numbers).encode()).hexdigest()
