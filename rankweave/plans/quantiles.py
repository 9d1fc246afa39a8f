"""Exact quantiles of any number of columns without gathering their values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from .ordering import prefix_totals


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles, one row ``(field, prob, value)`` each; nulls are skipped.

    Distinct values are counted map-side, placed by running totals over value ranges, and
    only the order statistics asked for are kept. (``percentile`` would gather every
    distinct value of a column in one task.)
    """
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("field"), F.col(name).cast("double").alias("value"))
                    for name in columns
                ]
            )
        ).alias("c")
    ).select("c.field", "c.value").where(F.col("value").isNotNull())
    counted = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_totals(counted, ["field"], ["value"], ["n"], sample_from=long)
    totals = counted.groupBy("field").agg(F.sum("n").alias("total"))
    asked = F.array(*[F.lit(float(q)) for q in probs])
    wanted = F.transform(
        asked,
        lambda q: F.struct(
            q.alias("prob"),
            (q * (F.col("total") - 1)).alias("at"),
        ),
    )
    # a compiled test first: almost no row holds an order statistic that is asked for
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in probs]
    holds_any = reduce(
        or_,
        [
            (F.ceil(x) >= F.col("n_before")) & (F.floor(x) < F.col("n_before") + F.col("n"))
            for x in at
        ],
    )
    # totals has one row per column asked for
    located = (
        placed.join(F.broadcast(totals), "field")
        .where(holds_any)
        .withColumn(
            "hit",
            F.explode(
                F.filter(
                    wanted,
                    lambda h: (F.ceil(h["at"]) >= F.col("n_before"))
                    & (F.floor(h["at"]) < F.col("n_before") + F.col("n")),
                )
            ),
        )
        .select("field", "value", "n_before", "n", "hit.prob", "hit.at")
    )
    holds = lambda place: (place >= F.col("n_before")) & (place < F.col("n_before") + F.col("n"))
    ends = located.groupBy("field", "prob").agg(
        F.max(F.when(holds(F.floor("at")), F.col("value"))).alias("lo"),
        F.max(F.when(holds(F.ceil("at")), F.col("value"))).alias("hi"),
        F.max(F.col("at") - F.floor("at")).alias("part"),
    )
    return ends.select(
        "field", "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value")
    )


def fit_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], accuracy: int | None = None
) -> dict[str, list[float]]:
    """Fitted quantiles on the driver (one number per column and probability).

    ``accuracy`` switches to the sketch-based ``percentile_approx``.
    """
    if accuracy:
        row = df.agg(
            *[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in columns]
        ).first()
        return {c: list(row[c] or []) for c in columns}
    out: dict[str, list[float]] = {c: [] for c in columns}
    for row in sorted(quantiles(df, columns, probs).collect(), key=lambda r: (r["field"], r["prob"])):
        out[row["field"]].append(row["value"])
    return out


def interior(n: int) -> list[float]:
    """Interior points of ``n`` equal probability steps."""
    return [i / n for i in range(1, n)]
