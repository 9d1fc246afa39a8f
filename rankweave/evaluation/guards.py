"""Leakage guards: column lineage, label names, and a bound on plausible metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import RANDOMIZED, STRICTLY_EARLIER, lineage_table
from ..operators.joins import unknown_names
from ..schemas import AUXILIARY_ALLOWED, KEYS, PRIMARY_TRIPWIRE, SAME_ROW_OUTCOMES, TRAIN_END


class LeakageError(ValueError):
    def __init__(self, rejections: list[dict]):
        super().__init__("; ".join(r["reason"] for r in rejections))
        self.rejections = rejections


def lineage_rejections(
    lineage: DataFrame, forbidden=SAME_ROW_OUTCOMES, cutoff: int = TRAIN_END
) -> DataFrame:
    """Refused columns of a lineage table ``(feature, has_lineage, sources, scope,
    source_log, max_source_date)``, one row per broken rule.

    Outcomes may be used only from strictly earlier rows; randomized-exposure columns must
    prove a source date up to the cutoff. The forbidden list is a fixed handful of names.
    """
    names = F.array(*[F.lit(n) for n in forbidden])
    hits = F.array_sort(F.array_intersect(F.col("sources"), names))
    outcome = (F.size(hits) > 0) | F.col("feature").isin(*forbidden)
    found = F.filter(
        F.array(
            F.when(~F.col("has_lineage"), F.lit("missing_lineage")),
            F.when(
                F.col("has_lineage")
                & outcome
                & (F.coalesce(F.col("scope"), F.lit("")) != STRICTLY_EARLIER),
                F.lit("same_row_outcome"),
            ),
            F.when(
                F.col("has_lineage")
                & (F.coalesce(F.col("source_log"), F.lit("")) == RANDOMIZED)
                & (F.col("max_source_date").isNull() | (F.col("max_source_date") > cutoff)),
                F.lit("randomized_after_cutoff"),
            ),
        ),
        lambda rule: rule.isNotNull(),
    )
    return lineage.select(
        "feature",
        F.explode(found).alias("rule"),
        F.concat_ws(",", F.when(F.size(hits) > 0, hits).otherwise(F.array("feature"))).alias("sources"),
        "max_source_date",
    )


_REASONS = {
    "missing_lineage": "no lineage is declared",
    "same_row_outcome": "reads outcomes of its own row",
    "randomized_after_cutoff": "reads randomized rows past the cutoff",
}


def reason_of(rule, feature, sources, max_source_date):
    """What the guard saw: column, rule, and the values that broke it."""
    said = reduce(lambda c, r: F.when(rule == r, _REASONS[r]).otherwise(c), _REASONS, F.lit(None).cast("string"))
    seen = F.when(rule == "same_row_outcome", F.concat(F.lit(": "), sources)).when(
        rule == "randomized_after_cutoff",
        F.concat(F.lit(": last date "), F.coalesce(max_source_date.cast("string"), F.lit("unknown"))),
    )
    return F.concat(feature, F.lit(": "), said, F.coalesce(seen, F.lit("")))


def check_lineage(df: DataFrame, keys=KEYS, cutoff: int = TRAIN_END) -> DataFrame:
    """Rejections of a feature frame, from its schema; no data is scanned."""
    return lineage_rejections(lineage_table(df, keys), cutoff=cutoff)


def require_lineage(
    df: DataFrame, keys=KEYS, cutoff: int = TRAIN_END, log: str | None = None, node_id: str | None = None
) -> DataFrame:
    """The frame itself, or :class:`LeakageError`; with ``log``, recorded there first."""
    bad = check_lineage(df, keys, cutoff)
    found = [r.asDict() for r in _with_reason(bad).orderBy("feature").collect()]
    if found:
        if log:
            append_rejections(bad, log, node_id)
        raise LeakageError(found)
    return df


def _with_reason(found: DataFrame) -> DataFrame:
    if "rule" not in found.columns:
        return found
    made = reason_of(*[F.col(c) for c in ("rule", "feature", "sources", "max_source_date")])
    return found.withColumn("reason", made)


def check_auxiliary(requested: DataFrame, allowed=AUXILIARY_ALLOWED) -> DataFrame:
    """Requested auxiliary labels that are not allowed."""
    names = requested.sparkSession.createDataFrame([(n,) for n in allowed], "name string")
    return unknown_names(requested, names)


def require_auxiliary(targets: list[str], allowed=AUXILIARY_ALLOWED) -> list[str]:
    bad = sorted(set(targets) - set(allowed))
    if bad:
        raise LeakageError([{"reason": f"unsupported auxiliary targets: {bad}", "invalid": bad}])
    return list(targets)


def check_metrics(df: DataFrame, tripwire: float = PRIMARY_TRIPWIRE, split: str | None = "valid") -> DataFrame:
    """Metric rows too good to be honest."""
    kept = df.where(F.col("split") == split) if split else df
    return kept.where(F.col("primary") > tripwire)


def require_metrics(
    df: DataFrame, tripwire: float = PRIMARY_TRIPWIRE, log: str | None = None, node_id: str | None = None
) -> DataFrame:
    """The frame itself, or :class:`LeakageError` with the worst offenders; recorded first."""
    bad = check_metrics(df, tripwire)
    said = F.concat(F.lit("metric: primary "), F.round("primary", 6).cast("string"), F.lit(f" is over {tripwire}"))
    found = [r.asDict() for r in bad.withColumn("reason", said).orderBy(F.col("primary").desc()).limit(20).collect()]
    if found:
        if log:
            append_rejections(bad.withColumn("reason", said), log, node_id, "empirical")
        raise LeakageError(found)
    return df


def append_rejections(
    df: DataFrame, path: str, node_id: str | None = None, layer: str = "static"
) -> None:
    """Appends rejection records to a JSON-lines log: time, event, layer, node, reason, the
    feature if there is one, and the other columns as details."""
    rows = df if "reason" in df.columns else _with_reason(df)
    details = [c for c in rows.columns if c not in ("reason", "feature")]
    rows.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
        F.lit("leakage_rejection").alias("event"),
        F.lit(layer).alias("layer"),
        F.lit(node_id).alias("node_id"),
        *[c for c in ("reason", "feature") if c in rows.columns],
        F.struct(*details).alias("details"),
    ).write.mode("append").json(path)
