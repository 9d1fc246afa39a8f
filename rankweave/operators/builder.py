"""User-written feature builders under the causal contract."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..evaluation.guards import require_lineage
from ..functions.lineage import STANDARD, STRICTLY_EARLIER, Lineage, feature_columns, tag
from ..schemas import KEYS
from ..session import work_path
from .history import _attach, check_alignment, daily_counts
from .joins import reindex


@dataclass(frozen=True)
class BuildContext:
    """What a builder may know besides its rows."""

    params: dict = field(default_factory=dict)
    date_column: str = "date"
    label_column: str = "long_view"


def _with_context(build, context: BuildContext):
    """The builder itself, or, if it takes a third argument, with the context in it."""
    taken = [p for p in inspect.signature(build).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    return (lambda past, rows: build(past, rows, context)) if len(taken) > 2 else build


def _require_frame(built) -> None:
    if not isinstance(built, DataFrame):
        raise TypeError(f"a builder must return a Spark DataFrame, not {type(built).__name__}")


def _contract(built, target: DataFrame, strict: bool) -> None:
    """Refuses a result that is no DataFrame, lacks the keys, or has other rows than asked."""
    _require_frame(built)
    missing = [k for k in KEYS if k not in built.columns]
    if missing:
        raise ValueError(f"builder result lacks {missing}")
    if not feature_columns(built):
        raise ValueError("builder result has no feature column")
    found = check_alignment(built, target)
    if not strict:
        found = found.where(~F.col("problem").isin("missing", "dropped"))
    bad = found.limit(3).collect()
    if bad:
        raise ValueError(f"builder broke row alignment: {[r.asDict() for r in bad]}")


def apply_builder(
    history: DataFrame,
    target: DataFrame,
    build,
    scope: str,
    sources,
    source_log: str = STANDARD,
    max_source_date: int | None = None,
    categorical=(),
    checked: bool = True,
    context: BuildContext = BuildContext(),
) -> DataFrame:
    """Runs ``build(history, target[, context]) -> DataFrame`` and ships its columns under lineage.

    With a strictly-earlier scope it is called once per target date and sees only history
    before that date, whatever it does; rows it leaves out become null. History and target are
    written once in a folder a day: a call reads the days before its own and its own rows, and its
    result is written, so calls do not stack in one plan. Pass history already reduced to days
    (:func:`~rankweave.operators.history.daily_counts`) when the builder can work from that.
    Other scopes get one call on everything and must return every row.
    """
    date, build = context.date_column, _with_context(build, context)
    if scope == STRICTLY_EARLIER:
        days = sorted(r[0] for r in target.select(date).distinct().collect())
        past, asked = _by_day(history, date), _by_day(target, date)
        path = work_path(target.sparkSession, "built")
        for day in days:
            own = build(past.where(F.col("_folder") < day).drop("_folder"), asked.where(F.col("_folder") == day).drop("_folder"))
            _require_frame(own)
            own.write.mode("append").parquet(path)
        built = target.sparkSession.read.parquet(path) if days else build(history, target)
        if checked:
            _contract(built, target, strict=False)
        built = reindex(built, target, checked=False)
    else:
        built = build(history, target)
        if checked:
            _contract(built, target, strict=True)
    return _ship(built, scope, sources, source_log, max_source_date, categorical)


def _by_day(df: DataFrame, date: str) -> DataFrame:
    """The rows written in a folder a day, by which a filter on ``_folder`` prunes; the columns as
    they were, lineage included."""
    path = work_path(df.sparkSession, "by_day")
    df.withColumn("_folder", F.col(date)).write.partitionBy("_folder").parquet(path)
    schema = StructType([*df.schema.fields, StructField("_folder", df.schema[date].dataType)])
    return df.sparkSession.read.schema(schema).parquet(path)


def apply_keyed_builder(
    history: DataFrame,
    target: DataFrame,
    build,
    keys: list[str],
    schema: StructType | str,
    sources,
    source_log: str = STANDARD,
    max_source_date: int | None = None,
    categorical=(),
    measures: dict[str, Column] | None = None,
    context: BuildContext = BuildContext(),
) -> DataFrame:
    """A pandas builder that works key by key.

    ``build(past, day[, context]) -> dict`` gets the key's strictly earlier days and the asked
    day, and returns the feature values named in ``schema``. A day has the counts of
    :func:`~rankweave.operators.history.daily_counts` and the ``measures``, aggregates of any
    columns of history (``{"watched": F.sum("play_time_ms")}``). History and questions are
    both reduced to one row per key and day, then to one row per key, so a key never holds more
    rows than there are days. A task takes a batch of keys at a time, and each call gets a copy of
    the days before its own. The answers are joined back to the rows.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    date, build = context.date_column, _with_context(build, context)
    days = daily_counts(history, keys, context.label_column, date, measures)
    asked = target.select(*keys, date).distinct()
    names = fields.fieldNames()
    out = StructType([f for f in asked.schema.fields] + list(fields.fields))
    kinds = target.sparkSession.createDataFrame([], out).toArrow().schema
    named = lambda columns: [F.col(f"`{c}`") for c in columns]
    past = F.struct(*named(days.columns)).alias("_past")
    both = days.select(*named(keys), past).unionByName(
        asked.select(*named(keys), F.col(date).alias("_want")), allowMissingColumns=True
    )
    # few bytes but many calls: the full shuffle width, which adaptive execution would shrink by bytes
    width = int(target.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # collect_list leaves out the nulls of the other side
    by_key = both.repartition(width, *named(keys)).groupBy(*named(keys)).agg(F.collect_list("_past").alias("_past"), F.collect_list("_want").alias("_want"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                yield _answers(batch, build, keys, date, names, kinds)

    state = by_key.where(F.size("_want") > 0).mapInArrow(work, out)
    built = _attach(target, state, [*keys, date], names, date).select(*KEYS, *names)
    return _ship(built, STRICTLY_EARLIER, sources, source_log, max_source_date, categorical)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists, and the number of the list that each is from."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _answers(batch: pa.RecordBatch, build, keys: list[str], date: str, names: list[str], kinds: pa.Schema) -> pa.RecordBatch:
    """What ``build`` says for every asked day of a batch of keys with their days."""
    days, owner = _flat(batch.column("_past"))
    frame = pa.Table.from_arrays(days.flatten(), names=[f.name for f in days.type]).to_pandas()
    order = np.lexsort((frame[date].to_numpy(), owner))
    frame, owner = frame.iloc[order], owner[order]
    dates, start = frame[date].to_numpy(), np.searchsorted(owner, np.arange(batch.num_rows + 1))
    want, asker = _flat(batch.column("_want"))
    found = {n: [] for n in names}
    for key, day in zip(asker.tolist(), want.to_pylist()):
        low, high = start[key], start[key + 1]
        # a copy: nothing of it leads to later days
        said = build(frame.iloc[low : low + np.searchsorted(dates[low:high], day)].copy(), day)
        for n in names:
            found[n].append(said.get(n))
    taken = pa.array(asker)
    columns = [want if f.name == date else batch.column(f.name).take(taken) for f in kinds if f.name in (date, *keys)]
    columns += [pa.Array.from_pandas(pd.Series(found[n]), type=kinds.field(n).type) for n in names]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)


def _ship(built, scope, sources, source_log, max_source_date, categorical) -> DataFrame:
    origin = Lineage(tuple(str(s) for s in sources), scope, source_log, max_source_date)
    names = feature_columns(built)
    out = built.select(*KEYS, *[F.col(f"`{n}`") for n in names])
    return require_lineage(tag(out, {n: origin for n in names}, tuple(categorical)))
