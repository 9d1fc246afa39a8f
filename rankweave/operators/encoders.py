"""Train-fitted encoders. Fitted state that grows with the data (vocabularies) stays a
DataFrame; only edges, medians and field sizes come to the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import feature_columns, is_categorical
from ..functions.scalars import bucketize, to_numeric
from ..plans.numbering import numbered
from ..plans.quantiles import fit_quantiles, interior, quantiles
from ..schemas import KEYS
from ..session import cut_lineage


def quantile_edges(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Interior quantile edges of the train split, one row per edge."""
    train = df.where(F.col("split") == "train")
    return quantiles(train, [column], interior(n))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("UNK"))


def fit_vocab(train: DataFrame, columns: list[str], order: str = "row_id") -> DataFrame:
    """Values of each field numbered from 0 by first appearance: ``(field, value, code)``."""
    long = train.select(
        F.col(order).alias("_at"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), _text(c).alias("value")) for c in columns])
        ).alias("c"),
    ).select("_at", "c.field", "c.value")
    # one row of train opens at most one value of a field, so (field, first_row) is unique
    first = long.groupBy("field", "value").agg(F.min("_at").alias("first_row"))
    return numbered(first, ["field"], ["first_row"], "code", ["field", "value"])


def vocab_sizes(vocab: DataFrame) -> dict[str, int]:
    return {r["field"]: r["n"] for r in vocab.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}


def encode(
    df: DataFrame, vocab: DataFrame, columns: list[str], unknown: str = "first",
    sizes: dict[str, int] | None = None,
) -> DataFrame:
    """Adds ``{column}_code``.

    ``first``: unseen is 0 and codes start at 1; ``last``: unseen is the vocabulary size.
    One lookup per field; Spark broadcasts the fields that are small enough.
    """
    if unknown not in ("first", "last"):
        raise ValueError("unknown must be first or last")
    if unknown == "last" and sizes is None:
        sizes = vocab_sizes(vocab)
    for name in columns:
        words = vocab.where(F.col("field") == name).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        df = df.join(words, _text(name) == F.col("_value"), "left")
        code = (
            F.coalesce(F.col("_code") + 1, F.lit(0))
            if unknown == "first"
            else F.coalesce(F.col("_code"), F.lit((sizes or {}).get(name, 0)))
        )
        df = df.withColumn(f"{name}_code", code.cast("long")).drop("_value", "_code")
    return df


def field_offsets(sizes: list[tuple[str, int]]) -> dict[str, int]:
    """Start of each field in one shared id space, in field order."""
    out, at = {}, 0
    for name, size in sizes:
        out[name] = at
        at += size
    return out


def fit_median(train: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, float]:
    """Medians of usable values; 0 for a column without any."""
    clean = train.select(*[to_numeric(F.col(c)).alias(c) for c in columns])
    found = fit_quantiles(clean, columns, [0.5], accuracy)
    return {c: (found[c][0] if found[c] else 0.0) for c in columns}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(to_numeric(F.col(c)), F.lit(float(m))) for c, m in medians.items()}
    )


def merge_features(*bundles: DataFrame, check_rows: bool = False) -> DataFrame:
    """Inner join of feature frames on ``(split, row_id)``; names may not clash.

    All sides hash on the same key, so a chain needs one exchange per bundle. Operators with
    ``append=True`` avoid the joins altogether. ``check_rows`` also compares the key sets.
    """
    if not bundles:
        raise ValueError("there is no feature frame to merge")
    seen: set[str] = set()
    for bundle in bundles:
        names = feature_columns(bundle)
        clash = sorted(seen.intersection(names))
        if clash:
            raise ValueError(f"two of {len(bundles)} frames bring the columns {clash}")
        seen.update(names)
    if check_rows:
        from .history import check_alignment

        for bundle in bundles[1:]:
            if check_alignment(bundle, bundles[0]).limit(1).collect():
                raise ValueError(f"the frame of {feature_columns(bundle)} has other rows than the first one")
    return reduce(lambda a, b: a.join(b, list(KEYS)), bundles)


@dataclass
class DensePrep:
    """Fitted dense preparation: codes for categoricals, imputed numerics, one vector.

    Code columns are declared as categories, so that tree models split them as sets. Fields in
    ``rates`` stand for their value's smoothed train label rate instead: for two classes, sets
    of categories are best cut along that order.
    """

    categorical: list[str]
    numeric: list[str]
    vocab: DataFrame | None
    medians: dict[str, float]
    dims: dict[str, int] = field(default_factory=dict)
    rates: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        kept = df.columns
        out = impute(df, self.medians)
        if self.categorical:
            out = encode(out, self.vocab, self.categorical, "first")
        inputs = []
        for name in self.categorical:
            if name in self.rates:
                table, prior = self.rates[name]
                out = out.join(table, out[name].cast("string") == table["_value"], "left").drop("_value")
                out = out.withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(prior)))
                inputs.append(f"{name}_rate")
            else:
                meta = {"ml_attr": {"type": "nominal", "num_vals": self.dims[name]}}
                code = f"{name}_code"
                out = out.withColumn(code, F.col(code).cast("double")).withMetadata(code, meta)
                inputs.append(code)
        return (
            VectorAssembler(inputCols=inputs + self.numeric, outputCol=output)
            .transform(out)
            .select(*[c for c in kept if c not in self.numeric], *self.numeric, output)
        )

    @property
    def largest(self) -> int:
        """The most categories of a field that is split as sets."""
        return max([n for c, n in self.dims.items() if c not in self.rates], default=0)

    def release(self) -> None:
        if self.vocab is not None:
            self.vocab.unpersist()


def label_rates(
    train: DataFrame, name: str, label: str = "long_view", smoothing: float = 10.0
) -> tuple[DataFrame, float]:
    """``(value, smoothed label rate)`` of a field's values, and the overall rate."""
    overall = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    table = train.groupBy(F.col(name).cast("string").alias("_value")).agg(
        ((F.sum(F.col(label).cast("double")) + smoothing * overall) / (F.count(F.lit(1)) + smoothing)).alias(
            f"{name}_rate"
        )
    )
    return table.where("_value IS NOT NULL"), float(overall)


def split_kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    categorical = [c for c in features if is_categorical(df, c)]
    return categorical, [c for c in features if c not in categorical]


def fit_dense(
    df: DataFrame,
    features: list[str],
    accuracy: int | None = None,
    rate_label: str | None = None,
    most_sets: int = 64,
) -> DensePrep:
    """Fits vocabularies and medians on the train rows of ``df``.

    With ``rate_label``, fields of more than ``most_sets`` values are ordered by that label's
    train rate instead of split as sets.
    """
    if not features:
        raise ValueError(f"no feature column was named; the frame has {df.columns}")
    train = df.where(F.col("split") == "train")
    categorical, numeric = split_kinds(df, features)
    vocab = fit_vocab(train, categorical).persist() if categorical else None
    dims = {c: n + 1 for c, n in vocab_sizes(vocab).items()} if categorical else {}
    medians = fit_median(train, numeric, accuracy) if numeric else {}
    wide = [c for c in categorical if rate_label and dims[c] > most_sets]
    rates = {c: label_rates(train, c, rate_label) for c in wide}
    return DensePrep(categorical, numeric, vocab, medians, dims, rates)


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    return fit_dense(df, features).transform(df, output)


@dataclass
class SparseEncoder:
    """Fitted one-hot ids: one id per field in a shared id space of ``dimension`` ids.

    With ``hashed`` set, a categorical value takes one of that many hashed slots of its field,
    so the model size stays bounded whatever the vocabulary.
    """

    fields: list[str]
    categorical: list[str]
    vocab: DataFrame | None
    sizes: dict[str, int]
    medians: dict[str, float]
    edges: dict[str, list[float]]
    widths: dict[str, int]
    offsets: dict[str, int]
    dimension: int
    hashed: int | None = None

    def transform(self, df: DataFrame, output: str = "ids") -> DataFrame:
        kept = df.columns
        ids, out = {}, df
        if self.categorical and not self.hashed:
            out = encode(out, self.vocab, self.categorical, "last", self.sizes)
        for name in self.fields:
            start = F.lit(self.offsets[name])
            if name not in self.categorical:
                value = F.coalesce(to_numeric(F.col(name)), F.lit(self.medians[name]))
                code = bucketize(value, self.edges[name], side="right")
            elif self.hashed:
                code = F.pmod(F.xxhash64(F.lit(name), _text(name)), F.lit(self.hashed))
            else:
                code = F.col(f"{name}_code")
            ids[name] = (start + code).cast("int")
        return out.select(*kept, F.array(*[ids[n] for n in self.fields]).alias(output))

    def one_hot(self, df: DataFrame, ids: str = "ids", output: str = "features") -> DataFrame:
        """Sparse 0/1 vectors of the ids.

        Field sizes are declared in column metadata, so the stock encoder needs no fitting
        pass and everything stays in the JVM.
        """
        codes = [f"_code{i}" for i in range(len(self.fields))]
        hots = [f"_hot{i}" for i in range(len(self.fields))]
        out = df
        for i, name in enumerate(self.fields):
            code = (F.element_at(ids, i + 1) - F.lit(self.offsets[name])).cast("double")
            out = out.withColumn(codes[i], code).withMetadata(
                codes[i], {"ml_attr": {"type": "nominal", "num_vals": self.widths[name]}}
            )
        hot = OneHotEncoder(inputCols=codes, outputCols=hots, dropLast=False).fit(out)
        return (
            VectorAssembler(inputCols=hots, outputCol=output)
            .transform(hot.transform(out))
            .select(*df.columns, output)
        )


def _fit_numeric(train, numeric, bins, accuracy):
    """Medians, and edges of the median-filled values. Columns without gaps need one pass."""
    clean = train.select(*[to_numeric(F.col(c)).alias(c) for c in numeric])
    gaps = clean.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
    probs = sorted({0.5, *interior(bins)})
    found = fit_quantiles(clean, numeric, probs, accuracy)
    half = probs.index(0.5)
    medians = {c: (found[c][half] if found[c] else 0.0) for c in numeric}
    partial = [c for c in numeric if gaps[c]]
    if partial:
        filled = impute(clean.select(*partial), {c: medians[c] for c in partial})
        found.update(fit_quantiles(filled, partial, probs, accuracy))
    inner = set(interior(bins))
    return medians, {
        c: sorted({v for q, v in zip(probs, found[c]) if q in inner}) for c in numeric
    }


def fit_sparse(
    df: DataFrame,
    features: list[str],
    numeric_bins: int = 32,
    hashed: int | None = None,
    accuracy: int | None = None,
) -> SparseEncoder:
    """Fits the factorization-machine encoding on the train rows of ``df``."""
    if numeric_bins < 2:
        raise ValueError(f"{numeric_bins} numeric bins tell no values apart; two or more do")
    if not features:
        raise ValueError(f"no feature column was named; the frame has {df.columns}")
    train = df.where(F.col("split") == "train")
    categorical, numeric = split_kinds(df, features)
    vocab, sizes = None, {}
    if categorical and not hashed:
        vocab = fit_vocab(train, categorical).persist()
        sizes = vocab_sizes(vocab)
    medians, edges = {}, {}
    if numeric:
        medians, edges = _fit_numeric(train, numeric, numeric_bins, accuracy)
    widths = {}
    for name in features:
        if name in numeric:
            widths[name] = len(edges[name]) + 1
        else:
            widths[name] = hashed or sizes.get(name, 0) + 1
    return SparseEncoder(
        list(features), categorical, vocab, sizes, medians, edges, widths,
        field_offsets(list(widths.items())), sum(widths.values()), hashed,
    )


def fm_encode(df: DataFrame, features: list[str], numeric_bins: int = 32) -> DataFrame:
    """``(split, row_id, ids)`` under an encoding fitted on the train rows."""
    return fit_sparse(df, features, numeric_bins).transform(df).select(*KEYS, "ids")
