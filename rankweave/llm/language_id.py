"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, with_columns

DIMENSIONS = 1024
GRAM = 3
SPACE = 32
UNKNOWN = "und"
#: characters worked on at once
CHUNK = 1 << 19
#: texts bundled at once, however short: each takes a row of n-gram counts
ROWS = 512
#: documents add to a prototype with this length, as whole numbers, so that sums have no order
UNIT = 1 << 20
#: n-gram codes up to this are looked up in a table
TABLE = 1 << 23


@lru_cache(maxsize=None)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1 << 12)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random +-1 vector of a letter, the same in every process."""
    raw = hashlib.shake_128(f"letter {code}".encode()).digest(dimensions // 8)
    return (np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) << 1) - 1


def spell(text: str | None) -> np.ndarray:
    """Lower-case letters as code points; every run of anything else is one space, also around."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    before = np.concatenate(([False], letter[:-1]))
    out = np.where(letter, codes, SPACE)[letter | before].astype(np.uint32)
    tail = [] if out[-1] == SPACE else [SPACE]
    return np.concatenate(([SPACE], out, tail)).astype(np.uint32)


def bundles(texts: list[str | None], dimensions: int) -> np.ndarray:
    """A row per text: the sum of its n-gram vectors, whole numbers.

    An n-gram's vector binds its letters' vectors, each permuted (rotated) by its place. The
    texts' n-gram counts times the matrix of n-gram vectors is that bundle.
    """
    spelled = [spell(t) for t in texts]
    sizes = np.array([len(s) for s in spelled])
    out = np.zeros((len(texts), dimensions))
    if not sizes.sum():
        return out
    codes = np.concatenate(spelled)
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids, owner = place[codes], np.repeat(np.arange(len(texts)), sizes)
    k = len(alphabet)
    gram = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    inside = owner[:-2] == owner[2:]
    gram, owner = gram[inside], owner[:-2][inside]
    if k**GRAM <= TABLE:
        used = np.zeros(k**GRAM, dtype=bool)
        used[gram] = True
        grams = np.flatnonzero(used)
        column = np.cumsum(used)[gram] - 1
    else:
        grams, column = np.unique(gram, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    turned = [np.roll(letters, GRAM - 1 - i, axis=1) for i in range(GRAM)]
    first, second, third = grams // (k * k), grams // k % k, grams % k
    # float32 holds these whole numbers exactly; n-grams go in blocks, so a rich alphabet is fine
    step = 1 << 13
    order = np.argsort(column, kind="stable") if len(grams) > step else None
    if order is not None:
        column, owner = column[order], owner[order]
    for at in range(0, len(grams), step):
        part = slice(at, at + step)
        low, high = (0, len(column)) if order is None else np.searchsorted(column, (at, at + step))
        vectors = (turned[0][first[part]] * turned[1][second[part]] * turned[2][third[part]]).astype(
            np.float32
        )
        width = len(vectors)
        cells = owner[low:high] * width + (column[low:high] - at)
        counts = np.bincount(cells, minlength=len(texts) * width).reshape(len(texts), width)
        out += counts.astype(np.float32) @ vectors
    return out


def _slices(batches):
    for part in chunks(batches, "text", CHUNK):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


@dataclass(frozen=True)
class Prototypes:
    """One vector a language, centred on their common mean."""

    labels: list[str]
    vectors: np.ndarray
    mean: np.ndarray

    def judge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best label's index and its cosine in 0..1, rounded to 9 places."""
        cosine = np.round(_unit(_unit(rows) - self.mean) @ self.vectors.T, 9)
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(rows)), best], 0.0, 1.0)


def fit_prototypes(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", dimensions: int = DIMENSIONS
) -> Prototypes | None:
    """Bundle every labelled row of `docs` into its language's prototype; None without any.

    All rows count, each with the same length, as whole numbers: the sums don't depend on the
    partitions. A task sends one vector a language, the driver gets one vector a language.
    Null labels and texts without letters are passed over.
    """

    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for part in _slices(batches):
            rows = bundles(part.column("text").to_pylist(), dimensions)
            rows = np.rint(_unit(rows) * UNIT).astype(np.int64)
            labels = np.array(part.column("label").to_pylist(), dtype=object)
            for label in set(labels):
                sums[label] = sums.get(label, 0) + rows[labels == label].sum(axis=0)
        if sums:
            totals = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), totals], names=["label", "total"])

    rows = docs.select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")
    ).where("label IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(work, "label string, total array<long>")
    sums = (
        parts.select("label", F.posexplode("total").alias("pos", "value"))
        .groupBy("label", "pos")
        .agg(F.sum("value").alias("value"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("total"))
        .select("label", F.col("total.value").alias("total"))
    )
    found = {r["label"]: np.array(r["total"], dtype=float) for r in sums.collect()}
    labels = sorted(k for k, v in found.items() if np.any(v))
    if not labels:
        return None
    vectors = _unit(np.stack([found[k] for k in labels]))
    mean = vectors.mean(axis=0) if len(labels) > 1 else np.zeros(dimensions)
    return Prototypes(labels, _unit(vectors - mean), mean)


def identify(
    docs: DataFrame,
    model: Prototypes | None,
    text_col: str = "text",
    label_out: str = "lang_pred",
    score_out: str = "score",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """`docs` with the predicted language and its cosine (0 to 1) in two more columns.

    Only the text is looked at, all of it. Null texts, texts without a letter, and any text if
    there is no model, get `und` and 0. Ties go to the first label by name.
    """
    kinds = [f.dataType.simpleString() for f in docs.schema]
    text = fresh(docs, "whole_text")
    # columns travel by place, so any names will do, also repeated ones
    names = [f"c{i}" for i in range(len(kinds))]
    rows = docs.select("*", F.col(text_col).cast("string").alias(text)).toDF(*names, "text")

    def work(batches):
        for part in _slices(batches):
            vectors = bundles(part.column("text").to_pylist(), dimensions)
            known = vectors.any(axis=1)
            label, score = np.full(len(known), UNKNOWN, dtype=object), np.zeros(len(known))
            if model is not None and known.any():
                best, cosine = model.judge(vectors[known])
                label[known], score[known] = np.array(model.labels, dtype=object)[best], cosine
            made = {"label_out": pa.array(label, pa.string()), "score_out": pa.array(score)}
            yield with_columns(part, ("text",), made)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return rows.mapInArrow(work, f"{schema}, label_out string, score_out double").toDF(
        *docs.columns, label_out, score_out
    )


def training_fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1; null ids are left out."""
    return docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> DataFrame:
    """`docs` without the rows in which no language is found (`und`); columns as they were.

    Rejected are only null texts and those without a letter, whatever the cosine of the others.
    Without a labelled row to learn from, the same rows go.
    """
    model = fit_prototypes(training_fold(docs, id_col), text_col, label_col)
    if model is None:
        model = Prototypes(["any"], np.zeros((1, DIMENSIONS)), np.zeros(DIMENSIONS))
    label, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = identify(docs, model, text_col, label, score)
    return found.where(F.col(label) != UNKNOWN).select(docs.columns)
