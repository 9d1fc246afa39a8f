"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import fresh, sortable, text_key, with_columns
from .components import connected_components
from .minhash import shingle_groups

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: shingle hashes whose bits are counted at once
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one text.

    A-Z are lower-cased, words end at ASCII white space, and a bit is 1 if more than half of the
    XXH64 values (seed 42) of the shingles have it. Fewer words than a shingle are one shingle;
    no word at all (null, empty, only white space) gives 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.fromiter(
            (digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])),
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(counts * 2 > n, bitorder="little").view("<i8")
    return int(value[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc, the carried columns, fingerprint) for every row, whole texts, no shuffle."""

    def work(batches):
        for batch in batches:
            made = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield with_columns(batch, ("text",), {"fingerprint": made})

    rows = docs.select(
        F.col(id_col).alias("doc"), *carry, F.col(text_col).cast("string").alias("text")
    )
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(work, ", ".join([*kinds, "fingerprint long"]))


def ball(column: str, radius: int):
    """The value and all values that differ from it in up to `radius` bits."""
    masks = [
        sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)
    ]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col(column).bitwiseXOR(m))


def fingerprint_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all distinct `fingerprint` values within `radius` bits.

    Two values at most `radius` (even) bits apart have a value in the middle, at most half of it
    from each. Every value goes to all values in that half ball, so the two meet there. Whatever
    meets is within `radius` of each other, hence links from the smallest in the bucket to the
    others join what all pairs would join. A bucket holds no more values than a ball: 65.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    near = values.select("fingerprint", F.explode(ball("fingerprint", radius // 2)).alias("middle"))
    low = F.min("fingerprint").over(Window.partitionBy("middle"))
    met = near.select("fingerprint", low.alias("low")).where("fingerprint <> low")
    links = met.select(F.col("low").alias("a"), F.col("fingerprint").alias("b")).distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc, the carried columns, fingerprint, root, component_id) for every row of `docs`.

    component_id is the smallest id reachable over fingerprints that differ in at most `radius`
    bits, root the smallest fingerprint. Equal fingerprints are collapsed before any link is
    sought, so a group of copies counts once. Texts without words share the fingerprint 0 and
    are linked like any other. Null ids are ignored in the smallest id (null only if the whole
    group has none). Repeated rows stay repeated; an empty table gives no rows; columns that
    are not named are not looked at.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, carry))
    values = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc").alias("first")))
    roots = connected_components(fingerprint_links(values, radius))
    tops = values.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = tops.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut_lineage(tops.join(least, "root").select("fingerprint", "root", "component_id"))
    return prints.join(labels, "fingerprint").select(
        "doc", *carry, "fingerprint", "root", "component_id"
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE,
    similarity: float | None = None,
) -> DataFrame:
    """The row with the smallest id of each group of near copies, all columns as they were.

    Without `similarity` the groups are those of `simhash_groups`, whose shingles have 3 words.
    With it, texts are linked whose sets of shingles of `words` words have at least that
    Jaccard similarity; candidates meet in bands of minima (`shingle_groups`; a pair of
    similarity 0.8 meets with probability 0.99995), and the exact similarity decides.

    Null ids come last in that order, ties go by a hash of the text, and of rows with equal id
    and text one stays. Rows are found again by id and text together, so a group of copies, a
    repeated id or a null id meets no single task.
    """
    marks = [fresh(docs, f"mark{i}") for i in (1, 2, 3)]
    key = [c.alias(m) for c, m in zip([*text_key(F.col(text_col)), F.xxhash64(id_col)], marks)]
    marked = docs.select("*", *key)
    if similarity is None:
        if words != SHINGLE:
            raise ValueError("other shingles need a similarity")
        groups = simhash_groups(marked, id_col, text_col, carry=tuple(marks))
    else:
        groups = shingle_groups(
            marked, id_col, text_col, similarity, words=words, carry=tuple(marks)
        )
    lead = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc").isNull(), "doc", *marks)).alias("lead")
    )
    lead = cut_lineage(lead.select(*[F.col(f"lead.{m}") for m in marks]))
    rank = fresh(docs, "lead_rank")
    order = [sortable(docs, c) for c in docs.columns if c not in (id_col, text_col)]
    same = Window.partitionBy(*marks).orderBy(*(order or [F.lit(0)]))
    return (
        marked.join(lead, marks, "left_semi")
        .withColumn(rank, F.row_number().over(same))
        .where(F.col(rank) == 1)
        .select(docs.columns)
    )
