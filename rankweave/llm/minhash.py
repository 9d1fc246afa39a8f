"""Document fingerprints: MinHash signatures, their neighbours in id order, banded near copies."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage
from .buckets import deal, gathered, gathered_pairs, local_roots
from .common import chunks, text_key
from .components import connected_components

WORDS = 5
SIZE = 128
#: 25 bands of 5: a pair of similarity 0.8 meets in one with probability 0.99995
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: two minima that differ have equal signatures with this probability
CHANCE = 2.0**-16
#: bytes of text, and shingles, worked on at once
CHUNK = 2 << 20
STEP = 1 << 12
BLOCK = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _random() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every byte, and factors and terms of the hash functions; fixed by the seed."""
    rng = np.random.default_rng(5)
    table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    factor, term = rng.integers(0, 1 << 64, (2, SIZE), dtype=np.uint64)
    return table, factor | np.uint64(1), term


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, where each text's words begin and the total, first byte of each word).

    A-Z count as lower case and ASCII white space parts words. Bytes are counted from the start
    of all texts, one byte apart.
    """
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    gap = np.concatenate(([True], _SPACE[data]))
    first = np.flatnonzero(gap[:-1] & ~gap[1:])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), first
    inside = np.flatnonzero(~gap[1:])
    at = np.searchsorted(inside, first)
    size = np.diff(at, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(at, size)
    powers = np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15))
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_random()[0][data[inside]] * powers[place], at)
    return _mix(sums), np.searchsorted(first, begin), first


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, where each text's begin and the total); short texts have one."""
    word, begin, _ = word_hashes(texts)
    count = np.diff(begin)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    start = np.concatenate(([0], np.cumsum(n)))
    if not start[-1]:
        return np.zeros(0, np.uint64), start
    at = np.arange(start[-1]) + np.repeat(begin[:-1] - start[:-1], n)
    stop = np.repeat(begin[1:], n)
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(words):
        there = at + i < stop
        value = word[np.minimum(at + i, len(word) - 1)]
        out = np.where(there, _mix(out * np.uint64(0x9E3779B97F4A7C15) + value), out)
    return out, start


def signatures(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row of 16 bits of each minimum for each text; a text without shingles has only 65535.

    Each hash function is a x + b modulo 2^64, of which the upper bits count, with random odd a
    and b: universal over the 32-bit shingle hashes x. The whole minimum is mixed before it is
    cut: the minimum of many hashes is small, so its own upper bits would be zero for any long
    text. What is kept is uniform at any length; unequal minima agree with chance 2^-16.
    """
    _, factor, term = _random()
    out = np.full((len(start) - 1, SIZE), np.iinfo(np.uint64).max)
    x = hashes >> np.uint64(32)
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    for at in range(0, len(x), STEP):
        values = factor[:, None] * x[None, at : at + STEP] + term[:, None]
        part = owner[at : at + STEP]
        first = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
        who = part[first]
        out[who] = np.minimum(out[who], np.minimum.reduceat(values, first, axis=1).T)
    cut = (_mix(out) >> np.uint64(48)).astype(np.uint16)
    cut[np.diff(start) == 0] = np.iinfo(np.uint16).max
    return cut


def fingerprint_texts(texts: list[str | None]) -> np.ndarray:
    """Signatures of whole texts; null as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return signatures(*shingle_hashes(raw))


def digits(rows: np.ndarray) -> list[str]:
    """Signatures as hexadecimal text, four digits a hash function."""
    return [r.astype(">u2").tobytes().hex() for r in rows]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An estimate of the Jaccard similarity, row by row: equal minima, less those equal by chance."""
    return np.maximum(((a == b).mean(axis=1) - CHANCE) / (1 - CHANCE), 0.0)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much, or all, of the start of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: bytes of text in a range
RANGE = 64 << 20
#: ids drawn a range of text ids
PICKED = 50


def _text_edges(ids: DataFrame, wanted: int) -> list[str]:
    """Ids that cut text ids into about `wanted` even ranges, from a sample of bounded size."""
    share = min(1.0, PICKED * wanted / max(1, ids.count()))
    drawn = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(share * (1 << 30))
    found = sorted({r["doc"] for r in ids.where(F.col("doc").isNotNull() & drawn).distinct().collect()})
    return sorted({found[i * len(found) // wanted] for i in range(1, wanted)}) if found else []


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, tail, missing, doc, mark, text), sorted, so that each row's successor follows.

    Ids are cut into ranges, as many as shuffle partitions and enough for `RANGE` bytes of text
    each; a range's first row also goes to the range before, as its `tail`, and the very first to
    the last. So each text moves once, and the order needs no single task. Null ids come first,
    equal ids go by a hash of the text. Text ids are in the order of their
    bytes; their ranges come from a sample by a hash, of about `PICKED` ids a range.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.count(id_col)).head()
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[0] or 0) // RANGE))
    rows = docs.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).select(F.col("doc").isNotNull().alias("given"), "doc", F.xxhash64("text").alias("mark"), "text")
    if isinstance(docs.schema[id_col].dataType, StringType):
        edges = _text_edges(docs.select(F.col(id_col).alias("doc")), wanted)
    else:
        shares = [i / wanted for i in range(1, wanted)]
        edges = docs.agg(F.percentile_approx(id_col, shares or [0.5], 10000).alias("e")).head()["e"]
        edges = sorted(set(edges or [])) if shares else []
    # the number of edges that are not above the id
    part = F.lit(0)
    if edges:
        known = F.array(*[F.lit(e) for e in edges])
        part = F.coalesce(F.size(F.filter(known, lambda e: e <= F.col("doc"))), F.lit(0))
    rows = rows.withColumn("part", part)
    # one row for each range, at most as many as partitions
    firsts = rows.groupBy("part").agg(F.min(F.struct("given", "doc", "mark")).alias("f"))
    found = sorted((r["part"], r["f"]["given"], r["f"]["doc"], r["f"]["mark"]) for r in firsts.collect())
    kind = rows.schema["doc"].dataType.simpleString()
    heads = [(p, g, d, m, found[i - 1][0]) for i, (p, g, d, m) in enumerate(found)]
    head = F.broadcast(
        spark.createDataFrame(heads, f"part int, given boolean, doc {kind}, mark long, back int")
        .withColumnsRenamed({"given": "g", "doc": "d", "mark": "m", "part": "p"})
    )
    same = (
        (rows["part"] == head["p"])
        & rows["doc"].eqNullSafe(head["d"])
        & (rows["mark"] == head["m"])
    )
    placed = rows.join(head, same, "left").select(
        F.explode(
            F.when(
                F.col("back").isNull(),
                F.array(F.struct(F.col("part"), F.lit(False).alias("tail"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("part"), F.lit(False).alias("tail")),
                    F.struct(F.col("back").alias("part"), F.lit(True).alias("tail")),
                )
            )
        ).alias("to"),
        "given",
        "doc",
        "mark",
        "text",
    )
    placed = placed.select("to.part", "to.tail", "given", "doc", "mark", "text")
    return placed.repartition(wanted, "part").sortWithinPartitions("part", "tail", "given", "doc", "mark")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), a row each.

    `edited` is the text with its last half replaced by the start of the next text in ascending
    id (after the last: the first); near_* are likenesses of the text's fingerprint to those of
    the edited text and of the next one. Null texts count as empty; a single row is its own
    next; no rows give no rows. Texts without words have the same fingerprint.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches):
        # the last row seen waits for its successor
        waiting = None
        for batch in chunks(batches, "text", CHUNK):
            part, tail = batch.column("part").to_pylist(), batch.column("tail").to_pylist()
            doc, text = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
            rows = list(zip(part, tail, doc, text))
            if waiting is not None:
                rows.insert(0, waiting)
            texts = [r[3] for r in rows]
            pairs = [
                i
                for i in range(len(rows) - 1)
                if not rows[i][1] and rows[i][0] == rows[i + 1][0]
            ]
            waiting = rows[-1]
            if not pairs:
                continue
            made = [edited(texts[i], texts[i + 1]) for i in pairs]
            own, other = fingerprint_texts(texts), fingerprint_texts(made)
            at = np.array(pairs)
            columns = [
                pa.array([rows[i][2] for i in pairs], batch.schema.field("doc").type),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array(made, pa.string()),
                pa.array(digits(own[at]), pa.string()),
                pa.array(digits(other), pa.string()),
                pa.array(likeness(own[at], other)),
                pa.array(likeness(own[at], own[at + 1])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return beside_next(docs, id_col, text_col).mapInArrow(
        work,
        f"doc {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def minhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """(doc, n_links, component_id) for every row: near copies by shingle sets.

    See `shingle_groups`.
    """
    groups = shingle_groups(docs, id_col, text_col, similarity, block)
    return groups.select("doc", "n_links", "component_id")


def shingle_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    block: int = BLOCK,
    words: int = WORDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc, the carried columns, root, n_links, component_id) for every row.

    Texts with equal words are one class. Signatures are cut into bands; classes that share a
    band meet there, the likeness of their signatures sorts out most pairs (those more than four
    standard deviations short), and the Jaccard similarity of the shingle sets decides the rest.
    A bucket of more than `block` classes is dealt in pairs of blocks; it sends a forest of its
    links. n_links counts the other rows linked. Texts without words are copies of each other.
    Null ids are ignored in the smallest id; repeated rows stay.
    """
    parts = F.filter(
        F.split(
            F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")),
                        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "[ \\x09-\\x0D]+",
        ),
        lambda w: w != "",
    )
    plain = docs.select(F.col(id_col).alias("doc"), *carry, F.array_join(parts, " ").alias("text"))
    keyed = plain.select("doc", *carry, "text", *text_key(F.col("text")))
    keyed = keyed.withColumn(
        "node", F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("key1", "key2")])
    ).drop("key1", "key2")
    classes = cut_lineage(
        keyed.groupBy("node").agg(
            F.count("*").alias("size"), F.min("doc").alias("first"), F.first("text").alias("text")
        )
    )
    margin = similarity - 4 * (similarity * (1 - similarity) / SIZE) ** 0.5

    def sketch(batches):
        for batch in chunks(batches, "text", CHUNK):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            hashes, start = shingle_hashes(texts, words)
            rows = signatures(hashes, start)
            sets = [np.unique(hashes[s:e]).tobytes() for s, e in zip(start[:-1], start[1:])]
            codes = np.zeros((len(rows), BANDS), dtype=np.uint64)
            for i in range(ROWS):
                codes = _mix(codes + rows[:, i : BANDS * ROWS : ROWS])
            columns = [batch.column("node"), batch.column("size")]
            columns += [pa.array([r.tobytes() for r in rows], pa.binary())]
            columns += [pa.array(sets, pa.binary()), pa.array(codes.view(np.int64).tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "signature", "shingles", "codes"])

    keys = ["band", "code"]
    sketched = cut_lineage(
        classes.select("node", "size", "text").mapInArrow(
            sketch, "node string, size long, signature binary, shingles binary, codes array<long>"
        )
    )
    near = sketched.select("node", F.posexplode("codes").alias("band", "code"))
    dealt = deal(near, sketched.drop("codes"), keys, "node", block)

    def compare(batches):
        for rows, groups in gathered(batches, keys, 4 * block):
            sign = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, SIZE)
            sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            band, size = np.array(rows["band"]), np.array(rows["size"])
            count, ends = np.zeros(len(sign)), []
            for a, b in gathered_pairs(groups):
                go = likeness(sign[a], sign[b]) >= margin
                a, b = a[go], b[go]
                real = np.array([_jaccard(sets[i], sets[j]) >= similarity for i, j in zip(a, b)], bool)
                a, b = a[real], b[real]
                ends.append((a, b))
                # a pair counts in the first band that it shares
                same = (sign[a] == sign[b])[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2)
                first = same.argmax(axis=1) == band[a]
                count += np.bincount(a[first], weights=size[b[first]], minlength=len(sign))
                count += np.bincount(b[first], weights=size[a[first]], minlength=len(sign))
            if not ends:
                continue
            root = local_roots(len(sign), *[np.concatenate(c) for c in zip(*ends)])
            keep = np.flatnonzero((count > 0) | (root != np.arange(len(sign))))
            node = np.array(rows["node"], dtype=object)
            links = pa.array(count[keep].astype(np.int64))
            columns = [pa.array(node[keep], pa.string()), links, pa.array(node[root[keep]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "other"])

    found = cut_lineage(dealt.mapInArrow(compare, "node string, links long, other string"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    tops = classes.select("node", "size", "first").join(roots, "node", "left")
    tops = tops.withColumn("root", F.coalesce("root", "node"))
    least = tops.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut_lineage(
        tops.join(least, "root").join(counts, "node", "left").select(
            "node",
            "root",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            "component_id",
        )
    )
    return (
        keyed.select("doc", *carry, "node")
        .join(labels, "node")
        .select("doc", *carry, "root", "n_links", "component_id")
    )


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
