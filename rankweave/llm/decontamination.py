"""Benchmark decontamination: every suffix of the test items, searched in suffix arrays of the training text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import chunks, fresh, with_columns
from .suffix_array import _settle

#: consecutive words that count as a verbatim match; a shorter item has to occur whole
WIDTH = 10
#: bytes of training text read at once
CHUNK = 4 << 20
#: bytes hashed in one step
STEP = 1 << 20
#: words of one suffix array
SHARD = 1 << 20
#: words of one piece of a test item; longer items are cut into pieces that overlap
PIECE = 1 << 16
#: bytes of test text that are searched, and broadcast, at once; more is searched block by block
BLOCK = 8 << 20
#: a word is a run of characters outside of these, after A-Z are lower-cased
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x41:0x5B] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random number a byte; A-Z have those of a-z."""
    table = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=np.uint64)
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0xD1342543DE82EF95
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, np.uint64(b))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _room(size: int) -> int:
    return max(1 << 16, 1 << (int(size) - 1).bit_length())


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of texts that lie one after the other in `data`.

    `ends` are the ends of the texts. Bytes are read in steps that end between two words, so
    that the memory for sums does not grow with a long text.
    """
    word = IN_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(ends, starts, side="right").astype(np.int32)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + STEP, side="right")))
        low, high = int(starts[at]), int(stops[upto - 1])
        up, down = _powers(_room(high - low + 1))
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_letters()[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, stops[at:upto] - low
        hashes[at:upto] = (sums[e] - sums[s]) * down[s]
        at = upto
    return hashes, owner


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)


@dataclass
class Items:
    """A block of test items as numbers: a word is its place in the sorted vocabulary, from 1."""

    vocabulary: np.ndarray
    words: np.ndarray  # all pieces one after the other, each followed by 0
    need: np.ndarray  # by place: words that must match from there; 0 if too few are left
    item: np.ndarray  # by place: number of the item
    at: np.ndarray  # by place: the word of the item
    ids: list[str | None]

    @staticmethod
    def of(rows: list) -> Items:
        """From rows (item, text, need, at): pieces of items."""
        data, ends = _flat([r["text"].encode() for r in rows])
        hashes, owner = word_hashes(data, ends)
        vocabulary, code = np.unique(hashes, return_inverse=True)
        count = np.bincount(owner, minlength=len(rows))
        place = np.arange(len(code)) + owner
        words = np.zeros(len(code) + len(rows), dtype=np.int64)
        need, item, at = np.zeros_like(words), np.zeros_like(words), np.zeros_like(words)
        words[place] = code + 1
        inside = np.arange(len(code)) - (np.cumsum(count) - count)[owner]
        wanted = np.array([r["need"] for r in rows], dtype=np.int64)[owner]
        need[place] = np.where(count[owner] - inside >= wanted, wanted, 0)
        names: dict[str | None, int] = {}
        number = np.array([names.setdefault(r["item"], len(names)) for r in rows], dtype=np.int64)
        item[place] = number[owner]
        at[place] = inside + np.array([r["at"] for r in rows], dtype=np.int64)[owner]
        return Items(vocabulary, words, need, item, at, list(names))

    @property
    def least(self) -> int:
        """Words of the shortest match that counts; 0 if nothing can match."""
        return int(self.need[self.need > 0].min(initial=1 << 30)) % (1 << 30)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words; 0 for one that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _ramp(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start .. start + length - 1, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Shard:
    """A suffix array over runs of training words.

    Words that no item has are in no match, so they cut the text as ends of documents do, and
    runs too short for a match are left out by the caller. `origin` tells the word a place is.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.origin = _ramp(starts, lengths + 1)
        ends = np.cumsum(lengths + 1) - 1
        self.origin[ends] = -1
        self.words = np.zeros(len(self.origin), dtype=np.int64)
        inside = self.origin >= 0
        self.words[inside] = codes[self.origin[inside]]
        # every cut is a symbol of its own, below all words
        names = self.words + (len(ends) - 1)
        names[ends] = np.arange(len(ends))[::-1]
        self.order = _settle(names)
        self.sorted = names[self.order]
        self.names, self.cuts = names, len(ends)

    def _bound(self, lo, hi, depth, symbol, right: bool) -> np.ndarray:
        """First place in [lo, hi) whose symbol at `depth` is not below (with `right`: above)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            seen = self.names[self.order[mid] + depth]
            below = seen <= symbol[open_] if right else seen < symbol[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]

    def search(self, tests: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test place, lo, hi): the suffixes `order[lo:hi]` start with the words needed there.

        All test suffixes are searched at once; a step takes one more word of each that still
        has matches.
        """
        left = np.flatnonzero(tests.need)
        symbol = tests.words[left] + (self.cuts - 1)
        lo = np.searchsorted(self.sorted, symbol)
        hi = np.searchsorted(self.sorted, symbol, side="right")
        keep = lo < hi
        left, lo, hi = left[keep], lo[keep], hi[keep]
        done = []
        depth = 1
        while len(left):
            full = tests.need[left] == depth
            done.append((left[full], lo[full], hi[full]))
            left, lo, hi = left[~full], lo[~full], hi[~full]
            symbol = tests.words[left + depth] + (self.cuts - 1)
            low = self._bound(lo, hi, depth, symbol, right=False)
            high = self._bound(low, hi, depth, symbol, right=True)
            keep = low < high
            left, lo, hi = left[keep], low[keep], high[keep]
            depth += 1
        parts = [np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3)]
        return parts[0], parts[1], parts[2]

    def _sums(self, words: np.ndarray) -> np.ndarray:
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mixed * _powers(_room(len(words) + 1))[0][: len(words)], out=sums[1:])
        return sums

    def longest(self, tests: Items, found: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(length, word) of the longest match of each test suffix that `search` found.

        A suffix's longest match is with one of its two neighbours in the order. Common prefixes
        come from hashes of ranges, by bisection.
        """
        ours, theirs = self._sums(self.words), self._sums(tests.words)
        room = _room(max(len(self.words), len(tests.words)) + 1)
        down = _powers(room)[1]
        mine = np.flatnonzero(self.words == 0)
        cut = np.flatnonzero(tests.words == 0)
        stop = cut[np.searchsorted(cut, found)]

        def common(which, place):
            test = found[which]
            most = np.minimum(stop[which] - test, mine[np.searchsorted(mine, place)] - place)
            low, high = np.zeros(len(test), np.int64), most
            while (low < high).any():
                mid = (low + high + 1) >> 1
                a = (ours[place + mid] - ours[place]) * down[place]
                b = (theirs[test + mid] - theirs[test]) * down[test]
                same = a == b
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            return low

        left, right = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                break
            mid = (left[open_] + right[open_]) >> 1
            place = self.order[mid]
            n = common(open_, place)
            # a cut in the training text is below every word; an ended test suffix is below all
            below = self.words[place + n] < tests.words[found[open_] + n]
            left[open_[below]] = mid[below] + 1
            right[open_[~below]] = mid[~below]
        every = np.arange(len(found))
        a = self.order[np.maximum(left - 1, lo)]
        b = self.order[np.minimum(left, hi - 1)]
        n, m = common(every, a), common(every, b)
        return np.maximum(n, m), self.origin[np.where(n >= m, a, b)]


def _shards(codes: np.ndarray, owner: np.ndarray, least: int, overlap: int, size: int):
    """Suffix arrays over the runs of known words of at least `least` words, in shards of about `size`.

    A run beyond `size` words is cut into parts that overlap, so that every match of up to
    `overlap` + 1 words lies in one part.
    """
    known = codes > 0
    joined = np.zeros(len(codes), dtype=bool)
    joined[1:] = known[1:] & known[:-1] & (owner[1:] == owner[:-1])
    starts = np.flatnonzero(known & ~joined)
    ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
    long = ends - starts >= least
    starts, lengths = starts[long], (ends - starts)[long]
    step = max(size - overlap, 1)
    parts = np.maximum(1, -(-(lengths - overlap) // step))
    if len(parts) and parts.max() > 1:
        run = np.repeat(np.arange(len(starts)), parts)
        offset = _ramp(np.zeros(len(parts), dtype=np.int64), parts) * step
        lengths = np.minimum(lengths[run] - offset, step + overlap)
        starts = starts[run] + offset
    group = np.cumsum(lengths) // size
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(starts)]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if e > s:
            yield Shard(codes, starts[s:e], lengths[s:e])


def _hits(codes, owner, tests: Items, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word is hit, pairs of text and item as text * items + item)."""
    hit = np.zeros(len(codes), dtype=bool)
    pairs = [np.zeros(0, dtype=np.int64)]
    width = int(tests.need.max(initial=1))
    for shard in _shards(codes, owner, tests.least, width - 1, size) if tests.least else ():
        place, lo, hi = shard.search(tests)
        if not len(place):
            continue
        # test suffixes with one window share it
        need = tests.need[place]
        windows, window = np.unique(lo * (width + 1) + need, return_inverse=True)
        one = np.zeros(len(windows), dtype=np.int64)
        one[window] = np.arange(len(window))
        where = shard.order[_ramp(lo[one], hi[one] - lo[one])]
        span = np.repeat(need[one], hi[one] - lo[one])
        cover = np.zeros(len(shard.words) + 1, dtype=np.int64)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + span, -1)
        covered = shard.origin[np.cumsum(cover[:-1]) > 0]
        hit[covered] = True
        # texts of a window and items of a window, each pair of the two once
        texts = owner[shard.origin[where]].astype(np.int64)
        of = np.repeat(np.arange(len(windows)), hi[one] - lo[one])
        total = len(tests.ids)
        texts = np.unique(of * (int(owner[-1]) + 1) + texts)
        of, texts = np.divmod(texts, int(owner[-1]) + 1)
        items = np.unique(window * total + tests.item[place])
        row = np.searchsorted(items, np.arange(len(windows) + 1) * total)
        n = np.diff(row)[of]
        for s in range(0, len(of), STEP // 64):
            part = slice(s, s + STEP // 64)
            item = items[_ramp(row[of[part]], n[part])] % total
            pairs.append(np.unique(np.repeat(texts[part], n[part]) * total + item))
    return hit, np.unique(np.concatenate(pairs))


def _pieces(tests: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (item, text, need, at) of every item that has a word; long items in pieces."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = tests.select(
        F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(lowered, F.lit(WORD)).alias("words")
    )
    size, step = F.size("words"), PIECE - width + 1
    starts = F.sequence(F.lit(0), F.greatest(size - width, F.lit(0)), F.lit(step))
    cut = rows.where(size > 0).select("*", F.least(size, F.lit(width)).alias("need"), F.explode(starts).alias("at"))
    part = F.array_join(F.slice("words", F.col("at") + 1, F.lit(PIECE)), " ")
    return cut.select("item", part.alias("text"), "need", "at")


def item_blocks(tests: DataFrame, item_col: str, text_col: str, width: int, block: int = BLOCK):
    """Blocks of test items, each of about `block` bytes at most, made one at a time."""
    pieces = cut_lineage(_pieces(tests, item_col, text_col, width))
    total = pieces.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0]
    count = max(1, -(-(total or 0) // block))
    number = F.pmod(F.xxhash64("item", "at", "text"), F.lit(count))
    for n in range(count):
        yield Items.of(pieces.where(number == n).collect())


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and the ends of its texts; null as empty."""
    return _flat([b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()])


def find_matches(
    docs: DataFrame,
    tests: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    shard: int = SHARD,
    block: int = BLOCK,
    words_out: str = "n_words",
    spans_out: str = "hit_spans",
    items_out: str = "items",
    keep_text: bool = True,
) -> DataFrame:
    """`docs` with the number of words, the ranges of words hit (start, stop) and the items hit.

    A word is hit inside any occurrence of `width` consecutive words of an item; an item of
    fewer words, but not none, has to occur whole. Words are told apart by 64-bit hashes.
    Every task builds suffix arrays over shards of its texts and searches all test suffixes in
    them. Test items beyond `block` bytes come in blocks, a pass over the texts each: what is
    broadcast and what a driver holds is one block. Texts of any length are cut into shards that
    overlap. Null texts have no words; rows stay as they are, repeated rows and ids too. Items are
    strings, in order, each once; rows of one item id are one item; an item without id hits words
    but is not listed. No test items: nothing is hit. Other columns pass through (the text with
    `keep_text`); a column with the name of a new one is replaced.
    """
    names = [words_out, spans_out, items_out]
    taken = {n.lower() for n in names} - {text_col.lower()}
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    held = [c for c in out.columns if keep_text or c != text_col]
    first = True
    for tests_block in item_blocks(tests, item_col, item_text_col, width, block):
        if not first:
            # the text is read again for the next block, from a written table
            out = cut_lineage(out)
        out = _pass(out, text_col, tests_block, shard, None if first else names, names)
        first = False
    return out.select(*held, *names)


def _pass(docs: DataFrame, text: str, tests: Items, size: int, have: list[str] | None, names: list[str]) -> DataFrame:
    """`docs` with new values of the columns `names`, joined to those that they `have`."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    kept = [c for c in docs.columns if c not in (have or ())]
    inner = [f"x{i}" for i in range(len(kept))]
    kinds = [docs.schema[c].dataType.simpleString() for c in kept]
    position = kept.index(text)
    cols = [F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)]
    old = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(have or ())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches):
        tests = shared.value
        ids = np.array([i if i is not None else "" for i in tests.ids], dtype=object)
        listed = np.array([i is not None for i in tests.ids], dtype=bool)
        for batch in chunks(batches, inner[position], CHUNK):
            data, ends = _texts(batch, inner[position])
            hashes, owner = word_hashes(data, ends)
            hit, pairs = _hits(tests.encode(hashes), owner, tests, size) if len(owner) else (None, None)
            count = np.bincount(owner, minlength=batch.num_rows)
            spans = [[] for _ in range(batch.num_rows)]
            items = [[] for _ in range(batch.num_rows)]
            if hit is not None and hit.any():
                first = np.cumsum(count) - count
                edge = np.concatenate(([True], owner[1:] != owner[:-1]))
                start = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1]))))
                stop = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True)) + 1
                for row, s, e in zip(owner[start].tolist(), start.tolist(), stop.tolist()):
                    spans[row].append({"start": s - int(first[row]), "stop": e - int(first[row])})
                row, item = np.divmod(pairs, len(ids))
                for r, i in zip(row[listed[item]].tolist(), ids[item[listed[item]]].tolist()):
                    items[r].append(i)
            if have:
                spans = [_merged(a, b) for a, b in zip(spans, batch.column("o1").to_pylist())]
                items = [a + b for a, b in zip(items, batch.column("o2").to_pylist())]
            made = {
                "n": pa.array(count, pa.int64()),
                "s": pa.array(spans, span),
                "i": pa.array([sorted(set(i)) for i in items], pa.list_(pa.string())),
            }
            yield with_columns(batch, ("o0", "o1", "o2"), made)

    schema = ", ".join(f"{n} {t}" for n, t in zip(inner, kinds))
    made = docs.select(*cols, *old).mapInArrow(
        work, f"{schema}, n long, s array<struct<start:bigint,stop:bigint>>, i array<string>"
    )
    return made.toDF(*kept, *names)


def _merged(a: list[dict], b: list[dict]) -> list[dict]:
    """Ranges that are covered by either; ranges that touch become one."""
    out: list[dict] = []
    for r in sorted([*a, *b], key=lambda r: r["start"]):
        if out and r["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], r["stop"])
        else:
            out.append(dict(r))
    return out


def longest_matches(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """(item, at, length, doc, place): the longest verbatim match of every test suffix that has one.

    `at` is the word of the item where the suffix starts, `length` the number of words, `doc` and
    `place` a document and the word in it where that match starts (of several longest ones, the
    greatest document, null as least). Suffixes without a match of the words needed have no row.
    A match ends where a piece of an item beyond 65,536 words does, or a shard of a text beyond
    `shard` words. Rows of one item id and `at` are one. Each task sends its own best only.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    for tests_block in item_blocks(tests, item_col, item_text_col, width, block):
        shared = docs.sparkSession.sparkContext.broadcast(tests_block)

        def work(batches, shared=shared):
            tests = shared.value
            ids = np.array(tests.ids, dtype=object)
            for batch in chunks(batches, "text", CHUNK):
                data, ends = _texts(batch, "text")
                hashes, owner = word_hashes(data, ends)
                if not len(owner) or not tests.least:
                    continue
                first = np.searchsorted(owner, np.arange(batch.num_rows))
                overlap = int(tests.need.max()) - 1
                for part in _shards(tests.encode(hashes), owner, tests.least, overlap, shard):
                    place, lo, hi = part.search(tests)
                    if not len(place):
                        continue
                    length, word = part.longest(tests, place, lo, hi)
                    row = owner[word]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[tests.item[place]].tolist(), pa.string()),
                            pa.array(tests.at[place], pa.int64()),
                            pa.array(length, pa.int64()),
                            batch.column("id").take(pa.array(row)),
                            pa.array(word - first[row], pa.int64()),
                        ],
                        names=["item", "at", "length", "doc", "place"],
                    )

        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            work, f"item string, at long, length long, doc {kind}, place long"
        )
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("item", "at").agg(F.max(F.struct("length", "doc", "place")).alias("best"))
    return best.select("item", "at", "best.*")


def words_hit(spans: Column) -> Column:
    """The number of words in ranges."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def decontaminate(docs: DataFrame, tests: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents of `docs` in which no test item is found; options as for `find_matches`."""
    names = {k: fresh(docs, k) for k in ("words_out", "spans_out", "items_out")}
    found = find_matches(docs, tests, text_col, **options, **names)
    return found.where(F.size(names["spans_out"]) == 0).select(docs.columns)
