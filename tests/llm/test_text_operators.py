"""Language, lines, near copies, passages, packing and byte-pair encoding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.llm import byte_bpe, language_id, line_dedup, packing, passages, pretokens, simhash, suffix_dedup
from rankweave.llm.components import connected_components
from rankweave.llm.pretokens import split_pieces
from rankweave.llm.suffix_array import repeated_starts, suffix_array

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# --- connected components ---


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(5, 5), (7, None)]
    links += [(100 + i, 101 + i) for i in range(40)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {x: x for link in links if None not in link and link[0] != link[1] for x in link}
    while True:
        before = dict(root)
        for a, b in links:
            if b is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert got == root


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language ---


def test_language_odd_rows(odd):
    model = language_id.fit_prototypes(odd)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
        assert r["lang_pred"] in {"en", "fr", "und"} and r["text_key1"] == 7
    assert language_id.keep_identified(odd).columns == odd.columns


def test_language_without_rows(nothing):
    assert language_id.fit_prototypes(nothing) is None
    assert language_id.identify(nothing, None).count() == 0


def test_bundle_is_the_sum_of_bound_vectors():
    text, d = "Aß, bc", 64
    spelled = " aß bc "
    want = np.zeros(d)
    for a, b, c in zip(spelled, spelled[1:], spelled[2:]):
        va, vb, vc = (language_id.letter_vector(ord(x), d).astype(int) for x in (a, b, c))
        want += np.roll(va, 2) * np.roll(vb, 1) * vc
    assert (language_id.bundles([None, text, "42"], d) == [np.zeros(d), want, np.zeros(d)]).all()


def test_held_out_accuracy(spark):
    from rankweave.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    rows = [r for r in QUERIES["op1_language_id"](spark, sf).collect() if r["held_out"]]
    assert len(rows) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.98
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    assert all(fold.values())


# --- lines ---


def plain_lines(rows, at_least):
    sites = defaultdict(set)
    for text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites[line].add(site)
    bad = {k for k, v in sites.items() if len(v) >= at_least}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in bad) for t, _ in rows]


@pytest.mark.parametrize("band", [0.25, 0.9])
def test_lines(corpus, band):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in corpus.collect()]
    want = dict(zip([r[0] for r in rows], plain_lines([r[1:] for r in rows], 6)))
    got = line_dedup.remove_boilerplate(corpus, min_sites=6, band=band)
    assert dict(texts_of(got)) == want and got.columns == corpus.columns
    assert any(t != dict(texts_of(corpus))[i] for i, t in want.items())


def test_lines_odd_rows(odd, nothing):
    want = plain_lines([(r["text"], r["source"]) for r in odd.collect()], 1)
    got = line_dedup.remove_boilerplate(odd, min_sites=1)
    key = lambda t: (t is None, t or "")
    assert sorted((r["text"] for r in got.collect()), key=key) == sorted(want, key=key)
    assert line_dedup.remove_boilerplate(nothing).count() == 0


# --- SimHash ---


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(corpus):
    prints = {i: plain_simhash(t) for i, t in texts_of(corpus)}
    want = plain_components(prints)
    rows = simhash.simhash_groups(corpus).collect()
    assert {r["doc"]: r["fingerprint"] % 2**64 for r in rows} == prints
    assert {r["doc"]: r["component_id"] for r in rows} == want
    kept = simhash.drop_near_copies(corpus)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == corpus.columns


def test_ball_hashing_misses_no_link(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(6):
            for flips in (1, 2, 3):
                values.add(b ^ sum({1 << rng.randrange(64) for _ in range(flips)}))
    want = plain_components({v: v for v in values})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fingerprint long"))
    roots = dict(connected_components(links).collect())
    got = defaultdict(set)
    for (v,) in signed:
        got[roots.get(v, v)].add(v % 2**64)
    groups = defaultdict(set)
    for v, r in want.items():
        groups[r].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_simhash_odd_rows(odd, nothing):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fingerprint"] == 0} == {1}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["root"] for r in rows})
    assert simhash.drop_near_copies(nothing).count() == 0


# --- suffix arrays ---


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 6))
def test_suffix_array(letters, repeat):
    letters = (letters * repeat)[:120] + [0]
    want = sorted(range(len(letters)), key=lambda i: letters[i:])
    for kind in (np.uint16, np.int32):
        assert suffix_array(np.array(letters, dtype=kind)).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=24).map(lambda b: bytes(c % 3 for c in b)), max_size=6), st.integers(1, 6))
def test_repeated_starts(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    want = [[i + width <= len(t) and count[t[i : i + width]] > 1 for i in range(len(t))] for t in texts]
    assert [x.tolist() for x in repeated_starts(texts, width)] == want


def plain_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([False], gone))) & gone).sum())
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found_repeats(df):
    return [
        (len((r["text"] or "").encode()), sum(s["stop"] - s["start"] for s in r["removed"]),
         len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in df.collect()
    ]


def plain_first(texts, order, width):
    """The bytes of each text that no string covers which occurs before, in the order given."""
    seen, out = set(), {}
    for i in sorted(range(len(texts)), key=order.__getitem__):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - width + 1):
            if data[j : j + width] in seen:
                gone[j : j + width] = True
            seen.add(data[j : j + width])
        out[i] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("shard", [4 << 20, 3000, 1])
def test_first_occurrences_stay(corpus, shard):
    got = suffix_dedup.remove_repeats(corpus, width=100, k=16, shard=shard, keep_first=True)
    rows = got.select("doc_id", "text", "kept", F.xxhash64(F.lit("id"), "doc_id"), F.xxhash64("text")).collect()
    want = plain_first([r["text"] for r in rows], [tuple(r)[3:] for r in rows], 100)
    assert [bytes(r["kept"]) for r in rows] == want
    whole = suffix_dedup.remove_repeats(corpus, width=100, k=16).select("kept").collect()
    assert sum(len(w) for w in want) > sum(len(r["kept"]) for r in whole)


def test_a_passage_of_51_words_leaves_all_but_one(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    rows = [(i, f"start{i} " * 30 + passage + f" end{i}" * 30) for i in range(5)] + [(9, "clean " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0]: r[1] for r in suffix_dedup.drop_repeated_passages(df).collect()}
    assert sum(passage in t for t in kept.values()) == 1
    assert all(f"start{i} " in kept[i] and f" end{i}" in kept[i] for i in range(5)) and kept[9] == "clean " * 20


@pytest.mark.parametrize("shard", [4 << 20, 3000, 1])
def test_repeats(corpus, shard):
    want = plain_repeats([t for _, t in texts_of(corpus)], 100)
    got = found_repeats(suffix_dedup.remove_repeats(corpus, width=100, k=16, shard=shard))
    assert sorted(got) == sorted(want) and sum(w[1] for w in want) > 1000


def test_repeats_in_periodic_texts(spark):
    rows = [(0, "ab" * 900, "", ""), (1, "a" * 1500, "", ""), (2, "xyz" * 50 + "ab" * 300, "", ""), (3, "b" * 401, "", ""),
            (4, "c" * 400, "", ""), (5, "d" * 399, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(found_repeats(suffix_dedup.remove_repeats(df))) == sorted(plain_repeats([r[1] for r in rows], 400))


def test_repeats_odd_rows(odd, nothing):
    got = found_repeats(suffix_dedup.remove_repeats(odd))
    assert sorted(got) == sorted(plain_repeats([t for _, t in texts_of(odd)], 400))
    out = suffix_dedup.drop_repeated_passages(odd)
    assert out.columns == odd.columns and out.where("text IS NULL").count() == 2
    assert suffix_dedup.drop_repeated_passages(nothing).count() == 0


def test_cut_characters_go(spark):
    shared = "é" * 60
    rows = [(0, "é1" + shared, "", ""), (1, "ü2" + shared, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = suffix_dedup.remove_repeats(df, width=101, k=8, as_text=True)
    assert all("�" not in r["kept"] for r in got.collect())


# --- passages ---


def test_passages(corpus):
    rows = {r["doc"]: r for r in passages.shared_passages(corpus).collect()}
    words = {i: t.lower().split() for i, t in texts_of(corpus)}
    runs = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 50):
            runs[tuple(w[j : j + 51])].add(i)
    for ids in runs.values():
        if len(ids) > 1:
            assert len({rows[i]["class_id"] for i in ids}) == 1
            assert all(rows[i]["n_links"] for i in ids)
    shared = {i for ids in runs.values() if len(ids) > 1 for i in ids}
    assert {i for i, r in rows.items() if r["n_links"]} == shared | {7, 50}
    for i, r in rows.items():
        assert r["copy_of"] in (None, 5, 40) and (r["class_id"] == i or r["n_links"])


def test_fuzzy_passage(spark):
    from .conftest import SCHEMA, invented

    passage = invented(1, 80).split(" ")
    changed = [w if i % 25 != 24 else "other" for i, w in enumerate(passage)]
    rows = [(0, f"{invented(2, 50)} {' '.join(passage)} {invented(3, 40)}", "", ""),
            (1, f"{invented(4, 70)} {' '.join(changed)} {invented(5, 30)}", "", ""),
            (2, invented(6, 200), "", "")]
    got = {r["doc"]: r for r in passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["class_id"] == got[1]["class_id"] == 0 and got[2]["n_links"] == 0
    (found,) = got[0]["passages"] + got[1]["passages"]
    assert found["words"] >= 75


def test_chain_over_a_gap_is_parted():
    """Two equal runs in different surroundings, near enough to be chained."""
    from .conftest import invented

    one, two, here, there = (invented(s, n) for s, n in ((31, 45), (32, 45), (33, 30), (34, 30)))
    a, b = f"{one} {here} {two}", f"{one} {there} {two}"
    anchors = [(0, 0), (len(f"{one} {here} ".encode()), len(f"{one} {there} ".encode()))]
    found = passages.aligned(a.encode(), b.encode(), anchors, 8, 36, 0.9)
    assert sorted(f[4] for f in found) == [45, 45]


def test_chain_is_the_best(spark):
    rng = random.Random(8)
    for _ in range(200):
        matches = sorted({(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(1, 9))})
        best = {}
        for x, y in matches:
            best[x, y] = 4 + max([0.0] + [
                best[u, v] - 0.2 * (x - u + y - v) for u, v in best if u < x and v < y
            ])
        score, path = passages.chains(matches, 4, 0.2)[0]
        assert score == pytest.approx(max(best.values()))
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(path, path[1:]))


def test_passages_odd_rows(odd, nothing):
    rows = passages.shared_passages(odd).collect()
    assert len(rows) == odd.count() and all(r["n_links"] == 0 and r["passages"] == [] for r in rows)
    assert passages.shared_passages(nothing).count() == 0


def test_repeated_word_is_no_blowup(spark):
    from .conftest import SCHEMA

    rows = [(i, "same " * 5000 + str(i), "", "") for i in range(4)]
    got = passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["class_id"] for r in got} == {0}


# --- pieces, ids, packing ---


TEXT = st.text(
    st.sampled_from("ab1'stmdrvel  \n\t!.é٣ 　\x85\x1c​𝒳😀") | st.characters(exclude_categories=["Cs"]), max_size=30
)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_pieces(texts):
    import regex

    found, begin = split_pieces(texts)
    got = [[p.decode() for p in found[a:b]] for a, b in zip(begin[:-1], begin[1:])]
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_merges(texts):
    plain, table = tiktoken_encoding(), byte_bpe.ranks(RANKS)
    for t in texts:
        raw, _ = byte_bpe._cache(RANKS).ids([t])
        ids = np.frombuffer(raw, "<i4")
        assert ids.tolist() == plain.encode_ordinary(t)
        assert table.decode(ids)[0].tobytes() == t.encode()


def test_long_pieces():
    rng = random.Random(2)
    plain, table = tiktoken_encoding(), byte_bpe.ranks(RANKS)
    pieces = ["a" * 3000, "".join(rng.choice("abcdeth") for _ in range(2500)), "x" * 256, "y" * 257, "a" * 2, "ab"]
    got = [np.frombuffer(b, "<i4").tolist() for b in table.encode([p.encode() for p in pieces])]
    assert got == [plain.encode_ordinary(p) for p in pieces]


def test_encode_and_decode(odd, nothing):
    plain = tiktoken_encoding()
    out = byte_bpe.decode(byte_bpe.encode(odd, RANKS), RANKS)
    assert out.columns == [*odd.columns, "ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == plain.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(nothing, RANKS).count() == 0
    both = byte_bpe.encode(odd, RANKS, decoded="back").collect()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in both)


def test_decode_takes_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [64, 64])], "i int, ids array<int>")
    assert {r["i"]: bytes(r["decoded"]) for r in byte_bpe.decode(df, RANKS).collect()}[2] == b""


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [x.ids + [0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_added_tokens_have_their_ids(spark):
    mark = "<|endoftext|>"
    texts = ["abc " + mark + " def", mark, mark + mark, mark + "x", "x" + mark, "a\n" + mark + "\n\nb", "<|endoftext|", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.token_pieces(df, JSON, with_ids=True).collect()
    got = {r["doc"]: r["ids"] for r in rows}
    assert [got[i] for i in range(len(texts))] == library_ids(texts)
    assert 50256 in got[0] and 50256 not in got[6]


def test_distinct_pieces(monkeypatch):
    raw = b"ab ab abc ab" * 3
    first = np.array([0, 3, 6, 10, 12])
    stop = np.array([2, 5, 9, 12, 14])
    for table in (None, np.zeros(256, dtype=np.uint64)):
        if table is not None:
            # all hashes equal: told apart by the bytes
            up = np.ones(1 << 16, dtype=np.uint64)
            monkeypatch.setattr(pretokens, "_mixers", lambda size: (table, up, up))
        pieces, number = pretokens.distinct_pieces(raw, first, stop)
        assert [pieces[n] for n in number] == [b"ab", b"ab", b"abc", b"ab", b"ab"] and len(pieces) == 2


def test_cache_is_bounded():
    cache = pretokens.PieceCache(lambda pieces: [b"\1\0\0\0" * len(p) for p in pieces], 2000)
    for n in range(40):
        ids, begin = cache.ids([f"one{n} two{n} three", "", f"one{n}"])
        assert begin.tolist() == [0, len(f"one{n} two{n} three"), len(f"one{n} two{n} three"), len(ids) // 4]
        assert cache.held < 2600


def test_pieces_of_documents(odd, corpus):
    for df in (odd, corpus):
        rows = packing.token_pieces(df, JSON, capacity=50, with_ids=True).collect()
        want = Counter((i, tuple(x)) for (i, t), x in zip(texts_of(df), library_ids([t for _, t in texts_of(df)])))
        whole, held = Counter(), []
        for r in rows:
            if r["piece"] == 0 and held:
                whole[held[0]["doc"], tuple(x for h in held for x in h["ids"])] += 1
                held = []
            held.append(r)
            data = np.array(r["ids"], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data) and r["length"] == len(r["ids"]) <= 50
            assert r["piece"] == 0 or r["length"] == 50
            assert r["start"] == sum(h["length"] for h in held[:-1])
        whole[held[0]["doc"], tuple(x for h in held for x in h["ids"])] += 1
        assert whole == want


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(map(sorted, bins))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit(lengths):
    bins, offsets = packing.best_fit(np.array(lengths, dtype=np.int64), 40)
    held = defaultdict(list)
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths)):
        assert o == sum(held[b])
        held[b].append(n)
    assert all(sum(v) <= 40 for v in held.values())
    assert sorted(map(sum, held.values())) == sorted(map(sum, plain_best_fit(lengths, 40)))


@pytest.mark.parametrize("per_task", [1 << 15, 40])
def test_pack(corpus, per_task):
    pieces = packing.token_pieces(corpus, JSON, capacity=300)
    rows = packing.pack(pieces, capacity=300, per_task=per_task).collect()
    assert len(rows) == pieces.count()
    held = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held[r["sequence_id"]]
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 300
    if per_task > 1000:
        assert len(held) <= -(-sum(held.values()) // 300) * 1.25


def test_pack_odd_rows(odd, nothing):
    rows = packing.pack(packing.token_pieces(odd, JSON)).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert packing.pack(packing.token_pieces(nothing, JSON)).count() == 0


# --- pipeline ---


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    docs = corpus.withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    prints = plain_components({i: plain_simhash(t) for i, t in texts_of(corpus)})
    kept = corpus
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == corpus.columns
    want = library_ids([t for _, t in sorted(texts_of(kept))])
    assert {i for i, _ in texts_of(kept)} == {r["doc_id"] for r in rows}
    assert set(prints.values()) == {r["doc_id"] for r in rows}
    for (i, _), ids in zip(sorted(texts_of(kept)), want):
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            data = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data)


def test_pipeline_without_documents(spark, tmp_path, nothing):
    import corpus_pipeline

    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
