"""Places that a review found to do less than the whole job."""

import random

import numpy as np
import pytest

from rankweave.llm import language_id, minhash, passages, simhash

from .conftest import SCHEMA, invented
from .test_url_vectors_minhash import jaccard, shingles


@pytest.mark.parametrize("words", [5, 3])
def test_near_copies_by_similarity(spark, words):
    rng = random.Random(3)
    rows = []
    for i in range(25):
        text = invented(300 + i, 200).split(" ")
        rows.append((len(rows), " ".join(text), "en", f"s{i}"))
        for n in (1, 3, 4, 9):
            copy = list(text)
            for at in rng.sample(range(len(copy)), n):
                copy[at] = f"y{at}"
            rows.append((len(rows), " ".join(copy), None, "s"))
    rows += [(3, rows[3][1], "en", "s"), (500, None, "", ""), (501, " ", "", "")]
    sets = [shingles(r[1], words) for r in rows]
    links = [[j for j, b in enumerate(sets) if jaccard(a, b) >= 0.8] for a in sets]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in n) for n in links]
    # the row with the smallest id, not the first row
    want = sorted({min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)})
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.drop_near_copies(df, words=words, similarity=0.8)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    # groups of two bits leave many of them
    assert len(want) < simhash.drop_near_copies(df).count()


@pytest.mark.parametrize("words", [30_000, 130_000])
def test_long_texts_are_as_alike_as_they_are(words):
    rng = np.random.default_rng(words)
    own, other = (" ".join(map(str, rng.integers(0, 1 << 40, words))) for _ in range(2))
    first = own.split(" ")
    half = " ".join(first[: words // 2] + other.split(" ")[: words - words // 2])
    rows = minhash.fingerprint_texts([own, other, half, own])
    assert minhash.likeness(rows[:1], rows[1:2])[0] < 0.02
    assert abs(minhash.likeness(rows[:1], rows[2:3])[0] - 1 / 3) < 0.17
    assert minhash.likeness(rows[:1], rows[3:])[0] == 1.0
    # the 16 bits are spread over their whole range
    assert abs(rows[:2].mean() / 65535 - 0.5) < 0.1


def test_texts_without_words_have_their_own_signature():
    rows = minhash.fingerprint_texts([None, " ", "a"])
    assert (rows[:2] == 65535).all() and minhash.likeness(rows[:1], rows[2:])[0] < 0.05


def test_fuzzy_passages_with_close_changes(spark):
    rows, changes = [], [9, 10, 11, 12, 13]
    for n, every in enumerate(changes * 6):
        own = invented(9000 + n, 60).split(" ")
        other = [w if i % every != every - 1 else f"z{i}" for i, w in enumerate(own)]
        for side, words in enumerate((own, other)):
            text = [invented(9100 + 2 * n + side, 50), " ".join(words), invented(9200 + 2 * n + side, 50)]
            rows.append((2 * n + side, " ".join(text), "", ""))
    got = passages.shared_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    # eight equal words are a seed, wherever they are; 36 equal ones are not asked for
    assert {r["doc"]: r["class_id"] for r in got} == {r[0]: r[0] // 2 * 2 for r in rows}
    assert all(r["n_links"] == 1 for r in got)


def test_unlabelled_corpus_keeps_texts_with_letters(spark):
    texts = ["some words of a text", None, "12 34 !?", "", "ein anderer Text"]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    kept = language_id.keep_identified(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4]


def test_short_texts_are_bundled_in_bounded_blocks(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 3000)], names=["text"])
    sizes = [part.num_rows for part in language_id._slices([batch])]
    assert sum(sizes) == 3000 and max(sizes) <= language_id.ROWS


def test_near_copies_with_a_map_column(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, {"a": 1}), (2, text, {"b": 2}), (3, "else", None)], "doc_id int, text string, m map<string,int>")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == [1, 3]


def test_next_text_of_text_ids(spark):
    ids = [f"id{i:03d}" for i in range(40)] + ["é", "z"]
    rows = [(i, f"text number {n} of some words {n * 7}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows[::-1], "doc_id string, text string")
    got = {r["doc"]: r["edited"] for r in minhash.compare_with_next(df).collect()}
    texts, order = dict(rows), sorted(ids)
    for i, after in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        assert got[i] == texts[i][: len(texts[i]) - half] + texts[after][:half]
