"""Benchmark decontamination against plain searches."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import decontamination as dec
from rankweave.llm.decontamination import decontaminate, find_matches, longest_matches, word_hashes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def plain(docs, items, width=10):
    """(words, ranges of words hit, items hit) of every text."""
    out = []
    for _, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for item, asked in items:
            asked = plain_words(asked)
            need = min(width, len(asked))
            windows = {tuple(asked[i : i + need]) for i in range(len(asked) - need + 1)} if asked else set()
            for i in range(len(words) - need + 1 if windows else 0):
                if tuple(words[i : i + need]) in windows:
                    hit.update(range(i, i + need))
                    names.update([str(item)] if item is not None else [])
        spans = [(i, min(j for j in range(i, len(words) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((len(words), spans, sorted(names)))
    return out


def texts(seed, count, vocabulary=12, longest=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "漢字", "Q9"]
    return [" ,.\n-"[i % 5].join(rng.choice(words) for _ in range(rng.randint(0, longest))) for i in range(count)]


def found(df):
    rows = df.select("doc_id", "n_words", "hit_spans", "items").collect()
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], r[3]) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"shard": 16}, {"block": 64}, {"shard": 40, "block": 300}])
def test_against_plain(spark, options):
    docs = list(enumerate(texts(1, 60, 4)))
    docs[7] = (7, docs[3][1] + " " + docs[9][1])
    items = [(i, t) for i, t in enumerate(texts(2, 25, 4, 14))] + [(3, "w1 w2"), (None, docs[11][1]), (40, docs[3][1])]
    items += [(41, "w1 never"), (42, docs[3][1]), (43, None), (44, " . ")]
    got = find_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width=4, **options)
    want = [(i, *r) for (i, _), r in zip(docs, plain(docs, items, 4))]
    assert found(got) == sorted(want, key=str) and any(w[2] for w in want)


def test_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(dec, "PIECE", 12)
    docs, items = list(enumerate(texts(5, 30, 3, 90))), list(enumerate(texts(6, 3, 3, 80)))
    items.append((9, docs[2][1]))
    got = find_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width=5, block=200)
    assert found(got) == sorted([(i, *r) for (i, _), r in zip(docs, plain(docs, items, 5))], key=str)


def test_longest_matches(spark):
    rng = random.Random(4)
    docs, items = list(enumerate(texts(3, 30, 5, 80))), list(enumerate(texts(4, 8, 5, 40)))
    items.append((8, " ".join(plain_words(docs[4][1])[5:] + ["w0", "end"])))
    rows = longest_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width=3).collect()
    got = {(r["item"], r["at"]): r for r in rows}
    said = {i: plain_words(t) for i, t in docs}
    for item, text in items:
        asked = plain_words(text)
        for at in range(len(asked)):
            best = 0
            for words in said.values():
                for i in range(len(words)):
                    n = 0
                    while at + n < len(asked) and i + n < len(words) and asked[at + n] == words[i + n]:
                        n += 1
                    best = max(best, n)
            need = min(3, len(asked))
            r = got.get((str(item), at))
            assert (r["length"] if r else 0) == (best if best >= need and at + need <= len(asked) else 0)
            if r:
                assert said[r["doc"]][r["place"] : r["place"] + best] == asked[at : at + best]
    assert rng and rows


def test_odd_rows(spark, odd, nothing):
    items = [(1, "one"), (2, None), (3, ""), (None, "another text"), (4, "naïve CAFÉ Œuvre äö"), (4, "a row")]
    tests = spark.createDataFrame(items, ITEMS).withColumn("extra", F.lit(1))
    rows = odd.select("doc_id", "text").collect()
    got = found(find_matches(odd, tests))
    want = plain(rows, items)
    assert got == sorted([(r["doc_id"], *w) for r, w in zip(rows, want)], key=str)
    whole = find_matches(odd.withColumn("items", F.lit(5)), tests)
    assert whole.columns == [*odd.columns, "n_words", "hit_spans", "items"] and whole.count() == odd.count()
    clean = decontaminate(odd.withColumn("n_words", F.lit(5)), tests)
    assert clean.columns == [*odd.columns, "n_words"]
    assert clean.count() == sum(not w[1] for w in want) < odd.count()
    assert find_matches(nothing, tests).count() == 0
    none = tests.where("item_id > 99")
    assert all(not r[2] and not r[3] for r in found(find_matches(odd, none)))
    assert longest_matches(odd, none).count() == 0 == longest_matches(nothing, tests).count()


def test_steps_end_between_words(monkeypatch):
    """Hashes of words don't depend on where a step ends, nor on their neighbours."""
    parts = [b"one two" * 50, b"", b"x" * 300, "é ü Two".encode(), b"tail"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    whole, owner = word_hashes(data, ends)
    monkeypatch.setattr(dec, "STEP", 16)
    again, _ = word_hashes(data, ends)
    assert (whole == again).all()
    assert [int((owner == i).sum()) for i in range(5)] == [51, 0, 1, 3, 1]
    assert whole[-2] == word_hashes(np.frombuffer(b"two", np.uint8), np.array([3]))[0][0]
