"""URL verdicts, vector links and MinHash against plain versions; the registered SQL."""

import os
import random
import re

import numpy as np
import pytest
from oracle import compare, duck

from rankweave.llm import embedding_dedup, minhash, url_filter
from rankweave.llm.queries import ORACLES, QUERIES
from rankweave.llm.url_filter import Rule

from .conftest import SCHEMA, invented

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RULES = [Rule.parse("allow", "org/"), Rule.parse("block", "a.org/x"), Rule.parse("block", "com/de/")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13


# --- URLs ---


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.ORG/x/1", "http://b.a.org/x", "http://ba.org/x",
    "http://org/", "http://org", "https://É.ORG/ä?q#f", "http://www.c.com/de/1", "http://c.com/de", "http://c.net/p/?utm_a=1",
    "https://www.C.net/p", "http://c.net/p?z=1&utm_b=2", "http://c.net/p?z=1", "http://c.net/q", "ftp://c.net?x=http://d",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS + ["http://c.net/p"] * 2)],
                                  "page_id long, url string, verdict string, canon int")
    listed = spark.createDataFrame([("http://c.net/p",), (None,), ("http://c.net/p?z=1",), ("http://a.org/y",)], "url string")
    got = url_filter.judge_urls(pages, listed, RULES)
    assert got.columns == ["page_id", "url", "verdict", "canon", "host", "path", "rule", "verdict"]
    rows = {r[0]: tuple(r)[4:] for r in got.collect()}
    assert len(rows) == pages.count()
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert rows[i][:3] == (host, path, best and best.text)
        if best:
            assert rows[i][3] == best.verdict
    blocked = {URLS[i] for i, r in rows.items() if i < len(URLS) and r[3] == "block" and r[2] is None}
    assert blocked == {"http://c.net/p?utm_a=1".replace("p?", "p/?"), "https://www.C.net/p", "http://c.net/p?z=1&utm_b=2", "http://c.net/p?z=1"}


def test_bloom_filter(spark):
    listed = spark.range(3000).selectExpr("concat('u', id) AS canon")
    asked = spark.range(60000).selectExpr("concat('u', id) AS canon")
    got = {r[0] for r in url_filter.possible_hits(asked, "canon", listed, "canon").collect()}
    want = {f"u{i}" for i in range(3000)}
    assert want <= got and len(got - want) < 600


def test_large_filters_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.net/p") for i in range(400)], "page_id long, url string")
    listed = pages.where("page_id < 10")
    small = {tuple(r) for r in url_filter.judge_urls(pages, listed, []).collect()}
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    assert {tuple(r) for r in url_filter.judge_urls(pages, listed, []).collect()} == small
    assert sum(r[-1] == "block" for r in small) == 80


def test_urls_without_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://c.net/p")], "page_id long, url string")
    assert url_filter.judge_urls(none, none, RULES).count() == 0
    assert url_filter.judge_urls(some, none, RULES).collect()[0]["verdict"] == "allow"


# --- vectors ---


def plain_links(rows, threshold=0.93):
    def fine(v, label):
        return v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = [[] for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a == b and fine(v, a) and fine(w, b) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i].append(j)
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min([root[i], *(root[j] for j in links[i])])
    ids = [min(r[0] for r, x in zip(rows, root) if x == root[i]) for i in range(len(rows))]
    return sorted((r[0], len(n), c, r[0] == c) for r, n, c in zip(rows, links, ids))


def test_vectors_of_any_size(spark):
    """Squares of these components leave the range of a double."""
    base = [[1.0, 2.0, -0.5], [1.0, 2.01, -0.5], [-1.0, 2.0, 0.5]]
    rows = [(3 * n + i, [x * size for x in v], 1) for n, size in enumerate((1.0, 1e200, 1e-200, 1e307)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (7, 0) if i % 3 < 2 else (3, 2) for i in range(12)}


@pytest.mark.parametrize("block", [2048, 8])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal((12, 24))
    for i in range(150):
        v = centre[i % 12] + rng.standard_normal(24) * (0.05 if i % 3 else 0.4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200 + i, rows[4][1], 0) for i in range(5)] + [(4, rows[4][1], 0)]
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [None] * 24, 1),
             (304, rows[1][1], None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 2, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = embedding_dedup.near_vectors(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == plain_links(rows)


def test_vectors_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(none).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * rng.standard_normal((200, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sketch = embedding_dedup.Sketch(unit)
    a, b = np.arange(200), np.arange(200, 400)
    exact = np.einsum("ij,ij->i", unit[a], unit[b])
    estimate = np.einsum("ij,ij->i", sketch.code[a], sketch.turned[b]) / sketch.factor[a]
    assert abs((estimate - exact).mean()) < 0.02
    assert (sketch.upper(a, b) >= exact).all()


# --- MinHash ---


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("width", [1, 7])
def test_next_text(spark, corpus, width):
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rows = {r["doc"]: r for r in minhash.compare_with_next(corpus).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    texts = [t for _, t in sorted((r["doc_id"], r["text"]) for r in corpus.collect())]
    off = []
    for i, text in enumerate(texts):
        other, r = texts[(i + 1) % len(texts)], rows[i]
        half = len(text) // 2
        assert r["edited"] == text[: len(text) - half] + other[:half] and r["n_chars"] == len(text)
        off.append(r["near_edited"] - jaccard(shingles(text), shingles(r["edited"])))
        off.append(r["near_next"] - jaccard(shingles(text), shingles(other)))
    assert np.abs(off).max() < 0.25 and abs(np.mean(off)) < 0.03
    assert rows[5]["fingerprint"] == rows[41]["fingerprint"] != rows[6]["fingerprint"]


def test_next_text_odd_rows(spark, odd, nothing):
    rows = minhash.compare_with_next(odd).collect()
    assert len(rows) == odd.count()
    same = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(same[0]) == 1
    assert minhash.compare_with_next(nothing).count() == 0
    one = minhash.compare_with_next(spark.createDataFrame([(1, "ab cd", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited"] == "ab ab"


@pytest.mark.parametrize("block", [512, 2])
def test_minhash_groups(spark, block):
    rng = random.Random(5)
    rows = []
    for i in range(12):
        words = invented(i, 120).split(" ")
        for j in range(4):
            copy = list(words)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = f"x{i}{j}"
            rows.append((len(rows), " ".join(copy), "", ""))
    rows += [(100, rows[0][1].upper().replace("É", "é").replace("Ü", "ü"), "", ""), (101, None, "", ""), (102, " ", "", ""), (102, " ", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = [shingles(r[1]) for r in rows]
    links = [[j for j in range(len(rows)) if j != i and jaccard(a, sets[j]) >= 0.8] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in n)]) for i, n in enumerate(links)]
    want = sorted((r[0], len(n), rows[x][0]) for r, n, x in zip(rows, links, root))
    got = sorted(tuple(r) for r in minhash.minhash_groups(df, block=block).collect())
    assert got == want


def test_minhash_groups_odd_rows(odd, nothing):
    assert minhash.minhash_groups(odd).count() == odd.count()
    assert minhash.minhash_groups(nothing).count() == 0
