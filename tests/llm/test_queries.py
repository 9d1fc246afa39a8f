"""The registered queries, with their production parameters, against plain versions."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as contract
from rankweave.llm.queries import QUERIES

from .test_text_operators import (
    library_ids,
    plain_components,
    plain_first,
    plain_lines,
    plain_repeats,
    plain_simhash,
    tiktoken_encoding,
)
from .test_url_vectors_minhash import jaccard, plain_links, shingles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    return {r["doc_id"]: (r["text"], r["source"]) for r in sorted(rows)}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_contract_lists_them(spark):
    names = contract.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {"op2_url_filter", "op10_line_dedup"} <= set(contract.oracle_sql())


def test_op1(spark, documents):
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == list(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1


def test_op3(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op3_passages"](spark, SF).collect()}
    words = {i: t.encode().lower().split() for i, (t, _) in documents.items()}
    runs = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 50):
            runs[tuple(w[j : j + 51])].add(i)
    for ids in runs.values():
        if len(ids) > 1:
            assert len({rows[i]["class_id"] for i in ids}) == 1 and all(rows[i]["n_links"] for i in ids)
    for i, r in rows.items():
        for p in r["passages"]:
            a, b = (documents[x][0].encode()[p[f"from_{s}"] : p[f"to_{s}"]].lower().split()
                    for x, s in ((i, "a"), (p["other"], "b")))
            assert p["words"] >= 36 and p["words"] >= 0.8 * max(len(a), len(b))
            assert p["words"] <= min(len(a), len(b)) and p["other"] in r["linked"]


def test_op4(spark, documents):
    rows = {r["doc_id"]: tuple(r)[1:5] for r in QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    want = plain_repeats([t for t, _ in documents.values()], 400)
    assert rows == dict(zip(documents, want)) and sum(w[1] for w in want)


def check_packed(rows, ids):
    """Every document's ids in order, sequences without gaps or overflow."""
    pieces, held = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for n, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            data = np.array(ids[i][at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(data))
            at += r["length"]
        assert at == len(ids[i]) and (len(own) == 1 or at > 2048)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held[r["sequence_id"]]
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048
    assert len(held) <= -(-sum(held.values()) // 2048) * 1.05 + 1


def test_op5(spark, documents):
    ids = dict(zip(documents, library_ids([t for t, _ in documents.values()])))
    check_packed(QUERIES["op5_best_fit_packing"](spark, SF).collect(), ids)


def test_op6(spark, documents):
    plain = tiktoken_encoding()
    for r in QUERIES["op6_byte_bpe"](spark, SF).collect():
        text = documents[r["doc_id"]][0]
        ids = plain.encode_ordinary(text)
        want = (r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
        assert tuple(r) == want


def test_op7(spark, documents):
    prints = {i: plain_simhash(t) for i, (t, _) in documents.items()}
    roots = plain_components(prints)
    rows = QUERIES["op7_simhash"](spark, SF).collect()
    assert {tuple(r) for r in rows} == {(i, f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_op8(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op8_minhash"](spark, SF).collect()}
    ids, off, prints = list(documents), [], {}
    for n, i in enumerate(ids):
        text, other, r = documents[i][0], documents[ids[(n + 1) % len(ids)]][0], rows[i]
        made = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(made.encode()))
        off.append(r["near_edited"] - jaccard(shingles(text), shingles(made)))
        off.append(r["near_next"] - jaccard(shingles(text), shingles(other)))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert np.abs(off).max() < 0.25 and abs(np.mean(off)) < 0.02


def test_op9(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = QUERIES["op9_embedding_dedup"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == plain_links([(r["vec_id"], r["embedding"], r["label"]) for r in table])


def test_pipeline_against_plain_stages(spark, documents):
    known = {i: v for i, v in documents.items() if any(c.isalpha() for c in v[0] or "")}
    texts = dict(zip(known, plain_lines(list(known.values()), 10)))
    roots = plain_components({i: plain_simhash(t) for i, t in texts.items()})
    kept = [i for i in texts if roots[i] == i]
    place = spark.createDataFrame([(i, texts[i]) for i in kept], "i long, t string")
    place = {r[0]: tuple(r)[1:] for r in place.select("i", F.xxhash64(F.lit("id"), "i"), F.xxhash64("t")).collect()}
    final = dict(zip(kept, plain_first([texts[i] for i in kept], [place[i] for i in kept], 256)))
    final = [b.decode("utf-8", "ignore") for b in final.values()]
    rows = contract.queries()["pipeline"](spark, SF).collect()
    check_packed(rows, dict(zip(kept, library_ids(final))))
