import random

import pytest

#: rows that every operator must stand: nulls, empty texts, white space, repeated rows and ids
ODD = [
    (1, None, None, None),
    (2, "", "en", "s0"),
    (3, " \t\n", "en", None),
    (4, "one", None, "s1"),
    (4, "one", None, "s1"),
    (4, "another text under an id that is taken", "en", "s1"),
    (None, "a row without id", "en", "s2"),
    (None, None, None, None),
    (5, "naïve café ŒUVRE ÄÖ 漢字 😀\x00 'tis I'll we're", "fr", "s2"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def invented(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "é", "ü"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, a very long text, and columns whose names operators use themselves."""
    rows = [*ODD, (6, invented(6, 60_000), "en", "s3")]
    wide = [(*r, 7, "x", 1) for r in rows]
    extra = ", text_key1 int, fingerprint string, mark1 int"
    return spark.createDataFrame(wide, SCHEMA + extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose of made-up words with copies, near copies, shared passages and shared lines."""
    rows = []
    for i in range(60):
        text = "\n".join(invented(1000 * i + j, 30) for j in range(4))
        rows.append([i, text, "en" if i % 3 else "de", f"s{i % 12}"])
    passage = invented(77, 90)
    for i in (3, 9, 21, 33):
        rows[i][1] += "\n" + passage + "\n" + invented(5000 + i, 12)
    for i in (40, 41, 42):
        rows[i][1] = rows[5][1]
    words = rows[7][1].split(" ")
    words[20] = "changed"
    rows[50][1] = " ".join(words)
    for i in range(0, 60, 2):
        rows[i][1] += "\n" + "All rights reserved by nobody."
    rows[8][1] += "\n" + passage + " " + passage
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
