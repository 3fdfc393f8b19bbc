import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use themselves
CLASHING = ["rest", "digit", "path", "node", "keys", "uid", "size", "mix", "row", "p", "token", "part", "idx", "shard", "row_id", "label", "urn", "sha1"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(rng, n=120):
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.choice([1, 3, 6, 30, 60])) for _ in range(rng.randrange(1, 5))]
        rows.append([i, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0])
    for i in range(0, n, 6):  # exact and near copies
        other = rows[rng.randrange(n)][1]
        words = other.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows[i][1] = other if i % 4 else " ".join(words)
    odd = [None, "", " \n ", "!!", "\n\n", "É é É", "one", "ONE", "a\x00b", "x" * 5000, prose(rng, 30000), "日本 語 text", None, ""]
    rows += [[n + k, t, None, "z", 0] for k, t in enumerate(odd)]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    """Random documents, odd ones, and extra columns whose names clash."""
    rows = documents(random.Random(3))
    wide = [(*r, *[f"x{k}" for k in range(len(CLASHING))]) for r in rows]
    return spark.createDataFrame(wide, SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def odd_ids(spark):
    """Null ids and rows that repeat."""
    rows = [(None, "a b c d e f g", "en", "s", 0), (None, "a b c d e f g", "en", "s", 0), (1, "same text here now yes", "en", None, 0), (1, "same text here now yes", "en", None, 0), (2, None, None, None, None), (2, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)
