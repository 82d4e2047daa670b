import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use inside; a table may have columns of the same names.
CLASHING = ("id", "key", "n", "row", "text2", "deleted", "score", "label", "hash", "pos", "token", "sig", "component", "ids", "pattern", "kept_id", "rows", "gone", "maybe", "first", "end")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank, one-word and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = sentence(rng, words, 120)
    long = "\n".join(sentence(rng, words, 40) for _ in range(400))
    texts = [None, "", "   ", "\n\n \n", "one", "ab cd", base, base, base + " tail", base.replace("w1 ", "w2 "), long, "x" * 3000, "é漢🙂 " * 200,
             base + "\n" + long[:3000], "\0\x1c\x85 " + base, None]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[1], (None, base, None, None, None), (None, None, None, None, None), (3, base, None, "s", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash."""
    df = spark.createDataFrame(odd_rows(), DOC)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    """No rows."""
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
