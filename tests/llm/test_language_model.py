import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from metaeval.llm import language_model as m

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows):
    tokens = [WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5))
                   for (i, _), t, h in zip(rows, tokens, held)), key=str)


def scored(df):
    return m.scored(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def result(df):
    rows = scored(df).collect()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    return sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), key=str)


def test_base_scores(docs, texts):
    assert result(docs) == brute_force(list(texts.items()))


def test_rare_words_are_joined(docs, texts, monkeypatch):
    monkeypatch.setattr(m, "COMMON", 50)
    assert result(docs) == brute_force(list(texts.items()))


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == brute_force(rows)
    assert scored(none).count() == 0
    alone = odd.filter("doc_id = 13")  # held out: nothing to learn from
    if zlib.crc32(b"13") % 7 == 2:
        assert scored(alone).first()["train_tokens"] == 0


def test_the_filter_misses_no_count(docs, texts):
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    words = m._counted(rows, range(1, 2))
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    model = m.train(rows, words, n, v)
    keys = words.toPandas()
    got = model.counts(keys["gram"].to_numpy(np.int64).view(np.uint64))
    # a count is read back within its level, or above it where bits meet by chance
    assert (got * m.BASE >= keys["n"].to_numpy() * 0.99).all()
    assert (got <= keys["n"].to_numpy() * m.BASE + 1).mean() > 0.95


def test_probabilities_sum_to_about_one(docs):
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    words = m._counted(rows, range(1, 2))
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    model = m.train(rows, words, n, v)
    every = words.toPandas()["gram"].to_numpy(np.int64).view(np.uint64)
    context = every[np.argsort(words.toPandas()["n"].to_numpy())[-3]]
    sequence = np.stack([np.full(len(every), context), every], 1).ravel()
    total = (10 ** model.log_probabilities(sequence, np.repeat(np.arange(len(every)), 2))[1::2]).sum()
    assert 0.8 < total < 1.2


def test_known_text_is_likelier(docs):
    rows = scored(docs).collect()
    for held in (False, True):
        some = [r for r in rows if r["held_out"] == held]
        assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)


def test_rare_ngrams_stay_in_a_large_corpus(spark):
    """A trigram that occurs once is stored, however many tokens there are."""
    filler = " ".join(f"w{i % 1000}" for i in range(1_000_000))
    rows = spark.createDataFrame([(0, "rare known phrase")], "id long, text string").unionByName(
        spark.range(1, 11).select("id", F.lit(filler).alias("text")))
    words = m._counted(rows, range(1, 2))
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    assert n > 1 << 23
    data = np.frombuffer(b"rare known phrase", np.uint8)
    found, row = m.tokens_of(data, np.array([0, len(data)]))
    keys = np.concatenate([m.ngrams(found, row, k)[0] for k in (1, 2, 3)])[:-1]
    assert (m.train(rows, words, n, v).counts(keys) >= 1).all()
