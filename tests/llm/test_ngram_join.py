import itertools
import random
import re

import numpy as np
import pytest

from metaeval.llm import ngram_join as j
from metaeval.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[root(i)]) for i in range(len(rows))), key=str)


def result(df):
    return sorted(((r["id"], r["n"], r["component_id"]) for r in j.with_component(*j.near_duplicates(df)).collect()), key=str)


def test_documents(docs, texts):
    assert result(docs) == brute_force(list(texts.items()))


def test_odd_rows(odd, none):
    assert result(odd) == brute_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert result(none) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_of_few_texts(spark, seed):
    """Many copies, some linked only through others, some just below the threshold."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for group in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 90]))]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(text))
                text[k:k + rng.randint(0, 1)] = [rng.choice(words)]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)


def test_prefix_filter_is_safe():
    for n in range(1, 200):
        for m in range(n, 200):
            need = (3 * (n + m) + 6) // 7
            if need <= n:
                assert j.prefix_size(n) >= n - need + 1 and j.prefix_size(m) >= m - need + 1
    a = np.arange(10, dtype=np.uint64)
    assert len(j.prefix(a, np.zeros(10, np.int64), None)) == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (31, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(32)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
