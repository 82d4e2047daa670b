import collections
import random
import re

import compare
import pytest

from metaeval.llm import source_divergence as s

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10, top=10):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(terms.keys())
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {k[1]: c for k, c in counts.items() if k[0] == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}  # noqa: E731,B023
        whole = share(sum(groups.values(), collections.Counter()))
        p = {name: share(c) for name, c in groups.items()}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for name in groups:
            pairs = [(sum(gap(p[name][t], p[other][t]) for t in kept), other) for other in groups if other != name]
            terms = [(gap(p[name][t], whole[t]), t) for t in kept if groups[name][t] and p[name][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.append((lang, name, part, item, value, rank))
    return sorted(out)


def result(df, **options):
    return sorted(map(tuple, s.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def given(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


def test_sql_and_brute_force_say_the_same(spark, docs):
    sf = "/root/testdata/sf0.001"
    assert compare.spark_rows(s.op12_source_divergence(spark, sf)) == compare.sql_rows(compare.connect(sf), s.SQL)
    assert result(docs) == brute_force(given(docs))


@pytest.mark.parametrize("least", [1, 2, 1000])
def test_odd_rows(odd, none, least):
    assert result(odd, min_documents=least) == brute_force(given(odd), least)
    assert result(none) == []


def test_tiles_and_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"{a}{b}é" for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(" ".join(rng.choices(words[:rng.randint(2, 64)], k=rng.randint(0, 60))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 12)}") for _ in range(400)]
    rows += [("", "xx", f"t{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    want = brute_force(rows)
    assert result(df) == want
    monkeypatch.setattr(s, "BLOCK_TERMS", 7)
    monkeypatch.setattr(s, "TILE_SOURCES", 3)
    monkeypatch.setattr(s, "STRETCH", 16)
    monkeypatch.setattr(s, "FLUSH_ENTRIES", 20)
    assert result(df) == want


def test_shares_stay_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(30_000_000_000, 90_000_000_001, 7)], "n long, total long, terms long")
    assert df.select(s.share("n", "total", "terms")).first()[0] == 1 + 10**9 * 30_000_000_002 // 90_000_000_015


def test_stretches_cut_at_separators():
    text = b"ab " * 700_000 + b"x" * 3_000_000 + b" tail"
    assert s.count_terms(text, 0, len(text)) == {b"ab": 700_000, b"x" * 3_000_000: 1, b"tail": 1}
