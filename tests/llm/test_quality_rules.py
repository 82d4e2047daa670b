import collections
import re

from metaeval.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def counts(df):
    return sorted(((r["id"], *(r[c] for c in q.COUNTS[:5])) for r in q.measured(df).collect()), key=str)


def test_counts(docs, texts, odd, none):
    assert counts(docs) == sorted(((i, *brute_force(t)) for i, t in texts.items()), key=str)
    assert counts(odd) == sorted(((r["doc_id"], *brute_force(r["text"])) for r in odd.collect()), key=str)
    assert counts(none) == []


def test_estimated_votes():
    all_good = int("2" * len(q.RULES), 3)
    one_bad = {r: all_good - 3 ** (len(q.RULES) - 1 - r) for r in range(len(q.RULES))}
    model = q.fit({all_good: 900, **{c: 12 for c in one_bad.values()}, 0: 5})
    assert model[all_good] > 0.7 and all(model[c] < 0.5 for c in one_bad.values())
    assert q.votes_of(one_bad[0]) == [1] + [2] * (len(q.RULES) - 1)
    assert q.fit({}) == {}


def test_held_out_quality(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    measures = q.measured(docs)
    rows = q.judged(measures, q.fit_documents(measures)).collect()
    bad = [r for r in rows if labels.get(r["id"]) == 0]
    good = [r for r in rows if labels.get(r["id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad) and sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_kept_rows_keep_their_columns(odd, none):
    kept = q.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() > 0
    assert all(len((r["text"] or "").split()) >= 50 and r["key"] == "key" for r in kept.collect())
    assert q.keep_good(none).count() == 0
