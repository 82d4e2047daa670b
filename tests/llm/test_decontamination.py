import re

from metaeval.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(documents, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(d.SPAN, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for name, text in documents:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    found |= windows[tuple(w[i:i + n])]
                    hit |= set(range(i, i + n))
        out.append((name, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def result(documents, benchmark):
    rows = d.hits_by_document(*d.contamination(documents, benchmark)).collect()
    return sorted(((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=str)


def test_documents(spark, docs, texts):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = result(docs, items)
    assert got == brute_force(texts.items(), [(r["item_id"], r["text"]) for r in items.collect()])
    assert any(n for _, _, n, _ in got)


def test_odd_rows_and_short_items(spark, odd, none):
    base = " ".join(odd.filter("doc_id = 6").first()["text"].split()[20:45])
    items = [(1, base), (2, base), (None, base.upper()), (3, "ab CD"), (4, "one"), (5, None), (6, ""), (7, "..."), (8, "x " * 12), (9, " ".join(base.split()[:10])), (10, "w1 w1 w1")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    # a null item has no name to be listed by
    assert result(odd, benchmark.filter("item_id is not null")) == brute_force(rows, [i for i in items if i[0] is not None])
    assert len(result(odd, benchmark)) == len(rows)
    assert all(n == 0 for _, _, n, _ in result(odd, benchmark.limit(0)))
    assert result(none, benchmark) == []
    kept = d.drop_contaminated(odd, benchmark)
    clean = [t for _, t in rows if brute_force([(0, t)], items)[0][2] == 0]
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted(t or "" for t in clean)
    assert kept.columns == odd.columns
