import numpy as np

from metaeval.llm import toxicity_gru as t
from metaeval.llm.line_crf import held_out_id

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.3, s) for k, s in t._shapes().items()}
    mask = np.arange(t.LENGTH)[:, None] < np.array([32, 3, 1, 20, 7])[None, :]
    x, y = rng.normal(size=(t.LENGTH, 5, t.INPUTS)) * mask[:, :, None], np.array([1, 0, 1, 0, 1])

    def loss():
        logit = t.forward(p, x, mask)
        return (np.logaddexp(0, logit) - y * logit).sum()

    logit, kept = t.forward(p, x, mask, True)
    g = t.backward(p, x, mask, kept, t._sigmoid(logit) - y)
    for name, value in p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        old, sides = value[at], []
        for step in (1e-5, -1e-5):
            value[at] = old + step
            sides.append(loss())
        value[at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - g[name][at]) < 1e-6


def test_windows_cover_every_word():
    row = np.repeat(np.arange(6), [0, 1, 32, 33, 100, 48])
    start, size, of = t._windows(row, 6)
    seen = set()
    for s, n, r in zip(start, size, of):
        assert (row[s:s + n] == r).all() and 0 < n <= t.LENGTH
        seen.update(range(s, s + n))
    assert len(seen) == len(row)
    assert np.bincount(of, minlength=6).tolist() == [0, 1, 1, 2, 6, 2]


def test_held_out_accuracy(spark):
    rows = t.op6_toxicity_gru(spark, SF).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.85


def test_odd_rows(spark, odd, none):
    documents = odd.select(odd["doc_id"].alias("id"), "text", "label")
    for labels in ([(1, 1)], [], [(6, 1), (6, 1), (11, 0), (None, 0), (9, None), (12, 0), (2, 1), (1, 1)]):
        labelled = spark.createDataFrame(labels, "id long, label int")
        model = t.fit_documents(documents.drop("label"), labelled, held_out_id())
        rows = t.scored(documents, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert t.scored(none.withColumnRenamed("doc_id", "id"), model).count() == 0
