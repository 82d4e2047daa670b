import itertools

import numpy as np

from metaeval.llm import line_crf as m

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2])
    scores, edges = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    marginal, pairs, log_z = m.forward_backward(scores, lengths, edges)
    want_pairs, at, ends = np.zeros((2, 2)), 0, []
    for n in lengths:
        if not n:
            continue
        weights = {y: np.exp(sum(scores[at + i] for i in range(n) if y[i]) + sum(edges[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(n))}
        total = sum(weights.values())
        ends.append(np.log(total))
        for i in range(n):
            assert abs(marginal[at + i] - sum(w for y, w in weights.items() if y[i]) / total) < 1e-9
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / total
        at += n
    assert np.allclose(pairs, want_pairs) and np.allclose(sorted(log_z), sorted(ends))


def test_held_out_accuracy(spark):
    rows = m.op2_line_crf_quality(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and len(held) > 50
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_odd_rows(spark, odd, none):
    documents = odd.select(odd["doc_id"].alias("id"), "text", "label")
    for labels in ([(1, 1)], [], [(6, 1), (6, 1), (11, 0), (None, 0), (9, None), (12, 0), (2, 1)]):
        labelled = spark.createDataFrame(labels, "id long, label int")
        model = m.fit_documents(documents.drop("label"), labelled, m.held_out_id())
        rows = m.scored(documents, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert m.scored(none.withColumnRenamed("doc_id", "id"), model).count() == 0
