"""Toxicity from a bidirectional gated recurrent network with attention pooling.

A word's inputs are one value for the word and one for each of its first three to
eight and last three to six bytes: how much more often toxic training documents
hold them than clean ones, on a log scale and drawn to zero where they are rare.
The network reads windows of ``LENGTH`` words, each overlapping the next by half,
in both directions; attention pools its states to one value per window. A
document's score combines its highest window and the number of windows that
speak for toxicity, over all windows of the whole text.

Network and values are learned with numpy on the driver from a bounded sample: at
most ``max_documents`` labelled documents, those with the least hash of their id.
Of a toxic document the strongest window is an example, of a clean one the two
strongest and one other. While learning, a document's own part in the values is
left out.

Defined results: null and empty texts have no window and get the score of the
weakest evidence. Repeated rows are scored each. A null id is never in the
sample. Without labels of both classes every score is the share of toxic labels,
0.0 without any. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from metaeval.llm import flat
from metaeval.llm.line_crf import held_out_id, sample_ids
from metaeval.llm.registry import query

LENGTH, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
SLOT_BITS = 18
STARTS, ENDS = range(3, 9), range(3, 7)
INPUTS = 1 + len(STARTS) + len(ENDS)
MAX_DOCUMENTS = 6000
EPOCHS, BATCH, RATE = 6, 128, 0.01
TOXIC_FROM = 0.3
FLOOR = -12.0
WINDOWS_AT_ONCE = 4096


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of every word's inputs, and its row."""
    data = flat.LOWER[data]
    starts, ends, row = flat.runs(data, offsets, flat.ALNUM)
    sums = flat.prefix_sums(data)
    spans = [(starts, ends, 0)]
    spans += [(starts, np.minimum(starts + k, ends), k) for k in STARTS]
    spans += [(np.maximum(ends - k, starts), ends, 16 + k) for k in ENDS]
    out = np.empty((len(starts), INPUTS), np.int64)
    for i, (a, b, kind) in enumerate(spans):
        out[:, i] = (flat.mixed(flat.span_hashes(sums, a, b) + np.uint64(kind)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return out, row


def _windows(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of every window."""
    words = np.bincount(row, minlength=n)
    many = np.where(words > 0, np.maximum(1, -(-(words - STRIDE) // STRIDE)), 0)
    of = np.repeat(np.arange(n), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    start = first[of] + nth * STRIDE
    return start, np.minimum(LENGTH, first[of] + words[of] - start), of


def _gathered(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (step, window, input) and which steps hold a word."""
    step = np.arange(LENGTH)[:, None]
    mask = step < size[None, :]
    return x[np.minimum(start[None, :] + step, len(x) - 1)] * mask[:, :, None], mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _shapes() -> dict[str, tuple[int, ...]]:
    one = {"W": (INPUTS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,)}
    return {f"{k}{d}": v for d in "fb" for k, v in one.items()} | {"A": (2 * HIDDEN, ATTENTION), "a": (ATTENTION,), "v": (ATTENTION,), "w": (2 * HIDDEN,), "c": (1,)}


def _direction(p: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one direction, in the order of the words."""
    steps = range(LENGTH) if d == "f" else range(LENGTH - 1, -1, -1)
    projected = x @ p["W" + d] + p["b" + d]
    h = np.zeros((x.shape[1], HIDDEN), x.dtype)
    states, kept = np.empty((LENGTH, x.shape[1], HIDDEN), x.dtype), {}
    for t in steps:
        side = h @ p["U" + d]
        gates = _sigmoid(projected[t, :, :2 * HIDDEN] + side[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(projected[t, :, 2 * HIDDEN:] + r * side[:, 2 * HIDDEN:])
        m = mask[t][:, None]
        after = np.where(m, new + z * (h - new), h)
        if keep:
            kept[t] = (h, z, r, new, side[:, 2 * HIDDEN:], m)
        states[t] = h = after
    return states, kept


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """The logit of every window; what the backward pass needs if asked for."""
    sides = {d: _direction(p, d, x, mask, keep) for d in "fb"}
    states = np.concatenate([sides["f"][0], sides["b"][0]], 2)
    looked = np.tanh(states @ p["A"] + p["a"])
    weight = np.where(mask, looked @ p["v"], -1e9)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    logit = pooled @ p["w"] + p["c"]
    return (logit, (sides, states, looked, weight, pooled)) if keep else logit


def backward(p: dict, x: np.ndarray, mask: np.ndarray, kept, slope: np.ndarray) -> dict:
    """Gradients of the parameters, from the slope of the loss by each logit."""
    sides, states, looked, weight, pooled = kept
    g = {"w": pooled.T @ slope, "c": np.array([slope.sum()])}
    by_pooled = slope[:, None] * p["w"]
    by_weight = (states * by_pooled).sum(2)
    by_states = weight[:, :, None] * by_pooled
    by_score = weight * (by_weight - (weight * by_weight).sum(0))
    g["v"] = np.einsum("twa,tw->a", looked, by_score)
    inner = by_score[:, :, None] * p["v"] * (1 - looked ** 2)
    g["A"], g["a"] = np.einsum("twh,twa->ha", states, inner), inner.sum((0, 1))
    by_states = by_states + inner @ p["A"].T
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        own, memory = by_states[:, :, part], sides[d][1]
        carried = np.zeros_like(own[0])
        by_projected, g["U" + d] = np.zeros(x.shape[:2] + (3 * HIDDEN,)), np.zeros_like(p["U" + d])
        for t in (range(LENGTH - 1, -1, -1) if d == "f" else range(LENGTH)):
            h, z, r, new, side, m = memory[t]
            down = own[t] + carried
            out = np.where(m, down, 0)
            by_new = out * (1 - z) * (1 - new ** 2)
            by_z = out * (h - new) * z * (1 - z)
            by_r = by_new * side * r * (1 - r)
            by_projected[t] = np.concatenate([by_z, by_r, by_new], 1)
            by_side = np.concatenate([by_z, by_r, by_new * r], 1)
            g["U" + d] += h.T @ by_side
            carried = np.where(m, out * z, down) + by_side @ p["U" + d].T
        g["W" + d] = np.einsum("twi,twk->ik", x, by_projected)
        g["b" + d] = by_projected.sum((0, 1))
    return g


@dataclass
class Model:
    """Counts behind the inputs, the network, and the curve from evidence to score."""

    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int
    network: dict = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = None

    def values(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
        odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        return (odds * (toxic + clean) / (toxic + clean + 5)).astype(np.float32)

    def inputs(self, slots: np.ndarray, row: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """The inputs of all words; with labels, without what each document itself added to the counts."""
        if labels is None:
            return self.table()[slots]
        own = labels[row][:, None]
        return self.values(self.toxic[slots] - own, self.clean[slots] - (1 - own), self.n_toxic - own, self.n_clean - (1 - own))

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = self.values(self.toxic, self.clean, self.n_toxic, self.n_clean)
        return self._table

    def evidence(self, slots: np.ndarray, row: np.ndarray, n: int, labels: np.ndarray | None = None) -> np.ndarray:
        """For each text: its highest window's logit, and the logarithm of the summed window probabilities."""
        start, size, of = _windows(row, n)
        x = self.inputs(slots, row, labels)
        logits = np.empty(len(start))
        for first in range(0, len(start), WINDOWS_AT_ONCE):
            part = slice(first, first + WINDOWS_AT_ONCE)
            logits[part] = forward(self.network, *_gathered(x, start[part], size[part]))
        best = np.full(n, FLOOR)
        np.maximum.at(best, of, np.maximum(logits, FLOOR))
        return np.stack([best, np.log(np.exp(FLOOR) + np.bincount(of, _sigmoid(logits), n))], 1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return _sigmoid(evidence @ self.curve[:2] + self.curve[2])


def _fit_network(x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict:
    """x: (window, step, input)."""
    rng = np.random.default_rng(7)
    p = {k: rng.normal(0, 0.3 if k[0] in "WUA" else 0.1, s) for k, s in _shapes().items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    weight = np.where(labels == 1, max(1.0, 0.3 * (labels == 0).sum() / max(1, (labels == 1).sum())), 1.0)
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for first in range(0, len(order), BATCH):
            at = order[first:first + BATCH]
            inputs, here = x[at].transpose(1, 0, 2).astype(float), mask[at].T
            logit, kept = forward(p, inputs, here, True)
            g = backward(p, inputs, here, kept, weight[at] * (_sigmoid(logit) - labels[at]) / len(at))
            t += 1
            for k in p:
                grad = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in p.items()}


def _fit_curve(evidence: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, slightly drawn to zero."""
    x = np.concatenate([evidence, np.ones((len(evidence), 1))], 1)
    b = np.zeros(3)
    for _ in range(50):
        q = _sigmoid(x @ b)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (labels - q) - 0.1 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit_documents(documents: DataFrame, labelled: DataFrame, held_out: Column, max_documents: int = MAX_DOCUMENTS) -> Model:
    """Learn from labelled documents: columns id, text, and id, label (1 for toxic)."""
    spark = documents.sparkSession
    flat.small_batches(spark)
    sample = F.broadcast(sample_ids(labelled, held_out, max_documents))  # at most max_documents rows
    rows = flat.written(documents.join(sample, "id").select("id", F.col("label").cast("long").alias("label"), "text"))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    none = np.zeros(1 << SLOT_BITS, np.int64)
    if not n_toxic or not n_clean:
        return Model(none, none, n_toxic, n_clean, constant=n_toxic / max(1, n_toxic + n_clean))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                slots, row = word_slots(data, offsets)
                pair = np.unique((row[:, None] << SLOT_BITS | slots).ravel())
                label = labels[first:end][pair >> SLOT_BITS]
                slot, n = np.unique(pair & ((1 << SLOT_BITS) - 1) | label << SLOT_BITS, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    # at most two rows per slot
    counts = rows.mapInArrow(held, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(2 << SLOT_BITS, np.int64)
    both[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    model = Model(both[1 << SLOT_BITS:], both[:1 << SLOT_BITS], n_toxic, n_clean)
    shared = spark.sparkContext.broadcast(model)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                slots, row = word_slots(data, offsets)
                if not len(row):
                    continue
                x = shared.value.inputs(slots, row, labels[first:end])
                start, size, of = _windows(row, end - first)
                strong = np.concatenate([[0], np.cumsum(np.maximum(x.max(1), 0) ** 2)])
                strength = strong[start + size] - strong[start]
                order = np.lexsort((-strength, of))
                rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
                many = np.bincount(of, minlength=end - first)[of[order]]
                label = labels[first:end][of[order]]
                chosen = np.where(label == 1, rank == 0, (rank < 2) | (rank == many // 2))
                at = order[chosen]
                gathered, mask = _gathered(x, start[at], size[at])
                yield pa.RecordBatch.from_arrays([
                    pa.array(label[chosen]), pa.array([g.astype(np.float32).tobytes() for g in gathered.transpose(1, 0, 2)], pa.binary()), pa.array(size[at])],
                    names=["label", "x", "size"])

    found = sorted(rows.mapInArrow(examples, "label long, x binary, size long").collect())
    x = np.stack([np.frombuffer(r["x"], np.float32).reshape(LENGTH, INPUTS) for r in found])
    mask = np.arange(LENGTH)[None, :] < np.array([r["size"] for r in found])[:, None]
    model.network = _fit_network(x, mask, np.array([r["label"] for r in found]))
    learned = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                e = learned.value.evidence(*word_slots(data, offsets), end - first, labels[first:end])
                yield pa.RecordBatch.from_arrays([pa.array(labels[first:end]), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["label", "best", "total"])

    e = sorted(rows.mapInArrow(judged, "label long, best double, total double").collect())
    model.curve = _fit_curve(np.array([[r["best"], r["total"]] for r in e]), np.array([r["label"] for r in e], float))
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """id and score of every document; columns id, text."""
    spark = documents.sparkSession
    flat.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                n = end - first
                evidence = shared.value.evidence(*word_slots(data, offsets), n) if shared.value.constant is None else np.zeros((n, 2))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), pa.array(shared.value.scores(evidence))], names=["id", "score"])

    rows = documents.select("id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))


@query()
def op6_toxicity_gru(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    out = scored(documents, fit_documents(documents, labelled, held_out_id()))
    return out.select(F.col("id").alias("doc_id"), held_out_id().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
