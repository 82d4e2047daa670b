"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word gets features of itself and of its neighbours. The
field labels each line good or bad; the forward-backward marginals of its lines,
weighted by their lengths, are a document's share of good text. A logistic curve
on the logit of that share, fitted with the field, makes it the probability that
the document is good.

Lines carry their document's label in a first round of training. In the second
round a line of a bad document that the first field holds to be good counts as
good: bad documents contain good lines too.

The field is fitted on the driver on a bounded sample: the lines of at most
``max_documents`` labelled documents, those with the least hash of their id, and
of a document at most ``MAX_TRAINING_LINES`` lines. Scoring covers every line.

Defined results: null and empty texts, and texts without a word, have the score of
an average document of the sample. Repeated rows are scored each. A null id is
never in the sample. Without labels of both classes every score is the share of
good labels, 0.5 without any. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from metaeval.llm import flat
from metaeval.llm.registry import query

MAX_DOCUMENTS = 4000
MAX_TRAINING_LINES = 300
ROUNDS = 120
GOOD_FROM = 0.7
FEATURES = 13

_TABLES = {
    "space": ~flat.NOT_SPACE, "symbol": b"#*$%&<>@^~=_+{}[]\\/", "mark": b"!?", "pipe": b"|", "digit": b"0123456789",
    "stop": b".,;:", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
}


def _table(x) -> np.ndarray:
    if isinstance(x, np.ndarray):
        return x
    out = np.zeros(256, bool)
    out[list(x)] = True
    return out


_TABLES = {k: _table(v) for k, v in _TABLES.items()}
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, length and row of each line with a word; the features end with those of both neighbours."""
    starts, ends, row = flat.runs(data, offsets, flat.NOT_SPACE)
    first, last, line_row = flat.lines(data, offsets)
    word = np.searchsorted(starts, first)
    n_words = np.searchsorted(starts, last) - word
    has = n_words > 0
    first, last, line_row, word, n_words = first[has], last[has], line_row[has], word[has], n_words[has]
    n = len(first)
    if not n:
        return np.zeros((0, 3 * FEATURES), np.float32), np.zeros(0), line_row

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return (total[last] - total[first]).astype(np.float64)

    sums = flat.prefix_sums(flat.LOWER[data])
    hashes = flat.span_hashes(sums, starts, ends)
    again = np.zeros(len(hashes) + 1, np.int32)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    np.cumsum(same, out=again[1:])
    order = np.lexsort((hashes, row))
    seen = np.zeros(len(hashes), bool)
    seen[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    before = np.zeros(len(hashes) + 1, np.int32)
    np.cumsum(seen, out=before[1:])
    line_hash = flat.span_hashes(sums, first, last)
    order = np.lexsort((line_hash, line_row))
    dup = np.zeros(n, bool)
    dup[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    chars = np.maximum(count(_FIRST_BYTE), 1)
    solid = np.maximum(chars - count(_TABLES["space"]), 1)
    upper, lower = count(_TABLES["upper"]), count(_TABLES["lower"])
    own = np.stack([
        np.ones(n), np.sqrt(count(_TABLES["symbol"]) / solid), np.sqrt(count(_TABLES["mark"]) / solid), np.sqrt(count(_TABLES["pipe"]) / solid),
        np.sqrt(count(_TABLES["digit"]) / solid), np.sqrt(count(_TABLES["stop"]) / solid), upper / np.maximum(upper + lower, 1),
        solid / n_words / 10, np.log1p(n_words) / 5, np.sqrt((again[word + n_words] - again[word]) / n_words),
        (before[word + n_words] - before[word]) / n_words, dup.astype(float), _TABLES["stop"][data[last - 1]].astype(float)], 1).astype(np.float32)
    previous, following = np.zeros_like(own), np.zeros_like(own)
    joined = line_row[1:] == line_row[:-1]
    previous[1:][joined] = own[:-1][joined]
    following[:-1][joined] = own[1:][joined]
    return np.concatenate([own, previous, following], 1), chars, line_row


def _columns(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of the sequences, long ones first, and how many of them reach each step."""
    order = np.argsort(-lengths, kind="stable")
    reach = np.bincount(lengths, minlength=int(lengths.max(initial=0)) + 1)
    alive = len(lengths) - np.cumsum(reach)[:-1]
    return order, alive.tolist()


def _logadd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, edges: np.ndarray):
    """Marginals of label 1 for each line, pair marginals summed over neighbours, and the log partition.

    ``scores`` are the lines' scores of label 1 against label 0, sequences one after
    the other; ``edges[a, b]`` is the score of label b after label a. Sequences run in
    step, so a step costs one operation over all sequences that reach it.
    """
    total = len(scores)
    order, alive = _columns(lengths)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
    for t, k in enumerate(alive):
        at = begin[:k] + t
        if t == 0:
            forward[at, 1] = scores[at]
            continue
        f = forward[at - 1]
        for b in (0, 1):
            forward[at, b] = _logadd(f[:, 0] + edges[0, b], f[:, 1] + edges[1, b]) + b * scores[at]
    for t in range(len(alive) - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        nxt = backward[at + 1]
        for a in (0, 1):
            backward[at, a] = _logadd(nxt[:, 0] + edges[a, 0], nxt[:, 1] + scores[at + 1] + edges[a, 1])
    both = forward + backward
    log_z = _logadd(both[:, 0], both[:, 1])
    marginal = np.exp(both[:, 1] - log_z)
    inner = np.ones(total, bool)
    ends = np.cumsum(lengths)[lengths > 0] - 1
    inner[ends] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(forward[at, a] + edges[a, b] + b * scores[at + 1] + backward[at + 1, b] - log_z[at]).sum()
    return marginal, pairs, log_z[ends]


@dataclass
class LineField:
    """A fitted field: feature scale, weights of label 1 (good), edges, and the curve of the document score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    curve: tuple[float, float]
    usual: float
    constant: float | None = None

    def lines(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return forward_backward(((features - self.mean) / self.scale) @ self.weights, lengths, self.edges)[0]

    def documents(self, features: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability that each document is good."""
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        row = np.repeat(np.arange(len(lengths)), lengths)
        share = np.full(len(lengths), np.nan)
        if len(features):
            weight = np.bincount(row, chars, len(lengths))
            some = lengths > 0
            share[some] = (np.bincount(row, chars * self.lines(features, lengths), len(lengths)) / np.maximum(weight, 1))[some]
        logit = _logit(np.where(np.isnan(share), self.usual, share))
        return 1 / (1 + np.exp(-(self.curve[0] * logit + self.curve[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _climb(gradient, x: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam ascent."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return x


def fit(features: np.ndarray, chars: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> LineField:
    """Fit on sequences of lines with a label, 1 for good, per document."""
    if not len(labels) or labels.min() == labels.max():
        constant = float(labels.mean()) if len(labels) else 0.5
        return LineField(np.zeros(1), np.ones(1), np.zeros(1), np.zeros((2, 2)), (1.0, 0.0), 0.5, constant)
    mean, scale = features.mean(0), features.std(0) + 1e-3
    mean[0], scale[0] = 0, 1
    x = (features - mean) / scale
    document = np.repeat(labels, lengths)
    line_labels = document.astype(float)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    inner = np.flatnonzero(inner)
    weights, edges = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(2):
        seen = np.zeros((2, 2))
        np.add.at(seen, (line_labels[inner].astype(int), line_labels[inner + 1].astype(int)), 1)
        observed = x.T @ line_labels

        def gradient(p: np.ndarray, seen=seen, observed=observed) -> np.ndarray:
            marginal, pairs, _ = forward_backward(x @ p[:-4], lengths, p[-4:].reshape(2, 2))
            g = np.concatenate([observed - x.T @ marginal, (seen - pairs).ravel()])
            return (g - 1.0 * p) / len(x)

        p = _climb(gradient, np.concatenate([weights, edges.ravel()]), ROUNDS, 0.1)
        weights, edges = p[:-4], p[-4:].reshape(2, 2)
        marginal = forward_backward(x @ weights, lengths, edges)[0]
        line_labels = np.where(document == 1, 1.0, (marginal > 0.5).astype(float))
        # every bad document keeps its worst line as bad
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((marginal, row))
        worst = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        line_labels[worst] = document[worst]
    model = LineField(mean, scale, weights, edges, (1.0, 0.0), float(labels.mean()))
    some = lengths > 0
    logit = _logit(model.documents(features, chars, lengths)[some])
    target = labels[some]

    def slope(p: np.ndarray) -> np.ndarray:
        off = target - 1 / (1 + np.exp(-(p[0] * logit + p[1])))
        return np.array([(off * logit).mean(), off.mean()])

    a, b = _climb(slope, np.array([1.0, 0.0]), 300, 0.05)
    model.curve = (float(a), float(b))
    model.usual = float(1 / (1 + np.exp(-(_logit(np.array(labels.mean())) - b) / max(a, 0.1))))
    return model


def sample_ids(labelled: DataFrame, held_out: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids that are not held out, with their label, chosen by hash: id, label."""
    rows = labelled.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out).select("id", "label")
    return rows.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(limit)


def _lines_of(batch: pa.RecordBatch):
    for first, end, data, offsets in flat.pieces(batch.column("text")):
        features, chars, row = line_features(data, offsets)
        yield first, end, features, chars, np.bincount(row, minlength=end - first)


def fit_documents(documents: DataFrame, labelled: DataFrame, held_out: Column, max_documents: int = MAX_DOCUMENTS) -> LineField:
    """Fit on labelled documents: columns id, text, and id, label."""
    flat.small_batches(documents.sparkSession)
    sample = F.broadcast(sample_ids(labelled, held_out, max_documents))  # at most max_documents rows
    rows = documents.join(sample, "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, features, chars, lengths in _lines_of(batch):
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                parts = [slice(a, min(b, a + MAX_TRAINING_LINES)) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, end - first) for c in ("id", "label")]
                    + [pa.array([features[p].tobytes() for p in parts], pa.binary()), pa.array([chars[p].tobytes() for p in parts], pa.binary())],
                    names=["id", "label", "features", "chars"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("features", T.BinaryType()), T.StructField("chars", T.BinaryType())])
    found = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (r["id"], len(r["features"])))
    if not found:
        return fit(np.zeros((0, 3 * FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, 3 * FEATURES) for r in found]
    return fit(np.concatenate(features), np.concatenate([np.frombuffer(r["chars"]) for r in found]),
               np.array([len(f) for f in features]), np.array([int(r["label"]) for r in found]))


def scored(documents: DataFrame, model: LineField) -> DataFrame:
    """id and score of every document; columns id, text."""
    spark = documents.sparkSession
    flat.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, features, chars, lengths in _lines_of(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(shared.value.documents(features, chars, lengths))], names=["id", "score"])

    rows = documents.select("id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))


def held_out_id(id_column: str = "id") -> Column:
    """A quarter of the ids, by checksum, never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query()
def op2_line_crf_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = scored(documents, fit_documents(documents, labelled, held_out_id()))
    return out.select(F.col("id").alias("doc_id"), held_out_id().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
