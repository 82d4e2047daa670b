"""Quality rules by weak supervision.

Each rule votes good or bad on a document or abstains. The documents are counted
by their pattern of votes, expectation-maximisation on these counts estimates
how often each rule votes which way on good and on bad documents, and the
posterior probability of being good takes the place of passing every rule.

The patterns are at most ``3 ** len(RULES)``, whatever the number of documents,
so only their counts reach the driver.

Defined results: a null or empty text has no words and lines; all of its shares
are zero, and it fails the base rule. Repeated rows are judged each by itself.
An empty table gives an empty result; the model then keeps the rules' priors.
Other columns of the input are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from metaeval.llm import flat
from metaeval.llm.registry import query

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
GOOD_FROM = 0.5
MAX_FALSE_ALARM = 0.002
MAX_RECALL = 0.5
#: Rule: measure, bad below, good from, good to, bad above; between them it abstains.
RULES = {
    "words": ("n_words", 20, 50, math.inf, math.inf),
    "word_length": ("mean_word", 2.0, 3.0, 12.0, 20.0),
    "symbols": ("symbol_share", -1, -1, 0.05, 0.1),
    "repeated_lines": ("dup_line_share", -1, -1, 0.1, 0.3),
    "repeated_windows": ("repeat_share", -1, -1, 0.2, 0.5),
    "upper_case": ("upper_share", -1, -1, 0.2, 0.4),
    "marks": ("mark_share", -1, -1, 0.15, 0.4),
    "distinct_words": ("distinct_share", 0.08, 0.15, 1.0, 1.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_marks", "n_distinct")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _repeats(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether an equal one stands earlier in its row, and whether any other does."""
    n = len(keys)
    earlier, any_other = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.lexsort((keys, row))
        same = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
        earlier[order[1:]] = same
        any_other[order[1:]] |= same
        any_other[order[:-1]] |= same
    return earlier, any_other


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a piece."""
    n = len(offsets) - 1
    starts, ends, row = flat.runs(data, offsets, flat.NOT_SPACE)
    sums = flat.prefix_sums(data)
    words = flat.span_hashes(sums, starts, ends)
    per_row = lambda at, values=None: np.bincount(at, values, n).astype(np.int64)
    windows, within = flat.grams(words, row, 3)
    _, twice = _repeats(windows[within], row[:len(windows)][within])
    in_repeat = np.zeros(len(words) + 3, bool)
    at = np.flatnonzero(within)[twice]
    for k in range(3):
        in_repeat[at + k] = True
    line_start, line_end, line_row = flat.lines(data, offsets)
    first_word = np.searchsorted(starts, line_start)
    has_word = (first_word < len(starts)) & (starts[np.minimum(first_word, len(starts) - 1)] < line_end) if len(starts) \
        else np.zeros(len(line_start), bool)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    dup_line, _ = _repeats(flat.span_hashes(sums, line_start, line_end), line_row)
    word_again, _ = _repeats(words, row)
    count = lambda table: flat.sums_by_row(offsets, table[data])
    return {
        "n_words": per_row(row), "word_chars": count(flat.NOT_SPACE & _FIRST_BYTE), "n_symbols": count(_SYMBOL),
        "n_dup_lines": per_row(line_row[dup_line]), "n_repeat_words": per_row(row[in_repeat[:len(row)]]),
        "n_lines": per_row(line_row), "n_upper": count(_UPPER), "n_letters": count(_LETTER), "n_marks": count(_MARK),
        "n_distinct": per_row(row[~word_again]),
    }


def patterns(m: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules as one number in base three: 0 abstains, 1 bad, 2 good."""
    share = lambda a, b: m[a] / np.maximum(m[b], 1)
    values = {
        "n_words": m["n_words"], "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_letters"), "mark_share": share("n_marks", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }
    code = np.zeros(len(m["n_words"]), np.int64)
    for what, bad_below, good_from, good_to, bad_above in RULES.values():
        x = values[what]
        vote = np.where((x < bad_below) | (x > bad_above), 1, np.where((x >= good_from) & (x <= good_to), 2, 0))
        code = code * 3 + vote
    return code


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def measured(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, the counts and the pattern of votes of every document."""
    flat.small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in (*COUNTS, "pattern"))])

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                m = measure(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), *(pa.array(m[c]) for c in COUNTS), pa.array(patterns(m))],
                    names=["id", *COUNTS, "pattern"])

    return rows.mapInArrow(run, schema)


def votes_of(code: int) -> list[int]:
    votes = []
    for _ in RULES:
        votes.append(code % 3)
        code //= 3
    return votes[::-1]


def fit(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior probability of being good, by pattern, from the number of documents with each pattern.

    Documents with a bad vote start as probably bad, all others as probably good.
    The rules are written for different faults, so a bad document is hit by few of
    them while all others call it good: a rule's chance of a bad vote on a bad
    document is free up to ``MAX_RECALL``, on a good one it may not exceed
    ``MAX_FALSE_ALARM``.
    """
    codes = sorted(counts)
    if not codes:
        return {}
    votes = np.array([votes_of(c) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    bad, good = (votes == 1).astype(float), (votes == 2).astype(float)
    posterior = np.where(bad.any(1), 0.1, 0.9)
    for _ in range(rounds):
        before = posterior
        prior = (n @ posterior + 8) / (n.sum() + 10)
        logit = np.full(len(codes), math.log(prior / (1 - prior)))
        for r in range(votes.shape[1]):
            # chances of a bad vote, given that the rule votes at all
            when_good = (n @ (posterior * bad[:, r]) + 0.1) / (n @ (posterior * (bad + good)[:, r]) + 100)
            when_bad = (n @ ((1 - posterior) * bad[:, r]) + 2) / (n @ ((1 - posterior) * (bad + good)[:, r]) + 10)
            when_good = min(when_good, MAX_FALSE_ALARM)
            when_bad = min(max(when_bad, 10 * when_good), MAX_RECALL)
            logit += bad[:, r] * math.log(when_good / when_bad)
            logit += good[:, r] * math.log((1 - when_good) / (1 - when_bad))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return dict(zip(codes, posterior.tolist()))


def fit_documents(measures: DataFrame) -> dict[int, float]:
    """The model from the vote patterns of all documents."""
    return fit({r["pattern"]: r["count"] for r in measures.groupBy("pattern").count().collect()})


def judged(measures: DataFrame, model: dict[int, float]) -> DataFrame:
    """``measures`` with ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    spark = measures.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in model.items()], "pattern long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # at most 3 ** len(RULES) rows
    return (measures.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= GOOD_FROM)))


def keep_good(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents whose quality the votes support, with all of their columns as they were."""
    model = fit_documents(measured(documents, text_column, text_column).drop("id"))
    flat.small_batches(documents.sparkSession)
    at = documents.columns.index(text_column)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in flat.pieces(batch.column(at)):
                m = measure(data, offsets)
                quality = np.array([model.get(c, 0.0) for c in patterns(m).tolist()])
                keep = ~base_failed(m) & (quality >= GOOD_FROM)
                if keep.any():
                    yield batch.slice(first, end - first).filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)


@query()
def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict for every document."""
    measures = flat.written(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = judged(measures, fit_documents(measures))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "quality")
