"""Language-model scoring with a log-frequency Bloom filter.

The filter holds every n-gram of one to three tokens of the training corpus with
its quantised count: a count in the ``q``-th power of ``BASE`` is stored as the ``q``
keys (n-gram, 1) to (n-gram, q), and is read back by probing until a key is
missing. A context is continued as often as it occurs, unless it ends a text, so

    P(w | h) = (c(hw) + K P(w | shorter h)) / (c(h) + K)

The filter grows with the corpus. It is cut by hash into segments, as many as the
texts need for each to fit a task, and is never in one place: pieces of text send
their different keys to the segments, and get their levels back.

The base score needs every token's exact count. Tokens with a share of at least
``1 / COMMON`` are at most ``COMMON`` and are broadcast; occurrences of all others
are summed per document and joined with the counts.

Defined results: null and empty texts are one end token. A null id is in
training. Repeated rows are scored each by itself. Without training tokens every
count is zero. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from metaeval.llm import flat
from metaeval.llm.registry import query

ORDER = 3
COMMON = 1 << 18
BASE = 1.25
PROBES = 4
BITS_PER_KEY = 10
SEGMENT_BYTES = 4 << 20
SMOOTHING = 100.0
FLUSH = 2_000_000
END = np.uint64(0xA24BAED4963EE407)
_KEY = np.uint64(0xFFFFFFFFFFFF0000)
_LEVEL = np.uint64(0xD1342543DE82EF95)
_PROBE = np.uint64(0x2127599BF4325C37)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token, one end after the words of each text."""
    data = flat.LOWER[data]
    starts, ends, row = flat.runs(data, offsets, flat.NOT_SPACE)
    words = flat.span_hashes(flat.prefix_sums(data), starts, ends)
    n = len(offsets) - 1
    last = np.searchsorted(row, np.arange(n), side="right")
    return np.insert(words, last, END), np.insert(row, last, np.arange(n))


def ngrams(tokens: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-grams inside rows, of their contexts, and the place of each one's last token."""
    if k == 1:
        return tokens, np.zeros(len(tokens), np.uint64), np.arange(len(tokens))
    grams, within = flat.grams(tokens, row, k)
    at = np.flatnonzero(within)
    context = tokens if k == 2 else flat.grams(tokens, row, k - 1)[0]
    return grams[at], context[at], at + k - 1


def _training(documents: DataFrame, id_column: str, text_column: str, held_out: Column) -> DataFrame:
    return documents.filter(~F.coalesce(held_out, F.lit(False))).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))


def _counted(rows: DataFrame, orders: range) -> DataFrame:
    """gram, context, order, n: counts over all rows; each task adds up before the shuffle."""
    flat.small_batches(rows.sparkSession)
    names = ["gram", "context", "size", "n"]

    def flush(held: list) -> pa.RecordBatch:
        gram, context, size, n = (np.concatenate(x) for x in zip(*held))
        unique, first, at = np.unique(gram, return_index=True, return_inverse=True)
        total = np.bincount(at, n, len(unique)).astype(np.int64)
        return pa.RecordBatch.from_arrays([flat.signed(unique), flat.signed(context[first]), pa.array(size[first]), pa.array(total)], names=names)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for _, _, data, offsets in flat.pieces(batch.column("text")):
                tokens, row = tokens_of(data, offsets)
                for k in orders:
                    gram, context, _ = ngrams(tokens, row, k)
                    unique, first, n = np.unique(gram, return_index=True, return_counts=True)
                    held.append((unique, context[first], np.full(len(unique), k), n))
                    waiting += len(unique)
                if waiting >= FLUSH:
                    yield flush(held)
                    held, waiting = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "gram long, context long, size long, n long").groupBy("gram").agg(
        F.first("context").alias("context"), F.first("size").alias("size"), F.sum("n").alias("n"))


def _level(n: np.ndarray, unit: float) -> np.ndarray:
    """The number of keys that stand for a count: 1 from the unit on, one more for each power of BASE."""
    return 1 + np.floor(np.log(np.maximum(n / unit, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _bytes(values: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight beside each other, for the shuffle's compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Ordered values as their steps."""
    return _bytes(np.diff(values, prepend=np.uint64(0)))


def _values(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=np.uint64)


def _segment(keys: np.ndarray, bits_of_segments: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits_of_segments)).astype(np.int64)


def _cut(keys: np.ndarray, bits_of_segments: int) -> Iterator[tuple[int, int, int]]:
    """Segment, first and end of the ordered keys of every segment."""
    of = _segment(keys, bits_of_segments)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(of)])


def _positions(keys: np.ndarray, level: np.ndarray | int, probe: int, size_bits: int) -> np.ndarray:
    """The place of a key at a level in the filter of its segment."""
    return (flat.mixed(keys + np.asarray(level).astype(np.uint64) * _LEVEL + np.uint64(probe) * _PROBE) >> np.uint64(64 - size_bits)).astype(np.int64)


def _filled(keys: np.ndarray, n: np.ndarray) -> bytes:
    """The filter of a segment: all keys with their counts, as large as they need."""
    level = _level(n.astype(float), 1.0)
    size_bits = max(10, int(BITS_PER_KEY * level.sum()).bit_length())
    marks = np.zeros(1 << size_bits, np.uint8)
    for k in range(1, int(level.max(initial=0)) + 1):
        for probe in range(PROBES):
            marks[_positions(keys[level >= k], k, probe, size_bits)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _levels(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """How many levels of each key are in the filter of its segment, from the first on."""
    marks = np.frombuffer(packed, np.uint8)
    size_bits = (8 * len(marks)).bit_length() - 1
    found, left, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
    while len(left) and level < 255:
        level += 1
        for probe in range(PROBES):
            at = _positions(keys[left], level, probe, size_bits)
            left = left[(marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        found[left] = level
    return found


def _middle(level: np.ndarray) -> np.ndarray:
    """The quantised counts: 0, or the middle of the level's range in whole numbers."""
    level = level.astype(float)
    low, high = np.ceil(BASE ** (level - 1) - 1e-6), np.ceil(BASE ** level - 1e-6) - 1
    return np.where(level > 0, (low + np.maximum(high, low)) / 2, 0)


def _keys(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The n-grams' hashes, shortest first, in the 48 bits that travel; equal ones by chance are far fewer than a filter's errors."""
    return np.concatenate([ngrams(tokens, row, k)[0] for k in range(1, ORDER + 1)]) & _KEY


def log_probabilities(tokens: np.ndarray, row: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of each token's probability after up to two tokens before it in its row; ``counts`` has those of its keys."""
    own = counts[:len(tokens)]
    # every token has half a count more, and so has one unknown
    p, used = (own + 0.5) / (total + 0.5 * (distinct + 1)), len(tokens)
    for k in range(2, ORDER + 1):
        at = np.flatnonzero(row[k - 1:] == row[:max(0, len(row) - k + 1)]) + k - 1
        n, whole = counts[used:used + len(at)], own[at - 1]
        p[at] = (np.minimum(n, whole) + SMOOTHING * p[at]) / (whole + SMOOTHING)
        own, used = np.zeros(len(tokens)), used + len(at)
        own[at] = n
    return np.log10(p)


@dataclass
class Filter:
    """The filter as a table of segments, each with its bits. A few keys can be read here; ``scored`` looks them up in tasks."""

    table: DataFrame
    bits_of_segments: int
    tokens: int
    distinct: int

    def counts(self, keys: np.ndarray) -> np.ndarray:
        unique, back = np.unique(keys & _KEY, return_inverse=True)
        found = np.zeros(len(unique), np.uint8)
        at = {segment: (first, end) for segment, first, end in _cut(unique, self.bits_of_segments)}
        for r in self.table.toLocalIterator():
            first, end = at.get(r["segment"], (0, 0))
            found[first:end] = _levels(r["packed"], unique[first:end])
        return _middle(found)[back]

    def log_probabilities(self, tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
        return log_probabilities(tokens, row, self.counts(_keys(tokens, row)), self.tokens, self.distinct)


def _bits_of_segments(rows: DataFrame) -> int:
    """So many segments that each is dealt the n-grams of about ``SEGMENT_BYTES`` of text, at any size."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, int(size // SEGMENT_BYTES).bit_length())


def _asked(pieces: DataFrame, bits_of_segments: int) -> DataFrame:
    """segment, piece, and of the piece's different keys in that segment: their steps, and their counts in training rows."""

    @flat.tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, held_out, lengths, data in zip(*(batch.column(c) for c in ("piece", "held_out", "lengths", "data"))):
                tokens, row = tokens_of(np.frombuffer(data.as_buffer(), np.uint8), np.concatenate([[0], np.cumsum(lengths.values.to_numpy())]))
                learned = ~held_out.values.to_numpy(zero_copy_only=False)[row]
                keys, at = np.unique(_keys(tokens, row), return_inverse=True)
                rows_of = np.concatenate([learned[ngrams(tokens, row, k)[2]] for k in range(1, ORDER + 1)])
                n = np.bincount(at, rows_of, len(keys)).astype(np.uint64)
                out = [(s, _steps(keys[a:b]), _bytes(n[a:b])) for s, a, b in _cut(keys, bits_of_segments)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([piece.as_py()] * len(out), pa.int64()),
                                                  *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2))], names=["segment", "piece", "keys", "n"])

    return pieces.select("piece", "held_out", "lengths", "data").mapInArrow(ask, "segment long, piece long, keys binary, n binary")


def _summed(asked: pd.DataFrame) -> tuple[bytes, np.ndarray, np.ndarray, list]:
    """The filter of a segment, its different keys, the place of each asked key among them, and how many each piece asked."""
    each = [_values(x) for x in asked["keys"]]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    n = np.bincount(at, np.concatenate([_numbers(x) for x in asked["n"]]), len(keys))
    return _filled(keys[n > 0], n[n > 0]), keys, at, [len(x) for x in each]


def train(rows: DataFrame, words: DataFrame, tokens: int, distinct: int) -> Filter:
    """The filter of all n-grams of the training rows, as a table. ``words`` is not read: words are counted with the rest."""
    rows = rows.select("id", F.lit(False).alias("held_out"), "text")
    flat.small_batches(rows.sparkSession)
    bits_of_segments = _bits_of_segments(rows)

    def fill(asked: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": [asked["segment"].iloc[0]], "packed": [_summed(asked)[0]]})

    filled = _asked(_packed(rows), bits_of_segments).groupBy("segment").applyInPandas(fill, "segment long, packed binary")
    return Filter(flat.written(filled), bits_of_segments, tokens, distinct)


def _packed(rows: DataFrame) -> DataFrame:
    """Pieces of rows: number, ids, held_out, lengths and bytes of the texts; a piece is one row."""
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("id", T.ArrayType(rows.schema["id"].dataType)),
                           T.StructField("held_out", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])

    @flat.tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                one = np.array([end - first])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), *(flat.lists(batch.column(c).slice(first, end - first), one) for c in ("id", "held_out")),
                    flat.lists(pa.array(np.diff(offsets)), one), pa.array([data.tobytes()], pa.binary())], names=schema.names)
                number += 1

    return flat.written(rows.mapInArrow(pack, schema), wide=True)


def _levels_of(pieces: DataFrame, bits_of_segments: int) -> DataFrame:
    """piece, segment, and the levels of the piece's different keys in that segment's filter, in their order."""

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        packed, keys, at, sizes = _summed(asked)
        levels = np.split(_levels(packed, keys)[at], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"piece": asked["piece"], "segment": asked["segment"], "levels": [x.tobytes() for x in levels]})

    return flat.written(_asked(pieces, bits_of_segments).groupBy("segment").applyInPandas(answer, "piece long, segment long, levels binary"))


def scored(documents: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: held_out, token counts, the base score and the model's score."""
    spark = documents.sparkSession
    flat.small_batches(spark)
    training = _training(documents, id_column, text_column, held_out)
    words = flat.written(_counted(training, range(1, 2)))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    common = words.filter(F.col("n") >= max(1.0, tokens / COMMON)).select("gram", "n").toPandas().sort_values("gram")
    common = spark.sparkContext.broadcast((common["gram"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    pieces = _packed(rows)
    levels = _levels_of(pieces, _bits_of_segments(rows))
    lists = {"id": pieces.schema["id"].dataType, "held_out": T.ArrayType(T.BooleanType())} | {
        c: T.ArrayType(t) for c, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("logs", T.DoubleType()), ("score", T.DoubleType()),
                                       ("gram", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())))}
    schema = T.StructType([T.StructField("piece", T.LongType()), *(T.StructField(c, t) for c, t in lists.items())])

    def run(piece: pd.DataFrame, found_levels: pd.DataFrame) -> pd.DataFrame:
        if not len(piece):
            return pd.DataFrame(columns=schema.names)
        r = piece.iloc[0]
        n = len(r["lengths"])
        found, row = tokens_of(np.frombuffer(r["data"], np.uint8), np.concatenate([[0], np.cumsum(r["lengths"])]).astype(np.int64))
        keys, key = np.unique(_keys(found, row), return_inverse=True)
        level = np.frombuffer(b"".join(found_levels.sort_values("segment")["levels"]), np.uint8)
        if len(level) != len(keys):
            raise ValueError(f"{len(level)} answers for {len(keys)} keys of a piece")
        score = np.bincount(row, log_probabilities(found, row, _middle(level)[key], tokens, distinct), n).astype(float)
        known, exact = common.value
        own = found.view(np.int64)
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        is_common = known[at] == own if len(known) else np.zeros(len(own), bool)
        c = exact[at[is_common]] if len(known) else np.zeros(0, np.int64)
        rare, rare_row = own[~is_common], row[~is_common]
        order = np.lexsort((rare, rare_row))
        rare, rare_row = rare[order], rare_row[order]
        new = np.ones(len(rare), bool)
        new[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(rare)))
        edges = np.searchsorted(rare_row[start], np.arange(1, n))
        return pd.DataFrame({
            "piece": [r["piece"]], "id": [r["id"]], "held_out": [r["held_out"]], "n_tokens": [np.bincount(row, minlength=n)], "n_known": [np.bincount(row[is_common], minlength=n)],
            "logs": [np.bincount(row[is_common], np.log10(c + 1.0), n).astype(float)], "score": [score],
            "gram": [np.split(rare[start], edges)], "times": [np.split(times, edges)]})

    each = flat.written(pieces.groupBy("piece").cogroup(levels.groupBy("piece")).applyInPandas(run, schema))
    each = each.select("piece", F.posexplode(F.arrays_zip(*lists))).select((F.struct("piece", "pos")).alias("row"), "col.*")
    rare = each.select("row", F.explode(F.arrays_zip("gram", "times")).alias("t")).select("row", "t.gram", "t.times")
    rare = rare.join(words.select("gram", "n"), "gram").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    base = float(np.log10(tokens + distinct + 1))
    return each.drop("gram", "times").join(rare, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - base * F.col("n_tokens")).alias("base_score"), "score")


@query()
def op9_language_model(spark, sf_dir: str) -> DataFrame:
    """Base and model score of every document; a seventh is held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scored(documents, held_out).withColumnRenamed("id", "doc_id")
