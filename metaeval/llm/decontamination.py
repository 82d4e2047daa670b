"""Benchmark decontamination by winnowing.

A text's words are hashed, and of every ``WINDOW`` neighbouring ``GRAM``-word
grams the one with the least hash is kept, the rightmost of equals. Two texts that
share ``SPAN = GRAM + WINDOW - 1`` words share such a fingerprint at the same place
of the shared span, so joining fingerprints finds every span. Each joined pair
is extended both ways, word by word, as far as a window of ``SPAN`` words around
the fingerprint can reach. Items of fewer words are one window each and have one
fingerprint, the hash of all their words.

Only fingerprints that a bitmap of the benchmark's fingerprints lets through
leave the scan of the documents; the bitmap has a fixed size.

Defined results: null and empty texts have no words, are never hit, and as items
match nothing. Repeated rows get a result each. An empty benchmark hits nothing.
A null id is kept. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from metaeval.llm import bits, flat
from metaeval.llm.registry import query

GRAM = 5
WINDOW = 6
SPAN = GRAM + WINDOW - 1
BITMAP_BITS = 24
CONTEXT = GRAM + 2 * (SPAN - GRAM)


def _winnowed(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the fingerprints; windows that cross rows are left out."""
    grams, _ = flat.grams(words, row, GRAM)
    m = len(words) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    within = row[:m] == row[SPAN - 1:]
    best, at = grams[:m].copy(), np.arange(m)
    for j in range(1, WINDOW):
        less = grams[j:j + m] <= best
        best = np.where(less, grams[j:j + m], best)
        at[less] = np.flatnonzero(less) + j
    at = np.unique(at[within])
    return grams[at], at


def _contexts(words: np.ndarray, row: np.ndarray, at: np.ndarray, beyond: int) -> np.ndarray:
    """The words around each gram; ``beyond`` stands for places outside of the row."""
    where = at[:, None] + np.arange(-(SPAN - GRAM), SPAN)[None, :]
    inside = (where >= 0) & (where < len(words))
    where = np.clip(where, 0, max(len(words) - 1, 0))
    inside &= row[where] == row[at][:, None]
    return np.where(inside, words[where], np.uint64(beyond))


def _short(n: int, hashes: np.ndarray) -> np.ndarray:
    return flat.mixed(hashes + np.uint64(n))


def fingerprints(rows: DataFrame, bitmap: np.ndarray | None, short: list[int], beyond: int) -> DataFrame:
    """Rows with columns id, key, text: id, key, n_words and the fingerprints that the bitmap lets through.

    Without a bitmap the rows are items: those with fewer than SPAN words give
    the hash of all their words.
    """
    spark = rows.sparkSession
    flat.small_batches(spark)
    shared = spark.sparkContext.broadcast(bitmap) if bitmap is not None else None
    schema = T.StructType([rows.schema["id"], T.StructField("key", T.LongType()), *(
        T.StructField(name, kind) for name, kind in (
            ("n_words", T.LongType()), ("hash", T.ArrayType(T.LongType())), ("pos", T.ArrayType(T.LongType())),
            ("size", T.ArrayType(T.LongType())), ("context", T.ArrayType(T.LongType()))))])

    def of_piece(data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        data = flat.LOWER[data]
        starts, ends, row = flat.runs(data, offsets, flat.ALNUM)
        words = flat.span_hashes(flat.prefix_sums(data), starts, ends)
        n_words = np.bincount(row, minlength=n)
        first_word = np.concatenate([[0], np.cumsum(n_words)])[:-1]
        found = []  # hash, place of the first word, size
        hashes, at = _winnowed(words, row)
        if shared is not None:
            ok = bits.has(shared.value, hashes, BITMAP_BITS)
            hashes, at = hashes[ok], at[ok]
        found.append((hashes, at, np.full(len(at), SPAN)))
        for size in range(1, SPAN) if shared is None else short:
            hashes, within = flat.grams(words, row, size)
            at = np.flatnonzero(within)
            if shared is None:  # an item is one window
                at = at[n_words[row[at]] == size]
                hashes = _short(size, hashes[at])
            else:
                hashes = _short(size, hashes[at])
                ok = bits.has(shared.value, hashes, BITMAP_BITS)
                hashes, at = hashes[ok], at[ok]
            found.append((hashes, at, np.full(len(at), size)))
        hashes, at, size = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row[at], kind="stable") if len(at) else np.zeros(0, np.int64)
        hashes, at, size = hashes[order], at[order], size[order]
        lengths = np.bincount(row[at], minlength=n) if len(at) else np.zeros(n, np.int64)
        around = _contexts(words, row, at, beyond) if len(at) else np.zeros((0, CONTEXT), np.uint64)
        return [pa.array(n_words), flat.lists(flat.signed(hashes), lengths),
                flat.lists(pa.array(at - first_word[row[at]] if len(at) else at), lengths),
                flat.lists(pa.array(size), lengths), flat.lists(flat.signed(around.reshape(-1)), lengths * CONTEXT)]

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                head = [batch.column(c).slice(first, end - first) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*head, *of_piece(data, offsets)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _exploded(prints: DataFrame) -> DataFrame:
    one = F.posexplode(F.arrays_zip("hash", "pos", "size")).alias("i", "f")
    return prints.select("id", "key", "context", one).select(
        "id", "key", "f.hash", "f.pos", "f.size", F.slice("context", F.col("i") * CONTEXT + 1, F.lit(CONTEXT)).alias("context"))


def _extended(pairs: DataFrame) -> DataFrame:
    """The words that the windows around each joined fingerprint cover; pairs without a whole window go."""
    schema = T.StructType([pairs.schema[c] for c in ("id", "key", "item")] + [T.StructField(c, T.LongType()) for c in ("start", "end")])

    def table(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, CONTEXT)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = SPAN - GRAM
        for batch in batches:
            if not batch.num_rows:
                continue
            same = table(batch.column("context")) == table(batch.column("item_context"))
            left = np.cumprod(same[:, side - 1::-1], 1).sum(1)
            right = np.cumprod(same[:, -side:], 1).sum(1)
            pos, size = batch.column("pos").to_numpy(), batch.column("size").to_numpy()
            long = size == SPAN
            hit = ~long | ((left + right >= side) & same[:, side:side + GRAM].all(1))
            start = np.where(long, pos - left, pos)
            end = np.where(long, pos + GRAM + right, pos + size)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "item")), pa.array(start), pa.array(end)], names=schema.names)
            yield out.filter(pa.array(hit))

    return pairs.mapInArrow(run, schema)


def _rows(table: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return table.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))


def contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every document (id, key, n_words), and the spans of words that items hit (id, key, item, start, end).

    ``key`` is the hash of the text: it tells apart different rows of one id.
    """
    items = flat.written(_exploded(fingerprints(_rows(benchmark, item_column, item_text_column), None, [], 1)))
    short = sorted(r["size"] for r in items.filter(F.col("size") < SPAN).select("size").distinct().collect())
    bitmap = bits.of_hashes(items, "hash", BITMAP_BITS)
    prints = flat.written(fingerprints(_rows(documents, id_column, text_column), bitmap, short, 0))
    item_side = items.select("hash", "size", F.col("id").alias("item"), F.col("context").alias("item_context")).distinct()
    pairs = _exploded(prints).join(item_side, ["hash", "size"])
    return prints.select("id", "key", "n_words"), _extended(pairs)


def hits_by_document(every: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, the items in the order of their text forms."""
    spans = flat.written(spans)
    ranges = spans.select("id", "key", "start", "end").distinct().groupBy("id", "key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    covered = F.aggregate(
        "ranges", F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["reach"], x["end"]).alias("reach"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["reach"]))).alias("n")),
        lambda a: a["n"])
    items = spans.select("id", "key", F.col("item").cast("string").alias("item")).distinct().groupBy("id", "key").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    hit = ranges.select("id", "key", covered.alias("n_hit")).join(items.select(
        F.col("id").alias("id2"), F.col("key").alias("key2"), "items"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
    hit = hit.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "n_hit", "items")
    return every.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left").select(
        "id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (columns doc_id, text and any others) that no benchmark window occurs in."""
    _, spans = contamination(documents, benchmark)
    bad = spans.select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    d = documents.alias("d")
    return d.join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.bad_id")) & (F.xxhash64("d.text") == F.col("b.bad_key")), "left_anti")


@query()
def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """What benchmark windows occur in every document."""
    every, spans = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits_by_document(every, spans).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
