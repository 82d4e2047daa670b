"""Texts of an Arrow batch as flat byte arrays: words, lines and hashes, without a loop per text.

Everything here runs inside tasks, on pieces of a few megabytes, so that memory
does not depend on the partition. A text longer than a piece is a piece of its
own. Hashes have 64 bits: a random value per byte, summed with the powers of an
odd number modulo 2^64, then mixed.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from metaeval.session import delete_at_exit, shared_dir

PIECE_BYTES = 2 << 20
BATCH_BYTES = "8m"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Words are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: Bytes with A-Z folded to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by their bytes too, so that long texts do not pile up in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run):
    """A task's function of batches, after which its worker gives the memory back.

    Workers are used again by later tasks and other jobs. What a task took and freed would stay
    with its worker, beside what the executor's other workers hold.
    """
    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            if len(_powers[0]) > PIECE_BYTES + 1:
                _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)
    return inner


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of pieces of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, ends, content = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; no two values meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for k, factor in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, factor, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows."""
    up, _ = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans, equal for equal bytes wherever they stand."""
    _, down = _powers_to(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that ``inside`` marks; no run crosses rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = inside[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begin[edges] = word[edges]
    edges = edges[edges > 0] - 1
    last[edges] = word[edges]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line, empty ones included; a row without text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    rows = np.concatenate([np.arange(n), row])
    order = np.lexsort((starts, rows))
    last = np.lexsort((ends, np.concatenate([row, np.arange(n)])))
    return starts[order], ends[last], rows[order]


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` neighbours from each element on, and whether they lie in one row."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = hashes[:m].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j:j + m]
    return mixed(out), row[:m] == row[k - 1:]


def sums_by_row(offsets_of_rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets_of_rows])


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def lists(flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    """An array column from its flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


#: A reader holds a whole row group of up to 4,096 rows; wide rows need small ones.
WIDE_ROWS = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, wide: bool = False) -> DataFrame:
    """Cut lineage: the rows, written as a table to the shared folder and read again.

    Columnar files take a fraction of the room that checkpointed rows take. The
    folder goes when the driver ends, or with ``delete_tables`` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    # the rows are read from the table from now on: nothing needs the shuffles behind them
    spark.conf.set(CLEANED, "true")
    try:
        df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    delete_at_exit(spark, path)
    release(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    _made.append(path)
    return table


#: Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def tables_made() -> int:
    """How many tables have been written so far."""
    return len(_made)


def delete_tables(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables written since then that nothing will read any more: all but those ``kept``."""
    stay = {table.written_to for table in kept}
    for path in _made[since:]:
        if path not in stay:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made[since:] = [path for path in _made[since:] if path in stay]


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more.

    It does so when the driver collects garbage, which a small heap may not need
    for hours while the executors' disks fill up.
    """
    gc.collect()
    spark._jvm.System.gc()
