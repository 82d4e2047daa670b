"""Which hashes are frequent over all rows, at a byte or two of shuffle per occurrence.

The hash space is cut into ``2 ** CELL_BITS`` cells. Tasks send the sorted cells of
their hashes by ranges, as steps whose bytes of equal weight stand beside each
other, so that the shuffle's compression gets at them. The counts of a range meet
in one group. The outcome is a bitmap per threshold, of a fixed size. A cell
counts every hash in it: a frequent hash is never missed, while a rare one may
pass for frequent. Only with ``rising`` the threshold rises with the mean load of a
cell; then frequent hashes may be missed, and the bitmaps may only order things.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from metaeval.llm import flat

CELL_BITS = 34
FLUSH = 4_000_000


def frequent_slots(rows: DataFrame, hashes: Callable, thresholds: Sequence[float], bitmap_bits: int, rising: bool = False) -> list[np.ndarray]:
    """A bitmap for each threshold. ``hashes(data, offsets)`` lists arrays of hashes of a piece of ``text``."""
    spark = rows.sparkSession
    flat.small_batches(spark)
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    range_bits = min(CELL_BITS - 10, bitmap_bits - 3, (parts - 1).bit_length())
    cell_range = CELL_BITS - range_bits

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held)) >> np.uint64(64 - CELL_BITS)
        part = (cells >> np.uint64(cell_range)).astype(np.int64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = []
        for first, end in zip(at.tolist(), [*at[1:].tolist(), len(cells)]):
            steps = np.diff(cells[first:end], prepend=np.uint64(part[first]) << np.uint64(cell_range))
            blobs.append(np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], names=["part", "cells"])

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in flat.pieces(batch.column("text")):
                found = hashes(data, offsets)
                held.extend(found)
                n += sum(map(len, found))
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        base = part << cell_range
        cells = [base + np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").astype(np.int64).ravel())
                 for x in group["cells"]]
        found, n = np.unique(np.concatenate(cells), return_counts=True)
        load = sum(map(len, cells)) / (1 << cell_range)
        size = 1 << (bitmap_bits - range_bits)
        out = []
        for k, least in enumerate(thresholds):
            marks = np.zeros(size, np.uint8)
            marks[(found[n >= least + (int(load) if rising else 0)] >> (CELL_BITS - bitmap_bits)) - part * size] = 1
            if marks.any():
                out.append((k, part, np.packbits(marks, bitorder="little").tobytes()))
        return pd.DataFrame(out, columns=["threshold", "part", "packed"])

    counted = rows.select("text").mapInArrow(run, "part long, cells binary").groupBy("part").applyInPandas(
        count, "threshold long, part long, packed binary")
    maps = [np.zeros((1 << bitmap_bits) // 8, np.uint8) for _ in thresholds]
    size = (1 << (bitmap_bits - range_bits)) // 8
    for r in counted.toLocalIterator():
        maps[r["threshold"]][r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(bytes(r["packed"]), np.uint8)
    flat.release(spark)
    return maps
