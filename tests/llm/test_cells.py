import collections

import numpy as np

from metaeval.llm import cells, flat


def slots_of(values, bits):
    return {int(h) >> (64 - bits) for h in flat.mixed(np.array(sorted(values), np.uint64))}


def test_a_loaded_part_misses_no_repeat(spark, monkeypatch):
    """With more hashes than cells, what occurs twice is still marked."""
    monkeypatch.setattr(cells, "CELL_BITS", 14)
    text = "ab" + "".join(chr(c) for c in range(99, 123)) * 2 + "c" * 60_000
    df = spark.createDataFrame([(text,)], "text string").repartition(1)
    bitmap, = cells.frequent_slots(df, lambda data, offsets: [flat.mixed(data.astype(np.uint64))], (2,), 12)
    marked = set(np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).tolist())
    n = collections.Counter(text.encode())
    assert slots_of([b for b in n if n[b] >= 2], 12) <= marked
