"""Sets of hashes as bitmaps of a fixed size.

A bitmap answers "maybe" or "surely not". It only ever saves work: what passes is
checked exactly later. Its size is a parameter, never a function of the data, so
it may be broadcast; filled up, it merely lets more through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from metaeval.llm import flat

CHUNK_BITS = 17


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The place of each hash in a bitmap of ``2 ** bits`` places."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be in the set."""
    at = slots(hashes, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def of_slots(places: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the numbers in the column ``slot``. ``2 ** bits / 8`` bytes reach the driver."""
    chunk = min(CHUNK_BITS, bits)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << chunk, np.uint8)
        marks[part["place"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "packed": [np.packbits(marks, bitorder="little").tobytes()]})

    parts = (
        places.select(F.shiftright("slot", chunk).alias("chunk"), F.col("slot").bitwiseAND((1 << chunk) - 1).alias("place"))
        .distinct().groupBy("chunk").applyInPandas(pack, "chunk long, packed binary")
    )
    bitmap = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    size = (1 << chunk) // 8
    for row in parts.toLocalIterator():
        bitmap[row["chunk"] * size:(row["chunk"] + 1) * size] = np.frombuffer(bytes(row["packed"]), np.uint8)
    flat.release(places.sparkSession)
    return bitmap


def of_hashes(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes."""
    return of_slots(hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("slot")), bits)

