"""Fixed-size batches and padding to the longest row of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from metaeval.functions.arrays import IGNORED_LABEL, pad, truncate

BATCH = "batch_id"


def with_batches(df: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """Consecutive positions share a ``batch_id``; at most ``batch_size`` rows each."""
    return df.withColumn(BATCH, F.expr(f"`{pos}` div {int(batch_size)}"))


def batch_lengths(df: DataFrame, columns, group=()) -> DataFrame:
    """The longest array of every batch, per column (``max_<column>``)."""
    return df.groupBy(*group, BATCH).agg(
        *[F.max(F.size(c)).alias(f"max_{c}") for c in columns])


def pad_batches(df: DataFrame, fillers: dict, group=()) -> DataFrame:
    """Fill every array up to the longest of its batch.

    ``fillers`` maps a column to its filling value. The window holds one batch,
    which never has more rows than the batch size.
    """
    batch = Window.partitionBy(*group, BATCH)
    sized = df.withColumns({f"_m_{c}": F.max(F.size(c)).over(batch) for c in fillers})
    return sized.withColumns(
        {c: pad(F.col(c), F.col(f"_m_{c}"), v) for c, v in fillers.items()}
    ).drop(*[f"_m_{c}" for c in fillers])


def encoded_fillers(pad_id: int) -> dict:
    """Filling values of the six encoded columns."""
    out = {}
    for start in ("", "suffix_"):
        out[start + "input_ids"] = pad_id
        out[start + "attention_mask"] = 0
        out[start + "labels"] = IGNORED_LABEL
    return out


def truncate_to_longest(df: DataFrame, values: str, length: str, group=()) -> DataFrame:
    """Cut every array to the largest ``length`` of its batch."""
    longest = F.max(length).over(Window.partitionBy(*group, BATCH))
    return df.withColumn("_m", longest).withColumn(
        values, truncate(F.col(values), F.col("_m"))).drop("_m")
