"""Positional alignment of score vectors and the system grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def align(first: DataFrame, second: DataFrame, keys, pos: str = "pos") -> DataFrame:
    """Scores of ``second`` beside those of ``first``, row by row.

    ``first`` decides the rows: a row ``second`` lacks gets NULL, surplus rows
    are dropped.
    """
    return first.join(second, [*keys, pos], "left")


def length_report(first: DataFrame, second: DataFrame, keys) -> DataFrame:
    """Rows on both sides per system, and whether they are equally many."""
    left = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_first"))
    right = second.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_second"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_first", "n_second")]
    return left.join(right, list(keys), "full").select(*keys, *counts).withColumn(
        "same_length", F.col("n_first") == F.col("n_second"))


def align_strict(first: DataFrame, second: DataFrame, keys, pos: str = "pos") -> DataFrame:
    """As ``align``; raises at once if a system's lengths differ."""
    off = length_report(first, second, keys).filter(~F.col("same_length")).limit(5).collect()
    if off:
        raise ValueError(f"score vectors of unequal length, among them: {off}")
    return align(first, second, keys, pos)
