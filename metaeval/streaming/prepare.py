"""The row-by-row preparation on a stream of manifest rows.

Correlations and the repair rule need a complete run and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metaeval.functions.audio import has_audio_ending, segment_ref
from metaeval.functions.text import prefix_path
from metaeval.plans.prepare import PrepareOptions, prepare_rows


def prepare_stream(rows: DataFrame, base_path: str | None = None,
                   options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Paths, segments, endings, target texts and prompts of streamed rows."""
    placed = rows.withColumn("path", prefix_path(base_path, F.col("path")))
    checked = placed.withColumn("segment", segment_ref(F.col("path"))).withColumn(
        "has_audio_ending", has_audio_ending(F.col("segment.file")))
    return prepare_rows(checked, options)
