"""Column layouts of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DoubleType, StringType, StructField, StructType,
)

# Manifest columns with a type of their own; every other column stays a text.
MANIFEST_TYPES = {
    "metric_score_xcomet-xl": DoubleType(),
    "metric_score_metricx-23-xl": DoubleType(),
    "humanda": DoubleType(),
}

MANIFEST = StructType([
    StructField("path", StringType()),
    StructField("sentence", StringType()),
    StructField("inst", StringType()),
    StructField("suffix", StringType()),
    StructField("lang", StringType()),
    *[StructField(n, t) for n, t in MANIFEST_TYPES.items()],
])

# One object per system: its mean and its segment scores in order.
SCORE_ARRAY = StructType([
    StructField("system_score", DoubleType()),
    StructField("scores", ArrayType(DoubleType())),
])

# Texts a score or manifest file uses for a missing entry.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
