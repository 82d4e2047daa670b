"""Parsing predictions under a run-wide rule, and reporting malformed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metaeval.functions.predictions import is_number, plain_value, repaired_value
from metaeval.operators.lookup import attach
from metaeval.operators.splits import stack


def malformed_counts(preds: DataFrame, run=("run",), text: str = "pred") -> DataFrame:
    """Rows and malformed rows of every run."""
    return preds.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~is_number(F.col(text))).alias("n_malformed"),
    )


def malformed_rows(preds: DataFrame, text: str = "pred") -> DataFrame:
    """The rows whose prediction is not a number."""
    return preds.filter(~is_number(F.col(text)))


def malformed_report(preds: DataFrame, run=("run",), pos: str = "pos", text: str = "pred"
                     ) -> DataFrame:
    """The malformed rows with the counts of their run; a clean run shows once."""
    counts = malformed_counts(preds, run, text)
    listed = attach(malformed_rows(preds, text), counts, on=list(run), spread=[pos], how="inner")
    return stack(listed, counts.filter("n_malformed = 0"))


def parse_predictions(preds: DataFrame, run=("run",), pos: str = "pos", text: str = "pred",
                      name: str = "pred_value", max_rows: int | None = None) -> DataFrame:
    """Add the number each prediction stands for.

    The repair rules hold for every row of a run with at least one malformed
    row; a clean run keeps its plain numbers. The runs with malformed rows are a
    small table, joined back by measured size.
    """
    repair = (
        malformed_counts(preds, run, text).filter("n_malformed > 0")
        .select(*run, F.lit(True).alias("_repair"))
    )
    gated = attach(preds, repair, on=list(run), spread=[pos], max_rows=max_rows)
    value = F.when(F.col("_repair"), repaired_value(F.col(text))).otherwise(
        plain_value(F.col(text)))
    return gated.withColumn(name, value).drop("_repair")


def join_labels(preds: DataFrame, manifest: DataFrame, keys=("pos",)) -> DataFrame:
    """Predictions read back, with all columns of their manifest row."""
    return manifest.join(preds, list(keys))
