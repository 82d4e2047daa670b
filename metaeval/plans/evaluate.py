"""Score a prepared dataset, write the predictions, correlate them with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metaeval.operators.batches import BATCH, encoded_fillers, pad_batches, with_batches
from metaeval.operators.correlation import correlation_report
from metaeval.operators.ordering import with_positions
from metaeval.operators.predictions import parse_predictions
from metaeval.operators.scoring import UNIT, score, score_resumable, with_units
from metaeval.operators.splits import require_rows
from metaeval.operators.tokens import PAD_ID
from metaeval.sinks.writers import (
    one_line_undone, prediction_name, record_name, write_predictions, write_record,
)
from metaeval.sources.inventory import opens, working_folder
from metaeval.sources.text_files import located, number_rows

# The labels of a report, and those where lower is better.
LABELS = {
    "corr_xcomet": "metric_score_xcomet-xl",
    "corr_metricx": "metric_score_metricx-23-xl",
    "corr_humanda": "humanda",
}
LOWER_IS_BETTER = ("metric_score_metricx-23-xl",)


def read_predictions(spark, path: str) -> DataFrame:
    """Predictions written by the sink: ``pos`` and ``pred_strings``.

    Read as lines, because a table reader would skip blank predictions. What the
    sink escaped is undone; a NULL prediction comes back as the empty text.
    """
    lines = located(spark.read.option("lineSep", "\n").text(path))
    line = F.col("value")
    inner = F.replace(F.substring(line, F.lit(2), F.length(line) - 2), F.lit('""'), F.lit('"'))
    quoted = line.startswith('"') & line.endswith('"') & (F.length(line) > 1)
    text = one_line_undone(F.when(quoted, inner).otherwise(line)).alias("pred_strings")
    return number_rows(lines.select(text, "_part", "_file", "_block"), header=True)


def report(rows: DataFrame, prediction: str = "pred_strings", run=()) -> tuple:
    """Rows with their parsed predictions, and the correlations per run."""
    keyed = rows if run else rows.withColumn("run", F.lit("all"))
    parsed = parse_predictions(keyed, list(run) or ["run"], text=prediction,
                               name="pred_strings_float")
    summary = correlation_report(parsed, "pred_strings_float", LABELS, run,
                                 LOWER_IS_BETTER)
    return (parsed if run else parsed.drop("run")), summary


#: About so many rows are scored before their predictions are kept.
UNIT_ROWS = 1024


def evaluate(rows: DataFrame, load_scorer, output: str, batch_size: int = 1,
             prefix: str = "qe", manifest_files: str | None = None, split: str = "test",
             config: str = "", output_name: str | None = None, arguments: dict | None = None,
             pad_id: int = PAD_ID, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Score encoded rows and write predictions and the result record below ``output``.

    Rows are told apart by their position, and by their split where positions are
    those inside a split; rows that share both raise. Predictions are kept every
    ``unit_rows`` rows or so, where tasks can open files: after a lost executor, or when a
    run that failed is started again, the scorer sees only the rest. Scored rows are written, without their arrays,
    before anything else reads them. Returns the summary.
    """
    spark = rows.sparkSession
    rows = require_rows(rows, "the test set has no rows")
    fillers = encoded_fillers(pad_id)
    key = row_key(rows)
    # a filter may have left gaps in the positions; batches are cut from the rows there are
    dense = with_positions(rows, (), key, "_dense")
    batched = with_units(with_batches(dense, batch_size, "_dense"), max(1, unit_rows // batch_size))
    name = prediction_name(prefix, manifest_files, split, config)
    path = f"{output}/{name}"
    padded = pad_batches(batched, fillers, (UNIT,))
    if opens(path, working_folder(spark)):
        scored = score_resumable(padded, load_scorer, f"{path}.units", ["_dense"], batch_size)
    else:
        scored = score(padded.drop(UNIT), load_scorer, batch_size)
    scored.drop(*fillers, BATCH).write.mode("overwrite").parquet(f"{path}.rows")
    kept = spark.read.parquet(f"{path}.rows")
    write_predictions(kept, path, "_dense")
    kept = kept.drop("_dense")
    parsed, summary = report(kept)
    write_record(summary, parsed, f"{output}/{record_name(name, output_name)}", arguments)
    return summary


def row_key(rows: DataFrame) -> list[str]:
    """The columns that number the rows of a run: the position, or, where splits share positions, the split and it."""
    if "split" not in rows.columns:
        return ["pos"]
    shared = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return ["pos"] if shared.isEmpty() else ["split", "pos"]
