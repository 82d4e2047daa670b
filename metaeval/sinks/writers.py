"""Writers for predictions, result records and prepared tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metaeval.session import path_exists

_PLAIN = {
    "sep": "\t", "header": "true", "escape": '"', "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def prediction_name(prefix: str, manifest_files: str | None = None, split: str = "",
                    config: str = "") -> str:
    """The file name of a run's predictions."""
    return f"{prefix}.{manifest_files}" if manifest_files else f"{prefix}.{split}-{config}.tsv"


def record_name(prediction_file: str, output_name: str | None = None) -> str:
    """The name of a run's result record."""
    return f"{output_name or prediction_file.replace('.tsv', '')}.json"


def one_line(text: Column) -> Column:
    """The text without line breaks: every backslash is followed by another one, n or r."""
    for old, new in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def one_line_undone(text: Column) -> Column:
    """The text that ``one_line`` was given."""
    # what lies between doubled backslashes has single ones only in escapes
    parts = F.split(text, F.lit(r"\\\\"))
    undone = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(undone, "\\")


def write_predictions(preds: DataFrame, path: str, pos: str = "pos", text: str = "pred_strings",
                      partition_by=()) -> None:
    """One text column in position order, tab-separated with a header.

    The parts of the folder, in name order, hold the rows in order. Outer space
    of a prediction is kept; a NULL is written as the empty text. Line breaks
    and backslashes are escaped, so that every prediction is one line.
    """
    line = one_line(F.coalesce(text, F.lit(""))).alias(text)
    ordered = preds.orderBy(*partition_by, pos).select(*partition_by, line)
    writer = ordered.write.mode("overwrite").options(**_PLAIN)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_record(summary: DataFrame, rows: DataFrame, path: str, arguments: dict | None = None
                 ) -> None:
    """The result of a run: correlations and arguments as JSON, rows as a table.

    ``summary`` has one row per run; entries without a value are written as null.
    Arguments keep their types, nested ones too.
    """
    if arguments:
        texts = {name: F.lit(json.dumps(values, default=str)) for name, values in arguments.items() if values}
        summary = summary.withColumns({name: F.from_json(text, F.schema_of_json(text)) for name, text in texts.items()})
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary")
    rows.write.mode("overwrite").parquet(f"{path}/rows")


def cached_table(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame],
                 reuse: bool = True, inputs: DataFrame | None = None) -> DataFrame:
    """The table kept under ``key``, built and kept first if there is none.

    Every build writes a folder of its own; then one small file names it as the kept
    one, beside the fingerprint of its ``inputs`` (``path``, ``length``, ``modificationTime``).
    So a table counts as kept only when its writing has finished, a reader of the one
    before goes on undisturbed, two writers do not mix, and files that are other than
    then, or more, or fewer, lead to a new build.
    """
    place = f"{root.rstrip('/')}/{key}"
    named = f"{place}/kept.json"
    wanted = None if inputs is None else fingerprint(inputs)
    kept = committed(spark, named)
    if not (reuse and kept and kept["inputs"] == wanted):
        kept = {"folder": f"table-{uuid.uuid4().hex}", "inputs": wanted}
        build().write.parquet(f"{place}/{kept['folder']}")
        commit(spark, named, kept)
    return spark.read.parquet(f"{place}/{kept['folder']}")


def fingerprint(files: DataFrame) -> str:
    """What tells one state of some files from another: their names, lengths and times, in any order."""
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    count, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{count}:{total}"


def commit(spark: SparkSession, place: str, content: dict) -> None:
    """Write a small JSON file so that it is there as a whole, or as it was before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (place, f"{place}.{uuid.uuid4().hex}"))
    out = aside.getFileSystem(conf).create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    whole = path.getFileSystem(conf).makeQualified(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(path.getFileSystem(conf).makeQualified(aside), whole, how)


def committed(spark: SparkSession, place: str) -> dict | None:
    """The content of a committed file, or None if there is none."""
    if not path_exists(spark, place):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
