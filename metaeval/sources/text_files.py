"""Reading delimited and JSON files with explicit row positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from metaeval.functions.text import decoded_path
from metaeval.operators.lookup import attach
from metaeval.operators.ordering import running_totals
from metaeval.schemas import MANIFEST, MANIFEST_TYPES, MISSING
from metaeval.session import cut
from metaeval.sources.inventory import opens, working_folder
from metaeval.sources.records import RANGE_BYTES, listed, scan_records, temporary_index

# What states a number: decimal, with or without exponent, or an infinity.
NUMBER = r"\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI]nf(?:inity)?)\z"
_TSV = {
    "sep": "\t", "header": "true", "escape": '"', "enforceSchema": "false",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def literal_path(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_tsv(spark: SparkSession, paths, multi_line: bool = False) -> DataFrame:
    """Tab-separated files of one layout, every column a text.

    The header names the columns; a file with other columns raises. With
    ``multi_line`` quoted cells may hold line breaks; a file is then read by one
    task, so large ones should come in parts.
    """
    return spark.read.options(**_TSV).option("multiLine", multi_line).option("lineSep", "\n").csv(paths)


def number_or_error(text: Column, kind="double") -> Column:
    """The number a cell states, NULL for a missing entry; any other text raises."""
    stripped = F.trim(text)
    known = F.when(stripped.rlike(NUMBER), stripped.try_cast(kind))
    failure = F.raise_error(F.concat(F.lit("not a number: "), text)).cast(kind)
    return F.when(text.isNull() | stripped.isin(*MISSING), F.lit(None)).otherwise(F.coalesce(known, failure))


def malformed_cells(table: DataFrame, column: str) -> DataFrame:
    """The rows of a table read as texts whose cell is neither missing nor a number."""
    text = F.trim(f"`{column}`")
    return table.filter(text.isNotNull() & ~text.isin(*MISSING) & ~text.rlike(NUMBER))


def not_missing(text: Column) -> Column:
    """The text, or NULL where it stands for a missing entry."""
    return F.when(~text.isin(*MISSING), text)


def located(df: DataFrame, part: int = 0) -> DataFrame:
    """Add where each row was read: file, block in the file, running row number."""
    return df.withColumns({
        "_part": F.lit(part),
        "_file": decoded_path(F.col("_metadata.file_path")),
        "_block": F.col("_metadata.file_block_start"),
    })


def number_rows(rows: DataFrame, system: Column | None = None, pos: str = "pos",
                header: bool = False) -> DataFrame:
    """Positions in reading order for ``located`` rows, from 0 in every ``system``.

    Order: the part as written, the folder, the name (of the files that Spark
    wrote, the part number), the block, the row. Rows of one block are read in one
    go, so counting blocks is enough. Only the counts, one row per block (some
    128 MB of input), are written out; the rows themselves are read once more. Should
    a file be split otherwise then, the rows do not fit their blocks, and this raises.
    With ``header`` the first row of every file is left out.
    """
    names = [c for c in rows.columns if not c.startswith("_")]
    name = F.element_at(F.split("_file", "/"), -1)
    read = rows.withColumns({
        "_system": F.lit("") if system is None else system,
        "_folder": F.regexp_replace("_file", r"/[^/]*\z", ""),
        "_number": F.coalesce(F.regexp_extract(name, r"\Apart-([0-9]+)", 1).try_cast("bigint"), F.lit(-1)),
        "_row": F.monotonically_increasing_id(),
    })
    block = ["_part", "_folder", "_number", "_file", "_block"]
    # all columns are parsed, as they are later, so that both passes see the same rows
    seen = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in names])) if names else F.lit(0)
    blocks = cut(read.groupBy("_system", *block).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"), seen.alias("_seen"))).drop("_seen")
    if header:
        skipped = F.when(F.col("_block") == 0, 1).otherwise(0)
        blocks = blocks.withColumns({"_first": F.col("_first") + skipped, "_count": F.col("_count") - skipped})
    starts = running_totals(blocks, ["_system"], block, "_count").select("_file", "_part", "_block", "_first", "_count", "_before")
    placed = attach(read.drop("_system", "_folder", "_number"), starts, on=["_part", "_file", "_block"], spread=["_row"])
    if header:
        placed = placed.filter((F.col("_block") > 0) | (F.col("_row") >= F.col("_first")))
    place = F.col("_row") - F.col("_first")
    fits = place.between(F.lit(0), F.col("_count") - 1)
    failure = F.raise_error(F.lit("a file was split otherwise when it was read again")).cast("bigint")
    return placed.withColumn(pos, F.when(fits, place + F.col("_before")).otherwise(failure)).drop(
        "_row", "_first", "_count", "_before", "_part", "_file", "_block")


#: How the cells of a record are parsed.
CELLS = {k: v for k, v in _TSV.items() if k not in ("header", "enforceSchema")}


def scan_manifests(spark: SparkSession, root: str, manifest_files: str,
                   schema: StructType = MANIFEST, multi_line: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A comma-separated list of TSV and JSON-lines manifests (or globs) as one table.

    Rows are numbered in the written order of the list. Columns a file lacks are
    NULL; columns beyond ``schema`` pass through, from JSON with the type that all
    of their values have. A cell of a number column that is none raises. With
    ``multi_line`` quoted cells may hold line breaks; large files are still read by
    many tasks, a range each, if they lie where tasks can open files; elsewhere a file
    with such cells is read by one task.
    """
    table, before = None, 0
    names = manifest_files.split(",")
    for part, name in enumerate(names):
        path = f"{root.rstrip('/')}/{name}"
        total = None
        if name.endswith(".json") or name.endswith(".jsonl"):
            given = {f.name: f for f in schema.fields}
            found = spark.read.json(path).schema.fields
            wanted = StructType([StructField(f.name, given[f.name].dataType if f.name in given else f.dataType) for f in found]
                                + [f for f in schema.fields if f.name not in {g.name for g in found}])
            rows = number_rows(located(spark.read.schema(wanted).option("mode", "FAILFAST").json(path)))
        else:
            if multi_line and opens(path, working_folder(spark)):
                index = temporary_index(listed(spark, path), per_folder=None, range_bytes=range_bytes)
                total = spark.read.parquet(index).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
                rows = scan_records(spark, index, read_tsv(spark, path, True).columns, CELLS).drop("_system", "_file").withColumnRenamed("_pos", "pos")
            else:
                rows = number_rows(located(read_tsv(spark, path, multi_line)))
            rows = rows.withColumns({
                c: number_or_error(F.col(f"`{c}`"), MANIFEST_TYPES[c]) if c in MANIFEST_TYPES
                else not_missing(F.col(f"`{c}`")) for c in rows.columns if c != "pos"
            })
        if before:
            rows = rows.withColumn("pos", F.col("pos") + before)
        if part + 1 < len(names):
            before += rows.count() if total is None else total
        table = rows if table is None else table.unionByName(rows, allowMissingColumns=True)
    return table
