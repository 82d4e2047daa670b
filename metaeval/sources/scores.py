"""Score vectors: positional files and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from metaeval.functions.text import decoded_path
from metaeval.schemas import SCORE_ARRAY
from metaeval.sources.records import listed, scan_records, select_records
from metaeval.sources.score_lists import RANGE_BYTES, explode_lists
from metaeval.sources.text_files import CELLS, literal_path, located, number_or_error, number_rows, read_tsv


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """The path without its last part."""
    return F.regexp_replace(path, r"/[^/]*\z", "")


def scan_scores(spark: SparkSession, paths, column: str = "score", per_folder: bool = False,
                keep=()) -> DataFrame:
    """One score per row of TSV files: ``system``, ``pos``, ``value``.

    A file holds one system, named by its path; with ``per_folder`` the files of a
    folder, in name order, together do. ``keep`` names partition columns. A cell that
    is neither missing nor a number raises; ``malformed_cells`` lists such rows.
    """
    rows = located(read_tsv(spark, paths))
    value = number_or_error(F.col(f"`{column}`")).alias("value")
    system = folder(F.col("_file")) if per_folder else F.col("_file")
    narrow = rows.select(*keep, value, "_part", "_file", "_block")
    return number_rows(narrow.withColumn("system", system), F.col("system")).select(
        "system", *keep, "pos", "value")


def scan_indexed_scores(spark: SparkSession, index: str, columns: list[str], column: str = "score") -> DataFrame:
    """As ``scan_scores``, by a kept index: nothing is counted, and a filter on ``pos`` or ``system`` opens only the ranges it needs."""
    value = number_or_error(F.col(f"`{column}`")).alias("value")
    return scan_records(spark, index, columns, CELLS).select(F.col("_system").alias("system"), F.col("_pos").alias("pos"), value)


def select_scores(spark: SparkSession, index: str, expression: str, columns: list[str], systems: dict[str, str], column: str = "score") -> DataFrame:
    """``split``, ``pos``, ``value`` of a split expression (``a[2:5]+b``) over indexed score files."""
    rows = select_records(spark, index, expression, columns, CELLS, systems)
    return rows.select("split", "pos", number_or_error(F.col(f"`{column}`")).alias("value"))


def explode_scores(systems: DataFrame, keys, scores: str = "scores") -> DataFrame:
    """One row per entry of each system's score array, numbered from 0."""
    return systems.select(*keys, F.posexplode(scores).alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"),
        F.col("value").cast("double").alias("value"))


def scan_score_arrays(spark: SparkSession, paths, whole_bytes: int = RANGE_BYTES, range_bytes: int = RANGE_BYTES,
                      keep: str | None = None) -> DataFrame:
    """Score objects in JSON files: ``system``, its stored ``system_score``, ``pos``, ``value``.

    A file of at most ``whole_bytes`` is read as one row. Of a larger one, the list is cut
    into ranges that tasks read by themselves. With ``keep`` (``name type, ...``) objects
    name themselves by these fields, which are passed through; a file then holds any
    number of objects, one a line, and large files are split between lines.
    """
    if keep:
        return scan_whole_arrays(spark, paths, keep)
    files = listed(spark, paths)
    large = files.filter(F.col("length") > whole_bytes)
    if large.isEmpty():
        return scan_whole_arrays(spark, paths)
    # names only, as Spark's own listing holds them on the driver
    small = [literal_path(r["path"]) for r in files.filter(F.col("length") <= whole_bytes).select("path").collect()]
    found = explode_lists(large, range_bytes)
    return scan_whole_arrays(spark, small).unionByName(found) if small else found


def scan_whole_arrays(spark: SparkSession, paths, keep: str | None = None) -> DataFrame:
    """As ``scan_score_arrays``, every object in one line and read as one row."""
    kept = StructType.fromDDL(keep).fields if keep else []
    objects = spark.read.schema(StructType([*SCORE_ARRAY, *kept])).option("mode", "FAILFAST").json(paths).withColumn(
        "system", decoded_path(F.col("_metadata.file_path")))
    return explode_scores(objects, ["system", "system_score", *[f"`{f.name}`" for f in kept]])
