"""File inventories: which expected files exist, which audio can be read."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metaeval.functions.containers import Audio, parse, parse_bytes
from metaeval.functions.text import file_safe
from metaeval.operators.lookup import attach


def cascade_name(asr: Column, st: Column, dataset: Column, config: Column, split: Column
                 ) -> Column:
    """The part of a file name that names a cascaded system and its data."""
    return F.concat_ws(".", F.lit("cas.A"), asr, F.lit("T"), st, file_safe(dataset), config, split)


def direct_name(st: Column, dataset: Column, config: Column, split: Column) -> Column:
    """The part of a file name that names a translation system and its data."""
    return F.concat_ws(".", F.lit("st"), st, file_safe(dataset), config, split)


def score_file(folder: Column, prefix: Column, model: Column, system: Column, suffix: Column
               ) -> Column:
    """The path of a score file: folder, kind, model and system names, ending.

    A NULL ``prefix`` and ``model`` leave their parts out.
    """
    name = F.concat_ws(".", prefix, file_safe(model), system)
    return F.concat(folder, F.lit("/"), name, suffix)


def missing_files(expected: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """The expected rows whose file does not exist."""
    return expected.join(existing.select(path).distinct(), path, "left_anti")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below ``root``; the contents are not read. Paths are as written, not encoded."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select("path", "length")
    )


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, whatever scheme it is listed under."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.element_at(F.split(path, F.concat(F.lit("\\Q"), F.lit(bare), F.lit("\\E")), 2), -1)


AUDIO_STRUCT = "container: string, codec: string, rate: int, channels: int, frames: bigint, complete: boolean"


def readable_contents(files: DataFrame, content: str = "content") -> DataFrame:
    """Path, properties and readability of files already read as bytes."""
    def parse_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "audio": [as_row(parse_bytes(c)) for c in frame["content"]]})

    found = files.select("path", F.col(content).alias("content")).mapInPandas(parse_all, f"path string, audio struct<{AUDIO_STRUCT}>")
    return with_readable(found)


def as_row(audio: Audio | None) -> dict | None:
    return None if audio is None else audio._asdict()


def with_readable(found: DataFrame, whole: bool = True) -> DataFrame:
    """``is_readable`` beside ``audio``: the file is one, and, with ``whole``, its end is there."""
    good = F.col("audio").isNotNull()
    return found.withColumn("is_readable", good & F.col("audio.complete") if whole else good)


def flag_readable(manifest: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Add ``is_readable`` to the manifest, and ``audio`` where the inventory has it; a file not in the inventory is not.

    Both tables may be large; paths that many manifest rows share are set apart.
    """
    given = [c for c in ("audio",) if c in inventory.columns]
    known = inventory.groupBy(path).agg(F.max("is_readable").alias("is_readable"), *[F.max_by(c, "is_readable").alias(c) for c in given])
    return attach(manifest, known, on=[path], spread=manifest.columns).withColumn(
        "is_readable", F.coalesce("is_readable", F.lit(False)))


def probe_audio(manifest: DataFrame, path: str = "path", whole: bool = True, attempts: int = 3) -> DataFrame:
    """Add ``audio`` (container, codec, rate, channels, frames, complete) and ``is_readable``.

    Each file is opened where Spark runs and its structure is followed by a few bounded
    reads; with ``whole`` a file whose end is missing is not readable. Only distinct
    paths travel to Python. A path without a scheme is one of the cluster's default
    file system; a relative one lies in its working folder. What is no file, or may
    not be opened, is not readable; any other failure raises after a few attempts, so
    that a busy store does not cost rows. Tasks need access to the files.
    """
    home = working_folder(manifest.sparkSession)

    def parse_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(audio=[as_row(audio_of(name, home, attempts)) for name in frame["name"]])

    names = manifest.select(F.col(path).alias("name")).filter(F.col("name").isNotNull()).distinct()
    found = names.mapInPandas(parse_all, f"name string, audio struct<{AUDIO_STRUCT}>")
    return flag_readable(manifest, with_readable(found, whole).withColumnRenamed("name", path), path)


def probe_readable(manifest: DataFrame, path: str = "path", attempts: int = 3) -> DataFrame:
    """Add ``is_readable`` by opening each file of the manifest, as ``probe_audio`` does."""
    return probe_audio(manifest, path, attempts=attempts).drop("audio")


# Names of file systems that tasks can open by themselves, and what some of them are called elsewhere.
OPENED = {"file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss"}
OTHER_NAMES = {"s3a": "s3", "s3n": "s3"}


def opens(name: str, home: str) -> bool:
    """Whether tasks can open files of that address without Spark's readers."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", name if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", name) else home)
    return scheme is not None and OTHER_NAMES.get(scheme[1], scheme[1]) in OPENED


def located_file(name: str, home: str):
    """The file system of an address, and the place in it; ``home`` resolves what lacks a scheme."""
    from pyarrow import fs

    scheme, rest = name.split("://", 1) if "://" in name else (None, name)
    if scheme is None and name.startswith("file:/"):
        scheme, rest = "file", name.removeprefix("file:")
    if scheme is None:
        scheme, _, place = home.partition(":")
        host, _, folder = place.removeprefix("//").partition("/") if place.startswith("//") else ("", "", place.lstrip("/"))
        rest = host + (name if name.startswith("/") else f"/{folder.rstrip('/')}/{name}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{OTHER_NAMES.get(scheme, scheme)}://{quote(rest)}")


def audio_of(name: str, home: str, attempts: int) -> Audio | None:
    """The properties of an audio file, or None if there is no such file to be read."""
    from pyarrow import fs

    for attempt in range(attempts):
        try:
            system, inner = located_file(name, home)
            info = system.get_file_info(inner)
            if info.type != fs.FileType.File:
                return None
            with system.open_input_file(inner) as file:
                return parse(lambda at, count: file.read_at(count, at) if at < info.size else b"", info.size)
        except (FileNotFoundError, PermissionError):
            return None
        except OSError:
            if attempt + 1 == attempts:
                raise
            time.sleep(0.5 * 2 ** attempt)
    return None


def working_folder(spark: SparkSession) -> str:
    """The address that relative paths begin with."""
    configuration = spark._jsc.hadoopConfiguration()
    return spark._jvm.org.apache.hadoop.fs.FileSystem.get(configuration).getWorkingDirectory().toString()


def write_files(files: DataFrame) -> None:
    """Write the bytes ``content`` of every row to the file ``path``, in the tasks."""
    home = working_folder(files.sparkSession)

    def write(rows) -> None:
        for path, content in rows:
            system, inner = located_file(path, home)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner) as stream:
                stream.write(bytes(content))

    files.select("path", "content").foreachPartition(write)
