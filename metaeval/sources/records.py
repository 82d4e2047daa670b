"""Delimited files of any size as positioned records, read by many tasks.

A file is cut into ranges of bytes. Where a range begins is unknown: a line break may
end a record or stand in a quoted cell. So every range is gone over for both cases,
which gives how many records begin in it and whether it ends inside quotes; these
few numbers, put together range by range, tell the true case and the position of
each range's first record. They are the index of the files. Reading takes it, and
nothing is counted again: a filter on positions reaches the reader, which opens only
the ranges that hold them. A kept index serves later sessions; a file that has
another length by then raises.

Records are found in Python, a range at a time; their cells are parsed by Spark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from metaeval.functions.text import decoded_path
from metaeval.operators.splits import parse_split
from metaeval.session import delete_at_exit, shared_dir
from metaeval.sources.inventory import located_file, working_folder

RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
#: A range is a task of its own up to so many of them; beyond, neighbours share a task, of ``RANGE_BYTES`` at most.
TASKS = 256

_QUOTED = rb'"[^"]*+(?:""[^"]*+)*+"[^\t\n]*+'
_CELL = rb'(?:' + _QUOTED + rb'|(?!")[^\t\n]*+)'
#: A record from its first byte on, and what is left of one from inside a quoted cell.
_RECORD = re.compile(rb'(?:' + _CELL + rb'\t)*+' + _CELL + rb'(?:\n|\Z)')
_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^\t\n]*+(?:\t' + _CELL + rb')*+(?:\n|\Z)')


def stretch(file, size: int, start: int, end: int) -> tuple[int, bytes]:
    """The lines that begin between two places of a file, as a whole, and where the first begins."""
    end = min(end, size)
    at = max(start - 1, 0)
    data = file.read_at(end - at, at)
    if start:
        first = data.find(b"\n") + 1
        if not first or at + first >= end:
            return end, b""
        at, data = at + first, data[first:]
    return at, data if data.endswith(b"\n") else data + to_line_end(file, size, end)


def to_line_end(file, size: int, at: int, least: int = 0) -> bytes:
    """From a place on at least so many bytes, up to the end of a line or of the file."""
    out = [file.read_at(min(least, size - at), at)] if least else []
    at += sum(map(len, out))
    while at < size and not (out and out[-1].endswith(b"\n")):
        more = file.read_at(min(1 << 16, size - at), at)
        end = more.find(b"\n") + 1
        out.append(more[:end] if end else more)
        at += len(out[-1])
    return b"".join(out)


class Lines:
    """Counts of the lines of some bytes that are not empty."""

    def __init__(self, data: bytes):
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if len(data) and (not len(ends) or ends[-1] < len(data)):
            ends = np.append(ends, len(data))
        self.ends = ends
        starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]]) if len(ends) else ends
        filled = ends - starts > 1
        if len(ends) and not data.endswith(b"\n"):
            filled[-1] = True
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(filled)])

    def count(self, start: int, end: int) -> int:
        """Between two places where lines begin or end."""
        first, last = np.searchsorted(self.ends, (start, end), side="right")
        return int(self.before[last] - self.before[first])


def line_start(data: bytes, at: int, place: int) -> int:
    """Where the line of ``place`` begins, not before ``at``."""
    found = data.rfind(b"\n", at, place)
    return found + 1 if found >= 0 else at


def count_records(data: bytes, lines: Lines, at: int) -> tuple[int, int]:
    """How many records begin from a record's start on, and whether the end is inside quotes."""
    count = 0
    while (quote := data.find(b'"', at)) >= 0:
        line = line_start(data, at, quote)
        count += lines.count(at, line) + 1
        found = _RECORD.match(data, line)
        if found is None:
            return count, 1
        at = found.end()
    return count + lines.count(at, len(data)), 0


def both_cases(data: bytes, quoted: bool) -> tuple[int, int, int, int]:
    """Records and end for a stretch that begins with a record, and for one that begins inside quotes."""
    lines = Lines(data)
    if not quoted or b'"' not in data:
        return lines.count(0, len(data)), 0, 0, 1
    outside = count_records(data, lines, 0)
    rest = _REST.match(data)
    return (*outside, *(count_records(data, lines, rest.end()) if rest else (0, 1)))


def records_of(file, size: int, start: int, end: int, inside: int, quoted: bool) -> Iterator[bytes]:
    """The records that begin in a range, the last one to its end."""
    (place, data), at = stretch(file, size, start, end), 0
    stop = len(data)
    if inside:
        rest = _REST.match(data)
        if rest is None:
            return
        at = rest.end()
    while at < stop:
        quote = data.find(b'"', at) if quoted else -1
        line = line_start(data, at, quote) if quote >= 0 else stop
        yield from (x for x in data[at:line].split(b"\n") if x)
        if quote < 0:
            return
        more = 1 << 20
        while (found := _RECORD.match(data, line)) is None:
            # the record goes on beyond the range; quotes that never close hold the rest of the file
            added = to_line_end(file, size, place + len(data), more)
            if not added:
                yield data[line:]
                return
            data += added
            more *= 2
        yield data[line:found.end()].removesuffix(b"\n")
        at = found.end()


# ---- the index

INDEX = "path string, length long, start long, stop long, inside int, heads int, count long, first long"


def index_files(files: DataFrame, quoted: bool = True, header: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per range of the files in ``path`` and ``length``: how it is to be read, and its first position in the file.

    ``inside``: 1 where it begins inside quotes; ``heads``: records to leave out (the header).
    """
    spark = files.sparkSession
    home = working_folder(spark)
    step, last = F.lit(range_bytes).cast("long"), F.greatest(F.col("length") - 1, F.lit(0))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, step)).alias("start"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, length, start in zip(frame["path"], frame["length"], frame["start"]):
                system, inner = located_file(path, home)
                with system.open_input_file(inner) as file:
                    rows.append(both_cases(stretch(file, length, start, start + range_bytes)[1], quoted))
            yield pd.concat([frame[["path", "length", "start"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n0", "s0", "n1", "s1"])], axis=1)

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        rows, inside, before, heads = [], 0, 0, 1 if header else 0
        for r in part.sort_values("start").itertuples(index=False):
            found, then = (r.n1, r.s1) if inside else (r.n0, r.s0)
            # a range without a line begin changes nothing
            mine = min(heads, found)
            rows.append((r.path, r.length, r.start, min(r.start + range_bytes, r.length), inside, mine, found - mine, before))
            heads, before, inside = heads - mine, before + found - mine, then
        return pd.DataFrame(rows, columns=["path", "length", "start", "stop", "inside", "heads", "count", "first"])

    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cases = ranges.repartition(tasks, "path", "start").mapInPandas(counted, "path string, length long, start long, n0 long, s0 int, n1 long, s1 int")
    # one row per range: a file of a terabyte has some 30,000
    return cases.groupBy("path").applyInPandas(joined, INDEX)


def listed(spark: SparkSession, paths, part: int = 0) -> DataFrame:
    """``path``, ``length`` and ``part`` of files, folders or patterns."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select(decoded_path(F.col("_metadata.file_path")).alias("path"), "length", F.lit(part).alias("part"))


def keep_index(files: DataFrame, folder: str, per_folder: bool = False, quoted: bool = True, header: bool = True, range_bytes: int = RANGE_BYTES) -> None:
    """Write the index of ``listed`` files, with positions over all files of a system.

    A file is a system of its own, or with ``per_folder`` all files of a folder are one; with
    ``per_folder`` None all are. Order: the part, the folder, the number that Spark gave
    a file, its name. The index has a row per range and is written as one small table.
    """
    spark = files.sparkSession
    name = F.element_at(F.split("path", "/"), -1)
    place = F.regexp_replace("path", r"/[^/]*\z", "")
    system = F.lit("") if per_folder is None else place if per_folder else F.col("path")
    ranges = index_files(files.select("path", "length"), quoted, header, range_bytes).join(files.select("path", "part"), "path")
    order = [F.col("part"), place, F.coalesce(F.regexp_extract(name, r"\Apart-([0-9]+)", 1).try_cast("bigint"), F.lit(-1)), F.col("path")]
    sizes = ranges.groupBy("part", "path").agg(F.sum("count").alias("records")).withColumn("system", system)
    # one row per file
    earlier = Window.partitionBy("system").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("records").over(earlier), F.lit(0)))
    placed = ranges.join(sizes.drop("records"), ["part", "path"])
    placed.select("system", "part", "path", "length", "start", "stop", "inside", "heads", "count", (F.col("before") + F.col("first")).alias("first"),
                  F.lit(quoted).alias("quoted")).write.parquet(folder)


# ---- reading by the index


class Range(InputPartition):
    """A row of the index, and those of the ranges that are read after it by the same task."""

    def __init__(self, row: dict, low: int, high: int, others=()):
        super().__init__(0)
        self.rows, self.low, self.high = [row, *others], low, high


def shared_tasks(rows: list[dict], tasks: int = TASKS, most: int = RANGE_BYTES) -> list[list[dict]]:
    """Ranges in the order of files and places, those that one task reads together."""
    if len(rows) <= tasks:
        return [[r] for r in rows]
    limit = min(most, sum(r["stop"] - r["start"] for r in rows) // tasks)
    out, size = [], limit
    for r in sorted(rows, key=lambda r: (r["path"], r["start"])):
        mine = r["stop"] - r["start"]
        if size + mine > limit:
            out.append([])
            size = 0
        out[-1].append(r)
        size += mine
    return out


class RecordReader(DataSourceReader):
    """Opens the ranges that may hold the asked positions, and gives out only those."""

    def __init__(self, options: dict):
        self.options, self.low, self.high, self.systems = options, 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("_pos",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            elif getattr(f, "attribute", None) == ("_system",) and isinstance(f, EqualTo):
                self.systems = {f.value} if self.systems is None else self.systems & {f.value}
            # Spark applies all of them once more
            yield f

    def partitions(self) -> list[Range]:
        import pyarrow.parquet as pq

        system, inner = located_file(self.options["index"], self.options["home"])
        rows = pq.read_table(inner, filesystem=system).to_pylist()
        wanted = [r for r in rows
                  if r["count"] and r["first"] < self.high and r["first"] + r["count"] > self.low and (self.systems is None or r["system"] in self.systems)]
        return [Range(first, self.low, self.high, others) for first, *others in shared_tasks(wanted)] or [Range({}, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for row in partition.rows:
            if row:
                yield from self.read_range(row, partition.low, partition.high)

    def read_range(self, row: dict, low: int, high: int) -> Iterator[pa.RecordBatch]:
        system, inner = located_file(row["path"], self.options["home"])
        if system.get_file_info(inner).size != row["length"]:
            raise ValueError(f"{row['path']} has changed since its index was made")
        held, size, pos = [], 0, row["first"] - row["heads"]
        low, high = max(low, row["first"]), min(high, row["first"] + row["count"])
        header = self.options.get("header", "").encode()

        def batch(records: list[bytes], end: int) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array([row["system"]] * n, pa.string()), pa.array([row["path"]] * n, pa.string()), pa.array(range(end - n, end), pa.int64()), pa.array(records, pa.binary())],
                names=["_system", "_file", "_pos", "_record"])

        with system.open_input_file(inner) as file:
            for record in records_of(file, row["length"], row["start"], row["stop"], row["inside"], row["quoted"]):
                if pos < row["first"]:
                    if header and record.removeprefix(b"\xef\xbb\xbf") != header:
                        raise ValueError(f"{row['path']} has other columns: {record[:200]!r}")
                elif pos >= high:
                    break
                elif pos >= low:
                    held.append(record)
                    size += len(record) + 100
                pos += 1
                if size >= BATCH_BYTES:
                    yield batch(held, pos)
                    held, size = [], 0
        if held:
            yield batch(held, pos)


class IndexedRecords(DataSource):
    """The records of indexed files: ``_system``, ``_file``, ``_pos`` in the system, ``_record``."""

    @classmethod
    def name(cls) -> str:
        return "indexed_records"

    def schema(self) -> str:
        return "_system string, _file string, _pos long, _record binary"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))


def scan_records(spark: SparkSession, index: str, columns: list[str], options: dict) -> DataFrame:
    """``_system``, ``_file``, ``_pos`` and the named columns, as texts, of the files of an index.

    A filter on ``_pos`` or ``_system`` decides which ranges of which files are opened.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedRecords)
    rows = spark.read.format("indexed_records").options(index=index, home=working_folder(spark), header="\t".join(columns)).load()
    cells = F.from_csv(F.col("_record").cast("string"), ", ".join(f"`{c}` string" for c in columns), options | {"header": "false"})
    place = ("_system", "_file", "_pos")
    return rows.select(*place, cells.alias("_cells")).select(*place, *[F.col(f"_cells.`{c}`") for c in columns])


def select_records(spark: SparkSession, index: str, expression: str, columns: list[str], options: dict, systems: dict[str, str]) -> DataFrame:
    """The rows of a split expression (``a[2:5]+b``) over indexed files, with ``pos`` running over the result.

    ``systems`` names the system of each split. Only the ranges of the asked positions are read.
    """
    sizes = {r["system"]: r["n"] for r in spark.read.parquet(index).filter(F.col("system").isin(*systems.values())).groupBy("system").agg(F.sum("count").alias("n")).collect()}
    out, before = None, 0
    for name, start, stop in parse_split(expression):
        if systems.get(name) not in sizes:
            raise ValueError(f"unknown split: {name}")
        first, end, _ = slice(start, stop).indices(sizes[systems[name]])
        rows = scan_records(spark, index, columns, options).filter((F.col("_system") == systems[name]) & (F.col("_pos") >= first) & (F.col("_pos") < end))
        rows = rows.select(F.lit(name).alias("split"), (F.col("_pos") - first + before).alias("pos"), *[F.col(f"`{c}`") for c in columns])
        out = rows if out is None else out.unionByName(rows)
        before += max(end - first, 0)
    return out


def temporary_index(files: DataFrame, **how) -> str:
    """An index that goes when the driver ends."""
    spark = files.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    keep_index(files, folder, **how)
    return folder
