"""Score objects whose list of scores is larger than a task should hold.

``{"system_score": …, "scores": [ … ]}`` is cut into ranges of bytes. The list is
flat, so its elements are what stands between commas, and it ends at the first closing
bracket after its opening one. Each range tells how many elements begin in it and
whether the list ends there; put together, these numbers give the position of every
range's first element, and the ranges are read by themselves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metaeval.session import cut
from metaeval.sources.inventory import located_file, working_folder

RANGE_BYTES = 32 << 20
#: Where the opening bracket, and after the list the system's score, are looked for.
MARGIN = 1 << 16
BATCH = 100_000

_OPENING = re.compile(rb'"scores"\s*:\s*\[')
_SYSTEM = re.compile(rb'"system_score"\s*:\s*(null|[-+0-9.eE]+)')


def list_start(file, size: int, path: str) -> int:
    """The place after the opening bracket of the list."""
    found = _OPENING.search(file.read_at(min(MARGIN, size), 0))
    if found is None:
        raise ValueError(f"{path} has no list of scores in its first {MARGIN} bytes")
    return found.end()


def element_starts(data: bytes, first: int, opens: int) -> tuple[np.ndarray, int | None]:
    """Places where elements may begin among bytes that stand from ``first`` on, and where the list ends, if it does."""
    data = data[max(0, opens - first):]
    first = max(first, opens)
    end = data.find(b"]")
    commas = np.flatnonzero(np.frombuffer(data[:end] if end >= 0 else data, np.uint8) == 44) + 1 + first
    return commas, None if end < 0 else first + end


def system_score(file, size: int, opens: int, closes: int) -> float | None:
    """The score beside the list, before or after it."""
    for start, end in ((0, opens), (closes, min(size, closes + MARGIN))):
        found = _SYSTEM.search(file.read_at(end - start, start))
        if found:
            return json.loads(found[1])
    return None


def list_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``start``, ``stop``, ``first`` position, ``count``, ``system_score`` of the ranges of the lists in ``path``, ``length``."""
    spark = files.sparkSession
    home = working_folder(spark)
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step)).alias("start"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, length, start in frame.itertuples(index=False):
                system, inner = located_file(path, home)
                with system.open_input_file(inner) as file:
                    opens = list_start(file, length, path)
                    stop = min(start + range_bytes, length)
                    starts, closes = element_starts(file.read_at(stop - start, start), start, opens)
                    # the first element follows the bracket rather than a comma; one that begins at the range's end is the next one's
                    own = int((starts < stop).sum()) + (start <= opens < stop) + _comma_before(file, start, opens)
                    score = system_score(file, length, opens, closes) if closes is not None else None
                    rows.append((path, start, stop, own, closes, closes is not None and _is_empty(file, opens, closes), score))
            yield pd.DataFrame(rows, columns=["path", "start", "stop", "own", "closes", "empty", "score"])

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        rows, before, score = [], 0, None
        for r in part.sort_values("start").itertuples(index=False):
            rows.append([r.path, r.start, r.stop, before, r.own])
            before += r.own
            if not pd.isna(r.closes):
                score = r.score
                if r.empty:
                    rows = []
                break
        else:
            raise ValueError(f"the list of {part['path'].iloc[0]} has no end")
        return pd.DataFrame([[*r, score] for r in rows], columns=["path", "start", "stop", "first", "count", "system_score"])

    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cases = ranges.repartition(tasks, "path", "start").mapInPandas(counted, "path string, start long, stop long, own long, closes long, empty boolean, score double")
    return cases.groupBy("path").applyInPandas(placed, "path string, start long, stop long, first long, count long, system_score double")


def _comma_before(file, start: int, opens: int) -> int:
    """1 if the byte before a range is a comma of the list, so that an element begins with the range."""
    return int(start > opens and file.read_at(1, start - 1) == b",")


def _is_empty(file, opens: int, closes: int) -> bool:
    return closes - opens < MARGIN and not file.read_at(closes - opens, opens).strip()


def range_values(file, size: int, start: int, stop: int, opens: int) -> Iterator[list]:
    """The elements that begin in a range, some at a time; the last one is read to its end."""
    data = file.read_at(stop - start, start)
    begins = opens - start if start <= opens < stop else 0 if _comma_before(file, start, opens) else data.find(b",") + 1
    closing = data.find(b"]", max(0, opens - start))
    if closing < 0:
        # what begins in the range's last bytes may end beyond; an element that begins at its end does not count
        at = stop
        while data and not data.endswith((b",", b"]")) and at < size:
            more = re.match(rb"[^,\]]*[,\]]?", file.read_at(min(256, size - at), at))[0]
            data, at = data + more, at + len(more)
        closing = len(data) - (data[-1:] in b",]")
    parts = data[begins:closing]
    first = 0
    while first <= len(parts):
        cut = parts.find(b",", first + 20 * BATCH)
        cut = len(parts) if cut < 0 else cut
        yield json.loads(b"[" + parts[first:cut] + b"]")
        first = cut + 1


def explode_lists(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``system``, ``system_score``, ``pos``, ``value`` of the lists in the files ``path`` of ``length`` bytes, a task per range."""
    spark = files.sparkSession
    home = working_folder(spark)
    # a row per range, kept: a reader that runs again does not count again
    ranges = cut(list_ranges(files, range_bytes).filter("count > 0").join(files.select("path", "length"), "path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                path, pos = r["path"], r["first"]
                system, inner = located_file(path, home)
                with system.open_input_file(inner) as file:
                    for values in range_values(file, r["length"], r["start"], r["stop"], list_start(file, r["length"], path)):
                        n = len(values)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * n, pa.string()), pa.array([r["system_score"]] * n, pa.float64()), pa.array(range(pos, pos + n), pa.int64()),
                             pa.array([None if x is None else float(x) for x in values], pa.float64())], names=["system", "system_score", "pos", "value"])
                        pos += n
                if pos != r["first"] + r["count"]:
                    raise ValueError(f"{path} from {r['start']}: {pos - r['first']} elements instead of {r['count']}")

    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, "system string, system_score double, pos long, value double")
