"""Running a scorer over batches of rows."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from metaeval.operators.batches import BATCH
from metaeval.sources.inventory import located_file, working_folder


def batches_of(frames: Iterator[pd.DataFrame], batch_size: int) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in order, ``batch_size`` at a time.

    A change of ``batch_id``, where the rows have one, also ends a batch.
    """
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        while len(rest):
            size = min(batch_size, len(rest))
            if BATCH in rest.columns:
                size = int((rest[BATCH].iloc[:size] == rest[BATCH].iloc[0]).cummin().sum())
            # the open end may go on in the next frame
            if size == len(rest) and size < batch_size:
                break
            yield rest.iloc[:size].reset_index(drop=True)
            rest = rest.iloc[size:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


UNIT = "_unit"


def with_units(rows: DataFrame, batches_per_unit: int) -> DataFrame:
    """Number the units that ``score_resumable`` commits, and bring each into one task.

    A unit is a run of neighbouring batches: some thousands of rows, never a group that grows.
    """
    return rows.withColumn(UNIT, F.expr(f"{BATCH} div {int(batches_per_unit)}")).repartition(UNIT)


def score_resumable(rows: DataFrame, load_scorer: Callable[[], Callable[[pd.DataFrame], list]], folder: str, key,
                    batch_size: int = 1, name: str = "pred_strings", drop=()) -> DataFrame:
    """As ``score``, for rows ``with_units``; predictions of a unit are kept in ``folder`` once all are there.

    A task that runs again, on another machine or after a new start, takes kept units
    as they are: the scorer sees only what is missing, and is not even loaded if
    nothing is. A unit counts as kept only for the very rows it was made from: a digest
    of their columns stands beside the predictions. ``key`` orders the rows of a batch.
    A unit's file appears under its name in one step, so half a unit is never read.
    """
    home = working_folder(rows.sparkSession)
    # maps and such have no digest of their own: their text stands for them
    content = F.xxhash64(*[F.to_json(F.struct(f.name)) if f.dataType.typeName() in ("map", "variant") else F.col(f.name) for f in rows.schema.fields])
    kept = [f for f in rows.schema.fields if f.name not in (*drop, UNIT)]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField(name, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for unit in units_of(frames):
            digest = hashlib.sha256(unit["_content"].to_numpy("int64").tobytes()).hexdigest()
            place = f"{folder}/unit-{int(unit[UNIT].iloc[0]):012d}-{digest[:32]}.json"
            found = kept_unit(place, home)
            if found is None:
                scorer = scorer or load_scorer()
                found = []
                for batch in batches_of(iter([unit.drop(columns=["_content", UNIT])]), batch_size):
                    predictions = list(scorer(batch))
                    if len(predictions) != len(batch):
                        raise ValueError("the scorer must return one prediction per row")
                    found += predictions
                keep_unit(place, home, found)
            yield unit[names].assign(**{name: found})

    ordered = rows.withColumn("_content", content).sortWithinPartitions(UNIT, BATCH, *key)
    return ordered.mapInPandas(run, schema)


def units_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each unit together; the rows come ordered by unit."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        units = frame[UNIT].to_numpy()
        cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1), len(frame)]
        for first, end in zip(cuts, cuts[1:]):
            if held and held[0][UNIT].iat[0] != units[first]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[first:end])
    if held:
        yield pd.concat(held, ignore_index=True)


def kept_unit(place: str, home: str) -> list | None:
    """The predictions kept under a name, or None if there are none."""
    system, inner = located_file(place, home)
    try:
        with system.open_input_stream(inner) as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


def keep_unit(place: str, home: str, predictions: list) -> None:
    """Write the predictions beside their place and move them there; a second writer writes the same."""
    system, inner = located_file(place, home)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    aside = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as file:
        file.write(json.dumps(predictions).encode())
    system.move(aside, inner)


def score(rows: DataFrame, load_scorer: Callable[[], Callable[[pd.DataFrame], list]],
          batch_size: int = 1, name: str = "pred_strings", drop=()) -> DataFrame:
    """Add one prediction text per row.

    ``load_scorer`` runs once per task and returns the function that turns a
    batch into predictions. All columns are carried along, but those in ``drop``
    (the raw samples, say) only as far as the scorer.
    """
    kept = [f for f in rows.schema.fields if f.name not in drop]
    schema = StructType([*kept, StructField(name, StringType())])
    names = [f.name for f in kept]

    def run(frames):
        scorer = load_scorer()
        for batch in batches_of(frames, batch_size):
            predictions = scorer(batch)
            if len(predictions) != len(batch):
                raise ValueError("the scorer must return one prediction per row")
            yield batch[names].assign(**{name: list(predictions)})

    return rows.mapInPandas(run, schema)
