"""Named splits: ordered unions, slices, heads, and row filters with accounts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

# The form of a split with bounds, and the separator of a union.
SLICED = re.compile(r"\A(?P<name>[^\[\]]+)\[(?P<start>-?\d*):(?P<stop>-?\d*)\]\Z")
UNION = "+"


def parse_split(expression: str) -> list[tuple[str, int | None, int | None]]:
    """``a+b[2:5]`` as (name, start, stop) parts in the written order."""
    parts = []
    for part in expression.split(UNION):
        bounds = SLICED.match(part)
        if bounds is None:
            parts.append((part, None, None))
        else:
            number = lambda text: int(text) if text else None
            parts.append((bounds["name"], number(bounds["start"]), number(bounds["stop"])))
    return parts


def select_split(df: DataFrame, expression: str, split: str = "split", pos: str = "pos"
                 ) -> DataFrame:
    """The rows of a split expression, with ``pos`` running over the whole result.

    A part named twice gives its rows twice. Positions are shifted by the size of
    the parts before, so nothing is sorted. ``pos`` counts from 0 inside each
    split of ``df``. A name that no row has raises when the rows are asked for.
    """
    spark = df.sparkSession
    parts = parse_split(expression)
    # one row per written part
    wanted = spark.createDataFrame(
        [(i, *part) for i, part in enumerate(parts)],
        "_part int, _name string, _start bigint, _stop bigint",
    )
    names = sorted({name for name, _, _ in parts})
    rows = df.filter(F.col(split).isin(names))
    sizes = rows.groupBy(F.col(split).alias("_name")).agg(F.count(F.lit(1)).alias("_size"))
    unknown = F.raise_error(F.concat(F.lit("unknown split: "), F.col("_name"))).cast("bigint")
    size = F.coalesce("_size", unknown)

    def bound(column: str, missing: Column) -> Column:
        given = F.col(column)
        from_end = F.when(given < 0, given + size).otherwise(given)
        return F.least(F.greatest(F.coalesce(from_end, missing), F.lit(0)), size)

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        wanted.join(sizes, "_name", "left")
        .select("_part", "_name", bound("_start", F.lit(0)).alias("_from"),
                bound("_stop", size).alias("_to"))
        .withColumn("_len", F.greatest(F.col("_to") - F.col("_from"), F.lit(0)))
        # as many rows as the expression has parts
        .withColumn("_offset", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    )
    return (
        rows.join(F.broadcast(placed), rows[split] == placed["_name"])
        .filter((F.col(pos) >= F.col("_from")) & (F.col(pos) < F.col("_to")))
        .withColumn(pos, F.col("_offset") + F.col(pos) - F.col("_from"))
        .drop("_part", "_name", "_from", "_to", "_len", "_offset")
    )


def slice_rows(df: DataFrame, start: int, stop: int, pos: str = "pos") -> DataFrame:
    """Rows ``start`` to ``stop`` - 1."""
    return df.filter((F.col(pos) >= start) & (F.col(pos) < stop))


def head_rows(df: DataFrame, count: int, pos: str = "pos") -> DataFrame:
    """The first ``count`` rows by position; all rows if ``count`` is not positive."""
    return df.filter(F.col(pos) < count) if count > 0 else df


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of the non-empty frames given (``None`` is skipped)."""
    given = [f for f in frames if f is not None]
    result = given[0]
    for frame in given[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def readable_rows(df: DataFrame, flag: str = "is_readable") -> DataFrame:
    """The rows whose audio can be read."""
    return df.filter(F.col(flag))


def readable_account(df: DataFrame, flag: str = "is_readable") -> DataFrame:
    """One row: rows before and after the readability filter, and the loss."""
    return df.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(F.col(flag)).alias("n_after"),
    ).withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def require_rows(df: DataFrame, message: str = "the dataset has no rows") -> DataFrame:
    """``df`` itself; raises at once if it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def row_count_checked(df: DataFrame, message: str = "the dataset has no rows") -> DataFrame:
    """One row with the row count; the query fails when that is zero."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    failure = F.raise_error(F.lit(message)).cast("bigint")
    return counted.select(F.when(F.col("n_rows") > 0, F.col("n_rows")).otherwise(failure)
                          .alias("n_rows"))
