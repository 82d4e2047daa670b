"""Positions and running totals over a global order, without one-task windows.

Spark range-partitions the rows, every range is numbered on its own, and the
totals of the ranges (one row per range and group) give the offsets. A group
may therefore be as large as the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from metaeval.operators.lookup import attach
from metaeval.session import cut

# monotonically_increasing_id() holds the partition in the bits above these.
_INDEX_BITS = 33


def group_key(by) -> Column:
    """The grouping columns as one struct, so that NULL keys match each other."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def with_positions(df: DataFrame, by=(), order=(), name: str = "pos") -> DataFrame:
    """Number the rows of every ``by`` group from 0 in the order of ``order``.

    ``order`` (names or Columns) must not tie inside a group; ties of names raise.
    Given names, only the columns that decide the order are written out; all others
    are joined back by them. Given Columns, whole rows are written: keep them narrow.
    """
    names = [*by, *order] if all(isinstance(o, str) for o in order) else df.columns
    if any(c not in names for c in df.columns):
        keys = {c: f"_k{i}" for i, c in enumerate(dict.fromkeys(names))}
        placed = with_positions(df.select(*keys), by, order, name).withColumnsRenamed(keys)
        # rows that share a key would meet each other in the join
        shared = F.raise_error(F.concat(F.lit("rows share a place in the order: "), F.to_json(F.struct(*keys.values())))).cast("bigint")
        placed = placed.groupBy(*keys.values()).agg(F.min(name).alias("_at"), F.count(F.lit(1)).alias("_rows")).select(
            *keys.values(), F.when(F.col("_rows") == 1, F.col("_at")).otherwise(shared).alias(name))
        same = F.lit(True)
        for mine, other in keys.items():
            same = same & F.col(f"l.`{mine}`").eqNullSafe(F.col(f"r.{other}"))
        return df.alias("l").join(placed.alias("r"), same).select(
            *[F.col(f"l.`{c}`") for c in df.columns if c != name], F.col(f"r.{name}"))
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    tagged = ranged.withColumn("_group", group_key(by)).withColumn(
        "_range", F.shiftright("_row", _INDEX_BITS))
    blocks = tagged.groupBy("_group", "_range").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    return number_blocks(tagged, blocks, ["_group"], ["_range"], name, few=not by).drop("_group", "_range")


def number_blocks(rows: DataFrame, blocks: DataFrame, group, order, name: str, few: bool = False) -> DataFrame:
    """Positions for rows that carry ``_row`` and lie in consecutive blocks.

    ``blocks`` has one row per block: ``_first`` (lowest ``_row`` that counts)
    and ``_count``. ``group`` + ``order`` name the block; ``order`` sorts the
    blocks of a group. Rows ahead of their block's first are dropped. ``few``: there are
    no more blocks than partitions, so they are broadcast without being measured.
    """
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = blocks.select(
        *group, *order, "_first",
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_earlier"))
    on = [*group, *order]
    placed = rows.join(F.broadcast(starts), on) if few else attach(rows, starts, on=on, spread=["_row"], how="inner")
    return (
        placed.filter(F.col("_row") >= F.col("_first"))
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_earlier"))
        .drop("_row", "_first", "_earlier")
    )


def running_totals(rows: DataFrame, group, order, weight: str) -> DataFrame:
    """Add ``_before`` and ``_total``: the weight ahead of a row, and of its group.

    ``group`` columns must not be NULL; ``group`` + ``order`` must be unique.
    """
    group = list(group)
    ranged = cut(rows.repartitionByRange(*group, *order).withColumn(
        "_range", F.spark_partition_id()))
    totals = ranged.groupBy(*group, "_range").agg(F.sum(weight).alias("_sum"))
    by_range = Window.partitionBy(*group).orderBy("_range")
    offsets = totals.select(
        *group, "_range",
        F.coalesce(F.sum("_sum").over(by_range.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        local.join(offsets, [*group, "_range"])
        .withColumn("_before", F.col("_offset") + F.col("_local"))
        .drop("_offset", "_local", "_range")
    )
