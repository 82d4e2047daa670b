"""Joins of many rows with few, and joins on keys of very unequal weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType

from metaeval.session import cut

# A table is broadcast only when measured at or below these sizes.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Least number of copies of fewer than HEAVY_SHARE keys that are too long to broadcast.
SALTS = 16
# At most this many keys can each hold more than 1/HEAVY_SHARE of all rows.
HEAVY_SHARE = 1000


def within_limits(kept: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a table, counted and weighed, may be broadcast."""
    width = F.lit(16 * len(kept.columns))
    for field in kept.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif field.dataType.typeName() in ("struct", "array", "map"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    rows, size = kept.agg(F.count(F.lit(1)), F.sum(width)).first()
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    return rows <= limit and (size or 0) <= MAX_BROADCAST_BYTES


def attach(rows: DataFrame, small: DataFrame, on, spread, how: str = "left",
           max_rows: int | None = None) -> DataFrame:
    """Join ``small`` (one row per key) to ``rows``, where one key may hold most rows.

    ``small`` is measured first. Up to the limits it is broadcast. Beyond them the
    rows of each key are counted. Keys holding more than 1/``HEAVY_SHARE`` of all
    rows are fewer than ``HEAVY_SHARE``: their entries are broadcast, or shuffled with
    a salt where keys are long. All other keys cannot swamp a task. ``spread`` names
    columns that tell the rows of one key apart.
    """
    kept = cut(small)
    if within_limits(kept, max_rows):
        return rows.join(F.broadcast(kept), on, how)
    counts = cut(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    heavy = cut(counts.filter(F.col("_rows") * F.lit(HEAVY_SHARE) > F.lit(total)).select(*on, F.lit(True).alias("_heavy")))
    if heavy.isEmpty():
        return rows.join(kept, on, how)
    marked = rows.join(heavy_side(heavy), on, "left")
    many = kept.join(heavy_side(heavy), on).drop("_heavy")
    first = marked.filter("_heavy").drop("_heavy")
    if within_limits(cut(many)):
        first = first.join(F.broadcast(many), on, how)
    else:
        first = salted_join(first, many, on, spread, how)
    return first.unionByName(marked.filter("_heavy IS NULL").drop("_heavy").join(kept, on, how))


def heavy_side(heavy: DataFrame) -> DataFrame:
    """The heavy keys, fewer than ``HEAVY_SHARE``: broadcast unless they are long texts."""
    return F.broadcast(heavy) if within_limits(heavy) else heavy


def salted_join(rows: DataFrame, few: DataFrame, on, spread, how: str = "inner") -> DataFrame:
    """Join by key and salt: rows take their salt from ``spread``, ``few`` is copied once per salt."""
    salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def join_by_weight(rows: DataFrame, lookup: DataFrame, on, weight: str, total: int,
                   spread=None) -> DataFrame:
    """Inner join with ``lookup``, whose ``weight`` counts the ``rows`` of each key.

    Keys holding more than 1/``HEAVY_SHARE`` of the ``total`` rows are fewer than
    ``HEAVY_SHARE``, so they are broadcast; no other key can swamp a task, and
    those meet their rows by an ordinary shuffle join. Heavy keys that are too
    long to broadcast together are salted by the ``spread`` columns of the rows.
    """
    heavy = F.col(weight) * F.lit(HEAVY_SHARE) > F.lit(total)
    many = lookup.filter(heavy)
    few = lookup.filter(~heavy)
    if spread is None or within_limits(many):
        first = rows.join(F.broadcast(many), on)
        rest = rows.join(F.broadcast(many.select(*on)), on, "left_anti")
    else:
        first = salted_join(rows, many, on, spread)
        rest = rows
    return first.unionByName(rest.join(few, on))
