"""Rank correlation over any number of groups in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from metaeval.operators.lookup import attach, join_by_weight, within_limits
from metaeval.operators.ordering import group_key, running_totals
from metaeval.operators.splits import stack
from metaeval.session import cut

# Groups with at most this many distinct value pairs are ranked by a window each.
WINDOW_CELLS = 1_000_000


def present(value: Column) -> Column:
    """Whether a score counts: neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def spearman(pairs: DataFrame, x: str, y: str, by=(), levels: dict | None = None,
             window_cells: int = WINDOW_CELLS, max_rows: int | None = None) -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` in every ``by`` group.

    Pairs with a missing side are left out, ties share their mean rank, and a
    group without spread has no correlation (NULL). The result has the ``by``
    columns, ``n_rows``, ``n_pairs`` and ``spearman``.

    ``levels`` maps a level name to the ``by`` columns it keeps; each row then
    counts once per level (column ``level``, dropped keys NULL). Ranks differ
    between levels, so one level cannot be derived from another.

    Rows are first counted per distinct pair of values (a cell); all later steps
    work on the counts. Groups of at most ``window_cells`` cells are ranked by a
    window each. Larger ones take their ranks from a range-partitioned order, so
    a group may hold any share of the data. ``max_rows`` bounds the broadcasts.
    """
    by = list(by)
    both = present(F.col(x).cast("double")) & present(F.col(y).cast("double"))
    values = [F.when(both, F.col(x).cast("double")).alias("_x"),
              F.when(both, F.col(y).cast("double")).alias("_y")]
    cells = pairs.select(*by, *values).groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    if levels is not None:
        # rows are counted once, and only the counts are taken to every level
        keys = F.explode(_level_keys(pairs, by, levels)).alias("_k")
        by = ["level", *by]
        cells = cells.select(keys, "_x", "_y", "_n").select("_k.*", "_x", "_y", "_n").groupBy(*by, "_x", "_y").agg(F.sum("_n").alias("_n"))
    cells = cut(cells)
    sizes = cells.groupBy(*by).count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= window_cells:
        sums = _sums_by_window(cells, by)
    else:
        # fewer large groups than cells / window_cells
        large = cut(sizes.filter(F.col("count") > window_cells).select(
            group_key(by).alias("_g"), F.monotonically_increasing_id().alias("_i")))
        marked = attach(cells.withColumn("_g", group_key(by)), large, ["_g"],
                        spread=["_x", "_y"], max_rows=max_rows)
        numbered = cut(marked.filter("_i IS NOT NULL").select("_i", "_x", "_y", "_n"))
        sums = _sums_by_range(numbered, max_rows).join(large, "_i").select(
            *[F.col("_g").getField(c).alias(c) for c in by], *SUMS)
        if by:
            sums = stack(sums, _sums_by_window(marked.filter("_i IS NULL"), by))
    scale = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    return sums.select(
        *by, "n_rows", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        F.try_divide(F.col("_xy"), scale).alias("spearman"),
    )


SUMS = ["n_rows", "n_pairs", "_xx", "_yy", "_xy"]


def _level_keys(pairs: DataFrame, by, levels: dict) -> Column:
    """The group keys a row has at every level, as an array of structs."""
    copies = []
    for level, kept in levels.items():
        missing = {c: F.lit(None).cast(pairs.schema[c].dataType) for c in by if c not in kept}
        copies.append(F.struct(
            F.lit(level).alias("level"), *[missing.get(c, F.col(c)).alias(c) for c in by]))
    return F.array(*copies)


def _pair_count() -> Column:
    return F.when(F.col("_x").isNotNull(), F.col("_n"))


def _sums_by_window(cells: DataFrame, by) -> DataFrame:
    """Row counts and sums of squares and products of the centred ranks, per group.

    A centred rank is the mean rank minus the group's middle rank: half of
    (weight below) - (weight above). It is exact, so an axis without spread
    sums to exactly zero. Invalid pairs form one cell that weighs nothing.
    """
    def up_to_and_ties(df: DataFrame, value: str) -> DataFrame:
        ordered = Window.partitionBy(*by).orderBy(value)
        return df.withColumns({
            "_up": F.sum("_p").over(ordered.rangeBetween(Window.unboundedPreceding, 0)),
            "_ties": F.sum("_p").over(ordered.rangeBetween(0, 0)),
        })

    centred = F.col("_up") - (F.col("_ties") + F.col("_all")) / F.lit(2.0)
    ranked = up_to_and_ties(cells.withColumn("_p", F.coalesce(_pair_count(), F.lit(0))), "_x")
    ranked = ranked.withColumn("_all", F.sum("_p").over(Window.partitionBy(*by)))
    ranked = ranked.withColumn("_cx", centred)
    ranked = up_to_and_ties(ranked, "_y").withColumn("_cy", centred)
    return ranked.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_p").alias("n_pairs"),
        F.sum(F.col("_p") * F.col("_cx") * F.col("_cx")).alias("_xx"),
        F.sum(F.col("_p") * F.col("_cy") * F.col("_cy")).alias("_yy"),
        F.sum(F.col("_p") * F.col("_cx") * F.col("_cy")).alias("_xy"),
    )


def _sums_by_range(cells: DataFrame, max_rows: int | None = None) -> DataFrame:
    """As ``_sums_by_window`` per group number ``_i``, with ranks from a ranged order."""
    valid = cells.filter(F.col("_x").isNotNull())
    axes = F.explode(F.array(
        F.struct(F.lit(0).alias("axis"), F.col("_x").alias("v")),
        F.struct(F.lit(1).alias("axis"), F.col("_y").alias("v")),
    ))
    values = (
        valid.select("_i", "_n", axes.alias("_a"))
        .groupBy("_i", F.col("_a.axis").alias("axis"), F.col("_a.v").alias("_v"))
        .agg(F.sum("_n").alias("_w"), F.count(F.lit(1)).alias("_cells"))
    )
    centred = F.col("_before") + (F.col("_w") - F.col("_total")) / F.lit(2.0)
    ranks = cut(running_totals(values, ["_i", "axis"], ["_v"], "_w").select(
        "_i", "axis", "_v", "_w", "_cells", centred.alias("_c")))
    x_ranks = ranks.filter("axis = 0").select("_i", F.col("_v").alias("_x"), "_w", "_c")
    y_ranks = ranks.filter("axis = 1").select(
        "_i", F.col("_v").alias("_y"), F.col("_c").alias("_cy"), "_cells")
    # y ranks meet the cells, which are then summed per x; so the x ranks join
    # one row to one row, and only the first join can meet unequal keys.
    if within_limits(y_ranks, max_rows):
        joined = valid.join(F.broadcast(y_ranks), ["_i", "_y"])
    else:
        joined = join_by_weight(valid, y_ranks, ["_i", "_y"], "_cells", valid.count())
    summed = (
        joined.groupBy("_i", "_x").agg(F.sum(F.col("_n") * F.col("_cy")).alias("_s"))
    )
    by_x = summed.join(x_ranks, ["_i", "_x"]).groupBy("_i").agg(
        F.sum(F.col("_w") * F.col("_c") * F.col("_c")).alias("_xx"),
        F.sum(F.col("_c") * F.col("_s")).alias("_xy"),
    )
    by_y = ranks.filter("axis = 1").groupBy("_i").agg(
        F.sum(F.col("_w") * F.col("_c") * F.col("_c")).alias("_yy"))
    sizes = cells.groupBy("_i").agg(
        F.sum("_n").alias("n_rows"), F.sum(_pair_count()).alias("n_pairs"))
    return sizes.join(by_x, "_i", "left").join(by_y, "_i", "left")


def correlation_report(rows: DataFrame, prediction: str, labels: dict, by=(),
                       lower_is_better=(), **options) -> DataFrame:
    """Correlations of ``prediction`` with up to all the ``labels``, one row per group.

    ``labels`` maps an output column to a label column. A label column the table
    lacks gives NULL. For labels in ``lower_is_better`` the sign is turned.
    """
    by = list(by)
    here = {out: col for out, col in labels.items() if col in rows.columns}
    wanted = list(labels)
    if not here:
        groups = rows.select(*by).distinct() if by else rows.limit(1).select()
        return groups.select(*by, *[F.lit(None).cast("double").alias(c) for c in wanted])
    unpivoted = F.explode(F.array(*[
        F.struct(F.lit(out).alias("label"), F.col(f"`{col}`").cast("double").alias("value"))
        for out, col in here.items()
    ]))
    long = rows.select(*by, prediction, unpivoted.alias("_l")).select(
        *by, prediction, F.col("_l.label").alias("_label"), F.col("_l.value").alias("_value"))
    per_label = spearman(long, prediction, "_value", [*by, "_label"], **options)
    value = {
        out: F.max(F.when(F.col("_label") == out, F.col("spearman")))
        * F.lit(-1.0 if labels[out] in lower_is_better else 1.0)
        for out in here
    }
    return per_label.groupBy(*by).agg(*[
        (value[out] if out in here else F.lit(None).cast("double")).alias(out) for out in wanted
    ])


def oriented(value: Column, lower_is_better: Column) -> Column:
    """The score with larger meaning better."""
    return F.when(lower_is_better, -value).otherwise(value)


def system_means(scores: DataFrame, keys, value: str = "value") -> DataFrame:
    """The mean score of every system."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("system_score"))


def system_counts(scores: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows per (outer, inner) system, and per outer system over all inner ones.

    ``is_total`` tells the latter from systems whose name is missing.
    """
    return (
        scores.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("_level"))
        .filter("_level < 3").select(outer, inner, "n_rows", (F.col("_level") == 1).alias("is_total"))
    )
