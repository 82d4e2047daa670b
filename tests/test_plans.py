"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from metaeval.operators.batches import pad_batches, with_batches
from metaeval.operators.splits import select_split, slice_rows
from metaeval.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_everything_or_runs_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert unwanted not in text
    assert ("MapInPandas" in text) == (name == "batch_score_stub")


def test_position_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("pos"), F.lit("a").alias("split"),
                            F.lit("x").alias("sentence")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    sliced = plan(slice_rows(table, 3, 9).select("pos"))
    assert "GreaterThanOrEqual(pos,3), LessThan(pos,9)" in sliced
    assert "ReadSchema: struct<pos:bigint>" in sliced
    assert "In(split" in plan(select_split(table, "a+b")) or "EqualTo(split" in plan(
        select_split(table, "a+b"))


def test_a_union_of_splits_sorts_no_rows(spark):
    table = spark.range(10).select(F.col("id").alias("pos"), F.lit("a").alias("split"))
    text = plan(select_split(table, "a+a"))
    assert "rangepartitioning" not in text and "SortMergeJoin" not in text


def test_padding_shuffles_once(spark):
    rows = spark.range(100).select(F.col("id").alias("pos"), F.array("id").alias("v"),
                                   F.array("id").alias("w"))
    text = plan(pad_batches(with_batches(rows, 8), {"v": 0, "w": 1}))
    assert text.count("Exchange hashpartitioning") == 1
