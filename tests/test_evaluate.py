import collections

import pytest
from pyspark.sql import functions as F

from metaeval.operators.batches import with_batches
from metaeval.operators.ordering import with_positions
from metaeval.operators.scoring import score_resumable, with_units
from metaeval.plans.evaluate import evaluate, read_predictions


def encoded(df):
    ids = F.sequence(F.lit(1), (F.col("pos") % 5 + 1).cast("int"))
    return df.select("*", F.lit(None).cast("double").alias("humanda"), *[ids.alias(f"{s}{c}") for s in ("", "suffix_") for c in ("input_ids", "attention_mask", "labels")])


def two_splits(spark):
    return spark.createDataFrame([(s, i, f"{s}{i}") for s in "ab" for i in range(3)], "split string, pos bigint, name string")


def test_splits_with_positions_of_their_own(spark, tmp_path):
    seen = collections.Counter()
    evaluate(encoded(two_splits(spark)), lambda: lambda batch: [f"0.{n[1]}{len(batch)} " for n in batch["name"]], str(tmp_path), batch_size=4, split="x")
    rows = spark.read.parquet(str(tmp_path / "qe.x-.json" / "rows")).collect()
    seen.update(r["name"] for r in rows)
    assert seen == collections.Counter({f"{s}{i}": 1 for s in "ab" for i in range(3)})
    back = [r["pred_strings"] for r in read_predictions(spark, str(tmp_path / "qe.x-.tsv")).orderBy("pos").collect()]
    assert back == ["0.04 ", "0.14 ", "0.24 ", "0.04 ", "0.12 ", "0.22 "]


def test_ties_raise(spark, tmp_path):
    twice = two_splits(spark).unionByName(two_splits(spark).limit(1))
    with pytest.raises(Exception, match="rows share a place"):
        evaluate(encoded(twice), lambda: lambda batch: ["0.1 "] * len(batch), str(tmp_path))
    with pytest.raises(Exception, match="rows share a place"):
        with_positions(two_splits(spark), (), ["pos"], "_dense").collect()
    assert with_positions(two_splits(spark), ["split"], ["pos"], "n").filter("n = pos").count() == 6


def noting(log, dies_at=None):
    """A scorer that notes the first row of every batch, and may die before one."""
    def load():
        def run(batch):
            first = int(batch["pos"].iloc[0])
            if dies_at is not None and first >= dies_at:
                raise RuntimeError("out of memory")
            with open(log, "a") as out:
                out.write(f"{first}\n")
            return [f"0.{p:03d} " for p in batch["pos"]]
        return run
    return load


@pytest.fixture
def one_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_second_start_scores_only_the_rest(spark, tmp_path, one_task):
    log, rows = tmp_path / "log", encoded(spark.range(100).withColumnRenamed("id", "pos"))
    options = {"batch_size": 4, "split": "x", "unit_rows": 8}
    with pytest.raises(Exception, match="out of memory"):
        evaluate(rows, noting(log, 48), str(tmp_path / "out"), **options)
    first = log.read_text().split()
    assert sorted(map(int, first)) == list(range(0, 48, 4))
    evaluate(rows, noting(log), str(tmp_path / "out"), **options)
    # over both runs the scorer saw every batch once
    assert sorted(map(int, log.read_text().split())) == list(range(0, 100, 4))
    got = spark.read.parquet(str(tmp_path / "out" / "qe.x-.json" / "rows")).orderBy("pos").collect()
    assert [r["pred_strings"] for r in got] == [f"0.{p:03d} " for p in range(100)]

    def refuse():
        raise AssertionError("nothing is left to be scored")

    evaluate(rows, refuse, str(tmp_path / "out"), **options)
    # other rows are scored anew, where they are other
    changed = rows.withColumn("humanda", F.when(F.col("pos") == 50, 1.0))
    evaluate(changed, noting(log), str(tmp_path / "out"), **options)
    assert sorted(map(int, log.read_text().split()))[:30].count(48) == 2 and len(log.read_text().split()) == 25 + 2


def test_half_a_unit_is_never_taken(spark, tmp_path, one_task):
    log = tmp_path / "log"
    rows = with_units(with_batches(spark.range(16).withColumnRenamed("id", "pos"), 4), 2)
    with pytest.raises(Exception, match="out of memory"):
        score_resumable(rows, noting(log, 12), str(tmp_path / "u"), ["pos"], 4).collect()
    assert len(list((tmp_path / "u").iterdir())) == 1
    got = score_resumable(rows, noting(log), str(tmp_path / "u"), ["pos"], 4).orderBy("pos").collect()
    assert [r["pred_strings"] for r in got] == [f"0.{p:03d} " for p in range(16)]
    assert sorted(map(int, log.read_text().split())) == [0, 4, 8, 8, 12]


def test_wrong_number_of_predictions_raises(spark, tmp_path):
    rows = with_units(with_batches(spark.range(5).withColumnRenamed("id", "pos"), 4), 1)
    with pytest.raises(Exception, match="one prediction per row"):
        score_resumable(rows, lambda: lambda batch: ["0.1"], str(tmp_path / "u"), ["pos"], 4).collect()
    assert score_resumable(rows.limit(0), lambda: None, str(tmp_path / "v"), ["pos"], 4).collect() == []
