import collections

import corpus_pipeline
import pytest
from test_decontamination import brute_force as windows_of
from test_line_dedup import brute_force as lines_of
from test_ngram_join import brute_force as groups_of
from test_quality_rules import brute_force as counts_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of each stage, each on what the one before kept."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
    return [*out, docs]


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].filter("not round_trip or n_tokens = 0").count() == 0


def test_rules_drop_what_fails_the_base(stages):
    kept = {i for i, _ in rows(stages[1])}
    for i, t in rows(stages[0]):
        n, *_, repeated = counts_of(t)
        assert i not in kept or (n >= 50 and 2 * repeated <= n)
    assert len(kept) > 0.7 * stages[0].count()


def test_lines(stages):
    want = lines_of(rows(stages[1]))
    assert sorted(rows(stages[2])) == sorted((i, t) for (i, old), t in want.items() if t == old or t.split())
    assert stages[2].filter("n_chars != length(text)").count() == 0


def test_one_of_each_group_stays(stages):
    before = groups_of(rows(stages[2]))
    kept = collections.Counter(i for i, _ in rows(stages[3]))
    assert kept == collections.Counter(i for i, _, c in before if i == c)


def test_no_benchmark_window_is_left(spark, stages):
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    clean = [i for i, _, n, _ in windows_of(rows(stages[3]), items) if not n]
    assert sorted(clean) == sorted(i for i, _ in rows(stages[4]))
    assert sorted(clean) == sorted(r["doc_id"] for r in stages[5].collect())


def test_odd_rows_and_no_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        stage(spark, odd, SF).collect()
    assert corpus_pipeline.near_duplicates(spark, odd, SF).columns == odd.columns


def test_repeated_rows_are_one_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, base), (5, base), (7, base), (9, None), (9, None)], "doc_id long, text string")
    got = rows(corpus_pipeline.near_duplicates(spark, df, SF))
    assert sorted(got, key=str) == sorted([(5, base), (9, None), (9, None)], key=str)
