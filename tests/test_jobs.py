import golden
import pytest
from pyspark.sql import functions as F

from metaeval.operators.alignment import align, align_strict
from metaeval.operators.splits import (
    head_rows, parse_split, readable_account, require_rows, row_count_checked, select_split, stack,
)
from metaeval.plans.evaluate import evaluate, report
from metaeval.plans.prepare import PrepareOptions, load_manifests, load_split, preprocess
from metaeval.sinks.audio import wav_bytes
from metaeval.streaming.prepare import prepare_stream


def golden_rows(spark):
    return spark.createDataFrame(
        [("test" if i < 8 else "rest", i % 8, f"c{i}.wav", f"Text {i}.", "Rate", None, "en", x, m)
         for i, (x, m) in enumerate(zip(golden.XCOMET, golden.METRICX))],
        "split string, pos bigint, path string, sentence string, inst string, suffix string, "
        "lang string, `metric_score_xcomet-xl` double, `metric_score_metricx-23-xl` double")


def test_scoring_a_split_gives_the_published_result(spark, tmp_path):
    options = PrepareOptions(from_file=False)
    answers = list(golden.PREDICTIONS)

    def load_golden():
        return lambda batch: [answers[p] for p in batch["pos"]]

    rows = load_split(golden_rows(spark), "test+rest", "/audio", options=options)
    assert {r["path"] for r in rows.collect()} == {f"/audio/c{i}.wav" for i in range(10)}
    summary = evaluate(rows, load_golden, str(tmp_path), batch_size=4, split="test",
                       config="en2de", arguments={"data_args": {"split": "test"}})
    row = summary.first()
    assert row["corr_xcomet"] == pytest.approx(golden.CORR_XCOMET, abs=1e-9)
    assert row["corr_metricx"] == pytest.approx(golden.CORR_METRICX, abs=1e-9)
    assert row["corr_humanda"] is None
    kept = spark.read.json(str(tmp_path / "qe.test-en2de.json" / "summary")).first()
    assert kept["corr_xcomet"] == row["corr_xcomet"] and kept["data_args"]["split"] == "test"
    parsed = spark.read.parquet(str(tmp_path / "qe.test-en2de.json" / "rows"))
    assert {r["pos"]: r["pred_strings_float"] for r in parsed.collect()} == {
        i: float(p) for i, p in enumerate(golden.PREDICTIONS)}


def test_manifests_are_prepared_once(spark, tmp_path):
    audio = tmp_path / "a.wav"
    audio.write_bytes(wav_bytes(b"\0" * 20, 8000))
    (tmp_path / "m.tsv").write_text(
        "path\tsentence\tinst\tlang\n" + f"{audio}\tOne two\tRate\tde\n" + "absent.wav\tX\tRate\tde\n")
    first = load_manifests(spark, str(tmp_path), "m.tsv")
    assert [r["target_text"] for r in first.collect()] == ["one two "]
    audio.rename(tmp_path / "gone")
    again = load_manifests(spark, str(tmp_path), "m.tsv")
    assert again.count() == 1 and again.first()["prompt_prefix"] == "<|im_start|>user\nRate\nGerman: "
    with pytest.raises(ValueError):
        load_manifests(spark, str(tmp_path), "m.tsv", reuse=False)
    with pytest.raises(ValueError):
        load_manifests(spark, str(tmp_path), "m.tsv", PrepareOptions(lower=False))


def test_training_rows_carry_the_response(spark):
    rows = golden_rows(spark).filter("split = 'test'")
    options = PrepareOptions(from_file=False, training=True)
    got = preprocess(rows, options=options).orderBy("pos").first()
    assert got["suffix_labels"][:2] == [-100, -100] and got["suffix_labels"][-1] == 2
    assert len(got["suffix_input_ids"]) == len(got["suffix_labels"]) == 5
    with pytest.raises(ValueError):
        preprocess(rows.drop("lang"), options=options)


def test_split_expressions(spark):
    assert parse_split("a+b[2:5]+c[-3:]") == [("a", None, None), ("b", 2, 5), ("c", -3, None)]
    df = spark.createDataFrame([(s, i) for s in "abc" for i in range(4)], "split string, pos bigint")
    def at(expression):
        got = select_split(df, expression).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(len(got)))
        return [r["split"] for r in got]
    assert at("c+a") == list("ccccaaaa")
    assert at("a[1:3]+b+a") == list("aa") + list("bbbb") + list("aaaa")
    assert at("a[-1:]+b[:2]+c[3:99]") == list("abbc")
    with pytest.raises(Exception, match="unknown split: missing"):
        at("a[-1:]+b[:2]+missing+c[3:99]")
    assert at("a[3:1]") == []


def test_heads_and_counts(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert head_rows(df, 3).count() == 3 and head_rows(df, -1).count() == 10
    flags = df.withColumn("is_readable", F.col("pos") > 3)
    assert tuple(readable_account(flags).first()) == (10, 6, 4)
    assert row_count_checked(df).first()[0] == 10
    with pytest.raises(Exception, match="nothing"):
        row_count_checked(df.limit(0), "nothing").collect()
    with pytest.raises(ValueError):
        require_rows(df.limit(0))
    assert stack(None, df, df.withColumn("x", F.lit(1))).count() == 20


def test_alignment_by_position(spark):
    qe = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0)], "st string, pos int, qe double")
    metric = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 6.0), ("s", 3, 6.0)],
                                   "st string, pos int, metric double")
    got = align(qe, metric, ["st"]).orderBy("pos").collect()
    assert [(r["qe"], r["metric"]) for r in got] == [(1.0, None), (2.0, 5.0)]
    with pytest.raises(ValueError):
        align_strict(qe, metric, ["st"])
    assert align_strict(qe, metric.filter("pos < 3"), ["st"]).count() == 2


def test_a_report_repairs_each_run_alone(spark):
    rows = spark.createDataFrame(
        [("a", i, p, float(i)) for i, p in enumerate(["0.1 ", "0.2 ", "-3"])] +
        [("b", i, p, float(i)) for i, p in enumerate(["50%", "60", "0.7 "])],
        "run string, pos int, pred string, humanda double")
    parsed, summary = report(rows, "pred", ["run"])
    values = {(r["run"], r["pos"]): r["pred_strings_float"] for r in parsed.collect()}
    assert values["a", 2] == -3.0 and values["b", 1] == 0.6
    got = {r["run"]: r["corr_humanda"] for r in summary.collect()}
    assert got["a"] == pytest.approx(-0.5) and got["b"] == pytest.approx(1.0)


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = golden_rows(spark)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = prepare_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")),
                            "/audio")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = prepare_stream(rows, "/audio").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 10
