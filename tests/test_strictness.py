"""What must raise rather than lose rows, and what must not get lost."""

import json

import pytest
from pyspark.sql import functions as F

from metaeval.functions.text import prompt_prefix
from metaeval.operators import lookup
from metaeval.operators.correlation import system_counts
from metaeval.operators.lookup import attach
from metaeval.operators.ordering import with_positions
from metaeval.operators.tokens import build_vocabulary, encode
from metaeval.plans.cascade import Grid, run_cascade
from metaeval.sinks.audio import wav_bytes
from metaeval.sources.inventory import probe_readable
from metaeval.sources.scores import scan_scores
from metaeval.sources.text_files import malformed_cells, read_tsv, scan_manifests

MODEL = "Unbabel/XCOMET-XL"


def write_grid(folder, lengths, systems=("two b", "c%d+")):
    for st in systems:
        for side, name in (("qe", f"qe.Unbabel_XCOMET-XL.cas.A.gold.T.{st}.d.c.s"), ("metric", f"metric.Unbabel_XCOMET-XL.st.{st}.d.c.s")):
            file = folder / side / f"{name}.json"
            file.parent.mkdir(exist_ok=True)
            file.write_text(json.dumps({"system_score": 0.25, "scores": [i * 7 % 5 / 4 for i in range(lengths[side])]}))
    return [Grid("d", "c", "s", (MODEL,), (MODEL,), ("gold",), systems)]


def test_odd_system_names_stay_in_the_grid(spark, tmp_path):
    rows = run_cascade(spark, str(tmp_path), write_grid(tmp_path, {"qe": 6, "metric": 6})).collect()
    assert {(r["st"], r["n_rows"], r["qe_mean"]) for r in rows} == {("two b", 6, 0.25), ("c%d+", 6, 0.25), (None, 12, None)}


def test_unequal_lists_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="unequal"):
        run_cascade(spark, str(tmp_path), write_grid(tmp_path, {"qe": 6, "metric": 4}))


def test_an_empty_vector_raises(spark, tmp_path):
    grids = write_grid(tmp_path, {"qe": 6, "metric": 6})
    next((tmp_path / "qe").iterdir()).write_text(json.dumps({"system_score": None, "scores": []}))
    with pytest.raises(ValueError, match="no scores"):
        run_cascade(spark, str(tmp_path), grids)


def test_an_unknown_metric_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="not supported"):
        run_cascade(spark, str(tmp_path), [Grid("d", "c", "s", ("bleu",), (MODEL,), ("gold",), ("x",))])


def test_malformed_scores_raise_and_can_be_listed(spark, tmp_path):
    file = tmp_path / "s.tsv"
    file.write_text("score\n1\nNA\noops\n1.0d\n")
    with pytest.raises(Exception, match="not a number"):
        scan_scores(spark, str(file)).collect()
    bad = malformed_cells(read_tsv(spark, str(file)), "score").collect()
    assert sorted(r["score"] for r in bad) == ["1.0d", "oops"]


def test_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "aa.tsv").write_text('path\tsentence\na0\t"x\ny"\na1\tz\n')
    (tmp_path / "b.tsv").write_text("path\tsentence\nb0\tw\n")
    rows = scan_manifests(spark, str(tmp_path), "*.tsv").orderBy("pos").collect()
    assert [(r["path"], r["sentence"]) for r in rows] == [("a0", "x\ny"), ("a1", "z"), ("b0", "w")]


def test_missing_instruction_and_language(spark):
    df = spark.createDataFrame([(None, "en", "German")], "inst string, lang string, name string")
    assert df.select(prompt_prefix(F.col("inst"), F.col("name"))).first()[0].endswith("None\nGerman audio: ")
    with pytest.raises(Exception, match="no language"):
        df.select(prompt_prefix(F.col("inst"), F.lit(None).cast("string"))).collect()


def test_rows_that_share_a_key_raise(spark):
    rows = spark.createDataFrame([("a", 0, "x y"), ("b", 0, "z")], "split string, pos long, text string")
    vocabulary = build_vocabulary(rows)
    with pytest.raises(Exception, match="share the key"):
        encode(rows, "pos", {"ids": F.col("text")}, vocabulary).collect()
    assert encode(rows, ["split", "pos"], {"ids": F.col("text")}, vocabulary).count() == 2


def test_counts_of_systems_without_a_name(spark):
    df = spark.createDataFrame([(None, "s"), (None, None), ("a", None)], "asr string, st string")
    got = {tuple(r) for r in system_counts(df, "asr", "st").collect()}
    assert got == {(None, "s", 1, False), (None, None, 1, False), ("a", None, 1, False), (None, None, 2, True), ("a", None, 1, True)}


def test_one_key_with_most_rows_without_a_broadcast(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = attach(rows, small, ["k"], ["id"], max_rows=0)
    assert joined.filter("v = 2 * k").count() == 5000
    # the rows of the heavy key are not shuffled
    sizes = [len(p) for p in joined.select("k").rdd.glom().collect()]
    assert max(sizes) < 3000
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    assert attach(rows, small, ["k"], ["id"]).filter("v = 2 * k").count() == 5000


def test_positions_do_not_write_other_columns(spark):
    df = spark.createDataFrame([(None, 2, "c"), (None, 1, "b"), ("g", 5, "a")], "g string, o int, text string")
    got = with_positions(df, ["g"], ["o"]).collect()
    assert {(r["text"], r["pos"]) for r in got} == {("a", 0), ("b", 0), ("c", 1)}
    assert list(got[0].asDict()) == ["g", "o", "text", "pos"]


def test_odd_names_and_relative_paths_can_be_probed(spark, tmp_path):
    names = ["w w.wav", "w%20x.wav", "w#1.wav", "w+.wav"]
    for n in names:
        (tmp_path / n).write_bytes(wav_bytes(b"\0" * 20, 8000))
    (tmp_path / "d.wav").mkdir()
    paths = [str(tmp_path / n) for n in [*names, "none.wav", "d.wav"]] + [f"file://{tmp_path}/{names[0]}", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = [r["is_readable"] for r in probe_readable(df).orderBy("i").collect()]
    assert got == [True] * 4 + [False, False, True, False]
