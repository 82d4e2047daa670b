import pandas as pd
import pytest
from pyspark.sql import functions as F

from metaeval.functions.arrays import (
    attention_from_padding, encoder_length, full_scale, mono, pad, padding_mask, peak_normalized,
    speech_length, subsampled_length, truncate,
)
from metaeval.operators import lookup
from metaeval.operators.batches import BATCH, encoded_fillers, pad_batches, with_batches
from metaeval.operators.scoring import batches_of, score
from metaeval.operators.tokens import BOS_ID, EOS_ID, UNK_ID, assemble, build_vocabulary, encode


def vocabulary(spark, texts):
    return build_vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_ids_follow_count_then_token(spark):
    got = vocabulary(spark, ["b a b", " c\ta\n", "é b", "", None]).orderBy("id").collect()
    assert [(r["token"], r["n"], r["id"]) for r in got] == [
        ("b", 3, 4), ("a", 2, 5), ("c", 1, 6), ("é", 1, 7)]


@pytest.mark.parametrize("max_rows", [None, 0])
def test_encoding(spark, max_rows, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY_SHARE", 4)
    known = vocabulary(spark, ["the the the cat sat"])  # the 4, cat 5, sat 6
    rows = spark.createDataFrame(
        [(1, "the cat ", "the the"), (2, "", None), (3, " dog\nsat the", "x"), (4, "the", "the")],
        "pos bigint, a string, b string")
    got = {r["pos"]: (r["x"], r["y"]) for r in encode(
        rows, "pos", {"x": F.col("a"), "y": F.col("b")}, known, max_rows=max_rows).collect()}
    assert got == {
        1: ([BOS_ID, 4, 5], [4, 4]), 2: ([BOS_ID], []),
        3: ([BOS_ID, UNK_ID, 6, 4], [UNK_ID]), 4: ([BOS_ID, 4], [4])}


def test_assembled_sequences(spark):
    known = vocabulary(spark, ["###[Assistant]: a b"])  # by token: ###[Assistant]: 4, a 5, b 6
    rows = spark.createDataFrame([(1, [1, 5], [6], [5, 5])],
                                 "pos bigint, p array<int>, s array<int>, r array<int>")
    train = assemble(rows, known, "p", "s", "r").first()
    assert train["input_ids"] == [1, 5] and train["labels"] == [-100, -100]
    assert train["suffix_input_ids"] == [6, 4, 5, 5, EOS_ID]
    assert train["suffix_labels"] == [-100, -100, 5, 5, EOS_ID]
    assert train["suffix_attention_mask"] == [1] * 5
    test = assemble(rows, known, "p", "s", None, label_all=True).first()
    assert test["suffix_input_ids"] == [6, 4] == test["suffix_labels"]
    assert test["labels"] == [1, 5]


def test_padding_to_the_batch_and_back(spark):
    rows = spark.createDataFrame([(i, list(range(i % 5)), i % 5) for i in range(23)],
                                 "pos bigint, v array<int>, n int")
    padded = pad_batches(with_batches(rows, 4), {"v": -7})
    for r in padded.withColumn("back", truncate(F.col("v"), F.col("n"))).collect():
        longest = max(i % 5 for i in range(r[BATCH] * 4, min(r[BATCH] * 4 + 4, 23)))
        assert len(r["v"]) == longest and r["back"] == list(range(r["pos"] % 5))
        assert set(r["v"][r["n"]:]) <= {-7}


def test_fillers():
    assert encoded_fillers(9) == {
        "input_ids": 9, "attention_mask": 0, "labels": -100, "suffix_input_ids": 9,
        "suffix_attention_mask": 0, "suffix_labels": -100}


def test_lengths_and_masks(spark):
    df = spark.createDataFrame([(3000, 2, 4), (1, 0, 0), (0, 4, 4)], "n int, l int, m int")
    got = df.select(
        encoder_length(F.col("n")), speech_length(F.col("n")), subsampled_length(F.col("n"), 1),
        padding_mask(F.col("l"), F.col("m")),
        attention_from_padding(padding_mask(F.col("l"), F.col("m")))).collect()
    assert tuple(got[0])[:3] == (1500, 188, 1500)
    assert got[0][3] == [False, False, True, True] and got[0][4] == [True, True, False, False]
    assert got[1][3] == [] and got[2][3] == [False] * 4


def test_waveforms(spark):
    df = spark.createDataFrame([([[0.5, -1.0], [0.25, 0.0]],), ([[0.0, 0.0]],)],
                               "c array<array<float>>")
    wave = mono(F.col("c"))
    got = df.select(wave, full_scale(wave), peak_normalized(wave)).collect()
    assert tuple(got[0]) == ([0.375, -0.5], [12288.0, -16384.0], [0.75, -1.0])
    assert got[1][2] == [0.0, 0.0]


def test_pad_expression(spark):
    df = spark.createDataFrame([([1], 3), ([1, 2, 3], 2)], "v array<int>, m int")
    assert [r[0] for r in df.select(pad(F.col("v"), F.col("m"), 0)).collect()] == [
        [1, 0, 0], [1, 2, 3]]


def frames(sizes, start=0):
    for size in sizes:
        yield pd.DataFrame({"i": range(start, start + size)})
        start += size


@pytest.mark.parametrize("sizes", [[], [0], [1], [5, 0, 5], [7, 1, 1, 9], [64]])
@pytest.mark.parametrize("batch", [1, 3, 8])
def test_batches_are_full_and_in_order(sizes, batch):
    got = [list(b["i"]) for b in batches_of(frames(sizes), batch)]
    assert sum(got, []) == list(range(sum(sizes)))
    assert all(len(b) == batch for b in got[:-1])


def test_a_new_batch_id_ends_a_batch():
    ids = [0, 0, 0, 1, 1, 2, 2, 2, 3]
    chunks = [pd.DataFrame({"i": range(a, b), BATCH: ids[a:b]}) for a, b in ((0, 2), (2, 4), (4, 9))]
    got = [list(b["i"]) for b in batches_of(iter(chunks), 3)]
    assert got == [[0, 1, 2], [3, 4], [5, 6, 7], [8]]


def test_scorer_gets_batches_and_loses_no_row(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(100)], "pos bigint, speech array<float>")

    def load():
        return lambda batch: [f"0.{int(v[0]):02d} of {len(batch)} " for v in batch["speech"]]

    got = score(rows.coalesce(1), load, 8, drop=["speech"])
    assert got.columns == ["pos", "pred_strings"]
    for r in got.collect():
        assert r["pred_strings"] == f"0.{r['pos']:02d} of {8 if r['pos'] < 96 else 4} "


def test_a_scorer_must_answer_every_row(spark):
    with pytest.raises(Exception, match="one prediction per row"):
        score(spark.range(3).coalesce(1), lambda: lambda batch: ["x"], 8).collect()
