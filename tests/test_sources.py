import json
import random
import wave

import golden
import pytest
from pyspark.sql import functions as F

from metaeval.operators import lookup
from metaeval.plans.cascade import Grid, grid_table, metric_path, qe_path, run_cascade
from metaeval.plans.evaluate import read_predictions
from metaeval.sinks.audio import flac_bytes
from metaeval.sinks.writers import (
    cached_table, prediction_name, record_name, write_predictions, write_record,
)
from metaeval.sources.inventory import (
    flag_readable, list_files, probe_readable, readable_contents, relative_to,
)
from metaeval.sources.scores import scan_score_arrays, scan_scores
from metaeval.sources.text_files import scan_manifests
from test_correlation import brute_force


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("max_rows", [None, 0])
def test_scores_keep_their_line_numbers(spark, tmp_path, small_blocks, max_rows, monkeypatch):
    if max_rows is not None:
        monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", max_rows)
    want = {}
    for name, n in (("b", 3000), ("a", 1), ("c", 700), ("empty", 0)):
        values = [(7 * i + len(name)) % 1001 / 8 for i in range(n)]
        (tmp_path / f"{name}.tsv").write_text(
            "seg\tscore\n" + "".join(f"s{i}\t{x}\n" for i, x in enumerate(values)))
        want[name] = values
    table = scan_scores(spark, [str(tmp_path / f"{n}.tsv") for n in want])
    got = {}
    for r in table.collect():
        got.setdefault(r["system"].rsplit("/", 1)[-1][:-4], []).append((r["pos"], r["value"]))
    for name, values in want.items():
        assert sorted(got.get(name, [])) == list(enumerate(values))


def test_other_columns_in_one_scan_raise(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("score\n1\n")
    (tmp_path / "b.tsv").write_text("raw\n1\n")
    with pytest.raises(Exception):
        scan_scores(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]).collect()


def test_manifests_in_written_order(spark, tmp_path, small_blocks):
    tsv = "path\tsentence\tlang\thumanda\tnote\n" + "".join(
        f"c{i}.wav\t\"say \"\"{i}\"\"\"\tde\t{'NA' if i == 3 else i / 2}\tx{i}\n"
        for i in range(300))
    (tmp_path / "m.tsv").write_text(tsv)
    (tmp_path / "j.json").write_text("".join(
        json.dumps({"path": f"j{i}.wav", "sentence": None if i == 1 else f"a\nb\t{i}"}) + "\n"
        for i in range(40)))
    rows = scan_manifests(spark, str(tmp_path), "j.json,m.tsv").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(340))
    assert [r["path"] for r in rows] == [f"j{i}.wav" for i in range(40)] + [
        f"c{i}.wav" for i in range(300)]
    assert rows[0]["sentence"] == "a\nb\t0" and rows[1]["sentence"] is None
    assert rows[42]["sentence"] == 'say "2"' and rows[42]["humanda"] == 1.0
    assert rows[43]["humanda"] is None and rows[42]["note"] == "x2"
    assert rows[0]["note"] is None and rows[42]["suffix"] is None


def test_glob_of_manifests(spark, tmp_path):
    for name in "cab":
        (tmp_path / f"t_{name}.tsv").write_text(f"path\tsentence\n{name}0\tx\n{name}1\ty\n")
    rows = scan_manifests(spark, str(tmp_path), "t_*.tsv").orderBy("pos").collect()
    assert [r["path"] for r in rows] == ["a0", "a1", "b0", "b1", "c0", "c1"]


def test_score_arrays(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"system_score": 0.5, "scores": [0.1, None, 0.9]}))
    got = scan_score_arrays(spark, str(tmp_path / "s.json")).orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in got] == [(0, 0.1), (1, None), (2, 0.9)]


def test_written_predictions(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(golden.PREDICTIONS)), "pos bigint, pred_strings string")
    path = str(tmp_path / prediction_name("qe", split="test[0:10]", config="en2de").replace(
        "[", "_").replace("]", "_"))
    write_predictions(df.repartition(3), path)
    parts = sorted((tmp_path / path).glob("part-*"))
    bodies = [p.read_text().split("\n", 1) for p in parts]
    assert {b[0] for b in bodies} == {"pred_strings"}
    assert "".join(b[1] for b in bodies) == "".join(p + "\n" for p in golden.PREDICTIONS)
    back = read_predictions(spark, path).orderBy("pos").collect()
    assert [(r["pos"], r["pred_strings"]) for r in back] == list(enumerate(golden.PREDICTIONS))


def test_odd_predictions_come_back(spark, tmp_path, small_blocks):
    texts = ["a ", "  ", "", 'say "hi"', "tab\there", '"', '""', "pred_strings", " x", "\\", "0.2\nbecause", "\r", "a\r\n", "\\n", "\\\n\\\\n\\"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, pred_strings string")
    write_predictions(df, str(tmp_path / "p"))
    back = read_predictions(spark, str(tmp_path / "p")).orderBy("pos").collect()
    assert [r["pred_strings"] for r in back] == texts
    assert [r["pos"] for r in back] == list(range(len(texts)))


def test_names():
    assert prediction_name("qe", "m.tsv") == "qe.m.tsv"
    assert prediction_name("qe", split="a+b", config="en2de") == "qe.a+b-en2de.tsv"
    assert record_name("qe.m.tsv") == "qe.m.json"
    assert record_name("qe.m.tsv", "mine") == "mine.json"


def test_record_holds_nulls_and_arguments(spark, tmp_path):
    summary = spark.createDataFrame([(0.5, None)], "corr_xcomet double, corr_humanda double")
    write_record(summary, summary, str(tmp_path / "r"), {"gen_args": {"batch_size": 1, "task": None},
                                                        "data_args": {}})
    text = "".join(p.read_text() for p in (tmp_path / "r" / "summary").glob("part-*"))
    assert json.loads(text) == {"corr_xcomet": 0.5, "corr_humanda": None,
                                "gen_args": {"batch_size": 1, "task": None}}


def test_cache_is_reused_only_when_asked(spark, tmp_path):
    built = []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)
        return run

    root = str(tmp_path)
    assert cached_table(spark, root, "k", build(3)).count() == 3
    assert cached_table(spark, root, "k", build(5)).count() == 3
    assert cached_table(spark, root, "k", build(7), reuse=False).count() == 7
    assert built == [3, 7]


def test_changed_inputs_lead_to_a_new_build(spark, tmp_path):
    built, root = [], str(tmp_path / "kept")

    def files():
        return list_inputs(spark, str(tmp_path / "in"))

    def build():
        built.append(1)
        return spark.range(len(built))

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("x\n1\n")
    first = cached_table(spark, root, "k", build, inputs=files())
    assert first.count() == 1 and cached_table(spark, root, "k", build, inputs=files()).count() == 1
    (tmp_path / "in" / "a.tsv").write_text("x\n1\n2\n")
    assert cached_table(spark, root, "k", build, inputs=files()).count() == 2
    (tmp_path / "in" / "b.tsv").write_text("x\n")
    assert cached_table(spark, root, "k", build, inputs=files()).count() == 3 and len(built) == 3
    # whoever read the first table goes on reading it
    assert first.count() == 1


def list_inputs(spark, path):
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def test_a_build_that_fails_leaves_the_kept_table(spark, tmp_path):
    root = str(tmp_path)
    assert cached_table(spark, root, "k", lambda: spark.range(3)).count() == 3
    with pytest.raises(Exception, match="broken"):
        cached_table(spark, root, "k", lambda: spark.range(9).select(F.raise_error(F.lit("broken")).alias("x")), reuse=False)
    assert cached_table(spark, root, "k", lambda: spark.range(5)).count() == 3

    # two writers at once: either of them is kept as a whole
    def slow():
        cached_table(spark, root, "k", lambda: spark.range(7), reuse=False)
        return spark.range(11)

    assert cached_table(spark, root, "k", slow, reuse=False).count() == 11
    assert cached_table(spark, root, "k", lambda: spark.range(5)).count() == 11
    assert [p.name for p in (tmp_path / "k").glob("kept.json*")] == ["kept.json"]


def test_readable_audio(spark, tmp_path):
    good = tmp_path / "good.wav"
    with wave.open(str(good), "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(16000)
        out.writeframes(b"\0\0" * 2000)
    (tmp_path / "bad.wav").write_bytes(b"nothing here")
    (tmp_path / "short.flac").write_bytes(b"fLaC")
    (tmp_path / "whole.flac").write_bytes(flac_bytes(b"\0\1" * 5000, 16000))
    names = ["good.wav", "bad.wav", "short.flac", "absent.wav", "good.wav", "whole.flac"]
    manifest = spark.createDataFrame([(i, str(tmp_path / n)) for i, n in enumerate(names)],
                                     "pos int, path string")
    want = [True, False, False, False, True, True]
    probed = probe_readable(manifest).orderBy("pos").collect()
    assert [r["is_readable"] for r in probed] == want
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn(
        "path", F.concat(F.lit(f"{tmp_path}/"), relative_to(F.col("path"), str(tmp_path))))
    flagged = flag_readable(manifest, readable_contents(files)).orderBy("pos").collect()
    assert [r["is_readable"] for r in flagged] == want


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.tsv").write_text("score\n1\n")
    listed = list_files(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split(
        "ReadSchema")[-1]
    assert [r[0] for r in listed.select(relative_to(F.col("path"), str(tmp_path))).collect()] == [
        "d/x.tsv"]


GRIDS = (
    Grid("covost2", "es_en", "t", ("Unbabel/XCOMET-XL", "google/metricx-23-xl-v2p0"),
         ("Unbabel/XCOMET-XL", "google/metricx-23-xl-v2p0", "blaser_2_0_qe"), ("gold", "w"),
         ("s1", "s2")),
    Grid("ACL", "en-de", "test", ("iwslt",), ("Unbabel/wmt22-cometkiwi-da",), ("gold",), ("s1",)),
)


def test_file_names(spark):
    folders = {"qe": "Q", "metric": "M", "human": "H"}
    rows = grid_table(spark, GRIDS).select(qe_path(folders).alias("q"),
                                           metric_path(folders).alias("m")).collect()
    assert {r["q"] for r in rows} >= {
        "Q/qe.Unbabel_XCOMET-XL.cas.A.gold.T.s1.covost2.es_en.t.json",
        "Q/qe.google_metricx-23-xl-v2p0.cas.A.w.T.s2.covost2.es_en.t.tsv",
        "Q/qe-t2t.blaser_2_0_qe.cas.A.w.T.s2.covost2.es_en.t.tsv",
        "H/qe.Unbabel_wmt22-cometkiwi-da.cas.A.gold.T.s1.ACL.en-de.test.json"}
    assert {r["m"] for r in rows} == {
        "M/metric.Unbabel_XCOMET-XL.st.s1.covost2.es_en.t.json",
        "M/metric.Unbabel_XCOMET-XL.st.s2.covost2.es_en.t.json",
        "M/metric.google_metricx-23-xl-v2p0.st.s1.covost2.es_en.t.tsv",
        "M/metric.google_metricx-23-xl-v2p0.st.s2.covost2.es_en.t.tsv",
        "H/st.s1.ACL.en-de.test.tsv"}


def test_grid_of_score_files(spark, tmp_path):
    rng = random.Random(1)
    folders = {"qe": "qe", "metric": "metric", "human": "human"}
    grid = grid_table(spark, GRIDS).withColumns(
        {"q": qe_path(folders), "m": metric_path(folders)}).collect()
    vectors = {}
    for path in sorted({r["q"] for r in grid} | {r["m"] for r in grid}):
        values = [rng.randrange(30) / 8 for _ in range(50)]
        vectors[path] = values
        file = tmp_path / path
        file.parent.mkdir(exist_ok=True)
        if path.endswith(".json"):
            file.write_text(json.dumps({"system_score": 0.0, "scores": values}))
        else:
            column = "raw" if file.name.startswith("st.") else "score"
            file.write_text(f"{column}\n" + "".join(f"{x}\n" for x in values))
    result = run_cascade(spark, str(tmp_path), GRIDS, folders)
    # the files were parsed once, and nothing reads them any more
    (tmp_path / "qe").rename(tmp_path / "read")
    found = result.collect()
    (tmp_path / "read").rename(tmp_path / "qe")
    assert len(found) == len(grid) + 13

    def turned(row):
        a = -1 if "google" in row["qe_model"] else 1
        b = -1 if row["metric_model"].startswith("google/metricx") else 1
        return [(a * x, b * y) for x, y in zip(vectors[row["q"]], vectors[row["m"]])]

    keys = ("dataset", "metric_model", "qe_model", "asr")
    for r in found:
        members = [g for g in grid if all(g[k] == r[k] for k in keys)
                   and r["st"] in (None, g["st"])]
        want = brute_force([p for g in members for p in turned(g)])
        assert (r["level"] == "pooled") == (r["st"] is None)
        assert r["n_rows"] == 50 * len(members)
        assert r["spearman"] == pytest.approx(want, abs=1e-12)
    (tmp_path / grid[0]["q"]).rename(tmp_path / "aside")
    with pytest.raises(FileNotFoundError):
        run_cascade(spark, str(tmp_path), GRIDS, folders)
