import random

import pytest
from pyspark.sql import functions as F

from metaeval.operators.splits import head_rows, slice_rows
from metaeval.sources import records as r
from metaeval.sources.scores import scan_indexed_scores, scan_scores, select_scores
from metaeval.sources.text_files import CELLS, read_tsv, scan_manifests

ODD = ["a", "", '"q"', '"line\nbreak"', '"say ""hi"""', '""', '"a\tb"', '5" x', 'x"y"', '"\n\n"', "é漢", "  sp ", '"un"x', "NA", '"""\n"""', '"\n\tfake\tcells\n"']


def odd_table(seed, n):
    rng = random.Random(seed)
    lines = ["x\ty\tz"]
    for i in range(n):
        lines.append("\t".join([str(i), rng.choice(ODD), rng.choice(ODD)]))
        lines += [""] * (rng.random() < 0.05)
    return "\n".join(lines) + "\n" * (seed % 2)


def values(df):
    return [tuple(x) for x in df.orderBy("_pos").drop("_system", "_file", "_pos").collect()]


@pytest.mark.parametrize("seed, size", [(1, 1 << 20), (1, 3000), (2, 97), (2, 7)])
def test_many_tasks_read_what_one_task_reads(spark, tmp_path, seed, size):
    (tmp_path / "m.tsv").write_text(odd_table(seed, 400))
    want = [tuple(x) for x in read_tsv(spark, str(tmp_path / "m.tsv"), True).collect()]
    index = r.temporary_index(r.listed(spark, str(tmp_path / "m.tsv")), range_bytes=size)
    rows = r.scan_records(spark, index, ["x", "y", "z"], CELLS)
    assert len(want) == 400 and values(rows) == want
    assert [x[0] for x in rows.select("_pos").orderBy("_pos").collect()] == list(range(400))


def test_a_cell_over_many_ranges(spark, tmp_path):
    long = "word\n" * 3000
    (tmp_path / "m.tsv").write_text(f'x\ty\na\t"{long}"\nb\tc\n')
    index = r.temporary_index(r.listed(spark, str(tmp_path / "m.tsv")), range_bytes=500)
    assert spark.read.parquet(index).count() > 25
    assert values(r.scan_records(spark, index, ["x", "y"], CELLS)) == [("a", long), ("b", "c")]


@pytest.mark.parametrize("content, want", [
    ("x\n", []), ("x", []), ("", []), ("x\n\n\n", []), ("x\n1", [("1",)]), ('x\n"never closed\n1\n2', [("never closed\n1\n2",)]), ("﻿x\n1\n", [("1",)])])
def test_small_files(spark, tmp_path, content, want):
    (tmp_path / "m.tsv").write_text(content)
    for size in (1, 3, 1 << 20):
        index = r.temporary_index(r.listed(spark, str(tmp_path / "m.tsv")), range_bytes=size)
        assert values(r.scan_records(spark, index, ["x"], CELLS)) == want


def test_positions_over_files_and_systems(spark, tmp_path):
    for folder, name, n in (("b", "part-2", 30), ("b", "part-10", 5), ("a", "z", 7), ("a", "empty", 0)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.tsv").write_text("score\n" + "".join(f"{folder}{name}{i}\n" for i in range(n)))
    files = r.listed(spark, str(tmp_path))
    b = [f"bpart-2{i}" for i in range(30)] + [f"bpart-10{i}" for i in range(5)]
    a = [f"az{i}" for i in range(7)]
    for per_folder, want in ((True, {"a": a, "b": b}), (None, {"": a + b}), (False, {"a/z.tsv": a, "b/part-2.tsv": b[:30], "b/part-10.tsv": b[30:]})):
        index = r.temporary_index(files, per_folder=per_folder, quoted=False, range_bytes=50)
        got = {}
        for x in r.scan_records(spark, index, ["score"], CELLS).orderBy("_pos").collect():
            got.setdefault(x["_system"].removeprefix(f"file:{tmp_path}/"), []).append((x["_pos"], x["score"]))
        assert got == {k: list(enumerate(v)) for k, v in want.items()}




def test_slices_open_only_their_ranges(spark, tmp_path):
    scores = {"a": 4000, "b": 900}
    for name, n in scores.items():
        (tmp_path / f"{name}.tsv").write_text("seg\tscore\n" + "".join(f"s\t{i / 8}\n" for i in range(n)))
    index = str(tmp_path / "index")
    r.keep_index(r.listed(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]), index, quoted=False, range_bytes=1000)
    ranges = spark.read.parquet(index).count()
    rows = scan_indexed_scores(spark, index, ["seg", "score"])
    assert rows.rdd.getNumPartitions() == ranges > 30
    system = F.col("system").endswith("a.tsv")
    some = slice_rows(rows, 1000, 1010)
    assert some.rdd.getNumPartitions() <= 4 and [x["value"] for x in some.filter(system).orderBy("pos").collect()] == [i / 8 for i in range(1000, 1010)]
    assert head_rows(rows, 5).rdd.getNumPartitions() == 2
    one = rows.filter((F.col("system") == f"file:{tmp_path}/b.tsv") & (F.col("pos") == 899))
    assert one.rdd.getNumPartitions() == 1 and one.first()["value"] == 899 / 8
    systems = {n: f"file:{tmp_path}/{n}.tsv" for n in scores}
    got = select_scores(spark, index, "b[-3:]+a[5:8]+b[:1]", ["seg", "score"], systems)
    assert got.rdd.getNumPartitions() <= 5
    assert [tuple(x) for x in got.orderBy("pos").collect()] == [
        ("b", 0, 897 / 8), ("b", 1, 898 / 8), ("b", 2, 899 / 8), ("a", 3, 5 / 8), ("a", 4, 6 / 8), ("a", 5, 7 / 8), ("b", 6, 0.0)]
    # the index gives what counting gives
    counted = scan_scores(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="unknown split: c"):
        select_scores(spark, index, "c[:1]", ["seg", "score"], systems)


def test_rows_that_leave_the_reader_are_those_asked_for(tmp_path):
    (tmp_path / "a.tsv").write_text("score\n" + "".join(f"{i}\n" for i in range(100)))
    row = {"system": "s", "path": f"file:{tmp_path}/a.tsv", "length": (tmp_path / "a.tsv").stat().st_size, "start": 0, "stop": 1 << 20, "inside": 0,
           "heads": 1, "count": 100, "first": 0, "quoted": False}
    reader = r.RecordReader({"index": "", "home": "file:/", "header": "score"})
    batches = list(reader.read(r.Range(row, 90, 93)))
    assert [x for b in batches for x in b.column("_record").to_pylist()] == [b"90", b"91", b"92"]


def test_many_ranges_share_tasks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tsv").write_text("score\n" + "".join(f'"{name}\n{i}"\n' for i in range(3000)))
    index = r.temporary_index(r.listed(spark, str(tmp_path)), per_folder=None, range_bytes=50)
    assert spark.read.parquet(index).count() > 2 * r.TASKS
    rows = r.scan_records(spark, index, ["score"], CELLS)
    assert r.TASKS // 2 < rows.rdd.getNumPartitions() <= 2 * r.TASKS
    want = [f"{name}\n{i}" for name in ("a", "b") for i in range(3000)]
    assert [(x["_pos"], x["score"]) for x in rows.orderBy("_pos").collect()] == list(enumerate(want))
    some = rows.filter("_pos >= 1500 and _pos < 4500").orderBy("_pos").collect()
    assert [x["score"] for x in some] == want[1500:4500]


def test_ranges_that_share_a_task_are_few_bytes():
    rows = [{"path": p, "start": k, "stop": min(k + 10, 995)} for p in ("b", "a") for k in range(0, 1000, 10)]
    tasks = r.shared_tasks(rows, 7, 95)
    assert [(x["path"], x["start"]) for t in tasks for x in t] == sorted((x["path"], x["start"]) for x in rows)
    assert all(sum(x["stop"] - x["start"] for x in t) <= 95 for t in tasks) and len(tasks) <= 24
    assert [len(t) for t in r.shared_tasks(rows, 200, 95)] == [1] * 200 and len(r.shared_tasks(rows, 7, 5)) == 200 and r.shared_tasks([]) == []


def test_changed_files_and_other_columns_raise(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("score\n1\n")
    (tmp_path / "b.tsv").write_text("raw\n1\n")
    index = r.temporary_index(r.listed(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]))
    with pytest.raises(Exception, match="other columns"):
        r.scan_records(spark, index, ["score"], CELLS).collect()
    index = r.temporary_index(r.listed(spark, str(tmp_path / "a.tsv")))
    (tmp_path / "a.tsv").write_text("score\n1\n2\n")
    with pytest.raises(Exception, match="has changed"):
        r.scan_records(spark, index, ["score"], CELLS).collect()


def test_manifests_with_line_breaks_in_ranges(spark, tmp_path):
    text = "path\tsentence\tlang\n" + "".join(f'p{i}\t"a ""{i}""\nb\t{i}"\tde\n' for i in range(500))
    (tmp_path / "m.tsv").write_text(text)
    (tmp_path / "n.tsv").write_text("path\tpos_note\nq\tx\n")
    rows = scan_manifests(spark, str(tmp_path), "n.tsv,m.tsv", range_bytes=300).orderBy("pos").collect()
    assert [x["pos"] for x in rows] == list(range(501)) and rows[0]["path"] == "q" and rows[0]["pos_note"] == "x"
    assert [(x["path"], x["sentence"]) for x in rows[1:]] == [(f"p{i}", f'a "{i}"\nb\t{i}') for i in range(500)]
