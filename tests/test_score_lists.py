import json
import random

import pytest

from metaeval.sources.records import listed
from metaeval.sources.score_lists import explode_lists
from metaeval.sources.scores import scan_score_arrays


def write_lists(folder):
    rng, want = random.Random(1), {}
    for n in (0, 1, 2, 500):
        values = [rng.choice([None, 0.5, -1e-9, 123456.789, 1]) for _ in range(n)]
        for style, text in (("a", json.dumps({"system_score": 0.25, "scores": values})), ("b", json.dumps({"scores": values, "system_score": 0.75}, indent=3 if n == 500 else None)),
                            ("c", json.dumps({"name": "x", "scores": values}, separators=(",", ":")))):
            (folder / f"{style}{n}.json").write_text(text)
            want[f"{style}{n}"] = [(i, None if x is None else float(x), {"a": 0.25, "b": 0.75, "c": None}[style]) for i, x in enumerate(values)]
    return {k: v for k, v in want.items() if v}


def found(rows):
    got = {}
    for r in rows.collect():
        got.setdefault(r["system"].rsplit("/", 1)[1][:-5], []).append((r["pos"], r["value"], r["system_score"]))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()}


@pytest.mark.parametrize("size", [1 << 20, 300, 37, 5, 1])
def test_ranges_of_lists(spark, tmp_path, size):
    want = write_lists(tmp_path)
    assert found(explode_lists(listed(spark, str(tmp_path)), size)) == want


def test_large_lists_beside_small_ones(spark, tmp_path):
    want = write_lists(tmp_path)
    path = f"{tmp_path}/*.json"
    few = {k: v for k, v in want.items() if not k.endswith("500")}
    assert found(scan_score_arrays(spark, f"{tmp_path}/?[012].json")) == few
    rows = scan_score_arrays(spark, path, 1000, 400)
    assert found(rows) == want
    assert rows.filter("system like '%a500%'").rdd.getNumPartitions() > 1


def test_special_numbers_and_damage(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"scores": [NaN, -Infinity, 1e3, null]}')
    got = found(explode_lists(listed(spark, str(tmp_path)), 9))["n"]
    assert str(got[0][1]) == "nan" and got[1][1] == float("-inf") and got[2][1] == 1000.0 and got[3][1] is None
    for text, why in (('{"scores": [1, 2', "no end"), ('{"other": [1]}', "no list of scores"), ('{"scores": [1, x]}', "Expecting value")):
        (tmp_path / "n.json").write_text(text)
        with pytest.raises(Exception, match=why):
            explode_lists(listed(spark, str(tmp_path)), 6).collect()


def test_objects_that_share_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"st": 7, "scores": [1, null], "system_score": 0.5}\n{"scores": [3], "st": -8}\n{"st": 9, "scores": []}\n{"scores": [4]}\n')
    (tmp_path / "b.json").write_text('{"st": 7, "scores": [5]}\n')
    got = [tuple(r) for r in scan_score_arrays(spark, str(tmp_path), 1, 1, keep="st bigint").select("st", "pos", "value", "system_score").collect()]
    assert sorted(got, key=str) == sorted([(7, 0, 1.0, 0.5), (7, 1, None, 0.5), (-8, 0, 3.0, None), (None, 0, 4.0, None), (7, 0, 5.0, None)], key=str)


def test_files_do_not_grow_with_the_systems(spark, tmp_path, monkeypatch):
    from metaeval.plans import queries

    monkeypatch.setattr(queries, "new_folder", lambda spark: str(tmp_path / "out"))
    table = spark.range(0, 400, 1, 2).selectExpr("id - 3 AS vec_id", "array(float(id), float(0.5)) AS embedding")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.score_array_explode(spark, str(tmp_path)).collect()
    assert sorted((r["st"], r["pos"], r["value"]) for r in rows) == sorted((i - 3, k, x) for i in range(400) for k, x in enumerate((float(i), 0.5)))
    assert all(r["system_score"] == (r["st"] / 8 if r["st"] % 3 else None) for r in rows)
    assert len(list((tmp_path / "out").rglob("*.json"))) <= 4
