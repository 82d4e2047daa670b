import hashlib
import json
import random

import compare
import pytest
from pyspark.sql import functions as F

from metaeval.llm import chat_format as c


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.spark_rows(c.op1_chat_format(spark, sf)) == compare.sql_rows(compare.connect(sf), c.SQL)


def test_layouts(spark):
    turns = [("user", "hi \"x\"\n"), ("assistant", "")]
    records = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in turns]},
        "conversations": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]},
        "dialogue": {"dialogue": [{"speaker": r, "text": t} for r, t in turns]},
        "prompt": {"prompt": turns[0][1], "response": ""},
        "question": {"question": turns[0][1], "answer": ""},
        "short_instruction": {"output": "", "instruction": turns[0][1]},
        "nested": {"prompt": {"text": turns[0][1]}, "completion": {"text": ""}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "name string, record string")
    for r in c.canonical(df).collect():
        assert r["layout"] == r["name"] and [tuple(t) for t in r["turns"]] == turns


def test_odd_records(spark):
    records = ['{"messages":[]}', '{"messages":[{"role":null,"content":null}]}', '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', "nope", None, "", "[1]", '{"a":{"b":[{"c":1}]}}', '{"prompt":null,"response":"y"}']
    df = spark.createDataFrame([(r, "t", "f") for r in records], "record string, turns string, formatted string")
    rows = {r["record"]: r for r in c.formatted(c.canonical(df)).collect()}
    assert len(rows) == len(records)
    assert rows['{"messages":[]}']["formatted"] == "" and rows['{"messages":[]}']["turns"] == []
    assert [tuple(t) for t in rows[records[2]]["turns"]] == [("user", "a"), ("assistant", "")]
    assert [tuple(t) for t in rows[records[8]]["turns"]] == [("user", ""), ("assistant", "y")]
    for r in ("nope", None, "", "[1]", records[7]):
        assert (rows[r]["layout"], rows[r]["turns"], rows[r]["formatted"], rows[r]["loss_spans"]) == (None,) * 4
    assert c.canonical(df.limit(0)).count() == 0


def test_any_text_comes_back(spark):
    rng = random.Random(2)
    parts = [*c.CONTROL, "<|end|>\n", "|>\n", "\\", "\\0", "\\1", "<", "|", ">", "a", "é", "🙂", "\n", "assistant"]
    make = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    turns = [[(rng.choice(["user", "assistant", make()]), make()) for _ in range(rng.randint(0, 5))] for _ in range(300)]
    df = spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in x]) for i, x in enumerate(turns)], "i int, turns array<struct<role:string,text:string>>")
    out = c.formatted(df).select("i", "formatted", c.parsed(F.col("formatted")).alias("back"), c.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        assert [tuple(t) for t in r["back"]] == turns[r["i"]]
        assert list(r["loss"]) == [t for role, t in turns[r["i"]] if role == "assistant"]
        assert all(s not in r["formatted"] for s in c.CONTROL if s not in ("<|", "|>"))


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", None), (2, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in c.digests(c.formatted(c.canonical(c.as_records(df), texts_column="texts"))).collect()}
    assert out[1]["n_turns"] == 4 and out[None]["n_turns"] == 1 and out[2]["loss_chars"] == 1
    assert c.digests(c.formatted(c.canonical(c.as_records(df.limit(0)), texts_column="texts"))).count() == 0


def test_a_turn_beyond_the_parser(spark):
    """A turn of 21 million characters is formatted like any other; a JSON record of that size raises."""
    long = F.concat(F.repeat(F.lit("a<|b\\ "), 3_500_000), F.lit("é"))
    df = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant")], "conv_id long, turn long, role string").withColumn(
        "text", F.when(F.col("conv_id") == 1, long).otherwise("x"))
    rows = {r["conv_id"]: r for r in c.digests(c.formatted(c.canonical(c.as_records(df), texts_column="texts"))).collect()}
    text = "a<|b\\ " * 3_500_000 + "é"
    assert rows[1]["n_turns"] == 2 and rows[1]["loss_chars"] == len(text) and rows[2]["n_turns"] == 1
    assert rows[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert rows[1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    whole = spark.range(1).select(F.to_json(F.struct(long.alias("prompt"), F.lit("y").alias("response"))).alias("record"))
    with pytest.raises(Exception, match="cannot be parsed"):
        c.canonical(whole).select("layout").collect()
