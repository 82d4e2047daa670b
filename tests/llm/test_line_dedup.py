import re

import compare

from metaeval.llm import line_dedup as d
from metaeval.llm.line_dedup import RUN

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows):
    """The text that stays of every different (id, text), in the order of the ids."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    seen, out = set(), {}
    for name, text in order:
        if text is None:
            out[name, text] = None
            continue
        lines = text.split("\n")
        real = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for j in range(len(real)):
            for size in range(1, RUN + 1):
                run = tuple(lines[i] for i in real[j:j + size])
                if len(run) == size and (size == RUN or sum(len(WORD.findall(line)) for line in run) >= d.LONG_WORDS):
                    if run in seen:
                        gone.update(real[j:j + size])
                    seen.add(run)
        out[name, text] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.spark_rows(d.op5_line_dedup(spark, sf)) == compare.sql_rows(compare.connect(sf), d.SQL)


def test_runs_within_and_across_documents(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\n\nc\nz"), (4, "a\nb"), (5, "r\nr\nr\nr\nr"), (6, long + "\nq"), (7, "p\n" + long), (8, "b\nc\nd"), (9, "a\nb\nc\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in d.without_repeats(df).collect()}
    assert got == {i: brute_force(rows)[i, t] for i, t in rows}
    assert got[2] == "x\ny" and got[3] == "\nz" and got[4] == "a\nb" and got[5] == "r" and got[7] == "p" and got[8] == "" and got[9] == ""


def test_passages_of_two_lines_and_other_blanks(spark):
    one, two = " ".join(f"a{i}" for i in range(26)), " ".join(f"b{i}" for i in range(25))
    tabs, short = "\t".join(f"c{i}" for i in range(50)), "  ".join(f"d{i}" for i in range(49))
    texts = [f"x1\n{one}\n{two}\ny1", f"x2\n{one}\n\n{two}\ny2", f"{tabs}\nz1", f"z2\n{tabs}", f"{short}\nv1", f"v2\n{short}", f"{one}\nu1", f"{one}\nu2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in d.without_repeats(df).collect()}
    assert got == {i: brute_force(list(enumerate(texts)))[i, t] for i, t in enumerate(texts)}
    assert got[1] == "x2\n\ny2" and got[3] == "z2" and got[5] == texts[5] and got[7] == texts[7]


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = d.without_repeats(odd)
    assert out.columns == odd.columns
    want = brute_force(rows)
    # rows of one id with different texts come in the order of their hashes: leave that id to its sizes
    single = [r for r in rows if len({t for i, t in rows if i == r[0]}) == 1 and r[0] is not None and r[0] < 6]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    for name, text in single:
        assert (name, want[name, text]) in got
    assert all(r["key"] == "key" for r in out.collect())
    assert d.without_repeats(none).count() == 0
