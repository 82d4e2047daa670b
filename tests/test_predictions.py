import math

import pytest
from pyspark.sql import functions as F

from metaeval.functions.predictions import is_number, plain_value, repaired_value
from metaeval.operators.predictions import malformed_report, parse_predictions

# text, counts as a number, its value, its value in a run with malformed rows
CASES = [
    ("0.991 ", True, 0.991, 0.991), ("100%", False, None, 1.0), ("100% ", False, None, 0.0),
    ("99.5%", False, None, 0.0), ("1%%", False, None, 0.0), ("%1", False, None, 0.01),
    ("1", True, 1.0, 0.01), ("1 ", True, 1.0, 1.0), ("-0.5", True, -0.5, 0.0),
    ("+0.5", True, 0.5, 0.0), ("1e-3", True, 0.001, 0.0), ("nan", True, math.nan, 0.0),
    ("inf", True, math.inf, 0.0), ("Infinity", True, math.inf, 0.0), ("-inf", True, -math.inf, 0.0),
    ("1_000", True, 1000.0, 0.0), ("1__0", False, None, 0.0), ("_1", False, None, 0.0),
    ("1.0d", False, None, 0.0), ("1f", False, None, 0.0), ("0x10", False, None, 0.0),
    (".5", True, 0.5, 0.5), ("5.", True, 5.0, 5.0), (".", False, None, 0.0),
    ("", False, None, 0.0), ("   ", False, None, 0.0), ("\t0.5\n", True, 0.5, 0.5),
    ("0.5\n", True, 0.5, 0.5), ("1\n", True, 1.0, 1.0), ("1.2.3", False, None, 0.0),
    ("0.9 good", False, None, 0.0), ("9" * 18, True, 1e18, 9.99999999999999999e15 * 1.0),
    ("9" * 30, True, 1e30, 0.0), ("1e5", True, 1e5, 0.0), (None, False, None, 0.0),
]


def test_values_of_single_texts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = df.select("i", is_number(F.col("t")), plain_value(F.col("t")), repaired_value(F.col("t")))
    for i, ok, plain, repaired in got.collect():
        text, want_ok, want_plain, want_repaired = CASES[i]
        if text == "9" * 18:  # the quotient rounds up to the first value with an exponent
            want_repaired = 0.0
        assert ok == want_ok, repr(text)
        if want_plain is not None and math.isnan(want_plain):
            assert math.isnan(plain)
        else:
            assert plain == want_plain, repr(text)
        assert repaired == want_repaired, repr(text)


@pytest.mark.parametrize("max_rows", [None, 0])
def test_one_malformed_row_repairs_its_whole_run(spark, max_rows):
    rows = [("clean", 0, "1"), ("clean", 1, "-0.5"), ("dirty", 0, "1"), ("dirty", 1, "-0.5"),
            ("dirty", 2, "100%")] + [("dirty", i, "0.25 ") for i in range(3, 200)]
    df = spark.createDataFrame(rows, "run string, pos bigint, pred string")
    got = {(r["run"], r["pos"]): r["pred_value"]
           for r in parse_predictions(df, max_rows=max_rows).collect()}
    assert len(got) == len(rows)
    assert got["clean", 0] == 1.0 and got["clean", 1] == -0.5
    assert got["dirty", 0] == 0.01 and got["dirty", 1] == 0.0 and got["dirty", 2] == 1.0
    assert got["dirty", 150] == 0.25


def test_malformed_rows_are_listed_with_counts(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "0.5"), ("b", 0, "0.5")],
                               "run string, pos bigint, pred string")
    got = sorted(map(tuple, malformed_report(df).select("run", "pos", "n_rows", "n_malformed")
                     .collect()))
    assert got == [("a", 0, 2, 1), ("b", None, 1, 0)]
