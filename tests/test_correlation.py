import math
import random

import golden
import pytest
from pyspark.sql import functions as F

from metaeval.operators import lookup
from metaeval.operators.correlation import correlation_report, spearman
from metaeval.operators.ordering import with_positions


def mean_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def brute_force(pairs):
    pairs = [(x, y) for x, y in pairs
             if x is not None and y is not None and not math.isnan(x) and not math.isnan(y)]
    if not pairs:
        return None
    a, b = mean_ranks([p[0] for p in pairs]), mean_ranks([p[1] for p in pairs])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    top = sum((i - ma) * (j - mb) for i, j in zip(a, b))
    low = math.sqrt(sum((i - ma) ** 2 for i in a) * sum((j - mb) ** 2 for j in b))
    return top / low if low else None


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, h string, x double, y double")


def sample_rows(seed=7, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # one group holds most rows, one value most of its x
        g = "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}"
        x = 0.991 if rng.random() < 0.4 else rng.randrange(40) / 10
        y = rng.choice([None, math.nan, x + rng.random(), float(rng.randrange(9))])
        rows.append((g, f"h{i % 3}", x, y))
    rows += [("single", "h0", 1.0, 2.0), ("flat", "h0", 1.0, 2.0), ("flat", "h0", 1.0, 3.0),
             ("empty", "h0", None, 1.0), (None, "h0", 1.0, 2.0), (None, "h0", 2.0, 3.0),
             ("zero", "h0", 0.0, 1.0), ("zero", "h0", -0.0, 2.0), ("zero", "h0", 1.0, 3.0)]
    return rows


PATHS = {
    "window": {},
    "range, ranks broadcast": {"window_cells": 0},
    "range, ranks joined by weight": {"window_cells": 0, "max_rows": 0},
    "large groups apart": {"window_cells": 60},
    "large groups apart, salted": {"window_cells": 60, "max_rows": 0},
}


@pytest.mark.parametrize("path", PATHS)
def test_groups_agree_with_brute_force(spark, path, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY_SHARE", 20)
    rows = sample_rows()
    found = {r["g"]: r for r in spearman(table(spark, rows), "x", "y", ["g"],
                                         **PATHS[path]).collect()}
    assert set(found) == {r[0] for r in rows}
    for g, row in found.items():
        pairs = [(r[2], r[3]) for r in rows if r[0] == g]
        want = brute_force(pairs)
        assert row["n_rows"] == len(pairs)
        assert row["spearman"] == (None if want is None else pytest.approx(want, abs=1e-12))
    assert found["flat"]["spearman"] is None
    assert found["empty"]["n_pairs"] == 0


@pytest.mark.parametrize("path", PATHS)
def test_levels_rank_on_their_own_pool(spark, path):
    rows = sample_rows(3, 300)
    found = spearman(table(spark, rows), "x", "y", ["g", "h"],
                     levels={"system": ["g", "h"], "pooled": ["g"]}, **PATHS[path]).collect()
    assert len(found) == len({r[:2] for r in rows}) + len({r[0] for r in rows})
    for row in found:
        pairs = [(r[2], r[3]) for r in rows
                 if r[0] == row["g"] and (row["level"] == "pooled" or r[1] == row["h"])]
        want = brute_force(pairs)
        assert row["spearman"] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_whole_table_as_one_group(spark):
    rows = sample_rows(5)
    for options in PATHS.values():
        row = spearman(table(spark, rows), "x", "y", **options).first()
        assert row["spearman"] == pytest.approx(brute_force([r[2:] for r in rows]), abs=1e-12)


def test_invariances(spark):
    base = table(spark, sample_rows(11)).filter("g = 'hot'")
    value = spearman(base, "x", "y").first()["spearman"]
    monotone = base.withColumn("x", F.exp("x") * 3)
    turned = base.withColumn("y", -F.col("y"))
    shuffled = base.orderBy(F.rand(1)).repartition(13)
    assert spearman(monotone, "x", "y").first()["spearman"] == pytest.approx(value, abs=1e-12)
    assert spearman(turned, "x", "y").first()["spearman"] == pytest.approx(-value, abs=1e-12)
    assert spearman(shuffled, "x", "y").first()["spearman"] == pytest.approx(value, abs=1e-12)


def test_published_correlations(spark):
    rows = spark.createDataFrame(
        list(zip([float(p) for p in golden.PREDICTIONS], golden.XCOMET, golden.METRICX)),
        ["p", "metric_score_xcomet-xl", "metric_score_metricx-23-xl"])
    labels = {"corr_xcomet": "metric_score_xcomet-xl",
              "corr_metricx": "metric_score_metricx-23-xl", "corr_humanda": "humanda"}
    row = correlation_report(rows, "p", labels, lower_is_better=["metric_score_metricx-23-xl"]
                             ).first()
    assert row["corr_xcomet"] == pytest.approx(golden.CORR_XCOMET, abs=1e-9)
    assert row["corr_metricx"] == pytest.approx(golden.CORR_METRICX, abs=1e-9)
    assert row["corr_humanda"] is None


def test_report_without_any_label(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 0.6), ("b", 0.1)], "run string, p double")
    found = correlation_report(rows, "p", {"corr_humanda": "humanda"}, ["run"]).collect()
    assert sorted((r["run"], r["corr_humanda"]) for r in found) == [("a", None), ("b", None)]


@pytest.mark.parametrize("max_rows", [None, 0])
def test_positions_over_many_ranges(spark, max_rows, monkeypatch):
    if max_rows is not None:
        monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", max_rows)
    ids = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5))
        .alias("g"), (F.hash("id").cast("bigint") * 10000 + F.col("id")).alias("k"))
    rows = with_positions(ids.repartition(7), ["g"], ["k"]).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append((r["k"], r["pos"]))
    assert len(rows) == 5000
    for members in groups.values():
        assert [p for _, p in sorted(members)] == list(range(len(members)))


def test_rows_are_counted_before_they_are_taken_to_levels(spark, monkeypatch):
    from metaeval.operators import correlation

    plans, cut = [], correlation.cut
    monkeypatch.setattr(correlation, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) or cut(df))
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS s", "id % 2 AS p", "IF(id % 7 = 0, NULL, id % 5) AS x", "(id * id) % 11 AS y")
    levels = {"one": ["s"], "pool": ["p"]}
    got = {(r["level"], r["s"], r["p"]): (r["n_rows"], r["n_pairs"], r["spearman"]) for r in correlation.spearman(rows, "x", "y", ["s", "p"], levels=levels).collect()}
    place = {name: [i for i, line in enumerate(plans[0]) if name in line] for name in ("Aggregate", "Generate")}
    assert place["Aggregate"][0] < place["Generate"][0] < place["Aggregate"][-1]
    for level, by in (("one", "s"), ("pool", "p")):
        for r in correlation.spearman(rows, "x", "y", [by]).collect():
            found = got.pop((level, r["s"] if by == "s" else None, r["p"] if by == "p" else None))
            assert found[:2] == (r["n_rows"], r["n_pairs"]) and found[2] == pytest.approx(r["spearman"], abs=1e-12)
    assert not got
