"""How far the vocabulary of each source lies from that of the others of its language.

A translate table lowers A-Z and blanks every separator byte in one pass over a
piece of texts; splitting and a ``Counter`` per document give its term counts. Tasks
add up the counters of a (language, source) group and send one row per term, so
that only sparse counts are shuffled. A language keeps the terms that enough of its
documents hold.

Pairs of sources are summed in tiles: kept terms are dealt to blocks by hash, the
sources of a language to tiles by hash, and a task gets one block of terms for two
tiles of sources. There the smoothed shares of terms that a source lacks are one
number, so nothing is sent for them; terms that no source of two tiles has are
settled by their number. All shares are integers, and so is every step.

Defined results: null text, language and source are ``''``. A repeated row is another
document. A group without terms has its pairs, against zero counts; a language
without kept terms has pairs of value 0. Equal values are ranked by the UTF-8 bytes
of their item. A very long text is split in stretches, cut at separators; only its
distinct terms are held. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from metaeval.llm import flat
from metaeval.llm.registry import query

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Kept terms and sources that a task holds against each other, about.
BLOCK_TERMS = 1024
TILE_SOURCES = 128
STRETCH = 1 << 20
FLUSH_ENTRIES = 250_000
FLUSH_BYTES = 64 << 20

#: Letters a-z and bytes beyond ASCII stay, A-Z are lowered, all others are blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(lowered: bytes, first: int, end: int) -> Counter:
    """The terms between two places of translated bytes, with their counts."""
    counts: Counter = Counter()
    while end - first > STRETCH:
        cut = lowered.rfind(b" ", first, first + STRETCH)
        cut = cut if cut >= 0 else lowered.find(b" ", first + STRETCH, end)
        if cut < 0:
            break
        counts.update(lowered[first:cut].split())
        first = cut + 1
    counts.update(lowered[first:end].split())
    return counts


def partial_counts(documents: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences in ``docs`` documents, added up in each task.

    Every group also has rows with the term NULL, so that it is there without terms.
    """
    flat.small_batches(documents.sparkSession)

    def batch_of(held: dict) -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for key, (counts, frequencies) in held.items():
            for column, value in ((lang, key[0]), (source, key[1])):
                column.extend([value] * (len(counts) + 1))
            term.append(None)
            term.extend(counts)
            n.append(0)
            n.extend(counts.values())
            docs.append(0)
            docs.extend(map(frequencies.__getitem__, counts))
        terms = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                          names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        entries = size = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                lowered, places = data.tobytes().translate(TABLE), offsets.tolist()
                for row in range(first, end):
                    key = langs[row], sources[row]
                    if key not in held:
                        held[key] = (Counter(), Counter())
                        entries += 1
                    counts, frequencies = held[key]
                    found = count_terms(lowered, places[row - first], places[row - first + 1])
                    entries -= len(counts)
                    counts.update(found)
                    frequencies.update(found.keys())
                    entries += len(counts)
                size += len(data)
                if entries >= FLUSH_ENTRIES or size >= FLUSH_BYTES:
                    yield batch_of(held)
                    held, entries, size = {}, 0, 0
        if held:
            yield batch_of(held)

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return documents.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` of kept terms, with ``lang_n`` over all sources.

    Each group has one row with the term NULL besides. ``lead`` marks one row per term.
    """
    summed = partial_counts(documents).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (
        summed.withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "lead": F.col("source") == F.min("source").over(term)})
        .filter(F.col("term").isNull() | (F.col("lang_docs") >= min_documents)).drop("docs", "lang_docs"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in whole numbers of up to 38 digits; 1 without terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    part = F.call_function("div", wide(wide(n + 2) * SCALE), wide(total + 2 * terms))
    return F.when(terms > 0, part + 1).otherwise(F.lit(1)).cast("long")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(p) + F.col(q))


def group_totals(kept: DataFrame) -> DataFrame:
    """For each (lang, source): its total, that of its language, the number of kept terms, and how both are dealt out."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term").isNotNull() & F.col("lead")).alias("led"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("led").alias("terms"), F.count("*").alias("sources"))
    split = lambda c, size: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("long")
    return groups.drop("led").join(langs, "lang").withColumns({"blocks": split("terms", BLOCK_TERMS), "tiles": split("sources", TILE_SOURCES)})


def pair_values(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: the summed gaps of every two sources of a language, both ways."""
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    nothing = share(F.lit(0).cast("long"), "total", "terms")
    heads = totals.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tiles", "source",
                          tile.alias("tile"), F.lit(None).cast("string").alias("term"), nothing.alias("p"))
    cells = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "tiles", "source", tile.alias("tile"), "term", "p")
    both = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    both = both.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "source", "tile", "term", "p")

    def sums(key, part: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        head = part["term"].isna().to_numpy()
        heads = part[head].sort_values("source")
        names, zero, tiles = heads["source"].to_numpy(), heads["p"].to_numpy(np.int64), heads["tile"].to_numpy()
        place = {name: i for i, name in enumerate(names)}
        found = part[~head]
        column, terms = pd.factorize(found["term"])
        shares = np.repeat(zero[:, None], len(terms), 1)
        shares[[place[name] for name in found["source"]], column] = found["p"].to_numpy(np.int64)
        out = []
        for i in np.flatnonzero(tiles == low):
            partners = np.flatnonzero(tiles == high)
            partners = partners[partners > i] if low == high else partners
            if not len(partners):
                continue
            theirs = shares[partners]
            value = ((theirs - shares[i]) ** 2 // (theirs + shares[i])).sum(1)
            out.append(pd.DataFrame({"lang": lang, "a": names[i], "b": names[partners], "value": value, "seen": len(terms), "p0": zero[i], "q0": zero[partners]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["lang", "a", "b", "value", "seen", "p0", "q0"])

    schema = "lang string, a string, b string, value long, seen long, p0 long, q0 long"
    parts = both.groupBy("lang", "block", "low", "high").applyInPandas(sums, schema)
    found = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("p0").alias("p0"), F.max("q0").alias("q0"))
    found = found.join(totals.groupBy("lang").agg(F.max("terms").alias("terms")), "lang")
    value = F.col("value") + (F.col("terms") - F.col("seen")) * gap("p0", "q0")
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.select("lang", way.alias("way"), F.when(F.col("terms") > 0, value).otherwise(F.lit(0)).alias("value")).select("lang", "way.*", "value")


def divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` ranks the other sources of the language, part ``term`` the ``top_terms``
    terms that the source has more of than its language.
    """
    kept = flat.written(kept_counts(documents, min_documents))
    totals = flat.written(group_totals(kept))
    rows = kept.filter(F.col("term").isNotNull()).join(totals, ["lang", "source"])
    rows = rows.withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")})
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    out = [(part, found.withColumn("rank", F.row_number().over(order))) for part, found in (("pair", pair_values(rows, totals)), ("term", terms))]
    pairs, terms = (found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, found in out)
    return pairs.unionByName(terms.filter(F.col("rank") <= top_terms))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(n.n, 0) AS n
  FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term) n
    ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
s AS (SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000 * (lang_n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q
  FROM c),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) v
    ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM s WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query(SQL)
def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All sources of every language against each other, and the terms that mark each."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
