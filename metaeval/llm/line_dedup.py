"""Line dedup by winnowing over line hashes, with DataFrame functions only.

The lines of a text that hold a word are its sequence; lines without one are no
part of any run and stay. Every two neighbouring lines have a joint hash, and of
every ``WINDOW`` neighbouring ones the least is a fingerprint, the first of equals.
Runs of ``GRAM + WINDOW - 1`` lines that are equal have the same fingerprint at the
same place. So positions meet by fingerprint, are extended to both sides to the
whole run, and each run is held against its first position, in the order of
document id and line. Longer repeats are covered run by run. A line, or two
neighbouring ones, of ``LONG_WORDS`` words or more in all are a run, and a
fingerprint, by themselves: so whatever repeats goes that has ``RUN`` lines or
``LONG_WORDS`` words.

Every line that a later occurrence of a run covers is deleted; the first
occurrence stays. A run that a third of all documents hold costs one minimum,
combined before the shuffle, and a join that can be split.

Defined results: null and empty texts have no lines in the sequence and stay as
they are. Rows with equal id and text are one document and get the same result.
A null id comes before all others. Extra columns are kept by ``without_repeats``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metaeval.llm import flat
from metaeval.llm.registry import query

GRAM = 2
WINDOW = 2
RUN = GRAM + WINDOW - 1
LONG_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]"


def sequence(text: Column) -> Column:
    """The lines that hold a word: place among all lines, hash, number of words."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        i.alias("i"), F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(f"{_WORD}+")).alias("words")))
    return F.filter(lines, lambda x: x["words"] > 0)


def _runs(lines: Column) -> Column:
    """The runs of a sequence: fingerprint, its place in the run, the hash of the run, first line, number of lines."""
    n = F.size(lines)

    def run(j: Column) -> Column:
        hashes = [F.get(lines, j + k)["h"] for k in range(RUN)]
        grams = [F.xxhash64(*hashes[k:k + GRAM]) for k in range(WINDOW)]
        least = F.least(*grams)
        place = F.lit(WINDOW - 1)
        for k in range(WINDOW - 2, -1, -1):
            place = F.when(grams[k] == least, k).otherwise(place)
        # the lines on both sides of the fingerprint, up to the whole run
        return F.struct(least.alias("print"), place.alias("place"), F.xxhash64(*hashes).alias("extended"), j.alias("line"), F.lit(RUN).alias("size"))

    many = F.when(n >= RUN, F.transform(F.sequence(F.lit(0), n - RUN), run)).otherwise(F.array())
    def few(size: int) -> Column:
        """A line, or two, with enough words."""
        def one(j: Column) -> Column:
            words, name = F.get(lines, j)["words"], F.get(lines, j)["h"]
            for k in range(1, size):
                words, name = words + F.get(lines, j + k)["words"], F.xxhash64(name, F.get(lines, j + k)["h"])
            return F.when(words >= LONG_WORDS, F.struct(name.alias("print"), F.lit(-size).alias("place"), name.alias("extended"), j.alias("line"), F.lit(size).alias("size")))

        return F.when(n >= size, F.filter(F.transform(F.sequence(F.lit(0), n - size), one), lambda x: x.isNotNull())).otherwise(F.array())

    return F.concat(many, *[few(size) for size in range(1, RUN)])


def _keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))


def repeated_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, key (the hash of the text) and the places, among all lines, of the lines to delete."""
    rows = _keyed(documents, id_column, text_column).select("id", "key", sequence(F.col("text")).alias("lines"))
    rows = flat.written(rows.select("id", "key", F.transform("lines", lambda x: x["i"]).alias("places"), _runs(F.col("lines")).alias("runs")))
    spots = rows.select("id", "key", F.explode("runs").alias("r")).select("id", "key", "r.print", "r.place", "r.extended", "r.line", "r.size")
    order = F.struct(F.col("id").isNotNull().alias("a"), F.coalesce("id", F.lit(0).cast(rows.schema["id"].dataType)).alias("b"), F.col("key").alias("c"), F.col("line").alias("d"))
    spots = spots.withColumn("spot", order)
    first = spots.groupBy("print", "place", "extended").agg(F.min("spot").alias("first"), F.max("spot").alias("last")).filter("first < last").drop("last")
    later = spots.join(first, ["print", "place", "extended"]).filter("spot > first")
    covered = later.select("id", "key", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1)).alias("line")).distinct()
    found = covered.groupBy("id", "key").agg(F.collect_list("line").alias("covered")).select(F.col("id").alias("id2"), F.col("key").alias("key2"), "covered")
    places = rows.select("id", "key", "places").dropDuplicates(["id", "key"])
    both = places.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
    return both.select("id", "key", F.transform("covered", lambda j: F.get("places", j)).alias("deleted"))


def marked(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document as the struct ``row``, beside the ``text`` that stays and the number of ``deleted`` lines."""
    gone = repeated_lines(documents, id_column, text_column)
    d = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                         F.xxhash64(text_column).alias("key"))
    g = gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), F.map_from_arrays("deleted", F.transform("deleted", lambda x: F.lit(True))).alias("gone"))
    joined = d.join(g, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    left = F.filter(F.split("text", "\n"), lambda line, i: F.element_at(F.col("gone"), i).isNull())
    return joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("deleted"))


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, with the later repeated lines deleted from their texts."""
    out = marked(documents, id_column, text_column)
    return out.select(*((F.col("text") if c == text_column else F.col("row").getField(c)).alias(c) for c in documents.columns))


SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
seq AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
win AS (SELECT doc_id, j, line, words, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(words) OVER w AS words2 FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
runs AS (
  SELECT doc_id, j, {RUN} AS size, md5(line) || md5(line2) || md5(line3) AS run FROM win WHERE line3 IS NOT NULL
  UNION ALL SELECT doc_id, j, 2, md5(line) || md5(line2) FROM win WHERE words + words2 >= {LONG_WORDS}
  UNION ALL SELECT doc_id, j, 1, md5(line) FROM seq WHERE words >= {LONG_WORDS}),
later AS (SELECT doc_id, j, size FROM runs QUALIFY row_number() OVER (PARTITION BY size, run ORDER BY doc_id, j) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + size)) AS j FROM later),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.j) AS n_deleted,
    sha256(coalesce(string_agg(CASE WHEN g.j IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
  FROM lines l LEFT JOIN seq s ON l.doc_id = s.doc_id AND l.i = s.i LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.j = g.j GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""


@query(SQL)
def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Number of lines, of deleted lines, and digest of what stays, for every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = marked(documents.withColumn("n_lines", n_lines))
    return out.select("row.doc_id", "row.n_lines", F.col("deleted").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
