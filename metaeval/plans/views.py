"""Evaluation tables derived from the sample tables, in Spark and as SQL.

The sample tables hold documents, events and vectors rather than speech data.
Each view here turns whole tables into one of the layouts the operators expect.
Every view has a SQL twin of the same name for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENDINGS = (".wav", ".flac", ".ogg", ".mp3", ".WAV")
INSTRUCTIONS = ("Rate the translation", "How good is this translation?", "Score")
# Malformed and unusual predictions, and unusual ones that are numbers.
ODD = ("100%", "100% ", "99.5%", "1%%", "%1", "1", "1 ", "-0.5", "+0.5", "1e-3", "nan", "inf",
       "Infinity", "1_000", "0.2\nbecause", "0.4\r", "a \"b\"\tc", "\n", "1.0d", "1f", "0x10", ".5", "5.", ".", "", "  ", "12345678901234567890")
ODD_NUMBERS = ("-0.5", "+0.5", "1e-3", "1_000", ".5", "5.", "1", " 1 ")
CLEAN_RUN = "view"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values, index) -> "F.Column":
    """The literal at ``index`` modulo the number of literals."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def pick_sql(values, index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST(({index}) % {len(values)} + 1 AS INTEGER)]"


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a manifest."""
    i = F.col("doc_id")
    segment = F.when(i % 7 == 0, F.concat(F.lit(":"), (i % 100).cast("string"), F.lit(":"),
                                          (i % 1000 + 1).cast("string"))).otherwise("")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("split"),
        F.concat(F.lit("clips/"), i.cast("string"), pick(ENDINGS, i), segment).alias("path"),
        F.when(i % 11 != 0, F.col("text")).alias("sentence"),
        pick(INSTRUCTIONS, i).alias("inst"),
        F.when(i % 2 != 0, F.concat(F.lit("\nHypothesis "), i.cast("string"))).alias("suffix"),
        "lang", "n_chars",
    )


MANIFEST = f"""manifest AS (
  SELECT doc_id, source AS split,
    'clips/' || CAST(doc_id AS VARCHAR) || {pick_sql(ENDINGS, 'doc_id')} ||
      CASE WHEN doc_id % 7 = 0 THEN ':' || CAST(doc_id % 100 AS VARCHAR) || ':' ||
        CAST(doc_id % 1000 + 1 AS VARCHAR) ELSE '' END AS path,
    CASE WHEN doc_id % 11 <> 0 THEN text END AS sentence,
    {pick_sql(INSTRUCTIONS, 'doc_id')} AS inst,
    CASE WHEN doc_id % 2 <> 0 THEN chr(10) || 'Hypothesis ' || CAST(doc_id AS VARCHAR) END AS suffix,
    lang, n_chars
  FROM documents)"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest with labelled documents counting as readable."""
    labelled = table(spark, sf, "labels").select("doc_id").distinct()
    return manifest(spark, sf).join(
        labelled.withColumn("_known", F.lit(True)), "doc_id", "left").withColumn(
        "is_readable", F.coalesce("_known", F.lit(False))).drop("_known")


FLAGGED = MANIFEST + """,
flagged AS (
  SELECT manifest.*, doc_id IN (SELECT doc_id FROM labels) AS is_readable FROM manifest)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the number their properties hold."""
    return table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"))


EVENTS = """ev AS (
  SELECT event_id, event_type, user_id, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as prediction texts; one run has no malformed row. With two labels."""
    i = F.col("event_id")
    usual = F.concat(F.lit("0."), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(" "))
    turn = F.expr("event_id div 97")
    odd = F.when(F.col("event_type") == CLEAN_RUN, pick(ODD_NUMBERS, turn)).otherwise(
        pick(ODD, turn))
    return events(spark, sf).select(
        F.col("event_type").alias("run"), i.alias("pos"),
        F.when(i % 97 == 0, odd).otherwise(usual).alias("pred"),
        F.when(i % 53 != 0, F.col("k")).alias("metric_score_xcomet-xl"),
        F.col("value").alias("metric_score_metricx-23-xl"),
    )


PREDICTIONS = EVENTS + f""",
predictions AS (
  SELECT event_type AS run, event_id AS pos,
    CASE WHEN event_id % 97 <> 0 THEN '0.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' '
      WHEN event_type = '{CLEAN_RUN}' THEN {pick_sql(ODD_NUMBERS, 'event_id // 97')}
      ELSE {pick_sql(ODD, 'event_id // 97')} END AS pred,
    CASE WHEN event_id % 53 <> 0 THEN k END AS "metric_score_xcomet-xl",
    value AS "metric_score_metricx-23-xl"
  FROM ev)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events as QE and metric scores of ten systems, many metric scores tied."""
    i = F.col("event_id")
    return events(spark, sf).select(
        F.concat(F.lit("asr"), (i % 2).cast("string")).alias("asr"),
        F.col("event_type").alias("st"), i.alias("pos"), F.col("value").alias("qe"),
        F.when(i % 53 != 0, F.col("k")).alias("metric"),
    )


SCORES = EVENTS + """,
scores AS (
  SELECT 'asr' || CAST(event_id % 2 AS VARCHAR) AS asr, event_type AS st, event_id AS pos,
    value AS qe, CASE WHEN event_id % 53 <> 0 THEN k END AS metric
  FROM ev)"""

# Names of models and systems, as files are named by them.
QE_MODELS = ("Unbabel/XCOMET-XL", "google/metricx-23-xl-v2p0", "blaser_2_0_qe")
METRIC_MODELS = ("Unbabel/XCOMET-XL", "google/metricx-23-xl-v2p0")
ASR_SYSTEMS = ("gold", "openai_whisper-large-v3")


def cascade_qe(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a segment, scored by three models after two ASR systems."""
    value, k, i = F.col("value"), F.col("k"), F.col("event_id")
    cells = [
        F.struct(F.lit(model).alias("qe_model"), F.lit(asr).alias("asr"), (base + noise).alias("qe"))
        for model, base in zip(QE_MODELS, (value, k, value + k))
        for asr, noise in zip(ASR_SYSTEMS, (F.lit(0.0), (i % 7).cast("double")))
    ]
    return events(spark, sf).select(
        F.lit("covost2").alias("dataset"),
        F.when(i % 3 == 0, "es_en").otherwise("en_de").alias("config"),
        F.lit("test0-500").alias("split"), F.col("event_type").alias("st"), i.alias("pos"),
        F.explode(F.array(*cells)).alias("_c"),
    ).select("dataset", "config", "split", "st", "pos", "_c.*")


def cascade_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a segment with two metric scores; some vectors lack rows."""
    i = F.col("event_id")
    cells = [
        F.struct(F.lit(METRIC_MODELS[0]).alias("metric_model"),
                 (F.col("user_id") % 97).cast("double").alias("metric")),
        F.struct(F.lit(METRIC_MODELS[1]).alias("metric_model"), F.col("k").alias("metric")),
    ]
    return events(spark, sf).filter(i % 53 != 0).select(
        F.lit("covost2").alias("dataset"),
        F.when(i % 3 == 0, "es_en").otherwise("en_de").alias("config"),
        F.lit("test0-500").alias("split"), F.col("event_type").alias("st"), i.alias("pos"),
        F.explode(F.array(*cells)).alias("_c"),
    ).select("dataset", "config", "split", "st", "pos", "_c.*")


def _cascade_qe_sql() -> str:
    parts = []
    for model, base in zip(QE_MODELS, ("value", "k", "value + k")):
        for asr, noise in zip(ASR_SYSTEMS, ("0.0", "CAST(event_id % 7 AS DOUBLE)")):
            parts.append(
                f"SELECT '{model}' AS qe_model, '{asr}' AS asr, event_type AS st, event_id AS pos,"
                " CASE WHEN event_id % 3 = 0 THEN 'es_en' ELSE 'en_de' END AS config,"
                f" {base} + {noise} AS qe FROM ev")
    return " UNION ALL ".join(parts)


CASCADE = EVENTS + f""",
cascade_qe AS ({_cascade_qe_sql()}),
cascade_metric AS (
  SELECT '{METRIC_MODELS[0]}' AS metric_model, event_type AS st, event_id AS pos,
    CASE WHEN event_id % 3 = 0 THEN 'es_en' ELSE 'en_de' END AS config,
    CAST(user_id % 97 AS DOUBLE) AS metric FROM ev WHERE event_id % 53 <> 0
  UNION ALL
  SELECT '{METRIC_MODELS[1]}', event_type, event_id,
    CASE WHEN event_id % 3 = 0 THEN 'es_en' ELSE 'en_de' END, k FROM ev
  WHERE event_id % 53 <> 0)"""


def waves(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors cut into two channels."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
        .alias("channels"))


def digest(values, name: str) -> "F.Column":
    """MD5 of integer or flag arrays, to compare long arrays briefly."""
    return F.md5(F.array_join(F.transform(values, lambda v: v.cast("bigint").cast("string")), " ")
                 .cast("binary")).alias(name)


def digest_sql(values: str) -> str:
    return (f"md5(coalesce(array_to_string(list_transform({values}, "
            "lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ' '), ''))")


def thousandths(values) -> "F.Column":
    return F.transform(values, lambda v: F.floor(v.cast("double") * 1000).cast("bigint"))


def thousandths_sql(values: str) -> str:
    return f"list_transform({values}, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT))"
