"""From raw documents to token ids: rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows as Parquet to
the shared folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from metaeval.llm import byte_bpe, decontamination, flat, line_dedup, ngram_join, quality_rules
from metaeval.session import delete_at_exit, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' votes reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated lines go, and with them documents of which no word is left."""
    out = line_dedup.marked(docs).filter((F.col("deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": size}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    sets, labels = ngram_join.near_duplicates(docs.select(own.alias("own"), "text"), "own")
    groups = ngram_join.with_component(sets, labels)
    kept = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    # read three times below
    kept = flat.written(kept.select(F.col("id.id").alias("kept_id"), F.col("id.key").alias("kept_key"), "rows", "n"))
    is_kept = F.col("d.doc_id").eqNullSafe(F.col("k.kept_id")) & (F.xxhash64("d.text") == F.col("k.kept_key"))
    # rows with equal id and text are one group and have one name; without words they have no group
    doubled = kept.filter((F.col("rows") > 1) & (F.col("n") > 0))
    if doubled.isEmpty():
        return docs.alias("d").join(kept.alias("k"), is_kept, "left_semi")
    single = docs.alias("d").join(kept.filter((F.col("rows") == 1) | (F.col("n") == 0)).alias("k"), is_kept, "left_semi")
    one = docs.alias("d").join(doubled.alias("k"), is_kept, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a window of a benchmark item occurs in go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    docs = docs.select("doc_id", "lang", "source", "text")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: SQL states neither the estimated votes of the first stage nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` on."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
