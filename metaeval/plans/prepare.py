"""From manifest rows to prompts and encoded rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from metaeval.functions.text import (
    cache_key, char_class, prefix_path, prompt_prefix, prompt_tail, target_text,
)
from metaeval.operators.languages import with_language_name
from metaeval.operators.splits import head_rows, readable_rows, require_rows, select_split
from metaeval.operators.tokens import assemble, build_vocabulary, encode
from metaeval.sinks.writers import cached_table
from metaeval.sources.inventory import probe_readable
from metaeval.sources.text_files import scan_manifests


@dataclass(frozen=True)
class PrepareOptions:
    """How rows are cleaned, prompted and encoded."""

    instruction: str = "Transcribe this audio"
    path_column: str = "path"
    text_column: str = "sentence"
    chars_to_ignore: tuple | None = None
    lower: bool = True
    use_row_instruction: bool = True
    language_in_prompt: bool = True
    chatml: bool = True
    indicate_audio: bool = False
    label_all: bool = False
    training: bool = False
    from_file: bool = True


def prepare_rows(rows: DataFrame, options: PrepareOptions = PrepareOptions(),
                 languages: DataFrame | None = None) -> DataFrame:
    """Add ``target_text``, ``prompt_prefix`` and ``prompt_tail``; all columns stay.

    Row by row without shuffle, so it serves batches and streams.
    """
    instruction = F.col("inst") if options.use_row_instruction else F.lit(options.instruction)
    language = None
    if options.language_in_prompt:
        if "lang" not in rows.columns:
            raise ValueError("the prompt names the language, but there is no column lang")
        rows = with_language_name(rows, languages)
        language = F.col("lang_name")
    suffix = F.col("suffix") if "suffix" in rows.columns else None
    return rows.withColumns({
        "target_text": target_text(F.col(options.text_column),
                                   char_class(options.chars_to_ignore), options.lower),
        "prompt_prefix": prompt_prefix(instruction, language, options.chatml,
                                       options.indicate_audio),
        "prompt_tail": prompt_tail(suffix, options.chatml),
    })


def encode_rows(rows: DataFrame, vocabulary: DataFrame, options: PrepareOptions = PrepareOptions(),
                key=None) -> DataFrame:
    """Add the six encoded columns to prepared rows.

    ``key`` names the columns that tell rows apart: by default the position, with
    the split where rows have one.
    """
    key = key or (["split", "pos"] if "split" in rows.columns else ["pos"])
    segments = {"_prefix_ids": F.col("prompt_prefix")}
    if "suffix" in rows.columns:
        segments["_suffix_ids"] = F.col("suffix")
    if options.training:
        segments["_response_ids"] = F.col("target_text")
    ids = encode(rows, key, segments, vocabulary)
    encoded = assemble(
        ids, vocabulary, "_prefix_ids",
        "_suffix_ids" if "_suffix_ids" in segments else None,
        "_response_ids" if options.training else None, options.chatml, options.label_all,
    ).drop(*segments)
    return rows.join(encoded, key)


def prompt_vocabulary(rows: DataFrame, options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """The vocabulary of the prepared texts."""
    texts = F.array("prompt_prefix", "prompt_tail", "target_text")
    return build_vocabulary(rows.select(F.explode(texts).alias("text")), "text")


def preprocess(rows: DataFrame, vocabulary: DataFrame | None = None,
               options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Prepared and encoded rows whose audio can be read; raises if none is left."""
    if not options.from_file:
        flagged = rows.withColumn("is_readable", F.lit(True))
    elif "is_readable" in rows.columns:
        flagged = rows
    else:
        flagged = probe_readable(rows, options.path_column)
    prepared = prepare_rows(require_rows(readable_rows(flagged), "no readable audio"), options)
    if vocabulary is None:
        vocabulary = prompt_vocabulary(prepared, options)
    return encode_rows(prepared, vocabulary, options)


def load_manifests(spark: SparkSession, root: str, manifest_files: str,
                   options: PrepareOptions = PrepareOptions(), tokenizer: str = "whitespace",
                   vocabulary: DataFrame | None = None, reuse: bool = True) -> DataFrame:
    """Encoded rows of local manifests, kept below ``root`` and reused as long as the manifests stay as they are."""
    wanted = char_class(options.chars_to_ignore)
    others = "-".join([f"{k}={v}" for k, v in sorted(asdict(options).items())] + [manifest_files])
    if vocabulary is not None:
        entries, digest = vocabulary.agg(F.count(F.lit(1)), F.sum(F.xxhash64("token", "id").cast("decimal(38,0)"))).first()
        others += f"-vocabulary={entries}:{digest}"
    key = spark.range(1).select(cache_key(
        F.lit(manifest_files), tokenizer, options.lower, F.lit(wanted),
        F.substring(F.sha2(F.lit(others), 256), 1, 12))).first()[0]

    def build() -> DataFrame:
        return preprocess(scan_manifests(spark, root, manifest_files), vocabulary, options)

    if not options.from_file:
        return build()
    paths = [f"{root.rstrip('/')}/{name}" for name in manifest_files.split(",")]
    inputs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    return cached_table(spark, root, key.replace(",", "_"), build, reuse, inputs)


def load_split(table: DataFrame, split: str, base_path: str | None = None, head: int = -1,
               options: PrepareOptions = PrepareOptions(), vocabulary: DataFrame | None = None
               ) -> DataFrame:
    """Encoded rows of a split expression over a dataset table."""
    rows = select_split(table, split)
    rows = rows.withColumn("path", prefix_path(base_path, F.col("path")))
    return preprocess(head_rows(rows, head), vocabulary, options)
