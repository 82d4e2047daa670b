"""All queries of this package."""

from metaeval.llm import arc_to_warc, byte_bpe, chat_format, decontamination, hard_negatives, language_model, line_crf, line_dedup, ngram_join, quality_rules, source_divergence, suffix_dedup, toxicity_gru  # noqa: F401
from metaeval.llm.registry import ORACLE, QUERIES  # noqa: F401
