"""Text cleaning, prompt assembly, hash buckets and cache keys as Column expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, functions as F

# The two prompt templates.
CHATML_USER = "<|im_start|>user\n"
CHATML_ASSISTANT = "<|im_end|>\n<|im_start|>assistant\n"
PLAIN_USER = "###[Human]: "
PLAIN_ASSISTANT = "\n\n\n###[Assistant]:"

# Default range of the hash bucket.
BUCKET_MIN = 0
BUCKET_MAX = 1_000_000


def char_class(chars) -> str | None:
    """The regular expression removing any of ``chars``; ``None`` switches it off.

    The characters keep their meaning inside a class (``-``, ``^``, ``]``). Only
    ``[`` and ``&`` are escaped, which Java reads as nested sets otherwise.
    """
    if chars is None:
        return None
    return java_class("[" + "".join(chars) + "]")


def java_class(pattern: str) -> str:
    """Escape what Java alone treats as special in the class ``pattern`` starts with."""
    if not pattern.startswith("["):
        return pattern
    out, escaped = ["["], False
    for ch in pattern[1:]:
        out.append("\\" + ch if ch in "[&" and not escaped else ch)
        escaped = ch == "\\" and not escaped
    return "".join(out)


def normalize(text: Column, remove: str | None = None, lower: bool = True) -> Column:
    """Remove the characters matching ``remove``, then lowercase."""
    if remove is not None:
        text = F.regexp_replace(text, F.lit(java_class(remove)), F.lit(""))
    return F.lower(text) if lower else text


def target_text(text: Column, remove: str | None = None, lower: bool = True) -> Column:
    """The response text: a missing one reads ``None``; one space ends it."""
    known = F.coalesce(text.cast("string"), F.lit("None"))
    return F.concat(normalize(known, remove, lower), F.lit(" "))


def prompt_prefix(instruction: Column, language: Column | None = None, chatml: bool = False,
                  indicate_audio: bool = True) -> Column:
    """The text before the speech; ``language`` is a display name or ``None``.

    A missing instruction reads ``None``. A row without a language raises.
    """
    user = F.lit(CHATML_USER if chatml else PLAIN_USER)
    instruction = F.coalesce(instruction, F.lit("None"))
    if language is None:
        return F.concat(user, instruction, F.lit(" "))
    mark = " audio: " if indicate_audio else ": "
    language = F.coalesce(language, F.raise_error(F.lit("a row has no language")).cast("string"))
    return F.concat(user, instruction, F.lit("\n"), language, F.lit(mark))


def assistant_tail(chatml: bool = False) -> str:
    """The fixed text that opens the answer."""
    return CHATML_ASSISTANT if chatml else PLAIN_ASSISTANT


def prompt_tail(suffix: Column | None = None, chatml: bool = False) -> Column:
    """The text after the speech: the row's suffix, if any, and the answer opening."""
    tail = F.lit(assistant_tail(chatml))
    if suffix is None:
        return tail
    return F.concat(F.coalesce(suffix, F.lit("")), tail)


def hash_bucket(text: Column, low: int = BUCKET_MIN, high: int = BUCKET_MAX) -> Column:
    """``low`` + SHA-256 of the text modulo the range size, as a BIGINT.

    The 256-bit number is folded in eight 32-bit digits, each step reduced by
    the modulus; that stays inside a BIGINT while the range is below 2^31.
    """
    size = high - low + 1
    if not 0 < size < 2**31:
        raise ValueError("the range must hold between 1 and 2^31 - 1 values")
    digest = F.sha2(text.cast("binary"), 256)
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"),
    )
    folded = F.aggregate(
        digits, F.lit(0).cast("bigint"),
        lambda acc, digit: F.pmod(acc * F.lit(2**32) + digit, F.lit(size).cast("bigint")),
    )
    return F.when(text.isNotNull(), folded + F.lit(low).cast("bigint"))


def bucket_label(text: Column, low: int = BUCKET_MIN, high: int = BUCKET_MAX) -> Column:
    """The hash bucket as text; a missing input reads ``None``."""
    return F.coalesce(hash_bucket(text, low, high).cast("string"), F.lit("None"))


def cache_key(manifest: Column, tokenizer: str, lower: bool, remove: Column,
              extra: Column | None = None) -> Column:
    """The name under which a prepared table is kept.

    ``remove`` is the character class as the user wrote it. ``extra`` widens the
    key by any other option that changes the prepared rows.
    """
    head = F.lit(f"processed_tok{posixpath.basename(tokenizer)}_lower{lower}_regex")
    name = F.concat(head, bucket_label(remove), F.lit("_"), manifest)
    for old, new in ((".tsv", ""), (".json", ""), ("*", "all")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return name if extra is None else F.concat(name, F.lit("_"), extra)


def decoded_path(path: Column) -> Column:
    """A file address as written, from the percent-encoded form of ``_metadata.file_path``."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_safe(name: Column) -> Column:
    """A model or dataset name as it appears in file names."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def prefix_path(base: Column | str | None, path: Column) -> Column:
    """``path`` below ``base``; an absolute path stands, no slash is doubled."""
    if base is None:
        return path
    base = F.lit(base) if isinstance(base, str) else base
    joint = F.when((base == "") | base.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.when(path.startswith("/"), path).otherwise(F.concat(base, joint, path))
