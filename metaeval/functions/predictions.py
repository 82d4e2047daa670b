"""Turning prediction text into numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The decimal grammar of a text that counts as a number.
_DIGITS = "[0-9](?:_?[0-9])*"
FLOAT_PATTERN = (
    r"(?i)\A[ \t\n\r\f\x0B\x1C-\x1F]*[+-]?(?:(?:" + _DIGITS + r"\.?(?:" + _DIGITS + r")?|\."
    + _DIGITS + r")(?:e[+-]?" + _DIGITS + r")?|inf|infinity|nan)[ \t\n\r\f\x0B\x1C-\x1F]*\z"
)
EDGE_SPACE = r"\A[ \t\n\r\f\x0B\x1C-\x1F]+|[ \t\n\r\f\x0B\x1C-\x1F]+\z"
ALL_DIGITS = r"\A[0-9]+\z"
PLAIN_DECIMAL = r"\A(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"
FIRST_PERCENT = r"\A([^%]*)%"
# A quotient from this size on prints with an exponent and then counts as zero.
EXPONENT_FROM = 1e16


def is_number(text: Column) -> Column:
    """Whether the text is a decimal number; a missing text is not."""
    return F.coalesce(text.rlike(FLOAT_PATTERN), F.lit(False))


def plain_value(text: Column) -> Column:
    """The number the text holds, NULL if it holds none."""
    bare = F.replace(F.regexp_replace(text, EDGE_SPACE, ""), F.lit("_"), F.lit(""))
    return F.when(is_number(text), bare.try_cast("double"))


def repaired_value(text: Column) -> Column:
    """The number under the repair rules for runs with malformed rows.

    One ``%`` is dropped; if digits alone remain they count as a percentage, so
    a bare whole number does too. Other texts count if, without outer space,
    they are an unsigned decimal. Everything else is zero.
    """
    without = F.regexp_replace(text, FIRST_PERCENT, "$1")
    percent = without.try_cast("double") / F.lit(100.0)
    percent = F.when(percent < F.lit(EXPONENT_FROM), percent).otherwise(F.lit(0.0))
    stripped = F.regexp_replace(text, EDGE_SPACE, "")
    decimal = F.when(stripped.rlike(PLAIN_DECIMAL), stripped.try_cast("double"))
    repaired = F.when(without.rlike(ALL_DIGITS), percent).otherwise(decimal)
    return F.coalesce(repaired, F.lit(0.0))
