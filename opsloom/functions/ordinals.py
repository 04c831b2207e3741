"""Parsers that turn mixed text and numbers into bounded ordinals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keyword -> level, default and bounds. A later keyword wins over an earlier one.
PRIORITY_WORDS = {"critical": 1, "high": 2, "moderate": 3, "medium": 3, "low": 4, "planning": 5}
IMPACT_WORDS = {"critical": 1, "high": 1, "medium": 2, "low": 3}
URGENCY_WORDS = {"critical": 1, "high": 1, "sev 1": 1, "medium": 2, "sev 2": 2, "low": 3, "sev 3": 3}
ORDINAL_RULES = {
    "priority": (PRIORITY_WORDS, 3, 1, 5),
    "business_impact": (IMPACT_WORDS, 2, 1, 3),
    "urgency": (URGENCY_WORDS, 2, 1, 3),
}

WHITE_SPACE = " \t\n\r\x0b\x0c"


def parse_ordinal(raw: Column, words: dict[str, int], default: int, numeric: bool = False) -> Column:
    """Level of a label: a keyword beats leading digits, digits beat the default; numbers pass through."""
    if numeric:
        return F.coalesce(raw, F.lit(default))
    text = F.lower(trim_ws(raw))
    by_word = [F.when(text.contains(w), F.lit(v)) for w, v in reversed(words.items())]
    digits = F.nullif(F.regexp_extract(text, r"^(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(*by_word, digits, F.lit(default))


def clip(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def apply_rule(column: str, raw: Column, numeric: bool = False) -> Column:
    words, default, low, high = ORDINAL_RULES[column]
    return clip(parse_ordinal(raw, words, default, numeric), low, high)


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space; a character set is far cheaper than a pattern on long texts."""
    return F.trim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_ws(c) == "")


def to_bool(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isin("True", "true", "1"), F.lit(True)).when(text.isin("False", "false", "0"), F.lit(False))
