"""Left join against a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Left join ``df`` to ``lookup``, which has one row per key and is never multiplied.

    Spark broadcasts the lookup when it measures it as small. Beyond that both sides are shuffled once and adaptive
    execution splits the partition of a hot key, repeating only that partition of the lookup.
    """
    return df.join(lookup, on, "left")
