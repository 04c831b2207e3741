"""The whole way from raw tickets to a split table: column gate, cleaning, context, features, texts, split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opsloom.operators.clean import clean, require_columns
from opsloom.operators.features import engineer, enrich
from opsloom.operators.search import exclude_cancelled
from opsloom.operators.split import assert_no_leakage, split
from opsloom.operators.text import add_clean_text
from opsloom.session import materialize


def prepare(raw: DataFrame, side: DataFrame | None = None, side_key: str = "cmdb_ci", strategy: str = "random", strict: bool = False) -> DataFrame:
    """Tickets cleaned, joined to their context table where there is one, with features and normalised texts, tagged with their split.

    A table without a required column is refused before anything is read. Cancelled tickets leave before the split. The
    cleaned table is stored once and read by what follows; a ticket that got into two splits fails the job.
    """
    cleaned = clean(exclude_cancelled(require_columns(raw)), strict)
    ready = enrich(cleaned, side, side_key).transform(engineer).transform(add_clean_text)
    return assert_no_leakage(split(materialize(ready, "prepared"), strategy))
