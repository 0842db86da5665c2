"""Raw text rows to typed, dated, bounded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hexlytics import constants as K
from hexlytics.operators import cleaning as C


def typed(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Standard names, known columns and those to carry, declared types, parsed time. No row is
    dropped."""
    named = C.standard_names(raw)
    named = named.select(*C.known_columns(named).columns, *carry)
    return C.with_datetime(C.standard_types(named))


def bronze(raw: DataFrame) -> DataFrame:
    """Rows with a time and a coordinate inside the box, with year and month to partition by."""
    return kept(typed(raw))


def kept(typed: DataFrame) -> DataFrame:
    dated = C.with_partition_values(typed.where(C.has_datetime()))
    if "latitude" in dated.columns and "longitude" in dated.columns:
        dated = dated.where(C.in_box(K.BRONZE_BOX))
    return dated
