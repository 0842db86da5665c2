"""Bronze rows to features: fills, category, calendar, cyclic codes, street, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hexlytics import constants as K, schemas as S
from hexlytics.functions import features as X, lattice as L
from hexlytics.operators import cleaning as C

CELL_FALLBACKS = ["h3", "h3_index", "h3id", "h3_r10", "h3_r9"]


def with_category(df: DataFrame) -> DataFrame:
    if "primary_type" not in df.columns and "crime_type" in df.columns:
        df = df.withColumn("primary_type", F.col("crime_type"))
    if "primary_type" not in df.columns:
        return df.withColumn("crime_category", F.lit(K.UNCLASSIFIED))
    return df.withColumn("crime_category", X.category_of(F.col("primary_type")))


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(X.calendar_parts()).withColumns(X.cyclic_parts())


def with_street(df: DataFrame) -> DataFrame:
    if "block_address" not in df.columns and "block" in df.columns:
        df = df.withColumn("block_address", F.col("block"))
    if "block_address" not in df.columns:
        return df.withColumn("street_norm", F.lit(K.UNKNOWN))
    return df.withColumn("street_norm", X.street_name(F.col("block_address")))


def canonical(df: DataFrame, res: int = 9) -> DataFrame:
    """Types a stored feature table must have, whatever the input frame looks like."""
    if "datetime" in df.columns:
        parts = X.calendar_parts()
        df = df.withColumns({k: parts[k] for k in ("date", "year", "month", "day_of_week", "hour")})
    cell = f"h3_r{res}"
    if cell not in df.columns:
        source = S.first_present(df, CELL_FALLBACKS)
        df = df.withColumn(cell, F.col(source) if source else F.lit(None).cast("string"))
    if "street_norm" not in df.columns:
        df = df.withColumn("street_norm", F.lit(None).cast("string"))
    kinds = {c: "double" for c in df.columns if c.endswith(("_sin", "_cos"))}
    kinds |= {c: "boolean" for c in ("is_weekend", "arrest_made", "is_domestic")}
    kinds |= {c: "bigint" for c in [*K.ID_FILL_COLUMNS, "incident_year"]}
    kinds |= {c: "string" for c in (cell, "street_norm", "crime_category")}
    return df.withColumns(
        {
            c: F.col(c).cast(kind) if kind == "string" else F.col(c).cast("string").try_cast(kind)
            for c, kind in kinds.items()
            if c in df.columns and dict(df.dtypes)[c] != kind
        }
    )


def silver(bronze: DataFrame) -> DataFrame:
    """One plan over all months. The only shuffle is the small mode table of the id fill."""
    if "datetime" not in bronze.columns:
        bronze = C.with_datetime(bronze)
    if "year" not in bronze.columns:
        bronze = C.with_partition_values(bronze)
    filled = C.fill_ids(C.fill_text(C.drop_incomplete(bronze)))
    featured = with_street(with_calendar(with_category(filled)))
    return S.conform(L.assign_cells(featured), S.SILVER_SCHEMA)
