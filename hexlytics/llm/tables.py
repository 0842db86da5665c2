"""Reading the tables, and small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    trimmed = F.regexp_replace(text, rf"^{GAP}|{GAP}\z", "")
    return F.coalesce(
        F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, GAP))), F.lit(0)
    ).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def source_key(source: Column) -> Column:
    """Never null, joins by equality, sorts by code point with the null source last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 32 << 20
          ) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and about ``most`` bytes, or one larger row: texts become
    Python strings a part at a time."""
    for batch in batches:
        parts = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def text_parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20
               ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the UTF-8 bytes of their texts in one array, and where each text ends in it.

    Parts have about ``most`` bytes, or one longer text; a null text has no bytes. The bytes are
    Arrow's own, not a copy.
    """
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
            texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield (batch.slice(low, high - low), held[at[low]:at[high]], at[low + 1:high + 1] - at[low])
            low = high


def map_columns(df: DataFrame, inputs: list[str], make: Callable[..., list], added: str
                ) -> DataFrame:
    """All columns of ``df`` plus those of the schema ``added``, in one pass over each partition.

    ``make`` gets the input columns of a batch as lists of Python values (null: None) and returns
    one sequence per added column. A column of ``df`` with the name of an added one is replaced.
    """
    new = StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in new.names]
    types = [to_arrow_type(f.dataType) for f in new.fields]
    out = StructType([df.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = make(*[batch.column(c).to_pylist() for c in inputs])
            arrays = [pa.array(v, t) for v, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + arrays, names=kept + new.names)

    return df.mapInArrow(run, out)
