"""Raw CSV files and the list of months still to be loaded."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hexlytics import schemas as S
from hexlytics.session import open_writers


# Quotes are doubled and blanks kept, in both directions.
CSV = {
    "header": True, "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

# Folder names are no columns here; folders of several roots may be nested as they like.
FILES = {"recursiveFileLookup": True}

OPEN_FILES = 32  # at a time, for their headers


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def header_columns(line: str) -> list[str]:
    """Column names of a header line; nameless and repeated ones get names of their own."""
    names: list[str] = []
    for k, name in enumerate(next(csv.reader([line.removeprefix("﻿")]), [])):
        name = name or f"_c{k}"
        names.append(name if name not in names else f"{name}_{k}")
    return names


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of one file, compressed or not; the rest is not read. None if it is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        plain = stream if codec is None else codec.createInputStream(stream)
        reader = jvm.java.io.InputStreamReader(plain, jvm.java.nio.charset.StandardCharsets.UTF_8)
        return jvm.java.io.BufferedReader(reader).readLine()
    finally:
        stream.close()


def _classes(thing) -> list[str]:
    """Names of a Java object's class and of those above it."""
    kind, names = thing.getClass(), []
    while kind is not None:
        names.append(kind.getName())
        kind = kind.getSuperclass()
    return names


def _by_header(spark: SparkSession, paths: Sequence[str], lenient: bool
               ) -> list[tuple[list[str], list[str]]]:
    """(columns, files) of each distinct header line.

    Any Spark stage over the lines would read all of them, so the driver, which lists the files
    anyway, opens each for a buffer, several at a time.
    """
    def header(path: str) -> str | None:
        try:
            return _first_line(spark, path)
        except Py4JJavaError as error:
            if not lenient or "java.io.IOException" not in _classes(error.java_exception):
                raise
            return None

    listed = spark.read.format("binaryFile").options(**FILES).load(list(paths)).select("path")
    files = sorted(r["path"] for r in listed.distinct().collect())
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        for path, line in zip(files, pool.map(header, files)):
            if line is not None:
                groups.setdefault(line, []).append(path)
    return [(header_columns(line), groups[line]) for line in sorted(groups)]


def read_by_header(spark: SparkSession, paths: str | Iterable[str], lenient: bool = False,
                   file: str | None = None) -> DataFrame | None:
    """Text columns of CSV files, matched by the names in each file's header.

    Files of one header are read by one plan, however many there are; a column that a file
    lacks is null. Empty files add nothing. Lenient: absent paths and corrupt files are
    skipped. ``file``: a further column for each row's file. None when no file has a line. Runs a
    small job when called (the headers).
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    if lenient:
        given = [p for p in given if _exists(spark, p)]
    groups = _by_header(spark, given, lenient) if given else []
    parts = []
    for columns, files in groups:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = spark.read.schema(schema).options(**CSV, **FILES).option(
            "ignoreCorruptFiles", lenient)
        # With one header for all, the paths as given spare a second listing.
        path = [F.col("_metadata.file_path").alias(file)] if file else []
        parts.append(reader.csv(given if len(groups) == 1 else files).select(
            *[F.col(f"`{c}`") for c in columns], *path))
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_raw(spark: SparkSession, paths: str | Sequence[str], file: str | None = None) -> DataFrame:
    """Yearly files as text columns; types come later, so nothing is lost on read. ``file``: a
    further column for each row's file.

    Columns are found by header name: order is free, absent ones are null, others left out.
    """
    rows = read_by_header(spark, paths, file=file)
    names = [*S.RAW_SCHEMA.names, *([file] if file else [])]
    if rows is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return rows.select(*[
        F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])


def read_monthly_raw(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Monthly files with all their columns, matched by header name; absent and unreadable
    files are skipped."""
    rows = read_by_header(spark, paths, lenient=True)
    if rows is None:
        raise ValueError("no monthly file could be read")
    return rows


def write_raw_by_year(df: DataFrame, path: str, year: str = "year") -> None:
    """Consolidate to one folder per year. The rows are wide text, so they are neither shuffled nor
    sorted: each task has a file of its own in the years it holds."""
    with open_writers(df.sparkSession):
        (
            df.withColumn("file_year", F.col(year))
            .write.mode("overwrite").options(**CSV).partitionBy("file_year").csv(path)
        )


def normalize_months(months: int | str | Iterable[int]) -> tuple[int, ...]:
    """A month or many, as a sorted tuple of ints."""
    if isinstance(months, (int, str, bytes)):
        return (int(months),)
    return tuple(sorted(int(m) for m in months))


def month_work_list(spans: DataFrame, first: str, last: str) -> DataFrame:
    """Months from ``first`` to ``last`` (date columns of a one-row frame) with half-open
    bounds ``starts``, ``ends``."""
    starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return spans.select(F.explode(starts).alias("starts")).select(
        F.year("starts").alias("year"), F.month("starts").alias("month"),
        F.to_date("starts").alias("starts"), F.add_months("starts", 1).alias("ends"),
    )


def pending_months(work: DataFrame, done_months: DataFrame, done_years: DataFrame | None = None
                   ) -> DataFrame:
    """Months not in the manifest of finished months, nor in a finished year."""
    out = work.join(done_months.select("year", "month"), ["year", "month"], "left_anti")
    if done_years is not None:
        out = out.join(done_years.select("year"), "year", "left_anti")
    return out
