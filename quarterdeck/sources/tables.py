"""Readers and writers for landed tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_columns(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], separator: str = "\t"
) -> DataFrame:
    """Delimited text with a header; every column a string and only the empty field null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema).option("sep", separator).option("header", True)
        .option("nullValue", "").option("emptyValue", "").option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_typed_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a declared type per column; a value that does not parse fails the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_tagged_parquet(
    spark: SparkSession, sources: Mapping[str, str], columns: Sequence[str] | None = None,
    tag: str = "source_archive_id",
) -> DataFrame:
    """Several Parquet tables of one schema as one, each row tagged with the source it came from.

    ``sources`` maps a tag to a path. All paths are one scan; a row's tag follows from the path of
    its file, the longest path first where one lies below another.
    """
    frame = spark.read.parquet(*sources.values())
    tagged = None
    for name, path in sorted(sources.items(), key=lambda s: len(s[1]), reverse=True):
        bare = re.sub(r"^[a-z0-9+.-]+:/+[^/]*(?=/)|^file:", "", path).rstrip("/")
        inside = F.lit(False)
        for form in {bare, quote(bare, safe="/=")}:
            inside = inside | F.contains(F.col("_metadata.file_path"), F.lit(f"{form}/")) | F.endswith(F.col("_metadata.file_path"), F.lit(form))
        tagged = F.when(inside, name) if tagged is None else tagged.when(inside, name)
    return frame.select(*(columns or frame.columns), tagged.alias(tag))


def read_factor_text(spark: SparkSession, path: str, columns: Sequence[str], pattern: str = "yyyyMMdd") -> DataFrame:
    """Factor file with a preamble: only lines whose first field is a date are data."""
    fields = F.split(F.col("value"), ",")
    day = F.try_to_date(F.trim(fields[0]), pattern)
    rows = spark.read.text(path).where(F.trim(fields[0]).rlike(r"^\d{8}$")).select(
        day.alias("date"),
        *[F.trim(fields[i]).cast("double").alias(c) for i, c in enumerate(columns, start=1)],
    )
    return rows.where(F.col("date").isNotNull())


def combine_factors(
    first: DataFrame, second: DataFrame, start: str, end: str, percent: Sequence[str]
) -> DataFrame:
    """Two factor tables on common dates inside a range, percentages turned into fractions."""
    joined = first.join(second, "date").where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return joined.withColumns({c: F.col(c) / 100 for c in percent})


def write_sorted(
    frame: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = (),
    compression: str = "zstd", mode: str = "errorifexists",
) -> None:
    """Parquet in a total order: range-partitioned by the sort key, sorted inside each file.

    With ``partition_by`` all quarters are written in one job into their own folders.
    """
    ranged = frame.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*partition_by, *order)
    writer = ranged.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_small_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A result table of report size as one CSV part with a header."""
    frame.repartition(1).write.mode(mode).option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each landed file, named by its place below the folder (at most 2 GB each)."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.substring_index("path", f"/{root}/", -1).alias("file_name"), "length", F.sha2("content", 256).alias("digest")
    )


def manifest_differences(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against a manifest (file_name, digest)."""
    recorded = manifest.select("file_name", F.col("digest").alias("recorded"))
    joined = digests.select("file_name", F.col("digest").alias("found")).join(recorded, "file_name", "full")
    state: Column = (
        F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "unexpected")
        .when(F.col("found") != F.col("recorded"), "changed")
    )
    return joined.withColumn("state", state).where(F.col("state").isNotNull())
