"""Ingest of zip archives as a distributed job: an archive is unzipped once, in one task."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.session import cut_lineage, release

_RECORDS_PER_BATCH = 20_000
_LONGEST_FIELD = 1 << 30
_SCHEMA = "source_archive_id string, member string, header array<string>, fields array<string>"


class _MemberRecords:
    """Streams the records of the required members of each archive in bounded batches."""

    def __init__(self, members: Sequence[str], separator: str) -> None:
        self.members = tuple(members)
        self.separator = separator

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                archive_id = path.rsplit("/", 1)[-1].removesuffix(".zip")
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member, full_name in self._resolve(archive, path).items():
                        yield from self._records(archive, archive_id, member, full_name)

    def _resolve(self, archive: zipfile.ZipFile, path: str) -> dict[str, str]:
        by_name: dict[str, list[str]] = {}
        for info in archive.infolist():
            if not info.is_dir():
                by_name.setdefault(info.filename.rsplit("/", 1)[-1], []).append(info.filename)
        counts = {m: len(by_name.get(m, [])) for m in self.members}
        if any(n != 1 for n in counts.values()):
            raise RuntimeError(f"{path}: required members must occur once, found {counts}")
        return {m: by_name[m][0] for m in self.members}

    def _records(self, archive: zipfile.ZipFile, archive_id: str, member: str, full_name: str) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(_LONGEST_FIELD)
        with io.TextIOWrapper(archive.open(full_name), encoding="utf-8-sig", newline="") as text:
            reader = csv.reader(text, delimiter=self.separator)
            header = [name.strip() for name in next(reader, [])]
            held: list[list[str]] = []

            def frame() -> pd.DataFrame:
                return pd.DataFrame(
                    {"source_archive_id": archive_id, "member": member, "header": [header] * len(held), "fields": held}
                )

            for record in reader:
                if not record:  # an empty line
                    continue
                held.append(record)
                if len(held) == _RECORDS_PER_BATCH:
                    yield frame()
                    held = []
            if held:
                yield frame()


def read_archives(spark: SparkSession, path: str, members: Sequence[str], separator: str = "\t") -> DataFrame:
    """Records of the required members of every archive below ``path`` (see ``archive_records``)."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return archive_records(archives.select("path", "content"), members, separator)


def archive_records(archives: DataFrame, members: Sequence[str], separator: str = "\t") -> DataFrame:
    """(source_archive_id, member, header, fields) of the required members of archives (path, content).

    A zip member cannot be split, so an archive is the unit of parallelism (at most 2 GB, the limit
    of a binary value); its records leave the task in bounded batches. Quoted fields may hold
    separators, quotes and line breaks. A missing or repeated member fails the job.
    """
    return archives.select("path", "content").mapInPandas(_MemberRecords(members, separator), _SCHEMA)


def member_table(records: DataFrame, member: str, columns: Sequence[str]) -> DataFrame:
    """One member as a table of strings, columns found by each archive's own header.

    The empty field is null; a column an archive does not have is null for that archive.
    """
    rows = records.where(F.col("member") == member)
    picked = []
    for name in columns:
        position = F.array_position("header", name)
        value = F.when(position > 0, F.try_element_at("fields", position.cast("int")))
        picked.append(F.when(value != "", value).alias(name))
    return rows.select("source_archive_id", *picked)


def land_archives(
    spark: SparkSession, path: str, tables: dict[str, Sequence[str]], output: str, separator: str = "\t"
) -> None:
    """Write each member as a Parquet table partitioned by archive; every archive is unzipped once."""
    records = cut_lineage(read_archives(spark, path, list(tables), separator))
    for member, columns in tables.items():
        name = member.rsplit(".", 1)[0].lower()
        member_table(records, member, columns).write.mode("errorifexists").partitionBy("source_archive_id").parquet(
            f"{output}/{name}"
        )
    release(records)
