"""Table contracts and data-quality audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.functions.aggregates import count_where


class ContractError(ValueError):
    """A table does not satisfy its declared contract."""


def require_columns(frame: DataFrame, required: Sequence[str], name: str = "input") -> DataFrame:
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ContractError(f"{name} lacks columns {missing}")
    return frame


def require_exact_columns(frame: DataFrame, expected: Sequence[str], name: str = "output") -> DataFrame:
    if list(frame.columns) != list(expected):
        raise ContractError(f"{name} has columns {frame.columns}, expected {list(expected)}")
    return frame


def key_audit(
    frame: DataFrame, key: Sequence[str], violations: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows, rows with a null key part, distinct full keys, repeated rows, and rule violations.

    Rows are first combined per key, so the distinct count is an ordinary grouped count.
    """
    violations = dict(violations or {})
    complete = F.lit(True)
    for part in key:
        complete = complete & F.col(part).isNotNull()
    per_key = frame.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[count_where(F.coalesce(rule, F.lit(False))).alias(f"_bad_{n}") for n, rule in violations.items()],
    )
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~complete, F.col("_rows"))), F.lit(0)).alias("null_key_rows"),
        count_where(complete).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(complete, F.col("_rows") - 1)), F.lit(0)).alias("duplicate_rows"),
        *[F.coalesce(F.sum(f"_bad_{n}"), F.lit(0)).alias(n) for n in violations],
    )


def enforce_contract(
    frame: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    violations: Mapping[str, Column] | None = None,
    name: str = "output",
) -> DataFrame:
    """Raise unless the table has exactly these columns, is not empty, has a unique key and
    no row breaks a rule; returns the frame unchanged."""
    require_exact_columns(frame, columns, name)
    found = key_audit(frame, key, violations).first().asDict()
    rows = found.pop("rows")
    found.pop("distinct_keys")
    if rows == 0:
        raise ContractError(f"{name} is empty")
    broken = {rule: count for rule, count in found.items() if count}
    if broken:
        raise ContractError(f"{name} breaks its contract: {broken}")
    return frame


def duplicate_audit(frame: DataFrame, candidate_key: Sequence[str]) -> DataFrame:
    """Rows beyond the first per candidate key, against rows beyond the first per exact row."""
    exact = frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias("_copies"))
    per_key = exact.groupBy(*candidate_key).agg(
        F.sum("_copies").alias("_rows"), F.count(F.lit(1)).alias("_variants")
    )
    return per_key.agg(
        F.sum("_rows").alias("rows"),
        F.count(F.lit(1)).alias("distinct_candidate_keys"),
        F.sum(F.col("_rows") - 1).alias("candidate_key_repeats"),
        F.sum(F.col("_rows") - F.col("_variants")).alias("exact_row_repeats"),
    )


def null_counts(frame: DataFrame, required: Sequence[str]) -> DataFrame:
    """Null count of each required field, one row per field."""
    counts = frame.agg(
        F.count(F.lit(1)).alias("_rows"), *[count_where(F.col(c).isNull()).alias(c) for c in required]
    )
    return counts.unpivot(["_rows"], list(required), "field", "null_rows").select(
        "field", F.col("_rows").alias("rows"), "null_rows"
    )


def rule_counts(frame: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Rows that meet each rule, one row per rule (and group)."""
    keys = list(keys)
    aggregates = [count_where(F.coalesce(rule, F.lit(False))).alias(n) for n, rule in rules.items()]
    counts = frame.groupBy(*keys).agg(*aggregates) if keys else frame.agg(*aggregates)
    return counts.unpivot(keys, list(rules), "rule", "rows")


def inventory(tables: Mapping[str, tuple[DataFrame, str | None, str]]) -> DataFrame:
    """Rows, identifiers, dates, first and last day of each table.

    ``tables`` maps a name to (frame, identifier column or None, date column).
    """
    result = None
    for name, (frame, entity, day) in tables.items():
        ids = F.count_distinct(entity) if entity else F.lit(None).cast("bigint")
        row = frame.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("rows"),
            ids.alias("identifiers"),
            F.count_distinct(day).alias("dates"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
        )
        result = row if result is None else result.unionByName(row)
    return result


def attrition_violations(
    frame: DataFrame, keys: Sequence[str], stage_order: str, measures: Sequence[str]
) -> DataFrame:
    """Stages whose measure exceeds that of the stage before, counted per measure."""
    from pyspark.sql.window import Window

    path = Window.partitionBy(*keys).orderBy(stage_order)
    steps = frame.select(
        *[(F.col(m) > F.lag(m).over(path)).alias(f"{m}_increases") for m in measures]
    )
    return steps.agg(
        F.count(F.lit(1)).alias("stages"),
        *[count_where(F.col(f"{m}_increases")).alias(f"{m}_increases") for m in measures],
    )


def stage_retention(
    frame: DataFrame, keys: Sequence[str], stage_order: str, measure: str
) -> DataFrame:
    """Each stage relative to the first and to the previous stage of its group."""
    from pyspark.sql.window import Window

    path = Window.partitionBy(*keys).orderBy(stage_order)
    first = F.first(measure).over(path.rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumns(
        {
            "share_of_first": F.col(measure) / F.nullif(first, F.lit(0)),
            "share_of_previous": F.col(measure) / F.nullif(F.lag(measure).over(path), F.lit(0)),
        }
    )


def schema_signatures(schemas: Mapping[tuple[str, str], Sequence[str]], spark: SparkSession) -> DataFrame:
    """Declared (source, table) schemas as rows of ordered column names."""
    rows = [(source, table, list(columns)) for (source, table), columns in schemas.items()]
    return spark.createDataFrame(rows, "source string, table_name string, columns array<string>")


def schema_drift(signatures: DataFrame, source: str = "source", table: str = "table_name") -> DataFrame:
    """Distinct ordered signatures per table, with columns not shared by every source."""
    exploded = signatures.select(table, source, F.explode("columns").alias("column_name"))
    sources = signatures.groupBy(table).agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_distinct(F.array_join("columns", ",")).alias("distinct_signatures"),
    )
    per_column = exploded.groupBy(table, "column_name").agg(F.count(F.lit(1)).alias("_in"))
    partial = (
        per_column.join(sources, table)
        .where(F.col("_in") < F.col("sources"))
        .groupBy(table)
        .agg(F.array_sort(F.collect_list("column_name")).alias("partial_columns"))
    )
    return sources.join(partial, table, "left").withColumn(
        "partial_columns", F.coalesce("partial_columns", F.array().cast("array<string>"))
    )


def universe_fingerprint(frame: DataFrame, entity: str, digits: int = 2) -> DataFrame:
    """Two-level SHA-256 of the distinct ids, which never meet in one place.

    An id belongs to the range named by the first ``digits`` hexadecimal digits of its text's own
    hash. A range's ids, ordered by their text and joined by newlines, are hashed as a stream in one
    task; the digest is the hash of the range digests in order, joined by newlines. More digits give
    smaller ranges and another digest. Without ids the digest is that of the empty text.
    """
    ids = frame.where(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("id")).distinct()
    dealt = ids.select(F.substring(F.sha2("id", 256), 1, digits).alias("range"), "id")
    ranges = dealt.repartition("range").sortWithinPartitions("range", "id").mapInPandas(
        _range_digests, "range string, entities long, digest string"
    )
    listed = F.array_sort(F.collect_list(F.struct("range", "digest")))  # at most 16 to the power of ``digits``
    return ranges.agg(
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"),
        F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), "\n"), 256).alias("digest"),
    )


def _range_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted ids; only the running hash of one range is held."""
    open_range, state, n = None, None, 0
    for batch in batches:
        done = []
        for name, own in batch.groupby("range", sort=False):
            text = "\n".join(own["id"]).encode()
            if name == open_range:
                state.update(b"\n")
            else:
                if open_range is not None:
                    done.append((open_range, n, state.hexdigest()))
                open_range, state, n = name, hashlib.sha256(), 0
            state.update(text)
            n += len(own)
        yield pd.DataFrame(done, columns=["range", "entities", "digest"])
    if open_range is not None:
        yield pd.DataFrame([(open_range, n, state.hexdigest())], columns=["range", "entities", "digest"])
