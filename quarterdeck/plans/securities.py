"""Point-in-time identifier mapping and the holdings panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions.aggregates import count_where, largest_row
from quarterdeck.functions.scalars import normalized_id
from quarterdeck.operators.aggregates import with_share_of_total, with_stage_baselines
from quarterdeck.operators.joins import validity_join

# Status labels, stage labels and the eligibility rule for common equity.
MATCH_STATES = ("MATCHED", "UNMATCHED", "AMBIGUOUS")
ELIGIBLE = {
    "securitytype": ("EQTY",),
    "securitysubtype": ("COM",),
    "sharetype": ("NS",),
    "usincflg": ("Y",),
    "primaryexch": ("N", "A", "Q"),
}
HOLDING_STAGES = ("FORM_13F_POSITIONS", "EXACT_CRSP_MATCHES", "ELIGIBLE_US_COMMON_EQUITIES")


def map_securities(
    keys: DataFrame,
    history: DataFrame,
    *,
    identifier: str = "CUSIP",
    period: str = "report_period",
    history_identifier: str = "cusip9",
    entity: str = "permno",
    start: str = "secinfostartdt",
    end: str = "secinfoenddt",
    attributes: Sequence[str] = (),
) -> DataFrame:
    """Resolve each (period, identifier) to the entity valid at the period end.

    Every candidate entity keeps its latest interval, and the candidates of a key are counted,
    in two grouped aggregations over structs; attributes appear only for a single candidate.
    """
    asked = keys.select(period, normalized_id(F.col(identifier)).alias(identifier)).distinct()
    names = [entity, *attributes]
    valid = history.where(F.col(entity).isNotNull() & F.col(history_identifier).isNotNull()).select(
        normalized_id(F.col(history_identifier)).alias("_id"), start, end, *names
    )
    candidates = validity_join(asked, valid, identifier, "_id", period, start, end)
    latest = candidates.groupBy(period, identifier, entity).agg(
        F.max(F.struct(start, end, *attributes)).alias("_row")
    )
    resolved = latest.groupBy(period, identifier).agg(
        F.count(F.lit(1)).cast("int").alias("candidate_count"),
        F.max(F.struct(entity, "_row")).alias("_only"),
    )
    single = F.col("candidate_count") == 1
    return asked.join(resolved, [period, identifier], "left").select(
        period,
        identifier,
        F.when(F.col("candidate_count").isNull(), "UNMATCHED")
        .when(single, "MATCHED")
        .otherwise("AMBIGUOUS")
        .alias("match_status"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(single, F.col(f"_only.{entity}")).alias(entity),
        *[F.when(single, F.col(f"_only._row.{a}")).alias(a) for a in attributes],
        F.when(single, F.col(f"_only._row.{start}")).alias(start),
        F.when(single, F.col(f"_only._row.{end}")).alias(end),
    )


def mapping_coverage(
    positions: DataFrame,
    mapping: DataFrame,
    *,
    identifier: str = "CUSIP",
    period: str = "report_period",
    value: str = "position_value_usd",
) -> DataFrame:
    """Securities, positions and value per period and match status, with shares in percent."""
    per_security = (
        positions.withColumn(identifier, normalized_id(F.col(identifier)))
        .groupBy(period, identifier)
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_value"))
    )
    statuses = (
        per_security.join(mapping.select(period, identifier, "match_status"), [period, identifier])
        .groupBy(period, "match_status")
        .agg(
            F.count(F.lit(1)).alias("securities"),
            F.sum("_rows").alias("manager_positions"),
            F.sum("_value").alias("position_value_usd"),
        )
    )
    group = Window.partitionBy(period)  # three rows per period
    shares = {
        "security_share_percent": "securities",
        "position_share_percent": "manager_positions",
        "value_share_percent": "position_value_usd",
    }
    return statuses.withColumns(
        {
            name: F.lit(100.0) * F.col(c) / F.nullif(F.sum(c).over(group), F.lit(0))
            for name, c in shares.items()
        }
    )


def mapping_audit(
    keys: DataFrame,
    mapping: DataFrame,
    history: DataFrame,
    *,
    identifier: str = "CUSIP",
    period: str = "report_period",
    entity: str = "permno",
    start: str = "secinfostartdt",
    end: str = "secinfoenddt",
    id_length: int = 9,
) -> DataFrame:
    """Counters that are zero for a sound history and a complete, consistent mapping."""
    intervals = history.agg(
        count_where(F.col(start).isNull() | F.col(end).isNull()).alias("null_intervals"),
        count_where(F.col(start) > F.col(end)).alias("reversed_intervals"),
    )
    state = F.col("match_status")
    n = F.col("candidate_count")
    consistent = (
        ((state == "UNMATCHED") & (n == 0) & F.col(entity).isNull())
        | ((state == "MATCHED") & (n == 1) & F.col(entity).isNotNull())
        | ((state == "AMBIGUOUS") & (n > 1) & F.col(entity).isNull())
    )
    rows = mapping.agg(
        count_where(F.length(identifier) != id_length).alias("malformed_identifiers"),
        count_where(~consistent).alias("inconsistent_statuses"),
        count_where(
            (state == "MATCHED") & ~F.col(period).between(F.col(start), F.col(end))
        ).alias("matches_outside_interval"),
    )
    asked = keys.select(period, normalized_id(F.col(identifier)).alias(identifier)).distinct()
    sides = asked.select(period, identifier, F.lit(1).alias("_k"), F.lit(0).alias("_m")).unionByName(
        mapping.select(period, identifier, F.lit(0).alias("_k"), F.lit(1).alias("_m"))
    ).groupBy(period, identifier).agg(F.max("_k").alias("_k"), F.max("_m").alias("_m"))
    coverage = sides.agg(
        count_where(F.col("_m") == 0).alias("missing_keys"),
        count_where(F.col("_k") == 0).alias("extra_keys"),
    )
    parts = None
    for frame in (intervals, rows, coverage):
        long = frame.unpivot([], frame.columns, "check", "rows")
        parts = long if parts is None else parts.unionByName(long)
    return parts


def eligible_positions(mapped: DataFrame, rules: dict[str, Sequence[str]] = ELIGIBLE) -> DataFrame:
    """Matched positions of ordinary domestic common stock on the main exchanges."""
    test = (F.col("match_status") == "MATCHED") & F.col("permno").isNotNull()
    for column, allowed in rules.items():
        test = test & F.col(column).isin(*allowed)
    return mapped.where(test)


def mapped_positions(positions: DataFrame, managers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Positions with their manager's information date and the security they map to."""
    cleaned = positions.withColumn("CUSIP", normalized_id(F.col("CUSIP")))
    dated = managers.select("CIK", "PERIODOFREPORT", "report_period", "information_date")
    return cleaned.join(dated, ["CIK", "PERIODOFREPORT", "report_period"]).join(
        mapping, ["report_period", "CUSIP"]
    )


def holdings_panel(eligible: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Positions summed to (manager, period, security), attributes of the largest position,
    and the weight inside the manager's eligible portfolio."""
    summed = eligible.groupBy(
        "CIK", "PERIODOFREPORT", "report_period", "information_date", "permno"
    ).agg(
        F.count_distinct("CUSIP").cast("int").alias("mapped_cusip_count"),
        F.sum("position_value_usd").alias("_value"),
        F.sum("raw_position_rows").alias("raw_position_rows"),
        *largest_row(["CUSIP", *attributes], F.col("position_value_usd"), F.col("CUSIP")),
    ).withColumnRenamed("_value", "position_value_usd")
    return with_share_of_total(
        summed, ["CIK", "PERIODOFREPORT"], "position_value_usd",
        share="portfolio_weight", total="portfolio_value_usd",
    )


def portfolio_totals(holdings: DataFrame, managers: DataFrame) -> DataFrame:
    """One row per manager-period portfolio."""
    totals = holdings.groupBy("CIK", "PERIODOFREPORT").agg(
        F.min("report_period").alias("report_period"),
        F.min("information_date").alias("information_date"),
        F.sum("position_value_usd").alias("portfolio_value_usd"),
        F.count(F.lit(1)).alias("security_count"),
        F.sum("raw_position_rows").alias("underlying_position_rows"),
    )
    names = managers.select("CIK", "PERIODOFREPORT", "FILINGMANAGER_NAME")
    return totals.join(names, ["CIK", "PERIODOFREPORT"])


def holdings_audit(mapped: DataFrame, rules: dict[str, Sequence[str]] = ELIGIBLE) -> DataFrame:
    """Positions, managers, securities and value at each construction stage of a period.

    A position's last stage is computed once; stages then come from one grouped pass by
    (period, manager) and (period, security) instead of a union of three scans.
    """
    matched = F.col("match_status") == "MATCHED"
    eligible = matched & F.col("permno").isNotNull()
    for column, allowed in rules.items():
        eligible = eligible & F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    reach = F.when(eligible, 3).when(matched, 2).otherwise(1)
    staged = mapped.withColumn("_reach", reach)
    period = ["PERIODOFREPORT", "report_period"]
    per_pair = staged.groupBy(*period, "_reach").agg(
        F.min("information_date").alias("information_date"),
        F.count(F.lit(1)).alias("manager_positions"),
        F.sum("position_value_usd").alias("position_value_usd"),
    )
    reached_stage = F.explode(F.sequence(F.lit(1), F.col("_reach"))).alias("stage_order")
    sums = per_pair.select("*", reached_stage).groupBy(*period, "stage_order").agg(
        F.min("information_date").alias("information_date"),
        F.sum("manager_positions").alias("manager_positions"),
        F.sum("position_value_usd").alias("position_value_usd"),
    )

    def distinct(entity: str, name: str) -> DataFrame:
        best = staged.groupBy(*period, entity).agg(F.max("_reach").alias("_reach"))
        return (
            best.groupBy(*period, "_reach").agg(F.count(F.lit(1)).alias(name))
            .select("*", reached_stage)
            .groupBy(*period, "stage_order").agg(F.sum(name).alias(name))
        )

    keys = [*period, "stage_order"]
    table = sums.join(distinct("CIK", "manager_periods"), keys).join(distinct("CUSIP", "securities"), keys)
    table = with_stage_baselines(
        table, ["report_period"], "stage_order",
        ["manager_positions", "manager_periods", "position_value_usd"],
    )
    labels = F.array(*[F.lit(s) for s in HOLDING_STAGES])
    return table.withColumn("stage", F.element_at(labels, F.col("stage_order"))).withColumnsRenamed(
        {
            "manager_positions_retention_percent": "position_retention_percent",
            "manager_periods_retention_percent": "manager_retention_percent",
            "position_value_usd_retention_percent": "value_retention_percent",
        }
    )
