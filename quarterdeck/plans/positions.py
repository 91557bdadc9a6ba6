"""Positions of selected filings: units, filters, aggregation, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.scalars import lenient_long, normalized_id
from quarterdeck.operators.aggregates import modal_labels, staged_counts
from quarterdeck.session import stored

# The date on which reported values changed from thousands to dollars, the
# report type of a plain holdings filing, and the stage labels of the filter audit.
VALUE_UNIT_CHANGE = "2023-01-03"
BASE_REPORT_TYPE = "13F HOLDINGS REPORT"
THOUSAND = 1000
UNIT_TOLERANCE = 0.0001
STAGES = {
    "Selected filing rows": "passes_selected",
    "Baseline-report rows": "passes_baseline",
    "Share-denominated rows": "passes_shares",
    "Non-option rows": "passes_non_option",
    "Valid nine-character CUSIP rows": "passes_valid_cusip",
    "Numeric-value rows": "passes_numeric_value",
    "Positive-value baseline rows": "passes_positive_value",
}


def selected_filings(decisions: DataFrame, change_date: str = VALUE_UNIT_CHANGE) -> DataFrame:
    """Selected filings with their role, the base's report type rule and the unit era."""
    chosen = decisions.where("is_selected")
    base_types = (
        chosen.where(F.col("selection_decision") == "SELECTED_BASE")
        .select("CIK", "PERIODOFREPORT", F.col("REPORTTYPE").alias("_base_type"))
    )
    return (
        chosen.join(base_types, ["CIK", "PERIODOFREPORT"], "left")
        .withColumn("baseline_eligible_manager", F.col("_base_type") == BASE_REPORT_TYPE)
        .withColumn("is_pre_value_unit_change", F.col("filed_on") < F.lit(change_date).cast("date"))
        .drop("_base_type")
    )


def positions_of(
    filings: DataFrame, information: DataFrame, columns: tuple[str, ...]
) -> DataFrame:
    """Position rows whose filing and source both match a selected filing."""
    keys = ["ACCESSION_NUMBER", "source_archive_id"]
    kept = filings.select(*keys, *columns)
    return information.join(kept, keys).withColumn(
        "reported_position_value", lenient_long(F.col("VALUE"))
    )


def filing_audit(filings: DataFrame, summary: DataFrame, raw: DataFrame) -> DataFrame:
    """Declared against observed rows and values, and the unit each filing was written in."""
    observed = raw.groupBy("ACCESSION_NUMBER").agg(
        F.count(F.lit(1)).alias("observed_position_rows"),
        F.count(F.when(F.col("reported_position_value").isNull(), F.lit(1))).alias("invalid_value_rows"),
        F.sum("reported_position_value").alias("_observed"),
    )
    declared_side = summary.select(
        "ACCESSION_NUMBER",
        "source_archive_id",
        lenient_long(F.col("TABLEENTRYTOTAL")).alias("declared_position_rows"),
        lenient_long(F.col("TABLEVALUETOTAL")).alias("_declared"),
        F.lit(True).alias("_summary"),
    )
    joined = (
        filings.join(declared_side, ["ACCESSION_NUMBER", "source_archive_id"], "left")
        .join(observed, "ACCESSION_NUMBER", "left")
        .withColumns(
            {
                "has_summary_row": F.coalesce(F.col("_summary"), F.lit(False)),
                "observed_position_rows": F.coalesce("observed_position_rows", F.lit(0)),
                "invalid_value_rows": F.coalesce("invalid_value_rows", F.lit(0)),
            }
        )
    )
    ratio = F.when(F.col("_declared") > 0, F.col("_observed") / F.col("_declared"))
    near_one = F.coalesce(F.abs(ratio - 1) <= UNIT_TOLERANCE, F.lit(False))
    near_thousand = F.coalesce(
        F.abs(ratio - THOUSAND) <= THOUSAND * UNIT_TOLERANCE, F.lit(False)
    )
    early = F.col("is_pre_value_unit_change")
    unit = (
        F.when(early & near_thousand, "PRE_2023_INFORMATION_TABLE_DOLLARS")
        .when(early & near_one, "PRE_2023_THOUSANDS")
        .when(early, "PRE_2023_UNRESOLVED")
        .when(near_one, "POST_2023_DOLLARS")
        .otherwise("POST_2023_UNRESOLVED")
    )
    era = F.when(early, F.lit(THOUSAND)).otherwise(F.lit(1)).cast("bigint")
    priced = joined.withColumns(
        {
            "position_count_matches_summary": F.col("declared_position_rows")
            == F.col("observed_position_rows"),
            "value_unit_classification": unit,
            "summary_value_multiplier_to_usd": era,
            "position_value_multiplier_to_usd": F.when(
                early & near_thousand, F.lit(1).cast("bigint")
            ).otherwise(era),
        }
    ).withColumns(
        {
            "declared_value_usd": F.col("_declared") * F.col("summary_value_multiplier_to_usd"),
            "observed_value_usd": F.col("_observed") * F.col("position_value_multiplier_to_usd"),
        }
    ).withColumn(
        "value_difference_usd", F.col("observed_value_usd") - F.col("declared_value_usd")
    )
    return priced.withColumn(
        "value_matches_summary",
        F.when(F.col("invalid_value_rows") == 0, F.col("value_difference_usd") == 0),
    ).drop("_summary", "_declared", "_observed")


def classify_positions(raw: DataFrame, audit: DataFrame) -> DataFrame:
    """Values in dollars and seven filter flags, each including the ones before it."""
    units = audit.select("ACCESSION_NUMBER", "position_value_multiplier_to_usd")
    valued = raw.join(units, "ACCESSION_NUMBER").withColumns(
        {
            "CUSIP": normalized_id(F.col("CUSIP")),
            "position_value_usd": F.col("reported_position_value")
            * F.col("position_value_multiplier_to_usd"),
        }
    )
    return with_cumulative_flags(
        valued,
        {
            "passes_selected": F.lit(True),
            "passes_baseline": F.col("baseline_eligible_manager"),
            "passes_shares": F.col("SSHPRNAMTTYPE") == "SH",
            "passes_non_option": F.col("PUTCALL").isNull(),
            "passes_valid_cusip": F.col("CUSIP").isNotNull() & (F.length("CUSIP") == 9),
            "passes_numeric_value": F.col("reported_position_value").isNotNull(),
            "passes_positive_value": F.col("position_value_usd") > 0,
        },
    )


def with_cumulative_flags(frame: DataFrame, tests: dict) -> DataFrame:
    """Named boolean stages, each the conjunction of its test with all earlier ones."""
    so_far = F.lit(True)
    flags = {}
    for name, test in tests.items():
        so_far = so_far & F.coalesce(test, F.lit(False))
        flags[name] = so_far
    return frame.withColumns(flags)


def position_universe(classified: DataFrame) -> DataFrame:
    """One row per manager, period and security with its most frequent labels."""
    kept = stored(classified.where("passes_positive_value"))
    totals = kept.groupBy("CIK", "PERIODOFREPORT", "report_period", "CUSIP").agg(
        F.sum("position_value_usd").alias("position_value_usd"),
        F.count(F.lit(1)).alias("raw_position_rows"),
    )
    labels = modal_labels(kept, "CUSIP", ["NAMEOFISSUER", "TITLEOFCLASS"])
    return totals.join(labels, "CUSIP").select(
        "CIK", "PERIODOFREPORT", "report_period", "CUSIP", "NAMEOFISSUER", "TITLEOFCLASS",
        "position_value_usd", "raw_position_rows",
    )


def position_filter_audit(classified: DataFrame) -> DataFrame:
    """Rows, managers and value left after each filter, per period."""
    return staged_counts(
        classified, ["PERIODOFREPORT", "report_period"], STAGES, "CIK", "position_value_usd"
    )


def build_position_universe(
    decisions: DataFrame, information: DataFrame, summary: DataFrame
) -> dict[str, DataFrame]:
    """Positions, filter audit and filing audit of the selected filings."""
    filings = stored(selected_filings(stored(decisions)))
    raw = stored(
        positions_of(
            filings,
            information,
            ("CIK", "PERIODOFREPORT", "report_period", "baseline_eligible_manager"),
        )
    )
    audit = filing_audit(filings, summary, raw)
    classified = classify_positions(raw, audit)
    return {
        "positions": position_universe(classified),
        "position_filter_audit": position_filter_audit(classified),
        "filing_audit": audit,
    }
