"""Point-in-time selection of the valid filings of each manager and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions import dates
from quarterdeck.functions.scalars import lenient_long
from quarterdeck.operators.joins import with_filing_deadline
from quarterdeck.session import stored

# Form and report type texts used by the regulator, and decision labels.
HOLDINGS_FORM_PREFIX = "13F-HR"
HOLDINGS_REPORT_TYPES = ("13F HOLDINGS REPORT", "13F COMBINATION REPORT")
SELECTED_DECISIONS = ("SELECTED_BASE", "SELECTED_ADDITION")

GROUP = ["CIK", "PERIODOFREPORT"]


def prepare_filings(
    submissions: DataFrame,
    coverpages: DataFrame,
    first_period: str,
    last_period: str,
    lag_days: int = 45,
) -> DataFrame:
    """Submissions paired with their cover page, dates parsed, signals classified."""
    paired = submissions.join(coverpages, "ACCESSION_NUMBER", "inner")
    filed, period = F.col("filed_on"), F.col("report_period")
    dated = paired.withColumns(
        {
            "report_period": dates.parse_date(F.col("PERIODOFREPORT")),
            "filed_on": dates.parse_date(F.col("FILING_DATE")),
        }
    )
    timed = with_filing_deadline(dated, "report_period", "filing_deadline", lag_days).withColumns(
        {
            "filing_lag_days": F.datediff(filed, period),
            "is_standard_quarter_end": dates.is_quarter_end(period),
        }
    ).withColumns(
        {
            "is_in_sample_period": F.col("is_standard_quarter_end")
            & period.between(F.lit(first_period).cast("date"), F.lit(last_period).cast("date")),
            "is_filed_by_deadline": filed <= F.col("filing_deadline"),
            "amendment_number": F.coalesce(lenient_long(F.col("AMENDMENTNO")), F.lit(0)),
        }
    )
    return classify_report(classify_amendment(timed))


def classify_amendment(filings: DataFrame) -> DataFrame:
    """Three amendment signals: any makes an amendment, disagreement is flagged."""
    suffix = F.coalesce(F.col("SUBMISSIONTYPE").endswith("/A"), F.lit(False))
    flag = F.coalesce(F.col("ISAMENDMENT") == "Y", F.lit(False))
    typed = F.col("AMENDMENTTYPE").isNotNull()
    any_signal = suffix | flag | typed
    return filings.withColumns(
        {
            "is_amendment": any_signal,
            "amendment_signal_disagreement": any_signal & ~(suffix & flag & typed),
            "amendment_kind": F.coalesce(
                F.col("AMENDMENTTYPE"),
                F.when(any_signal, "UNSPECIFIED AMENDMENT").otherwise("ORIGINAL"),
            ),
        }
    )


def classify_report(filings: DataFrame) -> DataFrame:
    """Holdings candidate, notice, or disagreement between form and report type."""
    form = F.coalesce(F.col("SUBMISSIONTYPE").startswith(HOLDINGS_FORM_PREFIX), F.lit(False))
    report = F.coalesce(F.col("REPORTTYPE").isin(*HOLDINGS_REPORT_TYPES), F.lit(False))
    return filings.withColumns(
        {
            "is_holdings_candidate": form & report,
            "is_notice": ~form & ~report,
            "classification_disagreement": form != report,
        }
    )


def assign_decisions(filings: DataFrame) -> DataFrame:
    """One decision per filing.

    The base of a group is its last original or restatement by (number, date, accession). It is
    found by a grouped maximum over a struct, which combines on the map side; the group's base
    then comes back by one join, and every label is a plain comparison with it.
    """
    filings = stored(filings)
    eligible = F.col("is_in_sample_period") & F.col("is_filed_by_deadline")
    candidate = F.col("is_holdings_candidate") & eligible
    base_candidate = candidate & (
        ~F.col("is_amendment") | (F.col("amendment_kind") == "RESTATEMENT")
    )
    rank = F.struct("amendment_number", "filed_on", "ACCESSION_NUMBER")
    bases = (
        filings.where(base_candidate)
        .groupBy(*GROUP)
        .agg(F.max(rank).alias("_base"))
        .select(
            *GROUP,
            F.col("_base.ACCESSION_NUMBER").alias("_base_accession"),
            F.col("_base.amendment_number").alias("_base_number"),
        )
    )
    addition = (
        candidate
        & (F.col("amendment_kind") == "NEW HOLDINGS")
        & (F.col("amendment_number") > F.col("_base_number"))
    )
    decision = (
        F.when(addition, "SELECTED_ADDITION")
        .when(candidate & (F.col("ACCESSION_NUMBER") == F.col("_base_accession")), "SELECTED_BASE")
        .when(candidate & F.col("_base_accession").isNull(), "UNRESOLVED")
        .when(candidate, "SUPERSEDED")
        .when(F.col("classification_disagreement") & eligible, "CLASSIFICATION_DISAGREEMENT")
        .when(F.col("is_notice") & eligible, "NOTICE_EXCLUDED")
        .when(F.col("is_in_sample_period"), "FILED_AFTER_DEADLINE")
        .otherwise("OUTSIDE_SAMPLE_PERIOD")
    )
    return (
        filings.join(bases, GROUP, "left")
        .withColumn("selection_decision", decision)
        .withColumn("is_selected", F.col("selection_decision").isin(*SELECTED_DECISIONS))
        .drop("_base_accession", "_base_number")
    )


def select_filings(
    submissions: DataFrame,
    coverpages: DataFrame,
    first_period: str,
    last_period: str,
    lag_days: int = 45,
) -> DataFrame:
    """Decide for every filing whether it is the version in force at the deadline."""
    return assign_decisions(
        prepare_filings(submissions, coverpages, first_period, last_period, lag_days)
    )


def manager_metadata(decisions: DataFrame) -> DataFrame:
    """Per manager and period: information date and the base filing's manager name."""
    return (
        decisions.where("is_selected")
        .groupBy(*GROUP)
        .agg(
            F.min("report_period").alias("report_period"),
            F.min("filing_deadline").alias("information_date"),
            F.max(
                F.when(F.col("selection_decision") == "SELECTED_BASE", F.col("FILINGMANAGER_NAME"))
            ).alias("FILINGMANAGER_NAME"),
        )
    )


def selection_invariants(decisions: DataFrame) -> DataFrame:
    """Violations that must all be zero on a valid selection."""
    is_base = F.col("selection_decision") == "SELECTED_BASE"
    is_addition = F.col("selection_decision") == "SELECTED_ADDITION"
    late = F.col("is_selected") & ~F.col("is_filed_by_deadline")
    outside = F.col("is_selected") & ~F.col("is_in_sample_period")
    groups = decisions.groupBy(*GROUP).agg(
        F.count(F.when(is_base, F.lit(1))).alias("bases"),
        F.count(F.when(is_addition, F.lit(1))).alias("additions"),
        F.max(F.when(is_base, F.col("amendment_number"))).alias("base_number"),
        F.min(F.when(is_addition, F.col("amendment_number"))).alias("first_addition"),
        F.count(F.when(late, F.lit(1))).alias("late"),
        F.count(F.when(outside, F.lit(1))).alias("outside"),
    )
    return groups.agg(
        F.count(F.when(F.col("bases") > 1, F.lit(1))).alias("groups_with_many_bases"),
        F.count(F.when((F.col("additions") > 0) & (F.col("bases") == 0), F.lit(1)))
        .alias("groups_with_baseless_additions"),
        F.count(F.when(F.col("first_addition") <= F.col("base_number"), F.lit(1)))
        .alias("groups_with_early_additions"),
        F.sum("late").alias("selected_late_rows"),
        F.sum("outside").alias("selected_outside_rows"),
        F.count(F.when(F.col("bases") == 1, F.lit(1))).alias("groups_with_one_base"),
    )
