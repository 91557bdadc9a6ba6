"""Filing selection, position universe, identifier mapping and holdings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.functions import dates
from quarterdeck.operators.aggregates import modal_labels, staged_counts
from quarterdeck.operators.contracts import attrition_violations, stage_retention
from quarterdeck.operators.joins import left_lookup, reconcile
from quarterdeck.plans import filings as fl
from quarterdeck.plans import positions as ps
from quarterdeck.plans import securities as sec
from quarterdeck.session import cut_lineage, stored
from workload import recipes as R
from workload.registry import case

FIRST, LAST = "1995-06-30", "2000-12-31"
CHANGE = "1998-01-01"

# ------------------------------------------------------------------ filings from orders
R.cte(
    "filings_raw",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS ACCESSION_NUMBER, 'A' || (o_orderkey % 3) AS source_archive_id,
        'M' || (o_custkey % 100) AS CIK, {R.quarter_end_sql('o_orderdate')} AS q,
        upper(strftime({R.quarter_end_sql('o_orderdate')}, '%d-%b-%Y')) AS PERIODOFREPORT,
        upper(strftime({R.quarter_end_sql('o_orderdate')} + CAST(o_orderkey % 60 AS INTEGER), '%d-%b-%Y')) AS FILING_DATE,
        CASE o_orderstatus WHEN 'F' THEN '13F-HR' WHEN 'O' THEN '13F-HR/A' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '13F-NT' ELSE '13F-HR' END END AS SUBMISSIONTYPE,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'N' END AS ISAMENDMENT,
        CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS AMENDMENTNO,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'RESTATEMENT' WHEN '2-HIGH' THEN 'NEW HOLDINGS' END AS AMENDMENTTYPE,
        'Manager ' || (o_custkey % 100) AS FILINGMANAGER_NAME,
        CASE WHEN o_orderkey % 10 < 7 THEN '13F HOLDINGS REPORT' WHEN o_orderkey % 10 = 7 THEN '13F COMBINATION REPORT'
             WHEN o_orderkey % 10 = 8 THEN '13F NOTICE' END AS REPORTTYPE
    FROM orders
    """,
)


def filings_raw(spark, sf):
    o = R.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    period = dates.quarter_end(F.to_date("o_orderdate"))

    def text(day):
        return F.upper(F.date_format(day, "dd-MMM-yyyy"))

    return o.select(
        key.cast("string").alias("ACCESSION_NUMBER"),
        F.concat(F.lit("A"), (key % 3).cast("string")).alias("source_archive_id"),
        F.concat(F.lit("M"), (F.col("o_custkey") % 100).cast("string")).alias("CIK"),
        text(period).alias("PERIODOFREPORT"),
        text(F.date_add(period, (key % 60).cast("int"))).alias("FILING_DATE"),
        F.when(F.col("o_orderstatus") == "F", "13F-HR").when(F.col("o_orderstatus") == "O", "13F-HR/A")
        .when(key % 3 == 0, "13F-NT").otherwise("13F-HR").alias("SUBMISSIONTYPE"),
        F.when(key % 6 == 0, None).when(F.col("o_orderstatus") == "O", "Y").otherwise("N").alias("ISAMENDMENT"),
        F.when(key % 11 == 0, "none").otherwise((key % 4).cast("string")).alias("AMENDMENTNO"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "RESTATEMENT")
        .when(F.col("o_orderpriority") == "2-HIGH", "NEW HOLDINGS").alias("AMENDMENTTYPE"),
        F.concat(F.lit("Manager "), (F.col("o_custkey") % 100).cast("string")).alias("FILINGMANAGER_NAME"),
        F.when(key % 10 < 7, "13F HOLDINGS REPORT").when(key % 10 == 7, "13F COMBINATION REPORT")
        .when(key % 10 == 8, "13F NOTICE").alias("REPORTTYPE"),
    )


SUBMISSION = ["ACCESSION_NUMBER", "source_archive_id", "CIK", "PERIODOFREPORT", "FILING_DATE", "SUBMISSIONTYPE"]
COVER = ["ACCESSION_NUMBER", "ISAMENDMENT", "AMENDMENTNO", "AMENDMENTTYPE", "FILINGMANAGER_NAME", "REPORTTYPE"]


def prepared(spark, sf):
    raw = filings_raw(spark, sf)
    return fl.prepare_filings(raw.select(*SUBMISSION), raw.select(*COVER), FIRST, LAST)


def decisions(spark, sf):
    raw = stored(filings_raw(spark, sf))
    return fl.select_filings(raw.select(*SUBMISSION), raw.select(*COVER), FIRST, LAST)


def stored_decisions(spark, sf):
    """The decisions as a stored table, the form in which later stages read them."""
    return cut_lineage(decisions(spark, sf))


R.cte(
    "prepared",
    f"""
    SELECT f.* EXCLUDE (q), f.q AS report_period, CAST(strptime(f.FILING_DATE, '%d-%b-%Y') AS DATE) AS filed_on,
        date_diff('day', f.q, CAST(strptime(f.FILING_DATE, '%d-%b-%Y') AS DATE)) AS filing_lag_days,
        i.information_date AS filing_deadline, true AS is_standard_quarter_end,
        f.q BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AS is_in_sample_period,
        CAST(strptime(f.FILING_DATE, '%d-%b-%Y') AS DATE) <= i.information_date AS is_filed_by_deadline,
        coalesce(TRY_CAST(AMENDMENTNO AS BIGINT), 0) AS amendment_number,
        (SUBMISSIONTYPE LIKE '%/A') OR coalesce(ISAMENDMENT = 'Y', false) OR AMENDMENTTYPE IS NOT NULL AS is_amendment,
        ((SUBMISSIONTYPE LIKE '%/A') <> coalesce(ISAMENDMENT = 'Y', false)) OR ((SUBMISSIONTYPE LIKE '%/A') <> (AMENDMENTTYPE IS NOT NULL))
            OR (coalesce(ISAMENDMENT = 'Y', false) <> (AMENDMENTTYPE IS NOT NULL)) AS amendment_signal_disagreement,
        CASE WHEN AMENDMENTTYPE IS NOT NULL THEN AMENDMENTTYPE
             WHEN SUBMISSIONTYPE LIKE '%/A' OR coalesce(ISAMENDMENT = 'Y', false) THEN 'UNSPECIFIED AMENDMENT' ELSE 'ORIGINAL' END AS amendment_kind,
        SUBMISSIONTYPE LIKE '13F-HR%' AND coalesce(REPORTTYPE IN ('13F HOLDINGS REPORT', '13F COMBINATION REPORT'), false) AS is_holdings_candidate,
        NOT (SUBMISSIONTYPE LIKE '13F-HR%') AND NOT coalesce(REPORTTYPE IN ('13F HOLDINGS REPORT', '13F COMBINATION REPORT'), false) AS is_notice,
        (SUBMISSIONTYPE LIKE '13F-HR%') <> coalesce(REPORTTYPE IN ('13F HOLDINGS REPORT', '13F COMBINATION REPORT'), false) AS classification_disagreement
    FROM filings_raw f JOIN infodates i ON i.report_period = f.q
    """,
    "filings_raw infodates",
)
R.cte(
    "decisions",
    """
    SELECT p.*, CASE
        WHEN NOT is_in_sample_period THEN 'OUTSIDE_SAMPLE_PERIOD'
        WHEN NOT is_filed_by_deadline THEN 'FILED_AFTER_DEADLINE'
        WHEN is_notice THEN 'NOTICE_EXCLUDED'
        WHEN classification_disagreement THEN 'CLASSIFICATION_DISAGREEMENT'
        WHEN amendment_kind = 'NEW HOLDINGS' AND b.base_number IS NOT NULL AND amendment_number > b.base_number THEN 'SELECTED_ADDITION'
        WHEN p.ACCESSION_NUMBER = b.base_accession THEN 'SELECTED_BASE'
        WHEN b.base_accession IS NULL THEN 'UNRESOLVED'
        ELSE 'SUPERSEDED' END AS selection_decision
    FROM prepared p LEFT JOIN (
        SELECT CIK, PERIODOFREPORT, ACCESSION_NUMBER AS base_accession, amendment_number AS base_number
        FROM prepared
        WHERE is_in_sample_period AND is_filed_by_deadline AND is_holdings_candidate
            AND (NOT is_amendment OR amendment_kind = 'RESTATEMENT')
        QUALIFY row_number() OVER (PARTITION BY CIK, PERIODOFREPORT
            ORDER BY amendment_number DESC, filed_on DESC, ACCESSION_NUMBER DESC) = 1) b USING (CIK, PERIODOFREPORT)
    """,
    "prepared",
)


@case(
    "p1_date_parsing",
    """SELECT ACCESSION_NUMBER, report_period, filed_on, CAST(filing_lag_days AS INTEGER) AS filing_lag_days,
        is_standard_quarter_end, is_in_sample_period FROM prepared""",
    uses="prepared",
)
def _(spark, sf):
    return prepared(spark, sf).select(
        "ACCESSION_NUMBER", "report_period", "filed_on", "filing_lag_days",
        "is_standard_quarter_end", "is_in_sample_period",
    )


@case(
    "p2_filing_deadline",
    f"""SELECT q AS report_period, information_date AS filing_deadline, count(*) AS filings
    FROM filings_raw JOIN infodates i ON i.report_period = q GROUP BY ALL""",
    uses="filings_raw infodates",
)
def _(spark, sf):
    return prepared(spark, sf).groupBy("report_period", "filing_deadline").agg(F.count(F.lit(1)).alias("filings"))


@case(
    "p3_amendment_signals",
    """SELECT is_amendment, amendment_signal_disagreement, amendment_kind, amendment_number, count(*) AS filings
    FROM prepared GROUP BY ALL""",
    uses="prepared",
)
def _(spark, sf):
    return prepared(spark, sf).groupBy(
        "is_amendment", "amendment_signal_disagreement", "amendment_kind", "amendment_number"
    ).agg(F.count(F.lit(1)).alias("filings"))


@case(
    "p4_report_classification",
    """SELECT is_holdings_candidate, is_notice, classification_disagreement, SUBMISSIONTYPE, REPORTTYPE, count(*) AS filings
    FROM prepared GROUP BY ALL""",
    uses="prepared",
)
def _(spark, sf):
    return prepared(spark, sf).groupBy(
        "is_holdings_candidate", "is_notice", "classification_disagreement", "SUBMISSIONTYPE", "REPORTTYPE"
    ).agg(F.count(F.lit(1)).alias("filings"))


@case(
    "w1_latest_version",
    """SELECT CIK, PERIODOFREPORT, ACCESSION_NUMBER, amendment_number FROM decisions WHERE selection_decision = 'SELECTED_BASE'""",
    uses="decisions",
)
def _(spark, sf):
    base = prepared(spark, sf).where(
        F.col("is_in_sample_period") & F.col("is_filed_by_deadline") & F.col("is_holdings_candidate")
        & (~F.col("is_amendment") | (F.col("amendment_kind") == "RESTATEMENT"))
    )
    last = F.max(F.struct("amendment_number", "filed_on", "ACCESSION_NUMBER")).alias("last")
    return base.groupBy("CIK", "PERIODOFREPORT").agg(last).select(
        "CIK", "PERIODOFREPORT", "last.ACCESSION_NUMBER", "last.amendment_number"
    )


@case(
    "w3_version_resolution",
    "SELECT ACCESSION_NUMBER, selection_decision FROM decisions",
    uses="decisions",
)
def _(spark, sf):
    return decisions(spark, sf).select("ACCESSION_NUMBER", "selection_decision")


C1_COLUMNS = (
    "ACCESSION_NUMBER source_archive_id CIK PERIODOFREPORT report_period FILINGMANAGER_NAME filed_on filing_deadline "
    "is_standard_quarter_end is_in_sample_period is_filed_by_deadline amendment_number is_amendment "
    "amendment_signal_disagreement amendment_kind is_holdings_candidate is_notice classification_disagreement selection_decision"
).split()


@case(
    "c1_filing_selection",
    f"""SELECT {', '.join(C1_COLUMNS)}, selection_decision IN ('SELECTED_BASE', 'SELECTED_ADDITION') AS is_selected FROM decisions""",
    uses="decisions",
)
def _(spark, sf):
    return decisions(spark, sf).select(*C1_COLUMNS, "is_selected")


@case(
    "q9_selection_invariants",
    """
    SELECT CAST(count(*) FILTER (WHERE bases > 1) AS BIGINT) AS groups_with_many_bases,
        count(*) FILTER (WHERE additions > 0 AND bases = 0) AS groups_with_baseless_additions,
        count(*) FILTER (WHERE first_addition <= base_number) AS groups_with_early_additions,
        CAST(sum(late) AS BIGINT) AS selected_late_rows, CAST(sum(outside) AS BIGINT) AS selected_outside_rows,
        count(*) FILTER (WHERE bases = 1) AS groups_with_one_base
    FROM (SELECT CIK, PERIODOFREPORT, count(*) FILTER (WHERE selection_decision = 'SELECTED_BASE') AS bases,
            count(*) FILTER (WHERE selection_decision = 'SELECTED_ADDITION') AS additions,
            max(amendment_number) FILTER (WHERE selection_decision = 'SELECTED_BASE') AS base_number,
            min(amendment_number) FILTER (WHERE selection_decision = 'SELECTED_ADDITION') AS first_addition,
            count(*) FILTER (WHERE selection_decision LIKE 'SELECTED%' AND NOT is_filed_by_deadline) AS late,
            count(*) FILTER (WHERE selection_decision LIKE 'SELECTED%' AND NOT is_in_sample_period) AS outside
          FROM decisions GROUP BY ALL)
    """,
    uses="decisions",
)
def _(spark, sf):
    return fl.selection_invariants(decisions(spark, sf))


@case(
    "q10_lag_distribution",
    """SELECT selection_decision, count(*) AS filings, CAST(min(filing_lag_days) AS INTEGER) AS minimum_lag,
        median(filing_lag_days) AS median_lag, CAST(max(filing_lag_days) AS INTEGER) AS maximum_lag,
        count(*) FILTER (WHERE is_amendment) AS amendments
    FROM decisions GROUP BY selection_decision""",
    uses="decisions", doubles="median_lag",
)
def _(spark, sf):
    from quarterdeck.functions.order import exact_quantiles

    d = decisions(spark, sf)
    stats = d.groupBy("selection_decision").agg(
        F.count(F.lit(1)).alias("filings"), F.min("filing_lag_days").alias("minimum_lag"),
        F.max("filing_lag_days").alias("maximum_lag"),
        F.count(F.when(F.col("is_amendment"), F.lit(1))).alias("amendments"),
    )
    return stats.join(exact_quantiles(d, ["selection_decision"], "filing_lag_days", {"median_lag": 0.5}), "selection_decision")


@case(
    "q11_signal_crosstab",
    """SELECT ISAMENDMENT, AMENDMENTTYPE, SUBMISSIONTYPE, count(*) AS filings FROM prepared
    WHERE amendment_signal_disagreement GROUP BY ALL""",
    uses="prepared",
)
def _(spark, sf):
    return prepared(spark, sf).where("amendment_signal_disagreement").groupBy(
        "ISAMENDMENT", "AMENDMENTTYPE", "SUBMISSIONTYPE"
    ).agg(F.count(F.lit(1)).alias("filings"))


# ------------------------------------------------------------------ positions from lineitem
R.cte(
    "info",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS ACCESSION_NUMBER,
        'A' || CASE WHEN l_partkey % 29 = 0 THEN (l_orderkey + 1) % 3 ELSE l_orderkey % 3 END AS source_archive_id,
        p_brand AS NAMEOFISSUER, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE p_type END AS TITLEOFCLASS,
        CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN 'short'
             ELSE ' us' || lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') || CASE WHEN l_partkey % 2 = 0 THEN 'x ' ELSE 'y' END END AS CUSIP,
        CASE WHEN l_partkey % 97 = 0 THEN 'n/a' WHEN l_partkey % 53 = 0 THEN '0'
             WHEN l_partkey % 31 = 0 THEN '10.6' ELSE CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) END AS VALUE,
        CASE WHEN l_returnflag = 'R' THEN 'PRN' ELSE 'SH' END AS SSHPRNAMTTYPE,
        CASE WHEN l_linestatus = 'F' AND l_partkey % 7 = 0 THEN 'Put' END AS PUTCALL
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)


def info(spark, sf):
    item, part = R.table(spark, sf, "lineitem"), R.table(spark, sf, "part")
    key, order = F.col("l_partkey"), F.col("l_orderkey")
    archive = F.when(key % 29 == 0, (order + 1) % 3).otherwise(order % 3)
    return item.join(part, item.l_partkey == part.p_partkey).select(
        order.cast("string").alias("ACCESSION_NUMBER"),
        F.concat(F.lit("A"), archive.cast("string")).alias("source_archive_id"),
        F.col("p_brand").alias("NAMEOFISSUER"),
        F.when(key % 17 != 0, F.col("p_type")).alias("TITLEOFCLASS"),
        F.when(key % 41 == 0, None).when(key % 37 == 0, "short").otherwise(
            F.concat(F.lit(" us"), F.lpad((key % 1000000).cast("string"), 6, "0"), F.when(key % 2 == 0, "x ").otherwise("y"))
        ).alias("CUSIP"),
        F.when(key % 97 == 0, "n/a").when(key % 53 == 0, "0").when(key % 31 == 0, "10.6")
        .otherwise(F.round("l_extendedprice").cast("bigint").cast("string")).alias("VALUE"),
        F.when(F.col("l_returnflag") == "R", "PRN").otherwise("SH").alias("SSHPRNAMTTYPE"),
        F.when((F.col("l_linestatus") == "F") & (key % 7 == 0), "Put").alias("PUTCALL"),
    )


R.cte(
    "summary",
    """
    SELECT ACCESSION_NUMBER, 'A' || (CAST(ACCESSION_NUMBER AS BIGINT) % 3) AS source_archive_id,
        CASE WHEN CAST(ACCESSION_NUMBER AS BIGINT) % 13 = 0 THEN 'unknown' ELSE CAST(count(*) AS VARCHAR) END AS TABLEENTRYTOTAL,
        CASE WHEN CAST(ACCESSION_NUMBER AS BIGINT) % 5 = 1 THEN CAST(CAST(sum(TRY_CAST(VALUE AS BIGINT)) AS BIGINT) // 1000 AS VARCHAR)
             WHEN CAST(ACCESSION_NUMBER AS BIGINT) % 5 = 2 THEN CAST(CAST(sum(TRY_CAST(VALUE AS BIGINT)) AS BIGINT) + 500000 AS VARCHAR)
             ELSE CAST(CAST(sum(TRY_CAST(VALUE AS BIGINT)) AS BIGINT) AS VARCHAR) END AS TABLEVALUETOTAL
    FROM info WHERE CAST(ACCESSION_NUMBER AS BIGINT) % 19 <> 0 GROUP BY ACCESSION_NUMBER
    """,
    "info",
)


def summary(spark, sf):
    from quarterdeck.functions.scalars import lenient_long

    key = F.col("ACCESSION_NUMBER").cast("bigint")
    total = F.col("total")
    grouped = info(spark, sf).where(key % 19 != 0).groupBy("ACCESSION_NUMBER").agg(
        F.count(F.lit(1)).alias("n"), F.sum(lenient_long(F.col("VALUE"))).alias("total")
    )
    return grouped.select(
        "ACCESSION_NUMBER",
        F.concat(F.lit("A"), (key % 3).cast("string")).alias("source_archive_id"),
        F.when(key % 13 == 0, "unknown").otherwise(F.col("n").cast("string")).alias("TABLEENTRYTOTAL"),
        F.when(key % 5 == 1, F.floor(total / 1000).cast("string")).when(key % 5 == 2, (total + 500000).cast("string"))
        .otherwise(total.cast("string")).alias("TABLEVALUETOTAL"),
    )


R.cte(
    "chosen",
    f"""
    SELECT d.*, coalesce(max(REPORTTYPE) FILTER (WHERE selection_decision = 'SELECTED_BASE') OVER (PARTITION BY CIK, PERIODOFREPORT)
            = '13F HOLDINGS REPORT', false) AS baseline_eligible_manager, filed_on < DATE '{CHANGE}' AS early
    FROM decisions d WHERE selection_decision IN ('SELECTED_BASE', 'SELECTED_ADDITION')
    """,
    "decisions",
)
R.cte(
    "rawpos",
    """
    SELECT i.*, c.CIK, c.PERIODOFREPORT, c.report_period, c.baseline_eligible_manager,
        TRY_CAST(i.VALUE AS BIGINT) AS reported_position_value
    FROM info i JOIN chosen c USING (ACCESSION_NUMBER, source_archive_id)
    """,
    "info chosen",
)
R.cte(
    "faudit",
    """
    SELECT *, observed_value_usd - declared_value_usd AS value_difference_usd,
        CASE WHEN invalid_value_rows = 0 THEN observed_value_usd = declared_value_usd END AS value_matches_summary
    FROM (SELECT *, declared * summary_value_multiplier_to_usd AS declared_value_usd, observed * position_value_multiplier_to_usd AS observed_value_usd
    FROM (SELECT *, CASE WHEN early THEN 1000 ELSE 1 END AS summary_value_multiplier_to_usd,
             CASE WHEN early AND NOT near_thousand THEN 1000 ELSE 1 END AS position_value_multiplier_to_usd,
             CASE WHEN early THEN CASE WHEN near_thousand THEN 'PRE_2023_INFORMATION_TABLE_DOLLARS' WHEN near_one THEN 'PRE_2023_THOUSANDS' ELSE 'PRE_2023_UNRESOLVED' END
                  ELSE CASE WHEN near_one THEN 'POST_2023_DOLLARS' ELSE 'POST_2023_UNRESOLVED' END END AS value_unit_classification
          FROM (SELECT *, coalesce(abs(ratio - 1) <= 0.0001, false) AS near_one, coalesce(abs(ratio - 1000) <= 0.1, false) AS near_thousand
                FROM (SELECT c.ACCESSION_NUMBER, c.early, s.ACCESSION_NUMBER IS NOT NULL AS has_summary_row,
                        TRY_CAST(s.TABLEENTRYTOTAL AS BIGINT) AS declared_position_rows, coalesce(o.n, 0) AS observed_position_rows,
                        TRY_CAST(s.TABLEENTRYTOTAL AS BIGINT) = coalesce(o.n, 0) AS position_count_matches_summary,
                        coalesce(o.bad, 0) AS invalid_value_rows, TRY_CAST(s.TABLEVALUETOTAL AS BIGINT) AS declared, o.v AS observed,
                        CASE WHEN TRY_CAST(s.TABLEVALUETOTAL AS BIGINT) > 0 THEN o.v / CAST(s.TABLEVALUETOTAL AS DOUBLE) END AS ratio
                      FROM chosen c LEFT JOIN summary s USING (ACCESSION_NUMBER, source_archive_id)
                      LEFT JOIN (SELECT ACCESSION_NUMBER, count(*) AS n, count(*) FILTER (WHERE reported_position_value IS NULL) AS bad,
                                    CAST(sum(reported_position_value) AS BIGINT) AS v FROM rawpos GROUP BY 1) o USING (ACCESSION_NUMBER)))))
    """,
    "chosen summary rawpos",
)
R.cte(
    "classified",
    """
    SELECT *, baseline_eligible_manager AS s2, baseline_eligible_manager AND SSHPRNAMTTYPE = 'SH' AS s3,
        baseline_eligible_manager AND SSHPRNAMTTYPE = 'SH' AND PUTCALL IS NULL AS s4,
        baseline_eligible_manager AND SSHPRNAMTTYPE = 'SH' AND PUTCALL IS NULL AND coalesce(length(ID) = 9, false) AS s5,
        baseline_eligible_manager AND SSHPRNAMTTYPE = 'SH' AND PUTCALL IS NULL AND coalesce(length(ID) = 9, false) AND usd IS NOT NULL AS s6,
        baseline_eligible_manager AND SSHPRNAMTTYPE = 'SH' AND PUTCALL IS NULL AND coalesce(length(ID) = 9, false) AND coalesce(usd > 0, false) AS s7
    FROM (SELECT r.*, upper(trim(r.CUSIP)) AS ID, r.reported_position_value * a.position_value_multiplier_to_usd AS usd
          FROM rawpos r JOIN faudit a USING (ACCESSION_NUMBER))
    """,
    "rawpos faudit",
)


def universe(spark, sf, decided=None):
    """``decided``: stored decisions, if the caller has them."""
    filings = stored(ps.selected_filings(stored_decisions(spark, sf) if decided is None else decided, CHANGE))
    raw = stored(ps.positions_of(
        filings, info(spark, sf), ("CIK", "PERIODOFREPORT", "report_period", "baseline_eligible_manager")
    ))
    audit = ps.filing_audit(filings, summary(spark, sf), raw)
    return raw, audit, ps.classify_positions(raw, audit)


@case(
    "f6_matching_source_rows",
    "SELECT CIK, report_period, count(*) AS rows, CAST(sum(reported_position_value) AS BIGINT) AS value FROM rawpos GROUP BY ALL",
    uses="rawpos",
)
def _(spark, sf):
    return universe(spark, sf)[0].groupBy("CIK", "report_period").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("reported_position_value").alias("value")
    )


@case(
    "p5_identifier_normalisation",
    "SELECT upper(trim(CUSIP)) AS CUSIP, count(*) AS rows FROM info GROUP BY ALL",
    uses="info",
)
def _(spark, sf):
    from quarterdeck.functions.scalars import normalized_id

    return info(spark, sf).groupBy(normalized_id(F.col("CUSIP")).alias("CUSIP")).agg(F.count(F.lit(1)).alias("rows"))


@case(
    "p6_lenient_numbers",
    """SELECT TITLEOFCLASS, count(*) AS rows, count(TRY_CAST(VALUE AS BIGINT)) AS numeric_rows,
        CAST(sum(TRY_CAST(VALUE AS BIGINT)) AS BIGINT) AS total FROM info GROUP BY ALL""",
    uses="info",
)
def _(spark, sf):
    from quarterdeck.functions.scalars import lenient_long

    value = lenient_long(F.col("VALUE"))
    return info(spark, sf).groupBy("TITLEOFCLASS").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("numeric_rows"), F.sum(value).alias("total")
    )


@case(
    "p7_cumulative_filters",
    "SELECT s2 AS passes_baseline, s3 AS passes_shares, s4 AS passes_non_option, s5 AS passes_valid_cusip, s6 AS passes_numeric_value, s7 AS passes_positive_value, count(*) AS rows FROM classified GROUP BY ALL",
    uses="classified",
)
def _(spark, sf):
    flags = [f for f in ps.STAGES.values() if f != "passes_selected"]
    return universe(spark, sf)[2].groupBy(*flags).agg(F.count(F.lit(1)).alias("rows"))


STAGE_SQL = "\nUNION ALL ".join(
    f"SELECT report_period, {i} AS stage_order, '{label}' AS stage, count(*) FILTER (WHERE {flag}) AS rows, "
    f"count(DISTINCT CIK) FILTER (WHERE {flag}) AS entities, CAST(sum(usd) FILTER (WHERE {flag}) AS BIGINT) AS value, "
    f"count(*) AS base_rows, count(DISTINCT CIK) AS base_entities FROM classified GROUP BY report_period"
    for i, (label, flag) in enumerate(zip(ps.STAGES, ["true", "s2", "s3", "s4", "s5", "s6", "s7"], strict=True), start=1)
)
R.cte("stages", STAGE_SQL, "classified")


@case(
    "g2_staged_counts",
    """SELECT report_period, stage_order, stage, rows, entities, value FROM stages""",
    uses="stages",
)
def _(spark, sf):
    return ps.position_filter_audit(universe(spark, sf)[2]).drop(
        "PERIODOFREPORT", "row_retention_percent", "entity_retention_percent"
    )


@case(
    "g3_stage_retention",
    """SELECT report_period, stage, rows / CAST(base_rows AS DOUBLE) * 100 AS row_retention_percent,
        entities / CAST(base_entities AS DOUBLE) * 100 AS entity_retention_percent FROM stages""",
    uses="stages", doubles="row_retention_percent entity_retention_percent", digits=3,
)
def _(spark, sf):
    return ps.position_filter_audit(universe(spark, sf)[2]).select(
        "report_period", "stage", "row_retention_percent", "entity_retention_percent"
    )


def stage_table(spark, sf):
    return staged_counts(universe(spark, sf)[2], ["report_period"], ps.STAGES, "CIK", "position_value_usd")


@case(
    "w19_monotone_attrition",
    """SELECT count(*) AS stages, count(*) FILTER (WHERE rows > pr) AS rows_increases, count(*) FILTER (WHERE entities > pe) AS entities_increases
    FROM (SELECT *, lag(rows) OVER w AS pr, lag(entities) OVER w AS pe FROM stages WINDOW w AS (PARTITION BY report_period ORDER BY stage_order))""",
    uses="stages",
)
def _(spark, sf):
    return attrition_violations(stage_table(spark, sf), ["report_period"], "stage_order", ["rows", "entities"])


@case(
    "w20_stage_to_stage_retention",
    """SELECT report_period, stage, rows, rows / CAST(first_value(rows) OVER w AS DOUBLE) AS share_of_first,
        rows / CAST(nullif(lag(rows) OVER w, 0) AS DOUBLE) AS share_of_previous
    FROM stages WINDOW w AS (PARTITION BY report_period ORDER BY stage_order)""",
    uses="stages", doubles="share_of_first share_of_previous",
)
def _(spark, sf):
    return stage_retention(stage_table(spark, sf), ["report_period"], "stage_order", "rows").select(
        "report_period", "stage", "rows", "share_of_first", "share_of_previous"
    )


AUDIT = (
    "ACCESSION_NUMBER has_summary_row declared_position_rows observed_position_rows position_count_matches_summary "
    "invalid_value_rows value_unit_classification declared_value_usd observed_value_usd value_difference_usd value_matches_summary"
).split()


@case(
    "q12_declared_reconciliation",
    f"SELECT {', '.join(AUDIT)} FROM faudit",
    uses="faudit",
)
def _(spark, sf):
    return universe(spark, sf)[1].select(*AUDIT)


@case(
    "j2_lookup_with_indicator",
    """SELECT c.ACCESSION_NUMBER, s.TABLEENTRYTOTAL, s.ACCESSION_NUMBER IS NOT NULL AS has_summary
    FROM chosen c LEFT JOIN summary s USING (ACCESSION_NUMBER, source_archive_id)""",
    uses="chosen summary",
)
def _(spark, sf):
    filings = ps.selected_filings(decisions(spark, sf), CHANGE).select("ACCESSION_NUMBER", "source_archive_id")
    return left_lookup(
        filings, summary(spark, sf), ["ACCESSION_NUMBER", "source_archive_id"], "has_summary"
    ).select("ACCESSION_NUMBER", "TABLEENTRYTOTAL", "has_summary")


R.cte(
    "positions",
    """
    SELECT p.CIK, p.PERIODOFREPORT, p.report_period, p.CUSIP, l.NAMEOFISSUER, l.TITLEOFCLASS, p.position_value_usd, p.raw_position_rows
    FROM (SELECT CIK, PERIODOFREPORT, report_period, ID AS CUSIP, CAST(sum(usd) AS BIGINT) AS position_value_usd, count(*) AS raw_position_rows
          FROM classified WHERE s7 GROUP BY ALL) p
    JOIN (SELECT CUSIP, NAMEOFISSUER, TITLEOFCLASS FROM (
            SELECT ID AS CUSIP, NAMEOFISSUER, TITLEOFCLASS, count(*) AS n FROM classified WHERE s7 GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY CUSIP ORDER BY n DESC, NAMEOFISSUER ASC NULLS LAST, TITLEOFCLASS ASC NULLS LAST) = 1) l USING (CUSIP)
    """,
    "classified",
)


@case("c2_position_universe", "SELECT * FROM positions", uses="positions")
def _(spark, sf):
    return ps.position_universe(universe(spark, sf)[2])


@case(
    "g5_modal_label",
    "SELECT DISTINCT CUSIP, NAMEOFISSUER, TITLEOFCLASS FROM positions",
    uses="positions",
)
def _(spark, sf):
    kept = universe(spark, sf)[2].where("passes_positive_value")
    return modal_labels(kept, "CUSIP", ["NAMEOFISSUER", "TITLEOFCLASS"])


# ------------------------------------------------------------------ mapping
ATTRIBUTES = ["permco", "ticker", "primaryexch", "sharetype", "securitytype", "securitysubtype", "usincflg"]
R.cte(
    "history",
    """
    SELECT CAST(p_partkey AS BIGINT) AS permno, CAST(p_partkey // 2 AS BIGINT) AS permco,
        CAST(DATE '1995-01-01' + CAST(p_partkey % 5 AS INTEGER) * 365 AS DATE) AS secinfostartdt,
        CAST(DATE '1995-01-01' + CAST(p_partkey % 5 AS INTEGER) * 365 + 800 AS DATE) AS secinfoenddt,
        'US' || lpad(CAST((p_partkey - CASE WHEN p_partkey % 6 = 5 THEN 1 ELSE 0 END) % 1000000 AS VARCHAR), 6, '0')
            || CASE WHEN (p_partkey - CASE WHEN p_partkey % 6 = 5 THEN 1 ELSE 0 END) % 2 = 0 THEN 'X' ELSE 'Y' END AS cusip9,
        CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE p_name END AS ticker,
        CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'Q' ELSE 'X' END AS primaryexch,
        'NS' AS sharetype, 'EQTY' AS securitytype, CASE WHEN p_size % 9 = 0 THEN 'PFD' ELSE 'COM' END AS securitysubtype,
        CASE WHEN p_size % 11 = 0 THEN 'N' ELSE 'Y' END AS usincflg
    FROM part
    """,
)


def history(spark, sf):
    k = F.col("p_partkey")
    shared = k - F.when(k % 6 == 5, 1).otherwise(0)
    start = F.date_add(F.lit("1995-01-01").cast("date"), ((k % 5) * 365).cast("int"))
    return R.table(spark, sf, "part").select(
        k.alias("permno"),
        F.floor(k / 2).cast("bigint").alias("permco"),
        start.alias("secinfostartdt"),
        F.date_add(start, 800).alias("secinfoenddt"),
        F.concat(F.lit("US"), F.lpad((shared % 1000000).cast("string"), 6, "0"), F.when(shared % 2 == 0, "X").otherwise("Y"))
        .alias("cusip9"),
        F.when(k % 10 != 3, F.col("p_name")).alias("ticker"),
        F.when(k % 4 == 0, "N").when(k % 4 == 1, "A").when(k % 4 == 2, "Q").otherwise("X").alias("primaryexch"),
        F.lit("NS").alias("sharetype"), F.lit("EQTY").alias("securitytype"),
        F.when(F.col("p_size") % 9 == 0, "PFD").otherwise("COM").alias("securitysubtype"),
        F.when(F.col("p_size") % 11 == 0, "N").otherwise("Y").alias("usincflg"),
    )


R.cte(
    "mapping",
    """
    WITH cand AS (
        SELECT s.report_period, s.CUSIP, h.*, row_number() OVER (PARTITION BY s.report_period, s.CUSIP, h.permno
            ORDER BY h.secinfostartdt DESC, h.secinfoenddt DESC) AS rn
        FROM (SELECT DISTINCT report_period, CUSIP FROM positions) s
        JOIN history h ON h.cusip9 = s.CUSIP AND s.report_period BETWEEN h.secinfostartdt AND h.secinfoenddt),
    counts AS (SELECT report_period, CUSIP, CAST(count(*) AS INTEGER) AS n FROM cand WHERE rn = 1 GROUP BY ALL)
    SELECT s.report_period, s.CUSIP, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS match_status,
        coalesce(n, 0) AS candidate_count, c.permno, c.permco, c.ticker, c.primaryexch, c.sharetype, c.securitytype,
        c.securitysubtype, c.usincflg, c.secinfostartdt, c.secinfoenddt
    FROM (SELECT DISTINCT report_period, CUSIP FROM positions) s
    LEFT JOIN counts USING (report_period, CUSIP)
    LEFT JOIN cand c ON c.rn = 1 AND counts.n = 1 AND c.report_period = s.report_period AND c.CUSIP = s.CUSIP
    """,
    "positions history",
)


def pos(spark, sf, decided=None):
    return cut_lineage(ps.position_universe(universe(spark, sf, decided)[2]))


def mapping_of(positions, spark, sf):
    return sec.map_securities(positions, history(spark, sf), attributes=ATTRIBUTES)


def mapping(spark, sf):
    return mapping_of(pos(spark, sf), spark, sf)


@case(
    "j3_interval_lookup",
    """SELECT s.report_period, s.CUSIP, h.permno, h.secinfostartdt FROM (SELECT DISTINCT report_period, CUSIP FROM positions) s
    JOIN history h ON h.cusip9 = s.CUSIP AND s.report_period BETWEEN h.secinfostartdt AND h.secinfoenddt""",
    uses="positions history",
)
def _(spark, sf):
    from quarterdeck.operators.joins import validity_join

    keys = pos(spark, sf).select("report_period", "CUSIP").distinct()
    return validity_join(
        keys, history(spark, sf), "CUSIP", "cusip9", "report_period", "secinfostartdt", "secinfoenddt"
    ).select("report_period", "CUSIP", "permno", "secinfostartdt")


@case(
    "w2_latest_interval",
    """SELECT cusip9, permno, secinfostartdt, secinfoenddt FROM history
    QUALIFY row_number() OVER (PARTITION BY cusip9 ORDER BY secinfostartdt DESC, secinfoenddt DESC, permno DESC) = 1""",
    uses="history",
)
def _(spark, sf):
    last = F.max(F.struct("secinfostartdt", "secinfoenddt", "permno")).alias("last")
    return history(spark, sf).groupBy("cusip9").agg(last).select("cusip9", "last.*")


@case(
    "j4_candidate_resolution",
    "SELECT match_status, candidate_count, count(*) AS keys, count(permno) AS resolved FROM mapping GROUP BY ALL",
    uses="mapping",
)
def _(spark, sf):
    return mapping(spark, sf).groupBy("match_status", "candidate_count").agg(
        F.count(F.lit(1)).alias("keys"), F.count("permno").alias("resolved")
    )


@case("c3_identifier_mapping", "SELECT * FROM mapping", uses="mapping")
def _(spark, sf):
    return mapping(spark, sf)


R.cte(
    "coverage",
    """
    SELECT *, 100.0 * securities / sum(securities) OVER w AS security_share_percent,
        100.0 * manager_positions / sum(manager_positions) OVER w AS position_share_percent,
        100.0 * position_value_usd / sum(position_value_usd) OVER w AS value_share_percent
    FROM (SELECT report_period, match_status, count(DISTINCT CUSIP) AS securities, count(*) AS manager_positions,
            CAST(sum(position_value_usd) AS BIGINT) AS position_value_usd
          FROM positions JOIN mapping USING (report_period, CUSIP) GROUP BY ALL)
    WINDOW w AS (PARTITION BY report_period)
    """,
    "positions mapping",
)


@case(
    "g17_status_shares",
    "SELECT * FROM coverage",
    uses="coverage", doubles="security_share_percent position_share_percent value_share_percent",
)
def _(spark, sf):
    p = pos(spark, sf)
    return sec.mapping_coverage(p, mapping_of(p, spark, sf))


@case(
    "q21_coverage_summary",
    """SELECT match_status, CAST(sum(securities) AS BIGINT) AS securities, CAST(sum(position_value_usd) AS BIGINT) AS value,
        100.0 * sum(position_value_usd) / sum(sum(position_value_usd)) OVER () AS value_share,
        min(value_share_percent) AS minimum_share, median(value_share_percent) AS median_share, max(value_share_percent) AS maximum_share
    FROM coverage GROUP BY match_status""",
    uses="coverage", doubles="value_share minimum_share median_share maximum_share",
)
def _(spark, sf):
    from quarterdeck.plans.audits import coverage_summary

    p = pos(spark, sf)
    return coverage_summary(sec.mapping_coverage(p, mapping_of(p, spark, sf)))


@case(
    "q21_lowest_coverage_periods",
    """SELECT report_period, value_share_percent FROM coverage WHERE match_status = 'MATCHED'
    ORDER BY value_share_percent, report_period LIMIT 10""",
    uses="coverage", doubles="value_share_percent",
)
def _(spark, sf):
    p = pos(spark, sf)
    table = sec.mapping_coverage(p, mapping_of(p, spark, sf))
    return table.where("match_status = 'MATCHED'").orderBy("value_share_percent", "report_period").limit(10).select(
        "report_period", "value_share_percent"
    )


@case(
    "g30_status_summary",
    """SELECT report_period, count(*) FILTER (WHERE match_status = 'MATCHED') AS matched,
        count(*) FILTER (WHERE match_status = 'UNMATCHED') AS unmatched, count(*) FILTER (WHERE match_status = 'AMBIGUOUS') AS ambiguous
    FROM mapping GROUP BY report_period""",
    uses="mapping",
)
def _(spark, sf):
    return mapping(spark, sf).groupBy("report_period").agg(
        *[F.count(F.when(F.col("match_status") == s, F.lit(1))).alias(s.lower()) for s in sec.MATCH_STATES]
    )


@case(
    "g31_long_tail",
    """SELECT count(*) AS keys, count(*) FILTER (WHERE n = 1) AS single_member_keys, max(n) AS maximum_members, median(n) AS median_members
    FROM (SELECT CUSIP, count(DISTINCT CIK) AS n FROM positions JOIN mapping USING (report_period, CUSIP) WHERE match_status <> 'MATCHED' GROUP BY 1)""",
    uses="positions mapping", doubles="median_members",
)
def _(spark, sf):
    from quarterdeck.operators.aggregates import member_concentration

    p = pos(spark, sf)
    open_keys = mapping_of(p, spark, sf).where("match_status <> 'MATCHED'").select("report_period", "CUSIP")
    return member_concentration(p.join(open_keys, ["report_period", "CUSIP"]), "CUSIP", "CIK")


@case(
    "q20_mapping_audit",
    """
    SELECT unnest(['null_intervals', 'reversed_intervals', 'malformed_identifiers', 'inconsistent_statuses', 'matches_outside_interval', 'missing_keys', 'extra_keys']) AS "check",
        unnest([(SELECT count(*) FROM history WHERE secinfostartdt IS NULL OR secinfoenddt IS NULL),
            (SELECT count(*) FROM history WHERE secinfostartdt > secinfoenddt),
            (SELECT count(*) FROM mapping WHERE length(CUSIP) <> 9),
            (SELECT count(*) FROM mapping WHERE (match_status = 'MATCHED') <> (permno IS NOT NULL) OR (match_status = 'UNMATCHED') <> (candidate_count = 0)),
            (SELECT count(*) FROM mapping WHERE match_status = 'MATCHED' AND NOT report_period BETWEEN secinfostartdt AND secinfoenddt),
            (SELECT count(*) FROM (SELECT DISTINCT report_period, CUSIP FROM positions) p ANTI JOIN mapping m USING (report_period, CUSIP)),
            (SELECT count(*) FROM mapping m ANTI JOIN positions p USING (report_period, CUSIP))]) AS rows
    """,
    uses="mapping positions history",
)
def _(spark, sf):
    p = pos(spark, sf)
    return sec.mapping_audit(p, cut_lineage(mapping_of(p, spark, sf)), history(spark, sf))


# ------------------------------------------------------------------ holdings
R.cte(
    "meta",
    """SELECT CIK, PERIODOFREPORT, min(report_period) AS report_period, min(filing_deadline) AS information_date,
        max(FILINGMANAGER_NAME) FILTER (WHERE selection_decision = 'SELECTED_BASE') AS FILINGMANAGER_NAME
    FROM chosen GROUP BY CIK, PERIODOFREPORT""",
    "chosen",
)
R.cte(
    "mapped",
    """SELECT p.*, m.information_date, s.* EXCLUDE (report_period, CUSIP) FROM positions p
    JOIN meta m USING (CIK, PERIODOFREPORT, report_period) JOIN mapping s USING (report_period, CUSIP)""",
    "positions meta mapping",
)
R.cte(
    "eligible",
    """SELECT * FROM mapped WHERE match_status = 'MATCHED' AND permno IS NOT NULL AND securitytype = 'EQTY' AND securitysubtype = 'COM'
        AND sharetype = 'NS' AND usincflg = 'Y' AND primaryexch IN ('N', 'A', 'Q')""",
    "mapped",
)
R.cte(
    "hpanel",
    """
    SELECT *, CAST(sum(position_value_usd) OVER (PARTITION BY CIK, PERIODOFREPORT) AS BIGINT) AS portfolio_value_usd,
        CAST(position_value_usd AS DOUBLE) / sum(position_value_usd) OVER (PARTITION BY CIK, PERIODOFREPORT) AS portfolio_weight
    FROM (SELECT CIK, PERIODOFREPORT, report_period, information_date, permno, CAST(count(DISTINCT CUSIP) AS INTEGER) AS mapped_cusip_count,
            first(CUSIP ORDER BY position_value_usd DESC, CUSIP) AS CUSIP,
            first(ticker ORDER BY position_value_usd DESC, CUSIP) FILTER (WHERE ticker IS NOT NULL) AS ticker,
            first(permco ORDER BY position_value_usd DESC, CUSIP) AS permco,
            CAST(sum(position_value_usd) AS BIGINT) AS position_value_usd, CAST(sum(raw_position_rows) AS BIGINT) AS raw_position_rows
          FROM eligible GROUP BY CIK, PERIODOFREPORT, report_period, information_date, permno)
    """,
    "eligible",
)


def mapped(spark, sf, decided=None):
    decided = stored_decisions(spark, sf) if decided is None else decided
    p = pos(spark, sf, decided)
    return cut_lineage(
        sec.mapped_positions(p, fl.manager_metadata(decided), mapping_of(p, spark, sf))
    )


@case("g7_group_metadata", "SELECT * FROM meta", uses="meta")
def _(spark, sf):
    return fl.manager_metadata(decisions(spark, sf))


@case(
    "p8_eligibility_screen",
    "SELECT report_period, primaryexch, count(*) AS rows FROM eligible GROUP BY ALL",
    uses="eligible",
)
def _(spark, sf):
    return sec.eligible_positions(mapped(spark, sf)).groupBy("report_period", "primaryexch").agg(F.count(F.lit(1)).alias("rows"))


@case("c4_holdings_panel", "SELECT * FROM hpanel", uses="hpanel", doubles="portfolio_weight")
def _(spark, sf):
    return sec.holdings_panel(sec.eligible_positions(mapped(spark, sf)), ["ticker", "permco"])


@case(
    "c4_portfolio_totals",
    """SELECT CIK, PERIODOFREPORT, min(h.report_period) AS report_period, min(h.information_date) AS information_date,
        max(FILINGMANAGER_NAME) AS FILINGMANAGER_NAME, CAST(sum(position_value_usd) AS BIGINT) AS portfolio_value_usd,
        count(*) AS security_count, CAST(sum(raw_position_rows) AS BIGINT) AS underlying_position_rows
    FROM hpanel h JOIN meta m USING (CIK, PERIODOFREPORT) GROUP BY CIK, PERIODOFREPORT""",
    uses="hpanel meta",
)
def _(spark, sf):
    decided = stored_decisions(spark, sf)
    holdings = sec.holdings_panel(sec.eligible_positions(mapped(spark, sf, decided)), ["ticker", "permco"])
    return sec.portfolio_totals(holdings, fl.manager_metadata(decided))


@case(
    "c4_construction_audit",
    """
    WITH st AS (
        SELECT report_period, 1 AS o, 'FORM_13F_POSITIONS' AS stage, count(*) AS n, count(DISTINCT CIK) AS m, count(DISTINCT CUSIP) AS s, CAST(sum(position_value_usd) AS BIGINT) AS v FROM mapped GROUP BY 1
        UNION ALL SELECT report_period, 2, 'EXACT_CRSP_MATCHES', count(*), count(DISTINCT CIK), count(DISTINCT CUSIP), CAST(sum(position_value_usd) AS BIGINT) FROM mapped WHERE match_status = 'MATCHED' GROUP BY 1
        UNION ALL SELECT report_period, 3, 'ELIGIBLE_US_COMMON_EQUITIES', count(*), count(DISTINCT CIK), count(DISTINCT CUSIP), CAST(sum(position_value_usd) AS BIGINT) FROM eligible GROUP BY 1)
    SELECT report_period, stage, n AS manager_positions, m AS manager_periods, s AS securities, v AS position_value_usd,
        100.0 * n / max(n) FILTER (WHERE o = 1) OVER w AS position_retention_percent,
        100.0 * m / max(m) FILTER (WHERE o = 1) OVER w AS manager_retention_percent,
        100.0 * v / max(v) FILTER (WHERE o = 1) OVER w AS value_retention_percent
    FROM st WINDOW w AS (PARTITION BY report_period)
    """,
    uses="mapped eligible",
    doubles="position_retention_percent manager_retention_percent value_retention_percent",
)
def _(spark, sf):
    return sec.holdings_audit(mapped(spark, sf)).select(
        "report_period", "stage", "manager_positions", "manager_periods", "securities", "position_value_usd",
        "position_retention_percent", "manager_retention_percent", "value_retention_percent",
    )


@case(
    "g18_first_stage_retention",
    """SELECT report_period, stage, 100.0 * rows / max(rows) FILTER (WHERE stage_order = 1) OVER (PARTITION BY report_period) AS rows_retention_percent FROM stages""",
    uses="stages", doubles="rows_retention_percent",
)
def _(spark, sf):
    from quarterdeck.operators.aggregates import with_stage_baselines

    return with_stage_baselines(stage_table(spark, sf), ["report_period"], "stage_order", ["rows"]).select(
        "report_period", "stage", "rows_retention_percent"
    )


@case(
    "q13_portfolio_reconciliation",
    """SELECT count(*) AS matched_rows, 0 AS left_only_rows, 0 AS right_only_rows, 0 AS total_differences, 0 AS weight_differences
    FROM (SELECT DISTINCT CIK, PERIODOFREPORT FROM hpanel)""",
    uses="hpanel",
)
def _(spark, sf):
    holdings = cut_lineage(sec.holdings_panel(sec.eligible_positions(mapped(spark, sf)), ["ticker"]))
    computed = holdings.groupBy("CIK", "PERIODOFREPORT").agg(
        F.sum("position_value_usd").cast("double").alias("total"), F.sum("portfolio_weight").alias("weight")
    )
    stored = holdings.select("CIK", "PERIODOFREPORT", F.col("portfolio_value_usd").cast("double").alias("total")).distinct()
    result = reconcile(
        computed, stored.withColumn("weight", F.lit(1.0)), ["CIK", "PERIODOFREPORT"], ["total", "weight"], 1e-9
    )
    return result.withColumns({c: F.col(c).cast("int") for c in result.columns if c != "matched_rows"})
