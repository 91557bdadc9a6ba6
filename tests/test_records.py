from datetime import date

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions.dates import filing_deadline
from quarterdeck.operators.joins import with_filing_deadline
from quarterdeck.plans import filings as fl
from quarterdeck.plans import positions as ps
from quarterdeck.plans import securities as sec
from workload import recipes

SUB = "ACCESSION_NUMBER string, source_archive_id string, CIK string, PERIODOFREPORT string, FILING_DATE string, SUBMISSIONTYPE string"
COVER = "ACCESSION_NUMBER string, ISAMENDMENT string, AMENDMENTNO string, AMENDMENTTYPE string, FILINGMANAGER_NAME string, REPORTTYPE string"
HOLD = "13F HOLDINGS REPORT"


@pytest.fixture(scope="module")
def decisions(spark):
    q, f = "31-MAR-2024", "10-MAY-2024"
    submissions = [
        ("a", "z", "1", q, f, "13F-HR"), ("b", "z", "1", q, f, "13F-HR/A"), ("c", "z", "1", q, f, "13F-HR/A"),
        ("d", "z", "2", q, f, "13F-NT"), ("e", "z", "3", q, "20-JUN-2024", "13F-HR"), ("f", "z", "4", q, f, "13F-HR"),
        ("g", "z", "5", q, f, "13F-HR/A"), ("h", "z", "6", "31-DEC-2010", "10-JAN-2011", "13F-HR"),
        ("i", "z", "7", "31-DEC-2025", "17-FEB-2026", "13F-HR"),
    ]
    covers = [
        ("a", "N", None, None, "one", HOLD), ("b", "Y", "1", "RESTATEMENT", "one", HOLD),
        ("c", "Y", "2", "NEW HOLDINGS", "one", HOLD), ("d", "N", None, None, "two", "13F NOTICE"),
        ("e", "N", None, None, "three", HOLD), ("f", "N", None, None, "four", "13F NOTICE"),
        ("g", "Y", "1", "NEW HOLDINGS", "five", HOLD), ("h", "N", None, None, "six", HOLD),
        ("i", "N", None, None, "seven", HOLD),
    ]
    return fl.select_filings(
        spark.createDataFrame(submissions, SUB), spark.createDataFrame(covers, COVER), "2013-06-30", "2025-12-31"
    )


def test_every_decision_label(decisions):
    got = {r["ACCESSION_NUMBER"]: r["selection_decision"] for r in decisions.collect()}
    assert got == {
        "a": "SUPERSEDED", "b": "SELECTED_BASE", "c": "SELECTED_ADDITION", "d": "NOTICE_EXCLUDED",
        "e": "FILED_AFTER_DEADLINE", "f": "CLASSIFICATION_DISAGREEMENT", "g": "UNRESOLVED",
        "h": "OUTSIDE_SAMPLE_PERIOD", "i": "SELECTED_BASE",
    }


def test_deadline_rolls_over_presidents_day(spark):
    day = spark.range(1).select(filing_deadline(F.lit("2025-12-31").cast("date")).alias("d")).first()["d"]
    assert day == date(2026, 2, 17)


def test_deadlines_come_from_a_table_and_beyond_it_from_the_rules(spark):
    days = [date(1899, 12, 30), date(1900, 1, 1), date(2025, 12, 31), date(2100, 12, 31), date(2101, 1, 1), None]
    frame = spark.createDataFrame([(d,) for d in days], "report_period date")
    got = with_filing_deadline(frame)
    assert got.columns == ["report_period", "information_date"]
    expected = frame.withColumn("information_date", filing_deadline(F.col("report_period")))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_holdings_and_samples_take_one_shuffle(spark):
    for build in (recipes.holdings, recipes.sample):
        plan = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert plan.count("lineitem.parquet") == 1


def test_selection_invariants_hold(decisions):
    row = fl.selection_invariants(decisions).first().asDict()
    assert row.pop("groups_with_one_base") == 2
    assert not any(row.values())


def test_units_filters_and_wrong_archive(spark):
    filings = spark.createDataFrame(
        [("a", "z1", "A", "q", date(2022, 9, 30), True, True), ("b", "z1", "B", "q", date(2022, 9, 30), True, True),
         ("c", "z2", "C", "q", date(2024, 9, 30), True, False)],
        "ACCESSION_NUMBER string, source_archive_id string, CIK string, PERIODOFREPORT string, report_period date, "
        "baseline_eligible_manager boolean, is_pre_value_unit_change boolean",
    )
    info = spark.createDataFrame(
        [("a", "z1", "N1", "COM", " abcdefgh1 ", "10", "SH", None), ("a", "z1", "N1", "COM", "ABCDEFGH1", "30", "SH", None),
         ("a", "z2", "N1", "COM", "ABCDEFGH1", "999", "SH", None),
         ("b", "z1", "N2", None, "ABCDEFGH2", "2000", "SH", None), ("b", "z1", "N2", None, "ABCDEFGH2", "bad", "SH", None),
         ("c", "z2", "N1", "COM", "ABCDEFGH1", "5", "PRN", None), ("c", "z2", "N1", "COM", "ABCDEFGH1", "7", "SH", "Call"),
         ("c", "z2", "N1", "COM", "ABCDEFGH1", "9", "SH", None)],
        "ACCESSION_NUMBER string, source_archive_id string, NAMEOFISSUER string, TITLEOFCLASS string, CUSIP string, "
        "VALUE string, SSHPRNAMTTYPE string, PUTCALL string",
    )
    summary = spark.createDataFrame(
        [("a", "z1", "2", "40"), ("b", "z1", "2", "2"), ("c", "z2", "x", "21")],
        "ACCESSION_NUMBER string, source_archive_id string, TABLEENTRYTOTAL string, TABLEVALUETOTAL string",
    )
    raw = ps.positions_of(filings, info, ("CIK", "PERIODOFREPORT", "report_period", "baseline_eligible_manager"))
    audit = ps.filing_audit(filings, summary, raw)
    rows = {r["ACCESSION_NUMBER"]: r for r in audit.collect()}
    assert rows["a"]["value_unit_classification"] == "PRE_2023_THOUSANDS"
    assert rows["b"]["value_unit_classification"] == "PRE_2023_INFORMATION_TABLE_DOLLARS"
    assert rows["b"]["value_matches_summary"] is None
    assert rows["c"]["value_unit_classification"] == "POST_2023_DOLLARS"
    assert rows["c"]["position_count_matches_summary"] is None
    positions = {r["CIK"]: r for r in ps.position_universe(ps.classify_positions(raw, audit)).collect()}
    assert {k: v["position_value_usd"] for k, v in positions.items()} == {"A": 40000, "B": 2000, "C": 9}
    assert positions["A"]["raw_position_rows"] == 2


def test_mapping_states(spark):
    keys = spark.createDataFrame([(date(2020, 3, 31), c) for c in ("AAA", "BBB", "CCC")], "report_period date, CUSIP string")
    history = spark.createDataFrame(
        [(1, date(2000, 1, 1), date(2030, 1, 1), "aaa "), (2, date(2000, 1, 1), date(2030, 1, 1), "BBB"),
         (3, date(2010, 1, 1), date(2030, 1, 1), "BBB"), (4, date(2000, 1, 1), date(2010, 1, 1), "CCC")],
        "permno long, secinfostartdt date, secinfoenddt date, cusip9 string",
    )
    got = {r["CUSIP"]: (r["match_status"], r["candidate_count"], r["permno"]) for r in sec.map_securities(keys, history).collect()}
    assert got == {"AAA": ("MATCHED", 1, 1), "BBB": ("AMBIGUOUS", 2, None), "CCC": ("UNMATCHED", 0, None)}


def test_holdings_queries_decide_on_filings_once(spark, monkeypatch):
    from workload import CASES, records

    calls, real = [], records.decisions
    monkeypatch.setattr(records, "decisions", lambda *a: (calls.append(1), real(*a))[1])
    for name in ("c4_holdings_panel", "c4_portfolio_totals"):
        calls.clear()
        CASES[name].build(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1
