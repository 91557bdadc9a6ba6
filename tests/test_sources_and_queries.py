import hashlib
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
from quarterdeck.operators import contracts as ct
from quarterdeck.sources import archives, tables
from tools.check_oracle import TABLES, canonical

SF = "/root/testdata/sf0.001"


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_archives_land_as_strings(spark, tmp_path):
    make_zip(tmp_path / "one.zip", {"x/SUBMISSION.tsv": "ID\tVALUE\n001\t10\n002\t\n", "meta.json": "{}"})
    make_zip(tmp_path / "two.zip", {"SUBMISSION.tsv": "VALUE\tID\n7\t003\n"})
    lines = archives.read_archives(spark, str(tmp_path), ["SUBMISSION.tsv"])
    rows = archives.member_table(lines, "SUBMISSION.tsv", ["ID", "VALUE"]).collect()
    assert {(r["source_archive_id"], r["ID"], r["VALUE"]) for r in rows} == {
        ("one", "001", "10"), ("one", "002", None), ("two", "003", "7"),
    }


def test_quoted_fields_hold_separators_quotes_and_breaks(spark, tmp_path):
    make_zip(tmp_path / "q.zip", {"T.tsv": 'A\tB\r\n"x\ty"\t"say ""no"""\r\n\r\n"two\nlines"\t\r\nshort\r\n'})
    rows = archives.member_table(archives.read_archives(spark, str(tmp_path), ["T.tsv"]), "T.tsv", ["A", "B", "C"]).collect()
    assert sorted((r["A"], r["B"], r["C"]) for r in rows) == [("short", None, None), ("two\nlines", None, None), ("x\ty", 'say "no"', None)]


def test_archives_are_landed_by_member(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        make_zip(tmp_path / "in" / f"a{i}.zip", {"ONE.tsv": f"K\n{i}\n", "TWO.tsv": f"V\n{i * 10}\n{i * 10 + 1}\n"})
    archives.land_archives(spark, str(tmp_path / "in"), {"ONE.tsv": ["K"], "TWO.tsv": ["V"]}, str(tmp_path / "out"))
    two = spark.read.parquet(str(tmp_path / "out" / "two"))
    assert sorted((r["source_archive_id"], int(r["V"])) for r in two.collect()) == [(f"a{i}", i * 10 + j) for i in range(3) for j in (0, 1)]
    assert spark.read.parquet(str(tmp_path / "out" / "one")).count() == 3


def test_files_are_tagged_by_their_path(spark, tmp_path):
    paths = {"one": tmp_path / "a b", "longer": tmp_path / "a b2", "partition": tmp_path / "x" / "c=d"}
    for i, path in enumerate(paths.values()):
        spark.range(i, i + 1).write.parquet(str(path))
    found = tables.read_tagged_parquet(spark, {k: str(p) for k, p in paths.items()}, ["id"], "tag").collect()
    assert {(r["id"], r["tag"]) for r in found} == {(0, "one"), (1, "longer"), (2, "partition")}


def test_fingerprint_of_ranges(spark):
    ids = [draw * 7919 % 100_003 for draw in range(3000)]
    frame = spark.createDataFrame([(i,) for i in ids + ids[:50]] + [(None,)], "k long").repartition(5)
    row = ct.universe_fingerprint(frame, "k").first()
    ranges = {}
    for text in sorted(map(str, set(ids))):
        ranges.setdefault(hashlib.sha256(text.encode()).hexdigest()[:2], []).append(text)
    digests = [hashlib.sha256("\n".join(ranges[r]).encode()).hexdigest() for r in sorted(ranges)]
    assert (row["entities"], row["digest"]) == (len(set(ids)), hashlib.sha256("\n".join(digests).encode()).hexdigest())
    assert ct.universe_fingerprint(frame.repartition(2), "k").first() == row
    assert ct.universe_fingerprint(frame.limit(0), "k").first()["entities"] == 0


@pytest.mark.parametrize("members", [{"other.tsv": "A\n"}, {"a/T.tsv": "A\n1\n", "b/T.tsv": "A\n1\n"}])
def test_missing_or_repeated_member_fails(spark, tmp_path, members):
    make_zip(tmp_path / "bad.zip", members)
    with pytest.raises(Exception, match="required members"):
        archives.read_archives(spark, str(tmp_path), ["T.tsv"]).collect()


def test_manifest_finds_changed_and_missing_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha")
    (tmp_path / "in" / "b.txt").write_text("beta")
    found = tables.file_digests(spark, str(tmp_path / "in"))
    manifest = spark.createDataFrame([("a.txt", "0" * 64), ("c.txt", "1" * 64)], "file_name string, digest string")
    states = {r["file_name"]: r["state"] for r in tables.manifest_differences(found, manifest).collect()}
    assert states == {"a.txt": "changed", "b.txt": "unexpected", "c.txt": "missing"}


def test_schema_drift(spark):
    signatures = ct.schema_signatures({("q1", "t"): ["A", "B"], ("q2", "t"): ["A", "B", "C"], ("q1", "u"): ["X"]}, spark)
    got = {r["table_name"]: (r["distinct_signatures"], r["partial_columns"]) for r in ct.schema_drift(signatures).collect()}
    assert got == {"t": (2, ["C"]), "u": (1, [])}


def test_contract_refuses_duplicates_and_wrong_columns(spark):
    frame = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ct.ContractError):
        ct.enforce_contract(frame, ["k", "v"], ["k"])
    with pytest.raises(ct.ContractError):
        ct.enforce_contract(frame, ["v", "k"], ["k", "v"])
    assert ct.enforce_contract(frame, ["k", "v"], ["k", "v"]).count() == 2


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["c15_market_features", "c16_downside_targets", "c1_filing_selection", "w11_score", "i4_event_window_metrics"])
def test_query_matches_sql(spark, name):
    frame = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = connection.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert canonical(rows, frame.columns) == canonical(result.fetchall(), names)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
