from datetime import date

from finstrata.operators.drift import FIELDS as FIELD_TABLE
from finstrata.operators.drift import layout_changes, unified_table, union_types, placed_columns

FILES = [
    (1, 10, date(2020, 1, 1), "Accession_Number\tSEQ_NO\tNAME\tCIK", "x"),
    (2, 10, date(2020, 4, 1), "﻿ accession-number \tSEQUENCENUMBER\tname\tFilingDate", "x"),
    (3, 10, date(2020, 7, 1), "NAME\tACCESSION NUMBER\tSEQUENCENUMBER\tMYSTERY\tcode", "x"),
    (4, 11, date(2020, 2, 1), "ACCN\tFIRM", "x"),
    (5, 11, None, "ACCN\tFIRM", "x"),
    (6, None, date(2020, 1, 1), "ACCN\tFIRM", "x"),
    (7, 12, date(2020, 1, 1), None, "x"),
    (8, 12, date(2020, 2, 1), "CIK", "x"),
]
LINES = [
    (1, 1, "0000000001-20-000001\t1\tAlpha Bank\t0000000012"), (1, 2, "0000000001-20-000002\t2\tBeta Bank\t"), (1, 2, "0000000001-20-000002\t2\tBeta Bank\t"), (1, 3, ""), (1, 4, None),
    (2, 1, "0000000001-20-000001\t1.0\tAlpha Bank\t2020-03-01"), (2, 2, "0000000001-20-000002\t\tBeta Bank"),
    (3, 1, "Alpha Bank\t0000000001-20-000001\tM001\t2020-06-01\t801-12345678"),
    (4, 1, "0000000001-20-000001\tGamma Bank"), (99, 1, "orphan"),
]
SCHEMA = "file_id long, feed_id long, published_on date, header_line string, field string"


def test_changes_and_content(spark):
    files, lines = spark.createDataFrame(FILES, SCHEMA), spark.createDataFrame(LINES, "file_id long, line_no int, raw_line string")
    got = {(r.file_id, r.field_name, r.change_kind) for r in layout_changes(files, lines).collect()}
    assert got == {
        (2, "sequence_number", "renamed"), (2, "sequence_number", "retyped"), (2, "cik", "removed"), (2, "filing_date", "added"),
        (3, "sequence_number", "retyped"), (3, "filing_date", "renamed"), (3, "sec_file_number", "added"), (8, "cik", "added"),
    }


def test_one_table(spark):
    files, lines = spark.createDataFrame(FILES, SCHEMA), spark.createDataFrame(LINES, "file_id long, line_no int, raw_line string")
    assert union_types(placed_columns(files, lines))["sequence_number"] == "text"
    rows = {(r.file_id, r.line_no): r for r in unified_table(files, lines).collect()}
    assert len(rows) == 6
    assert rows[1, 2].name == "Beta Bank" and rows[1, 2].cik is None
    assert rows[3, 1].sec_file_number == "801-12345678" and rows[3, 1].sequence_number == "M001"


def test_unknown_headings_are_placed_by_the_profile_of_known_ones(spark):
    import random

    r = random.Random(2)
    number = lambda n: str(r.randrange(10 ** (n - 1), 10**n))
    files, lines = [], []
    for k in range(30):
        cik, crd = ("CIK", "CRD") if k < 5 else ("KEY_A", "KEY_B") if k % 2 else ("X1", "X2")
        swap = k % 3 == 0
        files.append((k, 1, date(2020, 1, 1 + k), "\t".join((crd, cik) if swap else (cik, crd)), "x"))
        for n in range(8):
            a, b = number(8).zfill(10), number(9)
            lines.append((k, n, "\t".join((b, a) if swap else (a, b))))
    f, x = spark.createDataFrame(files, SCHEMA), spark.createDataFrame(lines, "file_id long, line_no int, raw_line string")
    got = {(p.file_id, p.pos): p.field for p in placed_columns(f, x).collect()}
    assert got == {(k, at): ("cik", "crd_number")[at ^ (k % 3 == 0)] for k in range(30) for at in (0, 1)}
    # the same by cells alone where no heading is known: what isn't told apart goes to the first pattern
    bare = {k: ([], pattern) for k, (_, pattern) in FIELD_TABLE.items()}
    assert {p.field for p in placed_columns(f, x, bare).collect()} == {"cik"}


def test_empty(spark):
    files, lines = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "file_id long, line_no int, raw_line string")
    assert layout_changes(files, lines).count() == 0 and unified_table(files, lines).count() == 0
