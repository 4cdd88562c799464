import zipfile
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from finstrata.sources import delimited as D
from finstrata.sources import markup as M
from finstrata.sources import sinks as K


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(" Name \tVALUE\nx \t1\ny\n")
    rows = D.read_tsv(spark, str(tmp_path / "a.tsv")).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("x", "1"), ("y", None)]
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("dir/INFOTABLE.tsv", "﻿ACCESSION\t value \n1-2-3\t 5 \n\n4-5-6\n")
        z.writestr("OTHER.tsv", "x\n1\n")
    got = D.read_zipped_tsv(spark, str(tmp_path), "infotable.tsv", ["value", "accession", "missing"]).collect()
    assert [tuple(r)[1:] for r in got] == [("5", "1-2-3", None), (None, "4-5-6", None)]
    (tmp_path / "c.csv").write_text('A,B\n"x, ""y""\nz",1\n')
    assert [tuple(r) for r in D.read_csv_records(spark, str(tmp_path / "c.csv")).collect()] == [('x, "y"\nz', "1")]


def test_feeds(spark):
    lines = spark.createDataFrame([(x,) for x in (D.SHORT_HEADER, "20240102|BRK/B|10|1|20|Q,N", "20240102|AB|x|0|5|B", "2")], "value string")
    rows, check = D.short_volumes(lines)
    assert [(r.symbol, r.short_volume) for r in rows.collect()] == [("BRK-B", Decimal("10.000000")), ("AB", None)]
    assert tuple(check.first()) == (True, 2, 2, 1)
    ftd = D.fails_to_deliver(spark.createDataFrame([("20240102|C1|AB|100|NAME|1.5",), ("bad|row",), ("20240103|C1|AB|x|NAME|.",), ("20240104|C2|CD|7|N|.",)], "value string"))
    assert [(r.settlement_date, r.quantity, r.price) for r in ftd.collect()] == [(date(2024, 1, 2), 100, Decimal("1.5000")), (date(2024, 1, 4), 7, None)]
    n = spark.createDataFrame([("1,234.5",), ("(12)",), (".",), ("N/A",), (None,)], "x string").select(D.tolerant_number(F.col("x")).alias("n")).collect()
    assert [None if r.n is None else float(r.n) for r in n] == [1234.5, -12.0, None, None, None]


INFO = """<?xml version="1.0"?><ns1:informationTable xmlns:ns1="http://x/y"><ns1:infoTable><ns1:nameOfIssuer>ACME</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>z9abc1234</ns1:cusip><ns1:value>1,200</ns1:value>
<ns1:shrsOrPrnAmt><ns1:sshPrnamt>10</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt><ns1:putCall>Put</ns1:putCall><ns1:investmentDiscretion>SOLE</ns1:investmentDiscretion><ns1:votingAuthority><ns1:Sole>10</ns1:Sole><ns1:Shared>0</ns1:Shared><ns1:None>0</ns1:None></ns1:votingAuthority></ns1:infoTable></ns1:informationTable>"""
FORM4 = """<ownershipDocument><documentType>4</documentType><issuer><issuerCik>0001</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>0002</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-02-03</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>12.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>900</value></sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_xml_filings(spark):
    r = M.information_tables(spark.createDataFrame([(1, INFO), (2, None), (3, "<informationTable/>")], "i int, x string"), "i", "x").collect()
    assert [(x.i, x.issuer, x.cusip, x.value, x.amount, x.option_type, x.sole) for x in r] == [(1, "ACME", "Z9ABC1234", 1200, 10, "Put", 10)]
    t = M.ownership_transactions(spark.createDataFrame([(1, FORM4), (2, "")], "i int, x string"), "i", "x").collect()
    assert [(x.kind, x.code, float(x.shares), float(x.price), x.transaction_date, x.owner_cik) for x in t] == [("NonDerivative", "S", 100.0, 12.5, date(2024, 2, 3), "0002")]
    cut = spark.createDataFrame([("<a><b>1</b></",), ("<a><b>1</b></a>",)], "x string").select(M.close_tags(F.col("x"), "a").alias("y")).collect()
    assert [c.y for c in cut] == ["<a><b>1</b></a>"] * 2


def test_envelopes_and_tables(spark):
    sub = "<SEC-DOCUMENT>\n<DOCUMENT>\n<TYPE>10-K\n<FILENAME>a.htm\n<TEXT>hello</TEXT>\n</DOCUMENT><DOCUMENT>\n<TYPE>EX-99\n<TEXT>cut off"
    got = M.envelope_documents(spark.createDataFrame([(1, sub), (2, None)], "i int, t string"), "i", "t").collect()
    assert [(r.seq, r.type, r.filename, r.body) for r in got] == [(0, "10-K", "a.htm", "hello"), (1, "EX-99", "", "cut off")]
    html = "<table><tr><th>A<th>B</th></tr><tr><td> 1&nbsp;2 </td><td><b>x</b></td></tr></table><p>no</p><table><tr><td>z</td></tr>"
    rows = M.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "<td>stray")], "i int, h string"), "i", "h").collect()
    assert [(r.table_no, r.row_no, r.cells) for r in rows][1:] == [(0, 1, ["1 2", "x"]), (1, 0, ["z"])]


IX = """<html><ix:header><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period><xbrldi:explicitMember dimension="srt:Axis">us:North</xbrldi:explicitMember></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:header><p>Revenue <ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="u" scale="6" sign="-">1,234.5</ix:nonFraction>
<ix:nonFraction name="us-gaap:None" contextRef="c1" unitRef="u" format="ixt:fixed-zero">—</ix:nonFraction><ix:nonNumeric name="dei:Name" contextRef="c1">Acme</ix:nonNumeric></p></html>"""
XB = """<xbrl><context id="a"><period><instant>2023-12-31</instant></period></context><unit id="s"><measure>shares</measure></unit><dei:Shares contextRef="a" unitRef="s">77</dei:Shares></xbrl>"""


def test_xbrl(spark):
    rows = M.xbrl_facts(spark.createDataFrame([(1, IX), (2, XB), (3, None)], "i int, h string"), "i", "h").collect()
    by = {r.concept.lower(): r for r in rows}
    rev = by["us-gaap:revenues"]
    assert (rev.value, rev.period_start, rev.period_end, rev.unit, rev.members) == (Decimal("-1234500000.000000"), date(2023, 1, 1), date(2023, 12, 31), "iso4217:USD", {"srt:Axis": "us:North"})
    assert by["us-gaap:none"].value == 0 and by["dei:name"].text == "Acme" and by["dei:name"].value is None
    assert by["dei:shares"].value == 77 and by["dei:shares"].period_end == date(2023, 12, 31)
    assert M.fact_value("(3)", None, None) == -3 and M.fact_value("x", "3", None) is None


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 20), (4, "d", 40)], "k int, s string, n int")
    assert sorted(tuple(r) for r in K.upsert(old, new, ["k"]).collect()) == [(1, "a", 1), (2, None, 20), (3, None, 3), (4, "d", 40)]
    assert sorted(tuple(r) for r in K.upsert(old, new, ["k"], ["n"]).collect())[1] == (2, "b", 20)
    assert K.delete_where(old, F.col("s") == "a").count() == 2
    p = str(tmp_path / "t")
    K.replace_partitions(old, p, ["k"])
    K.replace_partitions(new, p, ["k"])
    assert sorted((r.k, r.n) for r in K.read_table(spark, p).collect()) == [(1, 1), (2, 20), (3, 3), (4, 40)]
    K.append(spark.createDataFrame([("z", 9, 9)], "s string, n int, k int"), p, ["k"])
    assert K.read_table(spark, p).count() == 5
    K.write_csv(spark.createDataFrame([("=x", 'a "q", b', 1)], "a string, b string, c int").coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines() == ["a,b,c", "'=x,\"a \"\"q\"\", b\",1"]
    df = spark.createDataFrame([("a|b", None), ("c", 2)], "s string, n int")
    assert K.markdown_table(df).splitlines() == ["| s | n |", "| --- | --- |", "| a\\|b |  |", "| c | 2 |"]
    assert K.compact_table(df).splitlines() == ["s\tn", "a|b\t", "c\t2"]
    assert K.compact_table(spark.createDataFrame([("a\tb", 1)], "s string, n int")).startswith("| s |")
