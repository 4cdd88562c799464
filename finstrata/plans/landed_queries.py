"""Queries over landed files: whole tables are written in a source's format, read by its operator and
compared with the table; formats that no table fills are told by literal rows."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.functions import documents as D
from finstrata.functions import text as T
from finstrata.plans.incremental_queries import _folder
from finstrata.plans.views import day
from finstrata.sources import delimited, markup, sinks
from finstrata.streaming import incremental as I

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag(name: str, c, inner: str | None = None) -> Column:
    """<name>text</name>, or nothing for null."""
    text = _escaped((F.col(c) if isinstance(c, str) else c).cast("string"))
    a, b = (f"<{name}>", f"</{name}>") if inner is None else (f"<{name}><{inner}>", f"</{inner}></{name}>")
    return F.coalesce(F.concat(F.lit(a), text, F.lit(b)), F.lit(""))


@query("""SELECT DISTINCT holding_id, trim(title_of_class) AS title_of_class, upper(trim(cusip)) AS cusip, value, shares AS amount, share_type AS amount_type, option_type, investment_discretion AS discretion,
voting_auth_sole AS sole, voting_auth_shared AS shared, voting_auth_none AS "none" FROM institutional_holding WHERE filing_type = 'Form13F'""")
def src_information_tables(spark: SparkSession, d: str) -> DataFrame:
    """All holdings as information tables by filing, read back."""
    cols = ["holding_id", "accession_number", "title_of_class", "cusip", "value", "shares", "share_type", "option_type", "investment_discretion", "voting_auth_sole", "voting_auth_shared", "voting_auth_none"]
    rows = table(spark, d, "institutional_holding").filter(F.col("filing_type") == "Form13F").select(*cols).distinct()
    line = F.concat(
        F.lit("<n1:infoTable>"), _tag("n1:nameOfIssuer", "holding_id"), _tag("n1:titleOfClass", "title_of_class"), _tag("n1:cusip", "cusip"), _tag("n1:value", "value"), F.lit("<n1:shrsOrPrnAmt>"), _tag("n1:sshPrnamt", "shares"),
        _tag("n1:sshPrnamtType", "share_type"), F.lit("</n1:shrsOrPrnAmt>"), _tag("n1:putCall", "option_type"), _tag("n1:investmentDiscretion", "investment_discretion"), F.lit("<n1:votingAuthority>"), _tag("n1:Sole", "voting_auth_sole"),
        _tag("n1:Shared", "voting_auth_shared"), _tag("n1:None", "voting_auth_none"), F.lit("</n1:votingAuthority></n1:infoTable>"),
    )
    docs = rows.groupBy("accession_number").agg(F.concat(F.lit('<?xml version="1.0"?><n1:informationTable xmlns:n1="urn:x">'), F.array_join(F.collect_list(line), "\n"), F.lit("</n1:informationTable>")).alias("xml"))
    return markup.information_tables(docs, "accession_number", "xml").select(
        F.col("issuer").cast("bigint").alias("holding_id"), "title_of_class", "cusip", "value", "amount", "amount_type", "option_type", "discretion", "sole", "shared", "none"
    )


@query("""SELECT DISTINCT transaction_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, transaction_code AS code, CAST(shares AS DOUBLE) AS shares, CAST(price_per_share AS DOUBLE) AS price, acquired_disposed,
CAST(shares_owned_after AS DOUBLE) AS owned_after, ownership_nature AS nature, security_title FROM insider_transaction""")
def src_ownership_transactions(spark, d):
    """All insider transactions as ownership forms, read back."""
    cols = ["transaction_id", "transaction_date", "transaction_code", "shares", "price_per_share", "acquired_disposed", "shares_owned_after", "ownership_nature", "security_title"]
    rows = table(spark, d, "insider_transaction").select(*cols).distinct()
    xml = F.concat(
        F.lit('<?xml version="1.0"?><ownershipDocument><documentType>4</documentType><nonDerivativeTable><nonDerivativeTransaction>'), _tag("securityTitle", "security_title", "value"), _tag("transactionDate", day("transaction_date"), "value"),
        F.lit("<transactionCoding>"), _tag("transactionCode", "transaction_code"), F.lit("</transactionCoding><transactionAmounts>"), _tag("transactionShares", "shares", "value"), _tag("transactionPricePerShare", "price_per_share", "value"),
        _tag("transactionAcquiredDisposedCode", "acquired_disposed", "value"), F.lit("</transactionAmounts><postTransactionAmounts>"), _tag("sharesOwnedFollowingTransaction", "shares_owned_after", "value"),
        F.lit("</postTransactionAmounts><ownershipNature>"), _tag("directOrIndirectOwnership", "ownership_nature", "value"), F.lit("</ownershipNature></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"),
    )
    got = markup.ownership_transactions(rows.select("transaction_id", xml.alias("xml")), "transaction_id", "xml")
    return got.select("transaction_id", day("transaction_date").alias("transaction_date"), "code", *[F.col(c).cast("double").alias(c) for c in ("shares", "price")], "acquired_disposed", F.col("owned_after").cast("double").alias("owned_after"), "nature", "security_title")


_OWN = """<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerCik>11</rptOwnerCik></reportingOwnerId></reportingOwner><reportingOwner><reportingOwnerId><rptOwnerCik>12</rptOwnerCik></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeHolding><securityTitle><value>Common Stock</value></securityTitle><postTransactionAmounts><sharesOwnedFollowingTransaction><value>1200.5</value></sharesOwnedFollowingTransaction></postTransactionAmounts>
<ownershipNature><directOrIndirectOwnership><value>I</value></directOrIndirectOwnership></ownershipNature></nonDerivativeHolding></nonDerivativeTable>
<derivativeTable><derivativeHolding><securityTitle><value>Option</value></securityTitle></derivativeHolding></derivativeTable></ownershipDocument>"""


@query("SELECT * REPLACE (CAST(owned AS DOUBLE) AS owned) FROM (VALUES (1, 'NonDerivative', '11,12', 'Common Stock', 1200.5, 'I'), (1, 'Derivative', '11,12', 'Option', NULL, NULL)) AS t(form_id, kind, owner_ciks, security_title, owned, nature)")
def src_ownership_holdings(spark, d):
    """Holdings without a transaction, for all owners of a form."""
    got = markup.ownership_holdings(spark.createDataFrame([(1, _OWN), (2, None)], "form_id int, xml string"), "form_id", "xml")
    return got.select("form_id", "kind", "owner_ciks", "security_title", F.col("owned").cast("double").alias("owned"), "nature")


_COVER = """<?xml version="1.0"?><e:edgarSubmission xmlns:e="urn:y"><e:formData><e:coverPage><e:reportCalendarOrQuarter>12-31-2024</e:reportCalendarOrQuarter><e:isAmendment>true</e:isAmendment><e:amendmentInfo><e:amendmentType>RESTATEMENT</e:amendmentType></e:amendmentInfo>
<e:filingManager><e:name> Ulmis Capital LP </e:name></e:filingManager><e:form13FFileNumber>028-12345</e:form13FFileNumber><e:otherManagersInfo><e:otherManager><e:name>One LLC</e:name></e:otherManager><e:otherManager><e:name>Two Inc.</e:name></e:otherManager></e:otherManagersInfo></e:coverPage>
<e:summaryPage><e:tableEntryTotal>1,204</e:tableEntryTotal><e:tableValueTotal>98765432</e:tableValueTotal></e:summaryPage></e:formData></e:edgarSubmission>"""
_PLAIN_COVER = "<edgarSubmission><formData><coverPage><reportCalendarOrQuarter>2024-09-30</reportCalendarOrQuarter></coverPage></formData></edgarSubmission>"


@query("""SELECT * REPLACE (CAST(entries AS BIGINT) AS entries, CAST("value" AS BIGINT) AS "value") FROM (VALUES (1, '2024-12-31', true, 'RESTATEMENT', 'Ulmis Capital LP', '028-12345', 1204, 98765432, 'One LLC;Two Inc.'), (2, '2024-09-30', false, NULL, NULL, NULL, NULL, NULL, ''), (3, NULL, false, NULL, NULL, NULL, NULL, NULL, ''))
AS t(filing_id, report_date, is_amendment, amendment_type, manager, file_number, entries, "value", other_managers)""")
def src_cover_pages(spark, d):
    got = markup.cover_pages(spark.createDataFrame([(1, _COVER), (2, _PLAIN_COVER), (3, None)], "filing_id int, xml string"), "filing_id", "xml")
    return got.withColumn("report_date", day("report_date"))


_STAKE = """<edgarSubmission><formData><coverPageHeader><issuerInfo><issuerCik>0000001234</issuerCik><issuerCusip> 12345a108 </issuerCusip></issuerInfo></coverPageHeader>
<coverPageHeaderReportingPersonDetails><reportingPersonName>A Fund</reportingPersonName><reportingPersonBeneficiallyOwnedNumberOfShares><soleVotingPower>1,000</soleVotingPower><sharedVotingPower>0</sharedVotingPower></reportingPersonBeneficiallyOwnedNumberOfShares>
<reportingPersonBeneficiallyOwnedAggregateNumberOfShares>1,000</reportingPersonBeneficiallyOwnedAggregateNumberOfShares><classPercent>5.1%</classPercent></coverPageHeaderReportingPersonDetails>
<coverPageHeaderReportingPersonDetails><reportingPersonName>B Person</reportingPersonName><classPercent>9.9</classPercent></coverPageHeaderReportingPersonDetails></formData></edgarSubmi"""


@query("""SELECT * REPLACE (CAST(sole_voting AS DOUBLE) AS sole_voting, CAST(shared_voting AS DOUBLE) AS shared_voting, CAST(shares AS DOUBLE) AS shares, CAST(percent AS DOUBLE) AS percent) FROM (VALUES (1, 0, '0000001234', '12345A108', 'A Fund', 1000.0, 0.0, 1000.0, 5.1), (1, 1, '0000001234', '12345A108', 'B Person', NULL, NULL, NULL, 9.9)) AS t(filing_id, line, issuer_cik, cusip, person, sole_voting, shared_voting, shares, percent)""")
def src_ownership_stakes(spark, d):
    """Reporting persons of a schedule whose last tag was cut off."""
    got = markup.ownership_stakes(spark.createDataFrame([(1, _STAKE), (2, None)], "filing_id int, xml string"), "filing_id", "xml")
    return got.select("filing_id", "line", "issuer_cik", "cusip", "person", *[F.col(c).cast("double").alias(c) for c in ("sole_voting", "shared_voting", "shares", "percent")])


@query("""SELECT DISTINCT revenue_row_id, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, trim(unit) AS unit, CAST(value AS DOUBLE) AS value, axis, member
FROM dimensional_revenue_row WHERE value IS NOT NULL AND period_end IS NOT NULL AND axis IS NOT NULL AND member IS NOT NULL""")
def src_xbrl_facts(spark, d):
    """All revenue rows as inline XBRL by stock, read back."""
    cols = ["revenue_row_id", "common_stock_id", "axis", "member", "period_start", "period_end", "value", "unit"]
    rows = table(spark, d, "dimensional_revenue_row").select(*cols).distinct().filter("value IS NOT NULL AND period_end IS NOT NULL AND axis IS NOT NULL AND member IS NOT NULL")
    r = F.col("revenue_row_id").cast("string")
    dates = F.when(F.col("period_start").isNull(), _tag("xbrli:instant", day("period_end"))).otherwise(F.concat(_tag("xbrli:startDate", day("period_start")), _tag("xbrli:endDate", day("period_end"))))
    unit = F.coalesce(F.concat(F.lit('<xbrli:unit id="u'), r, F.lit('">'), _tag("xbrli:measure", "unit"), F.lit("</xbrli:unit>")), F.lit(""))
    fact = F.concat(
        F.lit('<xbrli:context id="c'), r, F.lit('"><xbrldi:explicitMember dimension="'), F.col("axis"), F.lit('">'), F.col("member"), F.lit("</xbrldi:explicitMember>"), dates, F.lit("</xbrli:context>"),
        F.when(F.col("unit").isNotNull(), unit).otherwise(F.lit("")), F.lit('<ix:nonFraction name="x:r'), r, F.lit('" contextRef="c'), r,
        F.when(F.col("unit").isNotNull(), F.concat(F.lit('" unitRef="u'), r)).otherwise(F.lit("")), F.when(F.col("value") < 0, '" sign="-').otherwise(""), F.lit('" scale="0">'), F.abs("value").cast("string"), F.lit("</ix:nonFraction>"),
    )
    docs = rows.groupBy("common_stock_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list(fact), "\n"), F.lit("</body></html>")).alias("html"))
    got = markup.xbrl_facts(docs, "common_stock_id", "html")
    return got.select(
        F.substring("concept", 4, 30).cast("bigint").alias("revenue_row_id"), day("period_start").alias("period_start"), day("period_end").alias("period_end"), "unit", F.col("value").cast("double").alias("value"),
        F.get(F.map_keys("members"), 0).alias("axis"), F.get(F.map_values("members"), 0).alias("member"),
    )


@query(r"""SELECT coalesce(industry, '') AS industry, CAST(row_number() OVER (PARTITION BY coalesce(industry, '') ORDER BY common_stock_id) - 1 AS INT) AS row_no,
common_stock_id || '|' || trim(regexp_replace(coalesce(ticker, ''), '\s+', ' ', 'g')) || '|' || trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g')) AS cells FROM common_stock""")
def src_html_tables(spark, d):
    """Each industry's stocks as a page with a table (the last tags missing), read back."""
    s = table(spark, d, "common_stock").select(F.coalesce("industry", F.lit("")).alias("industry"), "common_stock_id", *[F.coalesce(_escaped(F.col(c)), F.lit("")).alias(c) for c in ("ticker", "name")])
    row = F.concat(F.lit("<tr><td>"), F.col("common_stock_id").cast("string"), F.lit("</td>\n<td> "), F.col("ticker"), F.lit("</td><td>"), F.col("name"), F.lit("</td></tr>"))
    pages = s.groupBy("industry").agg(F.array_sort(F.collect_list(F.struct("common_stock_id", row.alias("row")))).alias("rows"))
    docs = pages.select("industry", F.concat(F.lit("<html><table>"), F.array_join(F.transform("rows", lambda x: x["row"]), "")).alias("html"))
    return markup.html_tables(docs, "industry", "html").select("industry", "row_no", F.array_join("cells", "|").alias("cells"))


_PAGE = """<table><tr><th>INCOME STATEMENT - USD ($) $ in Millions</th><th>12 Months Ended</th></tr><tr><th>Sep. 30, 2023</th><th>Sep. 24, 2022</th></tr>
<tr><td>Net sales</td><td>$ 383,285</td><td>$ 394,328</td></tr><tr><td>Other</td><td>[1]</td><td>(565)</td><td>(334)</td></tr><tr><td>Heading</td><td></td><td></td></tr></table>"""


@query("SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM (VALUES (1, 2, 'Net sales', 0, '2023-09-30', 383285.0, 1000000), (1, 2, 'Net sales', 1, '2022-09-24', 394328.0, 1000000), (1, 3, 'Other', 0, '2023-09-30', -565.0, 1000000), (1, 3, 'Other', 1, '2022-09-24', -334.0, 1000000)) AS t(page_id, row_no, label, column_no, period, value, scale)")
def src_statement_pages(spark, d):
    got = markup.statement_pages(spark.createDataFrame([(1, _PAGE), (2, None), (3, "<p>no table")], "page_id int, html string"), "page_id", "html")
    return got.select("page_id", "row_no", "label", "column_no", day("period").alias("period"), F.col("value").cast("double").alias("value"), "scale")


@query("SELECT doc_id, 'EX-' || lang AS type, 'd' || doc_id || '.txt' AS filename, length(text) AS n_chars, md5(text) AS body_md5 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def src_envelopes(spark, d):
    """All texts as documents of SGML submissions, read back."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "text").filter("text IS NOT NULL AND lang IS NOT NULL")
    sgml = F.concat(F.lit("<SEC-HEADER>x</SEC-HEADER>\n<DOCUMENT>\n<TYPE>EX-"), "lang", F.lit("\n<FILENAME>d"), F.col("doc_id").cast("string"), F.lit(".txt\n<TEXT>"), "text", F.lit("</TEXT>\n</DOCUMENT>\n"))
    got = markup.envelope_documents(rows.select("doc_id", sgml.alias("sgml")), "doc_id", "sgml")
    return got.select("doc_id", "type", "filename", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("body_md5"))


@query("""SELECT DISTINCT accession_number AS path, '13F-HR' AS form, 'HOLDER ' || institutional_holder_id AS company, lpad(CAST(institutional_holder_id AS VARCHAR), 10, '0') AS cik, strftime(filing_date, '%Y-%m-%d') AS filed
FROM institutional_holding WHERE filing_type = 'Form13F' AND accession_number IS NOT NULL AND institutional_holder_id IS NOT NULL AND filing_date IS NOT NULL""")
def src_index_rows(spark, d):
    """All filings as lines of a daily index, read back."""
    r = table(spark, d, "institutional_holding").filter("filing_type = 'Form13F' AND accession_number IS NOT NULL AND institutional_holder_id IS NOT NULL AND filing_date IS NOT NULL").select("institutional_holder_id", "filing_date", "accession_number").distinct()
    who = F.col("institutional_holder_id").cast("string")
    lines = r.select(F.concat(F.lit("13F-HR         HOLDER "), who, F.lit("      "), who, F.lit("     "), F.date_format("filing_date", "yyyyMMdd"), F.lit("    "), "accession_number").alias("value"))
    head = spark.createDataFrame([("Form Type   Company Name   CIK   Date Filed  File Name",), ("-----",)], "value string")
    return markup.index_rows(lines.unionByName(head), ["13F-HR"]).withColumn("filed", day("filed"))


_ATOM = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>10-K - ACME CORP (0000001234) (Filer)</title><updated>2024-03-01T10:00:00-05:00</updated><category term="10-K"/><id>urn:tag:x,2008:accession-number=0000001234-24-000001</id></entry></feed>'


@query("SELECT 1 AS feed_id, '10-K' AS form, '0000001234' AS cik, '0000001234-24-000001' AS accession, '10-K - ACME CORP (0000001234) (Filer)' AS title")
def src_atom_entries(spark, d):
    return markup.atom_entries(spark.createDataFrame([(1, _ATOM), (2, None)], "feed_id int, xml string"), "feed_id", "xml").select("feed_id", "form", "cik", "accession", "title")


_SV = "SELECT DISTINCT strftime(bar_date, '%Y-%m-%d') AS day, replace(coalesce(listed_ticker, 'A/B'), '/', '-') AS symbol, price_id, volume AS total_volume FROM daily_stock_price WHERE bar_date IS NOT NULL AND volume IS NOT NULL"


@query(f"SELECT day, symbol, CAST(price_id AS DOUBLE) AS short_volume, CAST(total_volume AS DOUBLE) AS total_volume, 'N' AS market FROM ({_SV})")
def src_short_volumes(spark, d):
    """All bars as lines of short-sale files, read back."""
    p = table(spark, d, "daily_stock_price").filter("bar_date IS NOT NULL AND volume IS NOT NULL").select("price_id", "bar_date", F.coalesce("listed_ticker", F.lit("A/B")).alias("symbol"), "volume").distinct()
    lines = p.select(F.concat_ws("|", F.date_format("bar_date", "yyyyMMdd"), "symbol", F.col("price_id").cast("string"), F.lit("0"), F.col("volume").cast("string"), F.lit("N")).alias("value"))
    rows, _ = delimited.short_volumes(lines.unionByName(spark.createDataFrame([(delimited.SHORT_HEADER,)], "value string")))
    return rows.select(day("day").alias("day"), "symbol", F.col("short_volume").cast("double").alias("short_volume"), F.col("total_volume").cast("double").alias("total_volume"), "market")


@query("SELECT true AS header_ok, CAST(2 AS BIGINT) AS rows_n, CAST(3 AS BIGINT) AS told_n, CAST(1 AS BIGINT) AS days")
def src_short_volume_check(spark, d):
    """A file whose trailer tells another number of rows than it has."""
    lines = [delimited.SHORT_HEADER, "20240102|BRK/B|10|0|20|N", "20240102|A|1|0|2|N", "3"]
    return delimited.short_volumes(spark.createDataFrame([(x,) for x in lines], "value string"))[1]


@query("SELECT strftime(report_date, '%Y-%m-%d') AS settlement_date, trim(cusip) AS cusip, CAST(disagreement_id AS VARCHAR) AS symbol, shares AS quantity FROM value_basis_disagreement WHERE report_date IS NOT NULL AND shares IS NOT NULL")
def src_fails_to_deliver(spark, d):
    """All disagreements as lines of a fails-to-deliver file, read back; a heading and a short line drop out."""
    v = table(spark, d, "value_basis_disagreement").filter("report_date IS NOT NULL AND shares IS NOT NULL")
    lines = v.select(F.concat_ws("|", F.date_format("report_date", "yyyyMMdd"), F.coalesce("cusip", F.lit("")), F.col("disagreement_id").cast("string"), F.col("shares").cast("string"), F.lit("X CORP"), F.lit(".")).alias("value"))
    extra = spark.createDataFrame([("SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE",), ("20240101|X",)], "value string")
    return delimited.fails_to_deliver(lines.unionByName(extra)).select(day("settlement_date").alias("settlement_date"), "cusip", "symbol", "quantity")


_GUARD = r"CASE WHEN regexp_matches({0}, '^[=+\-@\t\r]') THEN chr(39) || {0} ELSE nullif({0}, '') END"


@query("SELECT CAST(institutional_holder_id AS VARCHAR) AS institutional_holder_id, " + ", ".join(f"{_GUARD.format(c)} AS {c}" for c in ("name", "city", "crd_number")) + " FROM institutional_holder")
def src_csv_round_trip(spark, d):
    """All holders written as CSV and read back: blanks, quotes and commas stay, formulas are disarmed."""
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, d, "institutional_holder").select("institutional_holder_id", "name", "city", "crd_number"), path)
    return delimited.read_csv_records(spark, path)


@query("SELECT * FROM (VALUES ('0001', '100', NULL), ('0002', NULL, 'PUT'), ('0003', '7', NULL)) AS t(accession_number, sshprnamt, putcall)")
def src_zipped_tsv(spark, d):
    """The member INFOTABLE.tsv of two archives with unlike headings; short and empty lines."""
    folder, jvm = _folder(spark, "zips"), spark.sparkContext._jvm
    members = {"a.zip": "ACCESSION_NUMBER\tSSHPRNAMT\tPUTCALL\n0001\t100\t\n\n0002\t\tPUT\n", "b.zip": "﻿SshPrnAmt\tAccession_Number\n7\t0003\n"}
    for name, text in members.items():
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("2024/INFOTABLE.tsv", text)
            z.writestr("README.txt", "no")
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(raw.getvalue())
        out.close()
    got = delimited.read_zipped_tsv(spark, folder, "infotable.tsv", ["accession_number", "sshprnamt", "putcall"])
    return got.select("accession_number", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("sshprnamt", "putcall")])


@query("SELECT * REPLACE (CAST(assets AS DOUBLE) AS assets) FROM (VALUES (1, 'Ulmis, LP', 801, true, 1234567.5, '2024-03-31'), (2, NULL, NULL, NULL, NULL, NULL)) AS t(crd, name, file_number, is_active, assets, filed)")
def src_adviser_rows(spark, d):
    """Adviser records as typed rows: headings that vary, numbers with commas, cells that don't fit."""
    rows = spark.createDataFrame([("1", "Ulmis, LP", "801", "Y", "$1,234,567.50", "03/31/2024"), ("2", " ", "n/a", "?", "none", "soon")], "`Organization CRD#` string, `Primary Business Name` string, `SEC#` string, Active string, `5F(2)(c)` string, `Filing Date` string")
    want = {"crd": ("organization crd", "int"), "name": ("primary business name", "string"), "file_number": ("SEC #", "int"), "is_active": ("active", "boolean"), "assets": ("5f2c", "double"), "filed": ("filing date", "date")}
    return delimited.typed_records(rows, want).withColumn("filed", day("filed"))


@query("SELECT i, CAST(x AS DOUBLE) AS x FROM (VALUES (1, 1234.5), (2, -12.0), (3, NULL), (4, NULL), (5, 7.0), (6, NULL)) AS t(i, x)")
def src_tolerant_numbers(spark, d):
    rows = spark.createDataFrame([(1, "1,234.5"), (2, "(12)"), (3, "."), (4, "N/A"), (5, " $7 "), (6, None)], "i int, t string")
    return rows.select("i", delimited.tolerant_number(F.col("t")).cast("double").alias("x"))


# sinks


@query("""SELECT accession_number, CAST(sum(value) AS BIGINT) AS value, count(*) AS legs, strftime(max(filing_date), '%Y-%m-%d') AS filing_date FROM (SELECT DISTINCT holding_id, accession_number, value, filing_date FROM institutional_holding) GROUP BY 1""")
def snk_merge_stream(spark, d):
    """Holdings streamed in, each once, and appended batch by batch with the legs of a filing merged."""
    source, sink, state = (_folder(spark, x) for x in ("holdings", "merged", "state"))
    rows = table(spark, d, "institutional_holding").select("holding_id", "accession_number", "value", "filing_date").distinct()
    rows.write.parquet(source)
    sinks.merge_stream(I.stream_table(spark, source, 2), sink, state, ["accession_number"], "filing_date", "value")
    got = spark.read.parquet(sink)
    return got.groupBy("accession_number").agg(F.sum("value").alias("value"), F.sum("legs").alias("legs"), day(F.max("filing_date")).alias("filing_date"))


_HEADS = "(SELECT classification AS c, count(*) AS n FROM institutional_holder GROUP BY 1 ORDER BY 1 NULLS FIRST)"


@query(f"SELECT '| classification | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(coalesce(c, ''), '|', chr(92) || '|') || ' | ' || n || ' |', chr(10) ORDER BY c NULLS FIRST) AS markdown FROM {_HEADS}")
def snk_markdown_table(spark, d):
    top = table(spark, d, "institutional_holder").groupBy("classification").agg(F.count("*").alias("n")).orderBy("classification")
    return spark.createDataFrame([(sinks.markdown_table(top),)], "markdown string")


@query(f"SELECT 'classification' || chr(9) || 'n' || chr(10) || string_agg(coalesce(c, '') || chr(9) || n, chr(10) ORDER BY c NULLS FIRST) AS compact FROM {_HEADS}")
def snk_compact_table(spark, d):
    top = table(spark, d, "institutional_holder").groupBy("classification").agg(F.count("*").alias("n")).orderBy("classification")
    return spark.createDataFrame([(sinks.compact_table(top),)], "compact string")


# functions on text


@query(r"""SELECT doc_id, upper(regexp_extract(translate(text, '[]', '()'), '\(\s*([a-zA-Z]{1,5}([.][a-zA-Z][a-zA-Z]?)?)\s*\)', 1)) AS ticker FROM documents WHERE text IS NOT NULL
UNION ALL SELECT * FROM (VALUES (-1, 'BRK.B'), (-2, ''), (-3, 'ST')) AS t(doc_id, ticker)""")
def fn_ticker_in(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())
    more = spark.createDataFrame([(-1, "Berkshire [ brk.b ]"), (-2, "X (TOOLONG) (A1)"), (-3, "none (12) [ST]")], "doc_id bigint, text string")
    return docs.unionByName(more).select("doc_id", T.ticker_in(F.col("text")).alias("ticker"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS plain_md5 FROM documents WHERE text IS NOT NULL""")
def fn_strip_html(spark, d):
    """All texts in HTML with scripts and comments around them, and bare again."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    page = F.concat(F.lit("<html><script type='a'>if (a<b) x()</script><p class=\"x\">"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("<br>\n")), F.lit("</p><!-- gone --></html>"))
    return docs.select("doc_id", F.md5(T.strip_html(page)).alias("plain_md5"))


@query("""SELECT i, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM (VALUES (1, 1001, 15000), (2, 50000000, 50000000), (3, 1001, 15000), (4, 1001, 2000), (5, 50001, 100000), (6, 0, 500), (7, 0, 0), (8, 7, 7)) AS t(i, low, high)""")
def fn_amount_range(spark, d):
    texts = ["$1,001 - $15,000", "Over $50,000,000", "$1,001 -", "$1, 001 - $2,000", "$50,001 - $200", "$500", None, "$7 - $3"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string")
    return rows.select("i", T.amount_range(F.col("t")).alias("r")).select("i", "r.*")


@query("""SELECT * FROM (VALUES (1, '2024-03-01'), (2, '2024-03-01'), (3, '2024-03-01'), (4, '2024-03-01'), (5, '2024-03-01'), (6, NULL), (7, NULL)) AS t(i, day)""")
def fn_any_date(spark, d):
    rows = spark.createDataFrame(list(enumerate(["2024-03-01", " 01-Mar-2024 ", "03/01/2024", "3/1/2024", "20240301", "soon", None], 1)), "i int, t string")
    return rows.select("i", day(T.any_date(F.col("t"))).alias("day"))


@query("""SELECT * FROM (VALUES (1, 'Scott Franklin'), (2, 'Scott Franklin'), (3, 'C. C. Franklin'), (4, 'Mark Green'), (5, 'Mraz'), (6, 'Doe, Jane Q.'), (7, NULL)) AS t(i, name)""")
def fn_person_name(spark, d):
    names = ["Scott Mr Franklin", "Scott  scott Franklin", "C. C. Franklin", "Mark Dr. Green", "Mraz", "Hon. Doe, Jane Q.", None]
    return spark.createDataFrame(list(enumerate(names, 1)), "i int, n string").select("i", D.person_name(F.col("n")).alias("name"))


@query("SELECT * FROM (VALUES (1, '# Results' || chr(10) || chr(10) || 'Sales rose.' || chr(10) || chr(10) || '| Year | Sales |' || chr(10) || '| --- | --- |' || chr(10) || '| 2023 | $(5)% |' || chr(10) || chr(10) || '- one' || chr(10) || '- two'), (2, NULL)) AS t(page_id, markdown)")
def fn_markdown(spark, d):
    """Headings, lists and tables as Markdown; hidden facts, page numbers and empty cells gone, signs put to their numbers."""
    html = ("<html><head><title>x</title></head><div style='display:none'><ix:header>hidden</ix:header></div><h1>Results</h1><p>Sales  rose.</p><p>12</p>"
            "<table><tr><td>Year</td><td></td><td>Sales</td></tr><tr><td>2023</td><td>$</td><td>(5</td><td>)</td><td>%</td></tr></table><p>Table of Contents</p><ul><li>one</li><li>two</li></ul></html>")
    return D.markdown(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), "page_id", "html")


@query("SELECT * FROM (VALUES (1, '<a><b x=\"1\">t</b></a>'), (2, '<r>ok</r>'), (3, NULL)) AS t(i, xml)")
def fn_plain_xml(spark, d):
    rows = [(1, '<?xml version="1.0"?><n:a xmlns:n="urn:x" xmlns="urn:y"><n:b x="1">t\x01</n:b></n:a>'), (2, "<r>ok</r>"), (3, None)]
    return spark.createDataFrame(rows, "i int, x string").select("i", markup.plain_xml(F.col("x")).alias("xml"))


@query("""SELECT ticker, min(doc_id) AS best_rank, length(string_agg(text, chr(10) || '...' || chr(10) ORDER BY doc_id)) AS n_chars, md5(string_agg(text, chr(10) || '...' || chr(10) ORDER BY doc_id)) AS context_md5
FROM documents WHERE ticker IS NOT NULL AND text IS NOT NULL GROUP BY 1""")
def fn_excerpts(spark, d):
    """All texts of a ticker as one context in reading order."""
    docs = table(spark, d, "documents").filter("ticker IS NOT NULL AND text IS NOT NULL").withColumn("rank", F.col("doc_id"))
    e = D.excerpts(docs, "ticker", "doc_id", "text", "rank")
    return e.select("ticker", "best_rank", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("context_md5"))


@query("""SELECT revenue_row_id, sha256('axis=' || axis || '|member=' || member) AS key FROM dimensional_revenue_row WHERE axis IS NOT NULL AND member IS NOT NULL GROUP BY ALL UNION ALL SELECT -1, ''""")
def fn_member_key(spark, d):
    """Canonical keys of all rows' dimensions, whatever their order; none gives the empty key."""
    one = table(spark, d, "dimensional_revenue_row").filter("axis IS NOT NULL AND member IS NOT NULL").select("revenue_row_id", "axis", "member").distinct()
    rows = one.select("revenue_row_id", F.create_map(F.lit("member"), "member", F.lit("axis"), "axis").alias("m"))
    none = spark.range(1).select(F.lit(-1).cast("bigint").alias("revenue_row_id"), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).alias("m"))
    return rows.unionByName(none).select("revenue_row_id", T.member_key(F.col("m")).alias("key"))
