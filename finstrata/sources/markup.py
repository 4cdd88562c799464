"""Landed XML, SGML and HTML filings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_xml(c: Column) -> Column:
    """XML without declaration, namespaces and control characters, so that one schema reads all."""
    bare = F.regexp_replace(c, r"(?s)<\?xml.*?\?>|[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    bare = F.regexp_replace(bare, r"\s+xmlns(:\w+)?=\"[^\"]*\"|\s+\w+:schemaLocation=\"[^\"]*\"", "")
    return F.regexp_replace(bare, r"<(/?)[\w.-]+:", "<$1")


def close_tags(c: Column, root: str) -> Column:
    """XML whose last end tag was cut off, with it put back."""
    return F.when(~F.rtrim(c).endswith(f"</{root}>"), F.concat(F.regexp_replace(c, rf"</?\w*$|</{root}$", ""), F.lit(f"</{root}>"))).otherwise(c)


_INFO = (
    "infoTable array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,"
    "shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string,investmentDiscretion:string,otherManager:string,"
    "votingAuthority:struct<Sole:string,Shared:string,None:string>>>"
)


def information_tables(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """The holdings of 13F information tables, a row each."""
    parsed = docs.select(doc_id, F.from_xml(plain_xml(F.col(xml)), _INFO, {"mode": "PERMISSIVE"}).alias("x"))
    t = parsed.select(doc_id, F.posexplode("x.infoTable").alias("line", "t"))
    whole = lambda c: F.regexp_replace(F.col(c), r"[,\s]", "").try_cast("bigint")
    return t.select(
        doc_id, "line", F.trim("t.nameOfIssuer").alias("issuer"), F.trim("t.titleOfClass").alias("title_of_class"), F.upper(F.trim("t.cusip")).alias("cusip"),
        whole("t.value").alias("value"), whole("t.shrsOrPrnAmt.sshPrnamt").alias("amount"), F.col("t.shrsOrPrnAmt.sshPrnamtType").alias("amount_type"),
        F.col("t.putCall").alias("option_type"), F.col("t.investmentDiscretion").alias("discretion"),
        whole("t.votingAuthority.Sole").alias("sole"), whole("t.votingAuthority.Shared").alias("shared"), whole("t.votingAuthority.None").alias("none"),
    )


_V = "struct<value:string>"
_TXN = (
    f"array<struct<securityTitle:{_V},transactionDate:{_V},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_V},transactionPricePerShare:{_V},transactionAcquiredDisposedCode:{_V}>,"
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_V}>,ownershipNature:struct<directOrIndirectOwnership:{_V}>>>"
)
_OWNERSHIP = (
    "documentType string, periodOfReport string, issuer struct<issuerCik:string,issuerTradingSymbol:string>,"
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>>>,"
    f"nonDerivativeTable struct<nonDerivativeTransaction:{_TXN}>, derivativeTable struct<derivativeTransaction:{_TXN}>"
)


def ownership_transactions(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """Transactions of ownership forms 3, 4 and 5, of both tables."""
    p = docs.select(doc_id, F.from_xml(plain_xml(F.col(xml)), _OWNERSHIP).alias("x"))
    out = None
    for kind, path in (("NonDerivative", "x.nonDerivativeTable.nonDerivativeTransaction"), ("Derivative", "x.derivativeTable.derivativeTransaction")):
        t = p.select(doc_id, "x", F.posexplode(path).alias("line", "t"))
        number = lambda c, kind_: F.col(c).try_cast(kind_)
        rows = t.select(
            doc_id, F.lit(kind).alias("kind"), "line", F.col("x.issuer.issuerCik").alias("issuer_cik"), F.get("x.reportingOwner", 0)["reportingOwnerId"]["rptOwnerCik"].alias("owner_cik"),
            F.col("t.securityTitle.value").alias("security_title"), F.try_to_date("t.transactionDate.value", "yyyy-MM-dd").alias("transaction_date"),
            F.col("t.transactionCoding.transactionCode").alias("code"), number("t.transactionAmounts.transactionShares.value", "decimal(20,4)").alias("shares"),
            number("t.transactionAmounts.transactionPricePerShare.value", "decimal(18,4)").alias("price"), F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired_disposed"),
            number("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value", "decimal(20,4)").alias("owned_after"), F.col("t.ownershipNature.directOrIndirectOwnership.value").alias("nature"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_HOLD = f"array<struct<securityTitle:{_V},postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_V}>,ownershipNature:struct<directOrIndirectOwnership:{_V}>>>"


def ownership_holdings(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """Holdings without a transaction of ownership forms, of both tables, for every reporting owner."""
    schema = "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string>>>, " + ", ".join(f"{k}Table struct<{k}Holding:{_HOLD}>" for k in ("nonDerivative", "derivative"))
    p = docs.select(doc_id, F.from_xml(plain_xml(F.col(xml)), schema).alias("x"))
    owners = F.array_join(F.transform("x.reportingOwner", lambda o: o["reportingOwnerId"]["rptOwnerCik"]), ",")
    rows = [
        p.select(doc_id, F.lit(kind).alias("kind"), owners.alias("owner_ciks"), F.posexplode(f"x.{at}Table.{at}Holding").alias("line", "h"))
        for kind, at in (("NonDerivative", "nonDerivative"), ("Derivative", "derivative"))
    ]
    return rows[0].unionByName(rows[1]).select(
        doc_id, "kind", "line", "owner_ciks", F.col("h.securityTitle.value").alias("security_title"),
        F.col("h.postTransactionAmounts.sharesOwnedFollowingTransaction.value").try_cast("decimal(20,4)").alias("owned"), F.col("h.ownershipNature.directOrIndirectOwnership.value").alias("nature"),
    )


_COVER = (
    "formData struct<coverPage:struct<reportCalendarOrQuarter:string,isAmendment:string,amendmentInfo:struct<amendmentType:string>,"
    "filingManager:struct<name:string>,form13FFileNumber:string,otherManagersInfo:struct<otherManager:array<struct<cik:string,form13FFileNumber:string,name:string>>>>,"
    "summaryPage:struct<otherIncludedManagersCount:string,tableEntryTotal:string,tableValueTotal:string>>"
)


def cover_pages(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """A row for each 13F cover page: period, amendment, manager, totals, other managers by name."""
    p = docs.select(doc_id, F.from_xml(plain_xml(F.col(xml)), _COVER).alias("x"))
    c, s = "x.formData.coverPage", "x.formData.summaryPage"
    whole = lambda t: F.regexp_replace(F.col(t), r"[,\s]", "").try_cast("bigint")
    return p.select(
        doc_id, F.coalesce(F.try_to_date(f"{c}.reportCalendarOrQuarter", "MM-dd-yyyy"), F.try_to_date(f"{c}.reportCalendarOrQuarter", "yyyy-MM-dd")).alias("report_date"),
        F.lower(F.coalesce(f"{c}.isAmendment", F.lit("false"))).isin("true", "1", "y").alias("is_amendment"), F.col(f"{c}.amendmentInfo.amendmentType").alias("amendment_type"),
        F.trim(f"{c}.filingManager.name").alias("manager"), F.col(f"{c}.form13FFileNumber").alias("file_number"), whole(f"{s}.tableEntryTotal").alias("entries"), whole(f"{s}.tableValueTotal").alias("value"),
        F.coalesce(F.array_join(F.transform(f"{c}.otherManagersInfo.otherManager", lambda m: F.trim(m["name"])), ";"), F.lit("")).alias("other_managers"),
    )


_STAKES = (
    "formData struct<coverPageHeader:struct<dateOfEvent:string,eventDateRequiresFilingThisStatement:string,issuerInfo:struct<issuerCik:string,issuerName:string,issuerCusip:string>>,"
    "coverPageHeaderReportingPersonDetails:array<struct<reportingPersonName:string,"
    "reportingPersonBeneficiallyOwnedNumberOfShares:struct<soleVotingPower:string,sharedVotingPower:string>,"
    "reportingPersonBeneficiallyOwnedAggregateNumberOfShares:string,classPercent:string>>>"
)


def ownership_stakes(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """A row for each reporting person of a beneficial-ownership schedule; a cut end tag is put back first."""
    p = docs.select(doc_id, F.from_xml(plain_xml(close_tags(F.col(xml), "edgarSubmission")), _STAKES)["formData"].alias("x"))
    t = p.select(doc_id, "x.coverPageHeader", F.posexplode("x.coverPageHeaderReportingPersonDetails").alias("line", "r"))
    number = lambda c, kind: F.regexp_replace(F.col(c), r"[,\s%]", "").try_cast(kind)
    own = "r.reportingPersonBeneficiallyOwnedNumberOfShares"
    return t.select(
        doc_id, "line", F.col("coverPageHeader.issuerInfo.issuerCik").alias("issuer_cik"), F.upper(F.trim("coverPageHeader.issuerInfo.issuerCusip")).alias("cusip"),
        F.trim("r.reportingPersonName").alias("person"), number(f"{own}.soleVotingPower", "decimal(20,4)").alias("sole_voting"), number(f"{own}.sharedVotingPower", "decimal(20,4)").alias("shared_voting"),
        number("r.reportingPersonBeneficiallyOwnedAggregateNumberOfShares", "decimal(20,4)").alias("shares"), number("r.classPercent", "decimal(9,4)").alias("percent"),
    )


def statement_pages(docs: DataFrame, doc_id: str, html: str) -> DataFrame:
    """(doc_id, row_no, label, column_no, period, value, scale) of rendered statement pages.

    The page's first row names statement and unit ("$ in Millions"); the headings that are dates, in it or
    the row below, are the columns; rows with a label and numbers are the lines. A note's mark is no value.
    """
    cells = html_tables(docs, doc_id, html).filter(F.col("table_no") == 0)
    date = r"(?i)^(?:[a-z]{3,4}\.? \d{1,2}, \d{4})$"
    dates = F.filter("cells", lambda c: c.rlike(date))
    heads = cells.filter((F.col("row_no") < 2) & (F.size(dates) > 0)).groupBy(doc_id).agg(F.min_by(dates, "row_no").alias("_dates"), F.min("row_no").alias("_head"))
    first = cells.filter(F.col("row_no") == 0).select(doc_id, F.get("cells", 0).alias("_title"))
    size = F.when(F.col("_title").rlike("(?i)in billions"), 1_000_000_000).when(F.col("_title").rlike("(?i)in millions"), 1_000_000).when(F.col("_title").rlike("(?i)in thousands"), 1_000).otherwise(1)
    lines = cells.join(heads, doc_id).join(first, doc_id).filter(F.col("row_no") > F.col("_head"))
    values = F.filter(F.slice("cells", 2, 1000), lambda c: (c != "") & ~c.rlike(r"^\[.*\]$"))
    each = lines.filter(F.size(values) > 0).select(doc_id, "row_no", F.get("cells", 0).alias("label"), "_dates", size.alias("scale"), F.posexplode(values).alias("column_no", "_v"))
    number = F.regexp_replace(F.regexp_replace("_v", r"[$,\s]", ""), r"^\((.*)\)$", "-$1").try_cast("decimal(28,4)")
    day = F.try_to_date(F.regexp_replace(F.get("_dates", F.col("column_no")), r"^([A-Za-z]{3})[a-z]?\.? ", "$1 "), "MMM d, yyyy")
    return each.select(doc_id, "row_no", "label", "column_no", day.alias("period"), number.alias("value"), "scale").filter(F.col("value").isNotNull())


def envelope_documents(submissions: DataFrame, sub_id: str, text: str) -> DataFrame:
    """(sub_id, seq, type, filename, body): the documents of an SGML submission."""
    parts = submissions.select(sub_id, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<DOCUMENT>(.*?)(?:</DOCUMENT>|$)"), 1)).alias("seq", "d"))
    tag = lambda t: F.trim(F.regexp_extract("d", rf"<{t}>([^\r\n<]*)", 1))
    return parts.select(sub_id, "seq", tag("TYPE").alias("type"), tag("FILENAME").alias("filename"), F.regexp_extract("d", r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1).alias("body"))


class _Tables(HTMLParser):
    """Cells of all tables, row by row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.table, self.depth, self.row, self.cell = -1, 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
            self.depth += 1
            self.at = 0
        elif tag == "tr" and self.depth:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append((self.table, self.at, self.row))
            self.at += 1
            self.row = None
        elif tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(docs: DataFrame, doc_id: str, html: str) -> DataFrame:
    """(doc_id, table_no, row_no, cells) of the tables of HTML pages; broken pages give what they can."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, page in enumerate(b.column(1).to_pylist()):
                if page:
                    p = _Tables()
                    p.feed(page)
                    at += [i] * len(p.rows)
                    rows += p.rows
            yield pa.record_batch({
                doc_id: b.column(0).take(pa.array(at, pa.int64())), "table_no": pa.array([r[0] for r in rows], pa.int32()),
                "row_no": pa.array([r[1] for r in rows], pa.int32()), "cells": pa.array([r[2] for r in rows], pa.list_(pa.string())),
            })

    return docs.select(doc_id, html).mapInArrow(run, f"{doc_id} {kind}, table_no int, row_no int, cells array<string>")


class _Facts(HTMLParser):
    """Contexts, units and facts of inline (ix:) or plain XBRL."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.contexts: dict[str, dict] = {}
        self.units: dict[str, str] = {}
        self.facts: list[dict] = []
        self.open: list[dict] = []
        self.context = self.unit = None
        self.field = self.axis = None

    def handle_starttag(self, tag, attrs):
        a, name = dict(attrs), tag.split(":")[-1]
        if name == "context" and a.get("id"):
            self.context = self.contexts.setdefault(a["id"], {"members": {}})
        elif name == "unit" and a.get("id"):
            self.unit = a["id"]
            self.units[self.unit] = ""
        elif name in ("startdate", "enddate", "instant", "measure"):
            self.field = name
        elif name == "explicitmember":
            self.field, self.axis = name, a.get("dimension")
        elif name in ("nonfraction", "nonnumeric") and tag.startswith("ix:"):
            self.open.append({"concept": a.get("name"), "context": a.get("contextref"), "unit": a.get("unitref"), "scale": a.get("scale"), "sign": a.get("sign"), "format": a.get("format") or "", "nil": a.get("xsi:nil") == "true", "numeric": name == "nonfraction", "text": []})
        elif a.get("contextref") and ":" in tag and not tag.startswith("ix:"):
            self.open.append({"concept": tag, "context": a["contextref"], "unit": a.get("unitref"), "scale": None, "sign": None, "format": "", "nil": a.get("xsi:nil") == "true", "numeric": a.get("unitref") is not None, "text": []})

    def handle_endtag(self, tag):
        name = tag.split(":")[-1]
        if name == "context":
            self.context = None
        elif name == "unit":
            self.unit = None
        elif name in ("startdate", "enddate", "instant", "measure", "explicitmember"):
            self.field = None
        elif self.open and (name in ("nonfraction", "nonnumeric") or tag == self.open[-1]["concept"]):
            self.facts.append(self.open.pop())

    def handle_data(self, data):
        if self.field == "measure" and self.unit is not None:
            self.units[self.unit] = (self.units[self.unit] + "/" if self.units[self.unit] else "") + data.strip()
        elif self.field == "explicitmember" and self.context is not None:
            self.context["members"][self.axis] = data.strip()
        elif self.field and self.context is not None:
            self.context[self.field] = data.strip()
        for f in self.open:
            f["text"].append(data)


def fact_value(text: str, scale: str | None, sign: str | None, form: str = "") -> Decimal | None:
    """The number a fact shows, with scale and sign applied; a dash or "none" is zero."""
    t = re.sub(r"[\s ,]", "", text)
    if form.endswith(("zerodash", "fixed-zero")) or t in ("-", "—", "–"):
        return Decimal(0)
    if "comma" in form and "decimal" in form:
        t = re.sub(r"[\s.]", "", text).replace(",", ".")
    if t.startswith("(") and t.endswith(")"):
        t, sign = t[1:-1], "-"
    try:
        v = Decimal(t).scaleb(int(scale or 0))
    except (InvalidOperation, ValueError):
        return None
    return -v if sign == "-" else v


def xbrl_facts(docs: DataFrame, doc_id: str, html: str) -> DataFrame:
    """(doc_id, concept, period_start, period_end, unit, value, text, members) of inline or plain XBRL."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, page in enumerate(b.column(1).to_pylist()):
                if not page:
                    continue
                p = _Facts()
                p.feed(page)
                for f in p.facts:
                    c = p.contexts.get(f["context"] or "", {"members": {}})
                    text = "".join(f["text"]).strip()
                    value = None if f["nil"] or not f["numeric"] else fact_value(text, f["scale"], f["sign"], f["format"])
                    end = c.get("enddate") or c.get("instant")
                    at.append(i)
                    rows.append((f["concept"], c.get("startdate"), end, p.units.get(f["unit"] or ""), None if value is None else str(value), text, list(c["members"].items())))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.record_batch({doc_id: b.column(0).take(pa.array(at, pa.int64()))} | {
                n: pa.array(list(v), pa.map_(pa.string(), pa.string()) if n == "members" else pa.string())
                for n, v in zip(("concept", "period_start", "period_end", "unit", "value", "text", "members"), cols)
            })

    raw = docs.select(doc_id, html).mapInArrow(run, f"{doc_id} {kind}, concept string, period_start string, period_end string, unit string, value string, text string, members map<string,string>")
    return raw.withColumns({"period_start": F.try_to_date("period_start"), "period_end": F.try_to_date("period_end"), "value": F.col("value").try_cast("decimal(38,6)")})


def atom_entries(feeds: DataFrame, feed_id: str, xml: str) -> DataFrame:
    """(feed_id, title, form, cik, accession, updated) of an Atom feed of filings."""
    schema = "entry array<struct<title:string,updated:string,id:string,category:struct<_term:string>,summary:string>>"
    e = feeds.select(feed_id, F.explode(F.from_xml(plain_xml(F.col(xml)), schema)["entry"]).alias("e"))
    return e.select(
        feed_id, F.trim("e.title").alias("title"), F.coalesce(F.col("e.category._term"), F.trim(F.split_part("e.title", F.lit(" - "), F.lit(1)))).alias("form"),
        F.regexp_extract("e.title", r"\((\d{10})\)", 1).alias("cik"), F.regexp_extract("e.id", r"accession-number=([\d-]+)", 1).alias("accession"), F.col("e.updated").try_cast("timestamp").alias("updated"),
    )


def index_rows(lines: DataFrame, forms: list[str] | None = None, text: str = "value") -> DataFrame:
    """(form, company, cik, filed, path) of a daily index; its heading lines don't fit and drop out."""
    pattern = r"^(\S+(?: \S+)*)\s{2,}(.+?)\s{2,}(\d{1,10})\s+(\d{8}|\d{4}-\d{2}-\d{2})\s+(\S+)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    rows = lines.filter(F.col(text).rlike(pattern)).select(
        part(1).alias("form"), part(2).alias("company"), F.lpad(part(3), 10, "0").alias("cik"),
        F.coalesce(F.try_to_date(part(4), "yyyyMMdd"), F.try_to_date(part(4), "yyyy-MM-dd")).alias("filed"), part(5).alias("path"),
    )
    return rows if forms is None else rows.filter(F.col("form").isin(forms))
