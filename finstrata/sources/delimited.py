"""Landed delimited files: tab-separated archives, CSV records, exchange and regulator feeds."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions.text import any_date


def plain_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case without blanks around; of equal names the first stays.

    (The CSV reader numbers headings that repeat in a file, so those are told apart already.)
    """
    seen: dict[str, int] = {}
    picks = []
    for i, c in enumerate(df.columns):
        name = c.strip().lstrip("﻿").lower()
        if name not in seen:
            seen[name] = i
            picks.append(df[f"`{c}`"].alias(name))
    return df.select(*picks)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header; cells trimmed, short rows filled with null."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return plain_columns(raw)


def read_zipped_tsv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """The named member of every zip under ``path``, as (file, columns); read member by line, not whole.

    Columns are found by name in any case; one that a file lacks is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = next((m for m in z.namelist() if m.rsplit("/", 1)[-1].lower() == member.lower()), None)
                    if inside is None:
                        continue
                    with io.TextIOWrapper(z.open(inside), encoding="utf-8-sig", errors="replace") as lines:
                        head = [h.strip().lower() for h in next(lines, "").rstrip("\r\n").split("\t")]
                        at = [head.index(c) if c in head else -1 for c in columns]
                        rows: list[list] = []
                        for line in lines:
                            cells = line.rstrip("\r\n").split("\t")
                            if line.strip():
                                rows.append([cells[i].strip() if 0 <= i < len(cells) else None for i in at])
                            if len(rows) == 10_000:
                                yield _batch(name, columns, rows)
                                rows = []
                        if rows:
                            yield _batch(name, columns, rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(["file string", *[f"`{c}` string" for c in columns]]))


def _batch(name: str, columns: list[str], rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.record_batch({"file": pa.array([name] * len(rows), pa.string())} | {c: pa.array(list(v), pa.string()) for c, v in zip(columns, cols)})


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV by RFC 4180: quoted fields may hold commas, doubled quotes and line breaks."""
    return plain_columns(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True))


SHORT_HEADER = "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market"  # fixed value: the file's header


def short_volumes(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, check) of a daily short-sale file: pipe-separated, its trailer the number of rows.

    ``check`` has one row: header_ok, rows_n, told_n, days. It is for the caller to refuse a file.
    """
    parts = F.split(F.trim(text), r"\|")
    n = F.size(parts)
    body = lines.filter((n == 6) & ~F.col(text).startswith("Date|"))
    cut = lambda i: F.get(parts, F.lit(i))
    rows = body.select(
        F.try_to_date(cut(0), "yyyyMMdd").alias("day"), F.replace(cut(1), F.lit("/"), F.lit("-")).alias("symbol"),
        *[cut(i).try_cast("decimal(20,6)").alias(c) for i, c in ((2, "short_volume"), (3, "short_exempt_volume"), (4, "total_volume"))], cut(5).alias("market"),
    )
    told = F.max(F.when((n == 1) & F.col(text).rlike(r"^\d+\s*$"), F.trim(text).try_cast("bigint")))
    head = lines.agg((F.count_if(F.trim(text) == SHORT_HEADER) == 1).alias("header_ok"), F.count_if((n == 6) & ~F.col(text).startswith("Date|")).alias("rows_n"), told.alias("told_n"))
    return rows, head.crossJoin(rows.agg(F.count_distinct("day").alias("days")))


def fails_to_deliver(lines: DataFrame, text: str = "value") -> DataFrame:
    """Six pipe-separated fields: date, CUSIP, symbol, quantity, description, price; bad rows are left out."""
    parts = F.split(text, r"\|")
    cut = lambda i: F.trim(F.get(parts, F.lit(i)))
    rows = lines.filter(F.size(parts) == 6).select(
        F.try_to_date(cut(0), "yyyyMMdd").alias("settlement_date"), cut(1).alias("cusip"), cut(2).alias("symbol"),
        cut(3).try_cast("bigint").alias("quantity"), cut(4).alias("description"), cut(5).try_cast("decimal(18,4)").alias("price"),
    )
    return rows.filter(F.col("settlement_date").isNotNull() & F.col("quantity").isNotNull())


def tolerant_number(c: Column) -> Column:
    """A number from "1,234.5", "(12)" for a negative, "." or "N/A" for none."""
    bare = F.regexp_replace(F.trim(c), r"[,$%\s]", "")
    signed = F.when(bare.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(bare, r"[()]", ""))).otherwise(bare)
    return signed.try_cast("decimal(28,8)")


def typed_records(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Named columns of CSV records by heading and type; a heading that is missing, or a cell that doesn't fit, is null.

    Headings are compared without case, blanks and punctuation. Whole numbers may have commas, "Y" and "N" are booleans.
    """
    plain = lambda h: "".join(ch for ch in h.lower() if ch.isalnum())
    have = {plain(c): c for c in reversed(df.columns)}
    out = []
    for name, (heading, kind) in columns.items():
        at = have.get(plain(heading))
        c = F.trim(F.col(f"`{at}`")) if at else F.lit(None).cast("string")
        if kind == "boolean":
            c = F.when(F.upper(c).isin("Y", "YES", "TRUE"), True).when(F.upper(c).isin("N", "NO", "FALSE"), False)
        elif kind == "date":
            c = any_date(c)
        elif kind != "string":
            c = tolerant_number(c).try_cast(kind)
        out.append(F.when(c.cast("string") != "", c).alias(name))
    return df.select(*out)
