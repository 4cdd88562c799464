"""Writing: append, upsert, delete and replace over Parquet folders; tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions.text import export_cell


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or, where a key is there, updated.

    ``update`` names the columns that change (all by default). Keys must be unique in ``new``.
    One full outer join: unchanged rows pass through.
    """
    update = [c for c in old.columns if c not in keys] if update is None else update
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.select(*old.columns).withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in update)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions of ``path`` that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV with RFC quoting; text that a spreadsheet would run is disarmed. Files stay parallel."""
    guarded = df.select(*[(export_cell(F.col(c)) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes])
    guarded.write.mode("overwrite").csv(path, header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def escape_cell(x) -> str:
    return "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a Markdown table; for results that were ordered and limited."""
    head = "| " + " | ".join(escape_cell(c) for c in df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(escape_cell(x) for x in r) + " |" for r in df.limit(rows).collect())])


def compact_table(df: DataFrame, rows: int = 100) -> str:
    """The table with its header once and tabs between cells, if that is shorter than Markdown."""
    got = df.limit(rows).collect()
    cells = [["" if x is None else str(x) for x in r] for r in got]
    plain = "\n".join(["\t".join(df.columns), *("\t".join(r) for r in cells)])
    ragged = any("\t" in x or "\n" in x for r in cells for x in r)
    marked = markdown_table(df, rows)
    return marked if ragged or len(plain) >= len(marked) else plain


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, amount: str) -> None:
    """Runs a stream to its end into a Parquet folder, one batch at a time: rows of a key that come in one
    batch are merged (amounts added up, the newest ``order`` kept) and appended under the batch's number.

    A batch that is run again overwrites its own folder, so nothing is there twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        merged = rows.groupBy(*keys).agg(F.sum(amount).alias(amount), F.max(order).alias(order), F.count("*").alias("legs"))
        merged.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
