"""Incremental maintenance: exactly-once ingestion, corrections, and snapshots of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finstrata.sources.sinks import append, replace_partitions


def stream_table(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; what was read is kept in the query's checkpoint."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, however often it is delivered within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, width: str, by: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; the stream must bear a watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> int:
    """Runs a stream over all that is there now into a Parquet folder, and stops; tells how many rows came too late."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def sessions(events: DataFrame, by: list[str], time: str, gap: str) -> DataFrame:
    """Sessions of activity that a pause of ``gap`` ends."""
    s = events.groupBy(*by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def settle_submissions(filings: DataFrame, key: list[str], order: list, replaces) -> DataFrame:
    """The filings that stand: the last full replacement of each key, and additions made after it.

    ``replaces`` tells filings that replace all before from those that add to them.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = filings.withColumn("_n", F.row_number().over(w)).withColumn("_r", replaces)
    last = F.max(F.when(F.col("_r"), F.col("_n"))).over(Window.partitionBy(*key))
    return numbered.withColumn("_last", F.coalesce(last, F.lit(0))).filter((F.col("_n") >= F.col("_last"))).drop("_n", "_r", "_last")


def dirty_partitions(changed: DataFrame, part: str, then: str | None = None) -> DataFrame:
    """Partitions that a change touches: its own and, by ``then`` (an SQL expression), the next one."""
    own = changed.select(F.col(part).alias(part)).distinct()
    return own if then is None else own.unionByName(own.select(F.expr(then).alias(part))).distinct()


def refresh(base: DataFrame, dirty: DataFrame, part: str, build, path: str) -> None:
    """Rebuilds the snapshot's dirty partitions only: semi-join, aggregate, overwrite them."""
    replace_partitions(build(base.join(dirty, part, "left_semi")), path, [part])


def restate_periods(stored: DataFrame, restated: DataFrame, keys: list[str], part: str, path: str) -> None:
    """Stores rows by ``part`` and replaces those whose ``keys`` are restated: deleted, then inserted again.

    Only the partitions that have a restated key are written anew; ``part`` must be one of the keys.
    """
    append(stored, path, [part])
    old = stored.sparkSession.read.schema(stored.schema).parquet(path)
    touched = old.join(restated.select(part).distinct(), part, "left_semi")
    kept = touched.join(restated.select(*keys).distinct(), keys, "left_anti")
    replace_partitions(kept.unionByName(restated.select(*stored.columns)), path, [part])


def versioned_or_live(spark: SparkSession, tables: list[str], live):
    """The snapshots if all were computed together, else the live relation."""
    try:
        frames = [spark.read.parquet(t) for t in tables]
        stamps = {r[0] for f in frames for r in f.select("computed_at").distinct().limit(2).collect()}
    except Exception as e:  # a snapshot that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, live()
    return (frames, None) if len(stamps) == 1 else (None, live())


def reprice(pending: DataFrame, prices: DataFrame, keys: list[str], price: str, shares: str, filed: str, tries: str, most: int) -> DataFrame:
    """Adds value, source and state to pending rows: priced, tried again, or filed value after ``most`` tries."""
    known = prices.filter(F.col(price).isNotNull()).groupBy(*keys).agg(F.max(price).alias("_p"))
    j = pending.join(known, keys, "left")
    value = F.when(F.col("_p").isNotNull(), F.round(F.col(shares) * F.col("_p"), 0).cast("bigint"))
    spent = F.col(tries) + 1 >= most
    state = F.when(F.col("_p").isNotNull(), "derived").when(~spent, "pending").when(F.col(filed).isNotNull(), "filed").otherwise("unavailable")
    return j.withColumns({"value": F.coalesce(value, F.when(spent, F.col(filed))), "state": state, tries: F.when(F.col("_p").isNull(), F.col(tries) + 1).otherwise(F.col(tries))}).drop("_p")


def start_from(spark: SparkSession, stored: DataFrame, date: str, floor: str | None = None, default: str = "2020-01-01") -> str:
    """Where a fetcher goes on: the latest stored date, else the floor, else the default."""
    last = stored.agg(F.max(date).cast("string")).first()[0]
    return last or floor or default


def stale(rows: DataFrame, version: str, current: int) -> DataFrame:
    """Rows made by an older version of what made them, which are to be made again."""
    return rows.filter(F.coalesce(F.col(version), F.lit(0)) < current)


def split_failures(parsed: DataFrame, ok, key: str, attempts: DataFrame | None = None, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(good rows, tombstones): failures with their count and the hours to wait, which double."""
    bad = parsed.filter(~F.coalesce(ok, F.lit(False))).select(key).distinct()
    before = bad.withColumn("attempts", F.lit(0)) if attempts is None else bad.join(attempts.select(key, "attempts"), key, "left").fillna({"attempts": 0})
    tried = before.withColumn("attempts", F.col("attempts") + 1)
    wait = F.when(F.col("attempts") < most, F.pow(F.lit(2), F.col("attempts") - 1).cast("int"))
    return parsed.filter(ok), tried.withColumn("wait_hours", wait)
