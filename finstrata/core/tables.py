"""Readers for the tables of a data directory, and what a session needs to run the library."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``; one Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, so that kernels can import it there."""
    context = spark.sparkContext
    if getattr(context, "_finstrata_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="finstrata-")) / "finstrata.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._finstrata_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a local folder is set.
    """
    jsc = spark.sparkContext
    named = jsc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not jsc._jsc.sc().getCheckpointDir().isDefined():
            jsc.setCheckpointDir(tempfile.mkdtemp(prefix="finstrata-"))
        return jsc._jsc.sc().getCheckpointDir().get()
    if not jsc._jsc.sc().getCheckpointDir().isDefined():
        jsc.setCheckpointDir(named)
    return named
