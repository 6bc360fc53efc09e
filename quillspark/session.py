"""Session helpers: worker import path, table reads and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and pin the session's time zone.

    On a cluster the package is installed on, or put on the PYTHONPATH of, every node; the entry
    added here only matters where driver and executors share a file system.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder (``name.parquet`` as a file or a folder)."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Largest scan (bytes of its columns by the optimizer's statistics) that :func:`spread` shuffles.
SPREAD_BYTES = 1 << 30


def _is_small(scan: DataFrame) -> bool:
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES


def _partitions(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """A file scan over all cores where its files give fewer tasks than that, for work that outweighs a shuffle; scans beyond SPREAD_BYTES stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if _is_small(scan) and scan.rdd.getNumPartitions() < cores else scan


def spread_by(scan: DataFrame, *keys: str) -> DataFrame:
    """A small scan by hash of the keys, before an aggregate by them whose result goes on to Python: adaptive execution would put it into one task. Larger scans
    stay as they are, so that rows of a hot key are combined before they are shuffled."""
    return scan.repartition(_partitions(scan.sparkSession), *keys) if _is_small(scan) else scan


def balance(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of keys that are unique in them into the configured number of shuffle partitions (or the cores, if more): before heavy work on rows
    that are few in bytes, which adaptive execution would put into one task."""
    return df.repartition(_partitions(df.sparkSession), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Without that setting a temporary one if all runs in this process (tests), else an error: other nodes couldn't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        named = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, and safe against lost executors.

    A written table rather than ``checkpoint()``, which computes its input twice and stores it uncompressed.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut_lineage` wrote for this application; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
