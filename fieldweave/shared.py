"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL = "spark.fieldweave.scratch"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one if all work is done on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get(_LOCAL, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldweave-")
        spark.conf.set(_LOCAL, found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, wherever they lie."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def cut_with(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``df`` checkpointed, and aggregates of it that the same job makes."""
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(n) for n, c in sums.items()])), seen.get


_kept: dict[str, Bucketed | Stored] = {}


def sweep() -> None:
    """Deletes all stored and bucketed tables that are still there; operators and results that read them become invalid."""
    for table in list(_kept.values()):
        table.drop()


class Stored:
    """A table in the shared folder, compressed, until it is dropped."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.name = f"fieldweave_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/fieldweave/{self.name}"
        _kept[self.name] = self
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        _kept.pop(self.name, None)
        drop(self.spark, self.path)


class Bucketed:
    """A table in the shared folder, bucketed by one column: joins by that column bring the other side to it."""

    def __init__(self, df: DataFrame, by: str, then: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark = df.sparkSession
        self.name = f"fieldweave_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/fieldweave/{self.name}"
        # Not fewer buckets than shuffles have partitions, or Spark would shuffle the table rather than the other side.
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.spark.sparkContext.defaultParallelism)
        _kept[self.name] = self
        then(df.repartition(buckets, by)).write.bucketBy(buckets, by).option("path", self.path).option("compression", "none").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        _kept.pop(self.name, None)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.spark, self.path)
