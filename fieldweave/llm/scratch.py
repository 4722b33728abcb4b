"""Intermediate tables in the folder all executors share.

``keep`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back: lineage
is cut, the work is done once, and a lost executor loses nothing.  A lazy result may still read
such tables, so they stay until whoever owns them calls ``sweep``: tables kept within
``owned("name")`` belong to that name, all others to the session's user, whose sweep has no name.
"""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

_written: dict[str, list[str]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def owned(name: str):
    """Tables kept within belong to ``name``."""
    before = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(before)


def write(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df below ``folder`` under a new name and returns it as a plain scan; ``sweep`` leaves it."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and returns it as a plain scan."""
    path = f"{shared_dir(df.sparkSession)}/fieldweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(_owner.get(), []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession, name: str = "") -> None:
    """Deletes the tables kept so far for ``name``; results that still read them become invalid."""
    drop(spark, *_written.pop(name, []))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bytes and rows that Arrow hands to Python at once: some texts have megabytes, and some rows few bytes.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 20_000


def prepare(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES and BATCH_ROWS; operators with Python stages call it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark deletes shuffle files and broadcasts of finished rounds.

    Loops over jobs call it once a round: otherwise those files stay until the driver's heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
