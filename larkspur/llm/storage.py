"""Where operators keep intermediate tables: the shared folder of the cluster."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # folders of local sessions without the setting, by application


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  A local session without the setting gets a
    temporary folder, which is remembered; a cluster without it raises, as no folder of one
    machine is seen by the others.
    """
    base = spark.conf.get(SETTING, None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{SETTING} has to name a folder that the driver and all executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs a re-read, not a recomputation, and shuffle files of
    the plan above can be cleaned.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def spent_after() -> Iterator[None]:
    """Tables that :func:`materialize` stores inside are deleted at the end.

    Only what is made outside, such as a stored result, may be read later.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            discard(table)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any filesystem that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    delete(df.sparkSession, df._larkspur_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver collects garbage, which a driver with little to do rarely does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
