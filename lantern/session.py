"""Session helpers: one place for the settings the library wants and for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lantern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; an active session is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which every executor
    must be able to reach. Only where it is unset (local runs, tests) is a temporary
    folder made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        else:
            found = "file://" + tempfile.mkdtemp(prefix="lantern-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Removes a query's shuffle files when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet in the shared folder and read again: a lineage cut that
    survives the loss of any executor and is computed once, however often it is read. What it
    has shuffled goes when it is written, and not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lantern-{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing still to be computed reads; others
    are left alone."""
    for df in tables:
        if not hasattr(df, "_written"):
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")
