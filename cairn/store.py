"""Tables between steps: written to a folder that all executors share, and deleted when they are done with.

The folder is spark.checkpoint.dir's; a session without that setting writes
under its warehouse, which is shared as well. Never a folder of one machine alone, unless
the session itself runs on one. Each step's shuffles are dropped as soon as its
table is written, so a lost executor costs at most the step that is running.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that drops a statement's shuffles at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_NUMBERS = itertools.count()
_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
        if not _FOLDERS:
            atexit.register(_leave)
        _FOLDERS[app] = spark, f"{top.rstrip('/')}/cairn-{app}-{uuid.uuid4().hex[:8]}"
    return _FOLDERS[app][1]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _leave() -> None:
    for spark, path in _FOLDERS.values():
        with contextlib.suppress(Exception):  # the session may be gone with its JVM
            _delete(spark, path)


def settle(df: DataFrame) -> DataFrame:
    """df as a table that is written now and read from there from now on."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{next(_NUMBERS)}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more. What the caller still returns a plan over must not be named."""
    for t in tables:
        _delete(t.sparkSession, t._settled)
