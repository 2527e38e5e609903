"""Versions of the graph's tables in a folder: written whole, then marked, so that readers see the old or the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_VERSION"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, root: str) -> int:
    """The version that readers use: the greatest with a mark; 0 before the first."""
    fs, p = _fs(spark, f"{root}/{MARK}.*")
    return max((int(f.getPath().getName().rsplit(".", 1)[1]) for f in fs.globStatus(p) or ()), default=0)


def save(root: str, **tables: DataFrame) -> int:
    """Write the tables as the next version and mark it. A failure before the mark leaves readers with the version they had. One writer at a time: a version that has its mark is never written again."""
    spark = next(iter(tables.values())).sparkSession
    new = version(spark, root) + 1
    for name, df in tables.items():
        parts = ["schema_version"] if "schema_version" in df.columns else []
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/v{new}/{name}")
    fs, mark = _fs(spark, f"{root}/{MARK}.{new}")
    try:
        fs.create(mark, False).close()
    except Exception as e:
        raise OSError(f"version {new} could not be marked") from e
    return new


def load(spark: SparkSession, root: str, name: str, at: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version(spark, root) if at is None else at}/{name}")


def parse_cache(spark: SparkSession, root: str, schema_version: int) -> DataFrame:
    """Cached facts of one version of the parser; the version is a partition, so others aren't read."""
    return load(spark, root, "parse_cache").where(F.col("schema_version") == schema_version)


class Watch:
    """Reloads when the version changes; a failed reload keeps what was there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.seen, self.tables = spark, root, 0, None

    def refresh(self, *names: str) -> bool:
        now = version(self.spark, self.root)
        if now == self.seen:
            return False
        try:
            self.tables = {n: load(self.spark, self.root, n, now) for n in names}
        except Exception:
            if self.tables is None:
                raise
            return False
        self.seen = now
        return True
