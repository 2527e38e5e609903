"""Files of a repository as rows, and what of an earlier run can be used again."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never entered.
SKIPPED = (".git", "node_modules", "dist", "build", "target", "__pycache__", ".venv", "venv", "bin", "obj", "vendor")


def ignored(path: str | Column, patterns: list[str]) -> Column:
    """Whether ignore patterns leave a path out; of those that match the last one counts, and ! takes a path back."""
    c = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for p in patterns:
        p = p.rstrip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        body = re.escape(p.strip("/")).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        anchored = "/" in p.rstrip("/")
        shape = ("^" if anchored else "(^|/)") + body + ("/" if p.endswith("/") else "(/|$)")
        out = F.when(c.rlike(shape), F.lit(not back)).otherwise(out)
    return out


def read(spark: SparkSession, root: str, extensions: tuple[str, ...], patterns: list[str] = (), skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path (below root), text of files with one of the extensions, outside of skipped folders and ignore patterns."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape("/" + re.sub("^[a-z0-9]+:/*", "/", root).strip("/")) + "/", "")
    files = raw.select(below.alias("path"), F.col("content"))
    inside = F.col("path").rlike("(^|/)(" + "|".join(re.escape(s) for s in skipped) + ")/")
    return files.where(~inside & ~ignored("path", list(patterns))).select("path", F.decode("content", "UTF-8").alias("text"))


def is_markdown_kept(path: str) -> Column:
    """Texts under docs, at the root, and READMEs; never a changelog."""
    base = F.regexp_extract(path, r"[^/]*$", 0)
    return F.col(path).endswith(".md") & ~F.upper(base).startswith("CHANGELOG") & (F.col(path).startswith("docs/") | ~F.contains(F.col(path), F.lit("/")) | (base == "README.md"))


def without_vendored(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files that no installed package's record lists. records: path (of the record), text; a record's first field is a file beside its folder."""
    lines = records.select(F.regexp_replace("path", r"[^/]+/[^/]+$", "").alias("at"), F.explode(F.split("text", "\n")).alias("line"))
    listed = lines.where("line <> ''").select(F.concat("at", F.regexp_extract("line", r'^"?([^",]*)', 1)).alias("path")).distinct()
    return files.join(listed, "path", "left_anti")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def reuse(files: DataFrame, cache: DataFrame, version: int, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What parse gives for the files, taken from the cache where path, hash and version agree; files that are gone leave nothing. files: path, text; cache: path, hash, schema_version and parse's columns but path; parse: path, text to path and more."""
    now = with_hash(files)
    known = cache.where(F.col("schema_version") == version).drop("schema_version")
    keys = known.select("path", "hash").distinct()
    kept = known.join(now.select("path", "hash"), ["path", "hash"], "left_semi")
    fresh = parse(now.join(keys, ["path", "hash"], "left_anti").select("path", "text")).join(now.select("path", "hash"), "path")
    return kept.unionByName(fresh, allowMissingColumns=True)
