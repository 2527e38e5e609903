"""Call sites settled by a compiler's index, how linkers compare with it, and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks at least in which sites are grouped.
PARTS = 128


def resolve_sites(sites: DataFrame, occurrences: DataFrame, definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """site, uid, tier: where the index says a call goes, as the symbol of that file, line and name, else the only one of that file and name.

    sites: site, file, line, col; occurrences: file, line, col, symbol; definitions: symbol, def_file, def_line, name; symbols: uid, file, line, name.
    """
    told = sites.join(occurrences, ["file", "line", "col"]).select("site", "symbol").join(definitions, "symbol")
    s = symbols.select("uid", F.col("file").alias("def_file"), F.col("line").alias("def_line"), "name")
    exact = s.groupBy("def_file", "def_line", "name").agg(F.min("uid").alias("exact"))
    only = s.groupBy("def_file", "name").agg(F.min("uid").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    met = told.join(exact, ["def_file", "def_line", "name"], "left").join(only, ["def_file", "name"], "left")
    out = met.select("site", F.coalesce("exact", "only").alias("uid"), F.when(F.col("exact").isNotNull(), 1).otherwise(2).alias("tier"))
    return out.where("uid is not null")


def supersede(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges of linkers, and one resolved edge instead at sites the index settles; a resolved edge of a symbol to itself is left out. found: site, caller, uid, provenance, confidence; resolved: site, caller, uid."""
    kept = found.select("site", "caller", "uid", "provenance", "confidence").join(resolved.select("site").distinct(), "site", "left_anti")
    new = resolved.where("caller <> uid").select("site", "caller", "uid", F.lit("Resolved").alias("provenance"), F.lit(0.97).cast("float").alias("confidence"))
    return kept.unionByName(new)


def differential(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """site, n_found, covered, confirmed: how many targets the linkers gave, whether the index settles the site, and whether its target is among them. found: site, uid; resolved: site, uid."""
    given = found.select("site", "uid", F.lit(1).alias("f"), F.lit(0).alias("r"))
    told = resolved.select("site", "uid", F.lit(0).alias("f"), F.lit(1).alias("r"))
    # unknown sites and targets equal nothing; a settled site of that kind is apart from a found one
    apart = F.when(F.col("site").isNull(), F.col("f")).otherwise(0).alias("apart")
    both = given.unionByName(told).select("site", apart, "uid", "f", "r")
    # dealt before they are grouped, so that the tables of a task don't stand beside the sorts of the join that gives the rows
    spark = found.sparkSession
    tasks = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    targets = both.repartition(tasks, "site", "apart").groupBy("site", "apart", "uid").agg(F.max("f").alias("f"), F.max("r").alias("r"))
    hit = F.when(F.col("uid").isNotNull() & F.col("site").isNotNull(), F.col("f") * F.col("r")).otherwise(0)
    out = targets.groupBy("site", "apart").agg(F.sum("f").alias("n_found"), (F.max("r") == 1).alias("covered"), (F.max(hit) == 1).alias("confirmed"))
    return out.select("site", "n_found", "covered", "confirmed")


def _whole(name: str) -> str:
    return r"(?<![A-Za-z0-9_$])" + "".join(c if c.isalnum() or c == "_" else "\\" + c for c in name) + r"(?![A-Za-z0-9_$])"


def rename_edits(files: DataFrame, name: str) -> DataFrame:
    """path, line, col (from 1 and 0) of every place where the name stands as a whole word. files: path, text."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("k", "row")).where(F.col("row").rlike(_whole(name)))
    gaps = F.transform(F.split("row", _whole(name), -1), lambda x: F.char_length(x))
    cols = F.expr(f"transform(sequence(1, size(gaps) - 1), i -> aggregate(slice(gaps, 1, i), 0, (a, x) -> a + x) + (i - 1) * {len(name)})")
    return lines.withColumn("gaps", gaps).select("path", (F.col("k") + 1).alias("line"), F.explode(cols).alias("col"))


def renamed(files: DataFrame, name: str, new: str) -> DataFrame:
    """The files as the edits leave them; nothing is written. files: path, text."""
    return files.withColumn("text", F.regexp_replace("text", _whole(name), new.replace("\\", "\\\\").replace("$", "\\$")))


def collisions(nodes: DataFrame, uid: str, new: str) -> DataFrame:
    """Symbols that already have the new name in the file of the symbol to rename."""
    at = nodes.where(F.col("uid") == uid).select("path").distinct()
    return nodes.where(F.col("name") == new).join(at, "path", "left_semi").where(F.col("uid") != uid)
