"""Coverage of links, accuracy against a compiler's index, and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scalars

BANDS = ("Extracted", "Inferred", "Ambiguous")


def coverage(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "provenance").agg(F.count("*").alias("n"), F.sum(F.col("confidence").cast("double")).alias("confidence_sum"))


def link_coverage(sites: DataFrame) -> DataFrame:
    """One row of counters over call sites and how they were linked. sites: outcome (same_file, inferred, ambiguous, unresolved)."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return sites.agg(F.count("*").alias("calls_total"), *(n(x).alias(x) for x in ("same_file", "inferred", "ambiguous", "unresolved")))


def band_precision(sites: DataFrame) -> DataFrame:
    """provenance, n, confirmed, denied, precision (null where nothing could be judged). sites: provenance, correct (null: not covered)."""
    out = sites.groupBy("provenance").agg(F.count("*").alias("n"), F.count_if(F.col("correct")).alias("confirmed"), F.count_if(~F.col("correct")).alias("denied"))
    return out.withColumn("precision", F.when(F.col("confirmed") + F.col("denied") > 0, F.col("confirmed").cast("double") / (F.col("confirmed") + F.col("denied"))))


def overall(sites: DataFrame) -> DataFrame:
    """class, precision, recall: nothing to count is 1. sites: class, predicted, correct, expected."""
    out = sites.groupBy("class").agg(F.count_if("predicted").alias("p"), F.count_if(F.col("predicted") & F.col("correct")).alias("tp"), F.count_if("expected").alias("e"))
    return out.select("class", scalars.ratio("tp", "p").alias("precision"), scalars.ratio("tp", "e").alias("recall"))


def monotone(bands: DataFrame) -> DataFrame:
    """provenance, precision, falls: whether precision rises as the band falls, past bands without one. bands: ord, provenance, precision."""
    before = F.last("precision", ignorenulls=True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return bands.withColumn("violates", F.coalesce(F.col("precision") > before + 1e-9, F.lit(False))).select("provenance", "precision", "violates")


def postings(entries: DataFrame) -> DataFrame:
    """term, uid, tf, length of entries: uid, body. One row per term and entry."""
    words = entries.select("uid", scalars.tokens("body").alias("w"))
    return words.select("uid", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "uid").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(entries: DataFrame, query: str, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """rank, uid, score, terms: the best k entries that hold any of the query's tokens. Tokens that aren't asked for never leave the scan."""
    asked = sorted({t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    words = entries.select("uid", scalars.tokens("body").alias("w")).select("uid", F.size("w").alias("length"), F.filter("w", lambda x: x.isin(*asked)).alias("hits"))
    size = words.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    tf = words.where(F.size("hits") > 0).select("uid", "length", F.explode("hits").alias("term")).groupBy("uid", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(size), F.lit(True))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    found = scored.groupBy("uid").agg(F.round(F.sum(score), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("term")), " ").alias("terms"))
    top = found.orderBy(F.col("score").desc(), "uid").limit(max(1, min(k, 25)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "uid")))
