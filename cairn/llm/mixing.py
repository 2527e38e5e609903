"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target over its size is a rate r of at most 3: every document is
taken floor(r) times, and once more with the probability left over. Which ones
are taken once more is decided by the cube method: probabilities move through
the null space of two constraints (words, documents), three documents at a time,
until each has become 0 or 1 but for two per block. Blocks of a source are dealt
by a hash, so that a hot source is many blocks; what a block leaves undecided
goes on to the next round, and the two that the last block of a source leaves
land where its words come nearest to the target.

Nulls: a null source is a source of its own, the last; a null text has no words
and is taken 0 words. Empty table: no rows. Ties and repeated rows: by the order
of (hash of doc_id, doc_id, size); reruns agree. Rows with a null doc_id are mixed
like others; in what remix returns those of one text count as rows of one doc_id. Very long texts are sized whole. Sources may be many: their table is never collected or sent by force.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, n_words, settle, with_value

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 20_000


def flight(size: np.ndarray, p: np.ndarray, seed: tuple[int, ...], land: bool) -> np.ndarray:
    """Probabilities moved until at most two are neither 0 nor 1; with `land`, those two decided as well."""
    out, draw = p.astype(float).copy(), np.random.default_rng(seed).random(len(p) + 8).tolist()
    s, q = size.astype(float).tolist(), out.tolist()
    active: list[int] = []
    near = 1e-9
    for step, i in enumerate(range(len(q))):
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - q[k]) / x if x > 0 else q[k] / -x for k, x in zip(active, u, strict=True) if x)
        down = min(q[k] / x if x > 0 else (1 - q[k]) / -x for k, x in zip(active, u, strict=True) if x)
        move = up if draw[step] * (up + down) < down else -down
        keep = []
        for k, x in zip(active, u, strict=True):
            v = q[k] + move * x
            q[k] = 0.0 if v < near else 1.0 if v > 1 - near else v
            if 0 < q[k] < 1:
                keep.append(k)
        active = keep
    if land and active:
        due = sum(s[k] * q[k] for k in active)
        best = min(itertools.product((0, 1), repeat=len(active)), key=lambda z: (abs(sum(s[k] * x for k, x in zip(active, z, strict=True)) - due), z))
        for k, x in zip(active, best, strict=True):
            q[k] = float(x)
    return np.array(q)


def rates(sized: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """A row per source: k (its number, in order of code points with null last), of, source_size, target, base (times each), p (rate left over), blocks. The table of sources stays distributed; the driver sees sums."""
    spark = sized.sparkSession
    order = (F.col("source").isNull(), F.col("source"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sources = settle(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    bases, before = [], 0
    for r in sources.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        bases.append((r["p"], before))
        before += r["n"]
    k = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = sources.join(spark.createDataFrame(bases, "part long, first long"), F.shiftright("at", 33) == F.col("part")).withColumn("k", k)
    numbered = numbered.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("k") % len(weights) + 1).cast("int")))
    # a level rises until no source that is below its bound would be lifted above it: what full sources leave is shared by weight
    total = sources.agg(F.sum("size").alias("s")).first()["s"] or 0
    left, weight, level = 0, 1, 0.0
    while True:
        full = F.col("w") * F.lit(level) >= most * F.col("size")
        r = numbered.agg(F.sum(F.when(full, F.col("size"))).alias("s"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not r["w"]:
            break
        left, weight = total - most * (r["s"] or 0), r["w"]
        if left / weight <= level:
            break
        level = left / weight
    full = F.col("w") * F.lit(level) >= most * F.col("size")
    target = F.when(full, (most * F.col("size")).cast("double")).otherwise(F.lit(float(left)) * F.col("w") / F.lit(float(weight)))
    rated = numbered.withColumn("target", target).withColumn("rate", F.coalesce(F.try_divide("target", "size"), F.lit(0.0)))
    base = F.floor(F.col("rate") + 1e-12)
    over = F.col("rate") - base
    return rated.select(
        "k", F.col("source").alias("of"), F.col("size").alias("source_size"), "target", base.cast("int").alias("base"), F.when(over > 1e-12, over).otherwise(0.0).alias("p"), F.ceil(F.col("n") / block).alias("blocks")
    )


def _mover(level: int, last: bool):
    """The flight of one block, its documents in an order of their own."""

    def move(pdf):
        key = pdf["doc_id"].fillna(-1).astype("int64").to_numpy().astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        pdf = pdf.iloc[np.lexsort((pdf["p"].to_numpy(), pdf["size"].to_numpy(), key, mixed))]
        seed = (level, int(pdf["k"].iloc[0]), int(pdf["block"].iloc[0]))
        return pdf.assign(p=flight(pdf["size"].to_numpy(), pdf["p"].to_numpy(), seed, last))

    return move


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, times (how often the document is taken)."""
    sized = settle(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"].cast("string")).alias("size")))
    lookup = settle(rates(sized, weights, most, block))
    rated = sized.join(lookup, F.col("source").eqNullSafe(F.col("of")))
    own = ["doc_id", "size", "source_size", "target", "base"]
    undecided = (F.col("p") > 0) & (F.col("size") > 0)
    fields = "k long, block long, doc_id long, size long, source_size long, target double, base int, p double"
    decided = rated.where(~undecided).select(*own, F.lit(0).alias("s"))
    moving = rated.where(undecided).select("k", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")).alias("block"), "doc_id", "size", "source_size", "target", "base", "p")
    left, level = lookup.where("p > 0").agg(F.max("blocks").alias("b")).first()["b"] or 0, 0
    while left:
        last = left == 1

        moved = settle(moving.groupBy("k", "block").applyInPandas(_mover(level, last), fields))
        decided = decided.unionByName(moved.where("p in (0.0, 1.0)").select(*own, F.col("p").cast("int").alias("s")))
        left = 0 if last else -(-3 * left // block)
        level += 1
        moving = moved.where("p not in (0.0, 1.0)").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(max(left, 1))).cast("long"))
    times = (F.col("base") + F.col("s")).cast("int")
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.alias("times"))


def remix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Every document as often as the mix takes it, with all columns it came with. Repeated rows share what they are taken, the first of them the odd ones."""
    whole = in_order(docs)
    named = whole.select(F.col("key").alias("doc_id"), F.col("_document").getField("source").alias("source"), "text")
    chosen = settle(mix(named, weights, most, block).groupBy(F.col("doc_id").alias("key")).agg(F.sum("times").alias("_n"), F.count("*").alias("_rows"), F.when(F.count("*") == 1, F.sum("times")).otherwise(-1).cast("int").alias("value")))
    valued = with_value(whole.select("key", "_document"), chosen)
    taken = valued.select("_document", F.col("value").alias("_share"))
    if not chosen.where("_rows > 1").isEmpty():
        repeated = valued.where("value = -1").join(chosen.select("key", "_n", "_rows"), "key")
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.hash("_document")))
        share = F.floor(F.col("_n") / F.col("_rows")) + F.when(nth <= F.col("_n") % F.col("_rows"), 1).otherwise(0)
        taken = taken.where("_share >= 0").unionByName(repeated.select("_document", share.cast("int").alias("_share")))
    return taken.where("_share > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_share")))).select("_document.*")
