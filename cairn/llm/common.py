"""Helpers that the text operators share: stable intermediates and byte access."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.store import drop, settle  # noqa: F401  operators take both from here

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WS = r"[\x20\x09-\x0D]+"


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns never reach it."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def quoted(column: str) -> str:
    """A column's name as Spark reads it, whatever it holds (dots, blanks, quotes)."""
    return "`" + column.replace("`", "``") + "`"


def row(docs: DataFrame) -> Column:
    """All columns as one struct; other columns may clash with nothing in there."""
    return F.struct(*(docs[quoted(c)].alias(c) for c in docs.columns))


def identity(docs: DataFrame) -> Column:
    """doc_id, and for a row without one a key made of its text, from 2^62 on: rows without an id are one document only if their texts are equal."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def in_order(docs: DataFrame) -> DataFrame:
    """key, given, text, _document: a number for each document, the doc_id it came with, and the whole row. Numbers follow the identity; rows of one doc_id with other texts are documents of their own, in the order of a hash of the text."""
    rows = docs.select(identity(docs).alias("key"), docs["doc_id"].cast("long").alias("given"), docs["text"].cast("string").alias("text"), row(docs).alias("_document"))
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    of = rows.select("key", content.alias("content"))
    if of.groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").isEmpty():
        return rows
    # some doc_id has several texts: number what there is in its order, without one task that sees all
    each = settle(of.distinct().repartitionByRange("key", "content").sortWithinPartitions("key", "content").withColumn("at", F.monotonically_increasing_id()))
    return rows.withColumn("content", content).join(each, ["key", "content"]).select(F.col("at").alias("key"), "given", "text", "_document")


def _sieved(rows: DataFrame, known: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """rows and _met, the values whose Bloom filter holds their key. known: settled, key and value; sizes: how many keys a value has. All filters have `most` bits at most, and are sent to all tasks."""
    import pyarrow as pa

    each = min(12.0, most / sum(sizes.values()))
    first, length, words = {}, {}, 0
    for v, n in sorted(sizes.items()):
        first[v], length[v] = words, int(n * each) // 64 + 1
        words += length[v]
    places = lambda v: [F.lit(64 * first[v]) + F.pmod(F.xxhash64("key", F.lit(i)), F.lit(64 * length[v])) for i in range(4)]
    word, bit = lambda at: F.shiftright(at, 6).cast("int"), lambda at: at.bitwiseAND(63).cast("int")
    own = F.coalesce(*(F.when(F.col("value") == v, F.array(*places(v))) for v in first))
    set_ = known.select(F.explode(own).alias("at")).select(word(F.col("at")).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("at"))).alias("bit"))
    found = set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = known.sparkSession.createDataFrame(pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))}))

    def there(v) -> Column:
        met = [F.call_function("shiftright", F.get("_bits", word(at)), bit(at)).bitwiseAND(1) == 1 for at in places(v)]
        return met[0] & met[1] & met[2] & met[3]

    return rows.crossJoin(F.broadcast(sent)).select(*rows.columns, F.array_compact(F.array(*(F.when(there(v), F.lit(v)) for v in first))).alias("_met"))


#: Bits of all filters of a lookup at most (16 MB); with more keys than they serve, more rows are joined by key.
FILTER_BITS = 1 << 27


def perhaps_among(rows: DataFrame, keys: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """The rows whose key is among the keys, and a few in a hundred of the others. keys: settled, key."""
    known = keys.select("key", F.lit(1).alias("value"))
    n = known.count()
    return _sieved(rows, known, {1: n}, most).where(F.size("_met") > 0).select(*rows.columns) if n else rows.where(F.lit(False))


def with_value(rows: DataFrame, known: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """rows with the `value` that known has for their key. known: settled, key and value, each key once, few values; it has all keys of rows.

    A row that one value's filter alone holds has that value and stays where it is; only those in several, a few in a hundred, are joined by their key.
    """
    sizes = {r["value"]: r["n"] for r in known.groupBy("value").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return rows.withColumn("value", F.lit(next(iter(sizes), 0)))
    met = _sieved(rows, known, sizes, most)
    sure = met.where(F.size("_met") == 1).select(*rows.columns, F.col("_met")[0].alias("value"))
    return sure.unionByName(met.where(F.size("_met") != 1).select(*rows.columns).join(known.select("key", "value"), "key").select(*rows.columns, "value"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_views(column) -> tuple[np.ndarray, memoryview]:
    """Offsets and data of an Arrow string column whose nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, memoryview(data if data is not None else b"")


def give_back() -> None:
    """Return this process's free memory to the system, as far as its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def ending(run: Callable, forget: Callable[[], object] | None = None) -> Callable:
    """run, a function of a task's batches, after which the worker forgets its tables and gives its memory back.

    Workers outlive their task and wait beside those of later stages: what they keep adds up within an executor.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return whole
