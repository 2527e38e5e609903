"""Best-fit packing of token pieces into sequences of a fixed capacity.

Lengths are integers up to the capacity, so the whole plan is made from their
histogram (at most `capacity` rows, whatever the corpus): the long lengths are
cut into groups of equal cardinality and rounded up to their group's largest,
few-size configurations are optimised by column generation, the actual pieces
take the slots of their group, and what is left is placed by best fit, longest
first. The plan is a bounded list of runs over the global order of pieces, so
that assigning a piece is one binary search and needs no second shuffle.

Nulls: a null text is an empty one, which is one piece of the end token. Empty
table: no rows. Repeated rows: each is packed. Ties: any order, the same on each
run. Other columns of the input are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import byte_views, ending, id_and_text, settle

CAPACITY = 4096
#: Groups of equal cardinality that the long lengths are rounded up within.
GROUPS = 48
END_ID = 1

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: only documents longer than the capacity are cut."""
    path = path or tokens.default_path()

    def cut(batches):
        import pyarrow as pa

        table, end = tokens.chunk_ids(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            keys = batch.column("doc_id")
            rows: list[tuple[int, int, int, int, int]] = []
            for i in range(len(keys)):
                ids = tokens.encode(bytes(data[offsets[i] : offsets[i + 1]]), table) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((i, k, start, len(part) // 4, zlib.crc32(part)))
            cols = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[:, 0])), pa.array(cols[:, 1].astype(np.int32)), *(pa.array(cols[:, j]) for j in (2, 3, 4))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(ending(cut, tokens.forget), PIECES_SCHEMA)


class Run(NamedTuple):
    """Pieces first..last (exclusive) of the global order: `each` to a sequence from `sequence` on, at `offset` plus multiples of `length`."""

    first: int
    last: int
    sequence: int
    each: int
    offset: int
    length: int


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Few-size patterns and how often each is used: the linear programme of cutting stock by column generation, rounded down."""
    k = len(sizes)
    if not k:
        return []
    demand = np.array(counts, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    most = capacity // min(sizes)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, dual = inverse @ demand, inverse.sum(axis=0)
        best, chosen = np.zeros(capacity + 1), []
        for _ in range(most):
            step, pick = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                if dual[i] > 0:
                    trial = best[: capacity + 1 - s] + dual[i]
                    better = trial > step[s:] + 1e-12
                    step[s:][better] = trial[better]
                    pick[s:][better] = i
            chosen.append(pick)
            if (pick < 0).all():
                break
            best = step
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(chosen):
            if (i := pick[room]) >= 0:
                column[i] += 1
                room -= sizes[i]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, value / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    value = np.linalg.solve(basis, demand)
    used = [(tuple(np.repeat(np.arange(k), basis[:, j].round().astype(int)).tolist()), int(np.floor(value[j] + 1e-6))) for j in range(k)]
    return [(slots, n) for slots, n in used if n > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs that place every piece, given how many there are of each length; the order of pieces is by length, longest first."""
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> ranges of sequences
    free: list[int] = []
    opened = 0

    def put(r: int, a: int, b: int) -> None:
        if r and a < b:
            if not room[r]:
                bisect.insort(free, r)
            room[r].append((a, b))

    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    first, at = {}, 0
    for n in lengths:
        first[n] = at
        at += histogram[n]
    stretch = [(n, first[n], first[n] + histogram[n]) for n in lengths]
    if lengths and lengths[0] == capacity:
        n, a, b = stretch.pop(0)
        runs.append(Run(a, b, 0, 1, 0, n))
        opened = b - a
    long = [x for x in stretch if x[0] > capacity // 8]
    rest = [x for x in stretch if x[0] <= capacity // 8]
    if long:
        begin, end = long[0][1], long[-1][2]
        cuts = sorted({begin, end, *(begin + (end - begin) * i // groups for i in range(groups))}) if len(long) > groups else [begin, *(x[2] for x in long)]
        ends = [x[2] for x in long]
        length_at = lambda g: long[bisect.bisect_right(ends, g)][0]
        spans = list(zip(cuts, cuts[1:], strict=False))
        sizes = [length_at(a) for a, _ in spans]
        # groups that round up to the same length are one size
        merged: list[list[int]] = []
        for (a, b), s in zip(spans, sizes, strict=True):
            if merged and merged[-1][2] == s:
                merged[-1][1] = b
            else:
                merged.append([a, b, s])
        taken = [a for a, _, _ in merged]
        for slots, times in configurations([s for _, _, s in merged], [b - a for a, b, _ in merged], capacity):
            given = []
            for g in slots:
                a = taken[g]
                taken[g] = min(a + times, merged[g][1])
                given.append((a, taken[g]))
            marks = {0, times}
            for a, b in given:
                marks |= {b - a, *(e - a for e in ends if a < e < b)}
            marks = sorted(marks)
            for lo, hi in zip(marks, marks[1:], strict=False):
                offset = 0
                for a, b in given:
                    if a + lo < b:
                        n = length_at(a + lo)
                        runs.append(Run(a + lo, a + hi, opened + lo, 1, offset, n))
                        offset += n
                put(capacity - offset, opened + lo, opened + hi)
            opened += times
        left = []
        for g, (_, b, _) in enumerate(merged):
            a = taken[g]
            while a < b:
                e = min(b, ends[bisect.bisect_right(ends, a)])
                left.append((length_at(a), a, e))
                a = e
        rest = left + rest
    for n, a, b in rest:
        while a < b:
            k = bisect.bisect_left(free, n)
            if k == len(free):
                each = capacity // n
                whole = (b - a) // each
                lo, hi, r = opened, opened + max(whole, 1), capacity
                opened = hi
            else:
                r = free[k]
                lo, hi = room[r].pop()
                if not room[r]:
                    free.pop(k)
                each = r // n
                whole = (b - a) // each
            use = min(hi - lo, whole)
            if use:
                runs.append(Run(a, a + use * each, lo, each, capacity - r, n))
                put(r - each * n, lo, lo + use)
                a += use * each
                lo += use
            if lo < hi and a < b:  # fewer pieces than one sequence takes
                runs.append(Run(a, b, lo, each, capacity - r, n))
                put(r - (b - a) * n, lo, lo + 1)
                a, lo = b, lo + 1
            put(r, lo, hi)
    return sorted(runs)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = settle(pieces(docs, capacity, path))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(plan(histogram, capacity, groups), np.int64).reshape(-1, 6)
    ordered = cut.repartitionByRange(F.col("length").desc(), "doc_id", "piece", "ids_crc32").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    ordered = settle(ordered.withColumn("at", F.monotonically_increasing_id()))
    spark, base, before = docs.sparkSession, {}, 0
    for r in ordered.groupBy((F.shiftright("at", 33)).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        base[r["p"]] = before
        before += r["n"]
    shared = spark.sparkContext.broadcast((runs, base))

    def place(batches):
        import pyarrow as pa

        runs, base = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            index = np.array([base[p] for p in (at >> 33).tolist()], np.int64) + (at & ((1 << 33) - 1))
            run = runs[np.searchsorted(runs[:, 0], index, "right") - 1] if len(index) else runs[:0]
            nth = index - run[:, 0]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * run[:, 5])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ordered.mapInArrow(ending(place), PIECES_SCHEMA + ", sequence_id long, offset long")
