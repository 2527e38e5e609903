"""Near-duplicates by circulant MinHash, bands, and exact Jaccard on whole shingle sets.

Two fixed permutations of the 32-bit integers make every signature coordinate:
the first scatters a shingle, the second is applied after a circular shift by
the coordinate's number. Texts of equal sets are one class. Classes that share a
band value are a bucket. First each is compared with the bucket's first class only, so that a
thousand copies cost about a thousand comparisons. A bucket whose classes these
links don't all join has its other pairs compared too, but for pairs that are joined already: the
classes joined with the first against the rest, and the rest among themselves, in
tiles of a bounded size, a task each. Buckets are never merged, so
that a chain of chance candidates makes no large group, and a task's work is bounded
whatever a bucket holds.

Sets are compared whole, as 64-bit hashes of their shingles, made of the texts once. With 16 bands of 4
coordinates a pair at the threshold of 0.85 is missed with a chance under 1e-5.

Nulls: a null text has no words. Without words: empty set, linked with nothing.
Fewer words than a shingle has: the whole sequence is the one shingle. Ties:
the smallest doc_id names a component. Repeated rows of one doc_id are returned
once each. Empty table: no rows. Very long texts count whole. Other columns of the input are left out. Null doc_ids: such rows are
documents of their own, one for each text. They are compared like all others,
but name no component that has a doc_id, and are not kept there; of a component
without any doc_id (a null component_id) those of one text are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.components import connected_components

from .common import byte_views, drop, ending, in_order, perhaps_among, settle, with_value

SHINGLE, BANDS, ROWS = 3, 16, 4
#: Bytes of sets, and sets, of a tile at most, about.
TILE_BYTES, TILE_SETS = 8 << 20, 512
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHash(dict):
    """word -> 64-bit hash; starts anew beyond a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = WordHash()


def forget() -> None:
    """Empty the worker's table of words."""
    _WORDS.clear()


_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    h *= _MIX[4]
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(size, len(h))):
            out = _mixed(out * _MIX[k % 3] + h[k : k + n])
        out = _mixed(out + np.uint64(min(size, len(h))))
    return np.unique(out)


def _scatter(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = (np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(0x3C6EF35F) % np.uint64(1 << 32)).astype(np.uint32)


def signature(shingles: np.ndarray, shifts: np.ndarray = _SHIFTS) -> np.ndarray:
    """Coordinate k is the least second permutation of the set, which the first has scattered, shifted by k steps around the circle."""
    with np.errstate(over="ignore"):
        placed = _scatter((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        out = np.full(len(shifts), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(placed), 2048):
            block = _scatter(placed[None, i : i + 2048] + shifts[:, None], 0x21F0AAAD, 0xD35A2D97)
            np.minimum(out, block.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, given, n_shingles, set_a, set_b (128 bits that name the set), bands (a 64-bit number each). docs: as in_order."""

    def sign(batches):
        import pyarrow as pa

        shifts = (np.arange(bands * rows, dtype=np.uint64) * np.uint64(0x3C6EF35F) % np.uint64(1 << 32)).astype(np.uint32)
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            n = batch.num_rows
            count, names, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, bands), np.int64)
            for i in range(n):
                s = shingle_set(bytes(data[offsets[i] : offsets[i + 1]]), size)
                count[i] = len(s)
                names[i] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                if len(s):
                    with np.errstate(over="ignore"):
                        h, part = np.zeros(bands, np.uint64), signature(s, shifts).reshape(bands, rows).astype(np.uint64)
                        for r in range(rows):
                            h = _mixed(h * _MIX[0] + part[:, r])
                    keys[i] = h.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("given"), pa.array(count), pa.array(names[:, 0]), pa.array(names[:, 1]), lists], names=["key", "given", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("key", "given", "text").mapInArrow(ending(sign, forget), "key long, given long, n_shingles long, set_a long, set_b long, bands array<long>")


class _Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links_among(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Of the links among the sets (positions of pairs whose Jaccard is confirmed) enough to join what all of them join. Sets of one number in `known` are joined already."""
    n, joined, found = len(sets), _Joined(len(sets)), []
    first: dict[int, int] = {}
    for i, k in enumerate(known or []):
        joined.join(first.setdefault(k, i), i)
    sizes = np.array([len(s) for s in sets], np.int64)
    near = lambda both, a, b: 100 * both >= percent * (a + b - both)
    if n <= 40:
        order = np.argsort(-sizes, kind="stable").tolist()
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if 100 * sizes[j] < percent * sizes[i]:
                    break
                if joined.root(i) != joined.root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if near(both, sizes[i], sizes[j]) and joined.join(i, j):
                        found.append((i, j))
        return found
    # shingles that two sets share, numbered; products of 0/1 matrices count what pairs have in common
    row = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    width = int(shared.sum())
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    cuts = np.searchsorted(column, np.arange(0, width + 4096, 4096))
    block = 512
    for a in range(0, n, block):
        for b in range(a, n, block):
            na, nb = min(block, n - a), min(block, n - b)
            both = np.zeros((na, nb), np.float32)
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                r, c = row[lo:hi], column[lo:hi] - 4096 * k
                left, right = (r >= a) & (r < a + na), (r >= b) & (r < b + nb)
                if left.any() and right.any():
                    x, y = np.zeros((na, 4096), np.float32), np.zeros((nb, 4096), np.float32)
                    x[r[left] - a, c[left]] = 1
                    y[r[right] - b, c[right]] = 1
                    both += x @ y.T
            both = both.astype(np.int64)
            hit = near(both, sizes[a : a + na, None], sizes[None, b : b + nb])
            for i, j in zip(*(z.tolist() for z in np.nonzero(hit)), strict=True):
                if a + i != b + j and joined.join(a + i, b + j):
                    found.append((a + i, b + j))
    return found


def shingle_sets(classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """rep, hashes: the whole sets of the classes. classes: settled, rep, set_a, set_b. docs: as in_order."""
    texts = perhaps_among(docs.select("key", "text"), classes.select(F.col("rep").alias("key")))
    rows = classes.join(texts, classes.rep == texts.key).select("rep", "set_a", "set_b", "text")

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            reps, a, b = (batch.column(c).to_pylist() for c in ("rep", "set_a", "set_b"))
            kept, sets = [], []
            for i in range(len(reps)):
                s = shingle_set(bytes(data[offsets[i] : offsets[i + 1]]), size)
                # a doc_id may have several texts: the class's is meant
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == np.array([a[i], b[i]], np.int64).tobytes():
                    kept.append(reps[i])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["rep", "hashes"])

    return rows.mapInArrow(ending(make, forget), "rep long, hashes binary").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose Jaccard over whole sets reaches the threshold. pairs: a, b."""
    one, other = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    rows = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return rows.mapInArrow(ending(compare), "a long, b long")


def linked_in_tiles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links within the tasks that join all that is near there. members: key (of the task), rep, known."""
    rows = members.join(sets, "rep").select("key", "rep", "known", "hashes").repartition("key").sortWithinPartitions("key", "rep")

    def compare(batches):
        import pyarrow as pa

        def done(reps, known, held):
            pairs = [(reps[i], reps[j]) for i, j in links_among(held, percent, known)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, reps, known, held = None, [], [], []
        for batch in batches:
            for k, rep, c, h in zip(*(batch.column(x).to_pylist() for x in ("key", "rep", "known", "hashes")), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield done(reps, known, held)
                    key, reps, known, held = k, [], [], []
                reps.append(rep)
                known.append(c)
                held.append(np.frombuffer(h, np.uint64))
        if len(held) > 1:
            yield done(reps, known, held)

    return rows.mapInArrow(ending(compare), "a long, b long")


def tiled(banded: DataFrame, shared: DataFrame, joined: DataFrame, tile_bytes: int = TILE_BYTES, tile_sets: int = TILE_SETS) -> DataFrame:
    """key, rep, known: tasks that compare what the links with buckets' first classes left open. banded: rep, n, band, value; shared: band, value, head, n; joined: node, component."""
    groups = joined.withColumnRenamed("node", "rep")
    wide = shared.where("members > 2").join(groups.select(F.col("rep").alias("head"), F.col("component").alias("_home")), "head", "left").select("band", "value", F.coalesce("_home", "head").alias("home"))
    members = banded.join(wide, ["band", "value"]).join(groups, "rep", "left").select("band", "value", "home", "rep", "n", F.coalesce("component", "rep").alias("known"))
    own = F.col("known") == F.col("home")
    number = lambda side: F.ceil(F.greatest(F.sum(F.when(side, F.col("n") * 8)) / tile_bytes, F.count_if(side) / tile_sets, F.lit(1.0))).cast("int")
    parts = members.groupBy("band", "value").agg(F.count_if(~own).alias("others"), number(own).alias("p"), number(~own).alias("q"), F.count("*").alias("k"), F.sum(F.shiftright(F.xxhash64("rep"), 20)).alias("s"), F.sum(F.shiftright(F.hash("rep"), 2).cast("long")).alias("h"))
    # bands often give the same bucket: one of those that hold the same is enough
    one = parts.where("others > 0").groupBy("k", "s", "h").agg(F.min_by(F.struct("band", "value", "p", "q"), F.struct("band", "value")).alias("b")).select("b.*")
    open_ = members.join(one, ["band", "value"])
    t = F.when(own, F.pmod(F.xxhash64("rep"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("rep"), F.col("q"))).cast("int")
    # those joined with the first meet the rest; the rest meet all
    met = open_.withColumn("t", t).withColumn("u", F.explode(F.sequence(F.when(F.col("t") < F.col("p"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)))
    return met.select(F.concat_ws(":", "band", "value", F.least("t", "u"), F.greatest("t", "u")).alias("key"), "rep", "known")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. percent: the least Jaccard of a link, in hundredths; size: words of a shingle."""
    out = settle(components_of(in_order(docs), percent, size, bands, rows))
    # a component is named by the least doc_id there is, whatever its rows without one are
    names = out.groupBy("component").agg(F.min("given").alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), F.col("key") == F.col("component")).otherwise(F.coalesce(F.col("given") == F.col("component_id"), F.lit(False)))
    return out.join(names, "component").select(F.col("given").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def components_of(docs: DataFrame, percent: int, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, given, n_shingles, component (its least key). docs: as in_order."""
    signed = settle(signatures(docs, size, bands, rows))
    some = signed.where("n_shingles > 0")
    classes = settle(some.groupBy("set_a", "set_b").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    banded = classes.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min(F.struct("rep", "n")).alias("h"), F.count("*").alias("members")).where("members > 1")
    shared = settle(shared.select("band", "value", F.col("h.rep").alias("head"), F.col("h.n").alias("head_n"), "members"))
    met = settle(banded.join(shared, ["band", "value"]).select("rep", "n", "band", "value", "head", "head_n"))
    whole = settle(met.select("rep").distinct().join(classes, "rep").select("rep", "set_a", "set_b"))
    sets = settle(shingle_sets(whole, docs, size))
    # of very different sizes no two sets are near
    alike = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    pairs = met.where(F.col("rep") != F.col("head")).where(alike).select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    with_first = settle(confirmed(pairs, sets, percent))
    joined = connected_components(with_first)
    rest = settle(linked_in_tiles(tiled(met.select("rep", "n", "band", "value"), shared, joined), sets, percent))
    drop(joined, sets, whole, met, shared)
    linked = connected_components(with_first.unionByName(rest))
    named = settle(classes.join(linked, classes.rep == linked.node, "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component")))
    drop(classes, linked, with_first, rest)
    out = some.join(named, ["set_a", "set_b"]).select("key", "given", "n_shingles", "component")
    return out.unionByName(signed.where("n_shingles = 0").select("key", "given", "n_shingles", F.col("key").alias("component")))


def one_of_each(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The documents that stay, with all columns they came with: of each component the one of the smallest doc_id (of a component without doc_ids one of the rows), and of repeated rows one."""
    rows = in_order(docs)
    stays = F.col("key") == F.col("component")
    times = settle(components_of(rows, percent, size).groupBy("key").agg(F.when(~F.first(stays), 0).when(F.count("*") > 1, 2).otherwise(1).alias("value")))
    kept = with_value(rows.select("key", "_document"), times).where("value > 0")
    if times.where("value = 2").isEmpty():
        return kept.select("_document.*")
    again = kept.where("value = 2").groupBy("key").agg(F.min_by("_document", F.hash("_document")).alias("_document"))
    return kept.where("value = 1").select("_document").unionByName(again.select("_document")).select("_document.*")
