"""Near-duplicate vectors by cosine: comparison in tiles whose dimensions are in the order of principal components.

Equal vectors are one class. Classes are dealt to cells: a tree halves a bounded
sample along the principal axis of the widest spread, of the LEADING_CELLS first, until
a cell holds about `block` classes (a cell that can't be halved has parts instead, by a
hash). The sample only shapes cells; every class is dealt. A link's vectors lie within a
distance that the threshold gives, so a class meets, besides its own cell, those whose
box is that near to it, and no others: of two cells only what lies near their border is sent. In a task, tiles accumulate
the products of the leading components; what the rest can add is at most the product
of the suffix norms, and pairs that cannot reach the threshold stop there. Pairs left
are decided by their cosine in double precision over the vectors as given.

A tile's links are counted and joined as they are found and then dropped, so a
task's memory is bounded by its two cells; it returns sums and a star of each group it joined, never its pairs. Where
vectors have no direction in common, boxes are near to all and work grows
with the square of the classes: the comparison is exact.

Nulls, zeros, null or non-finite components: no links, a component of its own.
Vectors of different length are never linked. Repeated rows count as other vectors;
null vec_ids too (a component of such rows alone is named by null). Ties: a cosine of the
threshold links; the smallest vec_id names a component. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.components import connected_components

from .common import settle

THRESHOLD = 0.9
BLOCK, TILE, LEADING, LEADING_CELLS = 8192, 1024, 16, 8
#: Classes that shape the cells, about.
SAMPLE = 100_000
SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.cast(pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rotation(classes: DataFrame, d: int) -> np.ndarray:
    """Principal axes of all unit vectors, the most telling first."""

    def moments(batches):
        import pyarrow as pa

        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = units(_matrix(batch.column("v")))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "m"])

    rows = classes.select("v").mapInArrow(moments, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).collect()
    m = np.zeros(d * d)
    for r in rows:
        m[r["i"]] = r["m"]
    values, axes = np.linalg.eigh(m.reshape(d, d))
    return axes[:, np.argsort(-values)]


def linked_tiles(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, same: bool, threshold: float, leading: int = LEADING):
    """Tile by tile, positions in a and b of the pairs that reach the threshold; ra and rb are a and b along the principal axes. same: a is b, and each pair is met once."""
    leading = min(leading, a.shape[1])
    rest = lambda x: np.sqrt(np.maximum((x[:, leading:] ** 2).sum(axis=1), 0))
    sa, sb = rest(ra), rest(rb)
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            bound = ra[i : i + TILE, :leading] @ rb[j : j + TILE, :leading].T
            bound += sa[i : i + TILE, None] * sb[None, j : j + TILE]
            x, y = np.nonzero(bound >= threshold - SLACK)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 16):
                p, q = x[k : k + (1 << 16)] + i, y[k : k + (1 << 16)] + j
                hit = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
                yield p[hit], q[hit]


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label: of each position the least one it is joined with; joins the pairs a, b, in place."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Cells:
    """A tree of half-spaces along leading axes. Inner nodes: axis, cut, children; leaves: number of the cell."""

    def __init__(self, points: np.ndarray, n: int, block: int):
        self.nodes: list[tuple] = []
        self.parts: list[int] = []
        self.axes = points.shape[1]
        self._grow(points, n / max(1, len(points)), block)

    def _grow(self, points: np.ndarray, each: float, block: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        cut = None
        if len(points) * each > block and len(points) > 1:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            cut = float(np.median(points[:, axis]))
            left = points[:, axis] <= cut
            if left.all():  # more than half lie at the greatest value
                left = points[:, axis] < cut
                cut = float(points[left, axis].max()) if left.any() else None
        if cut is None:
            self.parts.append(max(1, -(-int(len(points) * each) // block)))
            self.nodes[at] = (len(self.parts) - 1,)
        else:
            self.nodes[at] = (axis, cut, self._grow(points[left], each, block), self._grow(points[~left], each, block))
        return at

    def near(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of point, cell, and whether the cell is its own: the cells whose box lies within reach."""
        found = []
        stack = [(0, np.arange(len(points)), np.zeros_like(points), np.ones(len(points), bool))]
        while stack:
            at, which, off, own = stack.pop()
            if not len(which):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                found.append((which, np.full(len(which), node[0]), own))
                continue
            axis, cut, left, right = node
            p = points[which, axis]
            for child, beyond, mine in ((left, p - cut, p <= cut), (right, cut - p, p > cut)):
                o = off.copy()
                o[:, axis] = np.maximum(o[:, axis], np.where(mine, 0, np.maximum(beyond, 0)))
                near = (o * o).sum(axis=1) <= reach * reach
                stack.append((child, which[near], o[near], (own & mine)[near]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _links(classes: DataFrame, d: int, n: int, threshold: float, block: int) -> DataFrame:
    """rep, links (rows of other classes linked), root: per task and class with links."""
    axes = rotation(classes, d)
    spark, leading = classes.sparkSession, axes[:, : min(LEADING_CELLS, d)]
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(n)) < SAMPLE).select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks() if n > block else None
    cells = Cells(units(_matrix(sample)) @ leading if sample is not None and len(sample) else np.zeros((1, leading.shape[1])), n, block)
    reach = (2 - 2 * threshold) ** 0.5 + 1e-6
    shared = spark.sparkContext.broadcast((axes, cells))

    def deal(batches):
        import pyarrow as pa

        axes, cells = shared.value
        parts = np.array(cells.parts)
        first = np.cumsum(parts) - parts
        for batch in batches:
            if not batch.num_rows:
                continue
            point, cell, mine = cells.near(units(_matrix(batch.column("v"))) @ axes[:, : cells.axes], reach)
            own = np.empty(batch.num_rows, np.int64)
            own[point[mine]] = cell[mine]
            mixed = batch.column("rep").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own = first[own] + (mixed >> np.uint64(33)).astype(np.int64) % parts[own]
            # every part of a cell that is near
            times = parts[cell]
            point = np.repeat(point, times)
            other = np.repeat(first[cell], times) + np.arange(len(point)) - np.repeat(np.cumsum(times) - times, times)
            a, b = np.minimum(own[point], other), np.maximum(own[point], other)
            taken = batch.take(pa.array(point))
            yield pa.RecordBatch.from_arrays([pa.array(a * int(parts.sum()) + b), pa.array((own[point] > other).astype(np.int32)), *(taken.column(c) for c in ("rep", "n", "v"))], names=["key", "side", "rep", "n", "v"])

    dealt = classes.mapInArrow(deal, "key long, side int, rep long, n long, v array<double>")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "side")
    total = sum(cells.parts)

    def compare(batches):
        import pyarrow as pa

        axes = shared.value[0]

        def done(key, rep, n, side, v):
            rep, n, side, v = (np.concatenate(x) for x in (rep, n, side, v))
            x = units(v)
            r = x @ axes
            same = key // total == key % total
            cut = 0 if same else int((side == 0).sum())
            links, label = np.zeros(len(n), np.int64), np.arange(len(n))
            for a, b in linked_tiles(x if same else x[:cut], x[cut:], r if same else r[:cut], r[cut:], same, threshold):
                b = b + cut
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                join(label, a, b)
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[label[some]])], names=["rep", "links", "root"])

        key, held = None, ([], [], [], [])
        for batch in batches:
            keys = batch.column("key").to_numpy()
            bounds = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    if held[0]:
                        yield done(key, *held)
                    key, held = int(keys[lo]), ([], [], [], [])
                part = batch.slice(lo, hi - lo)
                for to, x in zip(held, (part.column("rep").to_numpy(), part.column("n").to_numpy(), part.column("side").to_numpy(), _matrix(part.column("v"))), strict=True):
                    to.append(x)
        if held[0]:
            yield done(key, *held)

    return dealt.mapInArrow(compare, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    given = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.withColumn("ok", F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    valid = given.where("ok").select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = settle(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    found = None
    for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():
        part = _links(classes.where(F.size("v") == r["d"]), r["d"], r["n"], threshold, block)
        found = part if found is None else found.unionByName(part)
    lone = given.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        found = settle(found)
        sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
        joined = connected_components(found, "root", "rep")
        named = classes.join(sums, "rep", "left").join(joined, classes.rep == joined.node, "left")
        named = settle(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", classes.rep).alias("component_id")))
        lone = valid.join(named, "v").select("vec_id", "n_links", "component_id").unionByName(lone)
    return lone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
