"""Reachability with path confidence: impact, explanations, members, neighbourhoods.

A walk goes against the direction of edges, level by level. Per level and source
it keeps two states of a vertex, ambiguous or not, each with its greatest
confidence: confidence multiplies along a path in single precision, ambiguity
sticks. The walk is exhaustive up to its depth and free of order; many targets
are walked at once, as the target is a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions.scalars import will_break

from cairn.store import settle


@dataclass(frozen=True)
class Options:
    depth: int = 5
    min_confidence: float = 0.0
    imports: bool = False
    contracts: bool = True
    infra: bool = True

    def kinds(self) -> tuple[str, ...]:
        return schema.WALKED + (("Imports",) if self.imports else ()) + (schema.WALKED_INFRA if self.infra else ())


def _ready(nodes: DataFrame, edges: DataFrame, options: Options, *more: str) -> DataFrame:
    """Live edges of the kinds a walk goes along, and of more, written once: each level reads them."""
    return settle(live(nodes, edges.where(F.col("kind").isin(*options.kinds(), "Produces", "Consumes", *more))))


def live(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are vertices."""
    ids = nodes.select("uid")
    return edges.join(ids, edges.src == ids.uid, "left_semi").join(ids, edges.dst == ids.uid, "left_semi")


def _times(c: Column) -> Column:
    return (c * F.col("confidence")).cast("float")


def _step(frontier: DataFrame, edges: DataFrame, options: Options, path: bool) -> DataFrame:
    """From states (target, uid, amb, conf) to those one edge farther."""
    e = edges.where(F.col("kind").isin(*options.kinds())).select(F.col("src").alias("to"), F.col("dst").alias("uid"), "kind", "provenance", "confidence")
    moved = frontier.join(e, "uid").withColumn("c", _times(F.col("conf"))).withColumn("a", F.col("amb") | (F.col("provenance") == "Ambiguous"))
    moved = moved.where(F.col("c") >= F.lit(options.min_confidence).cast("float"))
    found = [F.max("c").alias("conf")]
    if path:
        hop = F.struct(F.col("uid").alias("to"), F.col("to").alias("from"), F.col("kind").alias("edge_kind"), "provenance", F.col("confidence").alias("edge_confidence"), F.col("c").alias("running"))
        found.append(F.max_by(F.concat("path", F.array(hop)), F.struct("c", "uid", "kind")).alias("path"))
    return moved.groupBy("target", F.col("to").alias("uid"), F.col("a").alias("amb")).agg(*found)


def reach(starts: DataFrame, edges: DataFrame, options: Options, path: bool = False) -> DataFrame:
    """starts: target, uid, amb, conf, depth. States reached after them, with depth.

    A state no surer than one of the same vertex and ambiguity of an earlier level
    is left out and not walked on: whatever follows it, the earlier one reaches sooner
    and at least as surely. So a cycle ends once it adds nothing.
    """
    keep = ["target", "uid", "amb", "conf", *(["path"] if path else [])]
    frontier, out = None, None
    for d in range(options.depth):
        new = starts.where(F.col("depth") == d).select(*keep)
        frontier = new if frontier is None else frontier.unionByName(new)
        found = _step(frontier, edges, options, path)
        if out is not None:
            seen = out.groupBy("target", "uid", "amb").agg(F.max("conf").alias("surest"))
            found = found.join(seen, ["target", "uid", "amb"], "left").where("surest is null or conf > surest").select(*keep)
        # written per level, as the levels before would be run again for each level after
        frontier = settle(found)
        level = frontier.withColumn("depth", F.lit(d + 1))
        out = level if out is None else out.unionByName(level)
        if d + 1 < options.depth and frontier.isEmpty() and starts.where(F.col("depth") > d).isEmpty():
            break
    return out


def _merged(states: DataFrame) -> DataFrame:
    return states.groupBy("target", "uid").agg(F.min("depth").alias("depth"), F.max("conf").alias("confidence"), F.bool_or("amb").alias("ambiguous"))


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, options: Options = Options()) -> DataFrame:
    """target, uid, name, depth, confidence, ambiguous, will_break of all that a change of each target reaches. targets: uid."""
    return _impact(nodes, _ready(nodes, edges, options), targets, options)


def _impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, options: Options) -> DataFrame:
    given = targets.select(F.col("uid").alias("target")).distinct()
    least = F.lit(options.min_confidence).cast("float")
    start = given.select("target", F.col("target").alias("uid"), F.lit(False).alias("amb"), F.lit(1.0).cast("float").alias("conf"), F.lit(0).alias("depth"))
    states = reach(start, edges, options)
    if options.contracts:
        consumes = edges.where("kind = 'Consumes'").select(F.col("dst").alias("op"), F.col("src").alias("consumer"), "provenance", "confidence")
        seeds = _merged(states).select("target", "uid", F.col("ambiguous").alias("amb"), F.col("confidence").alias("conf"), "depth").unionByName(start).where(F.col("depth") < options.depth)
        produces = edges.where("kind = 'Produces'").select(F.col("src").alias("uid"), F.col("dst").alias("op"), "provenance", "confidence")
        ops = seeds.join(produces, "uid").select("target", F.col("op").alias("uid"), (F.col("amb") | (F.col("provenance") == "Ambiguous")).alias("amb"), _times(F.col("conf")).alias("conf"), (F.col("depth") + 1).alias("depth")).where(F.col("conf") >= least)
        # a target that is an operation itself is consumed at depth 1
        asked = nodes.where(F.col("kind").isin(*schema.OPERATIONS)).select("uid")
        own = start.join(asked, "uid", "left_semi").select("target", "uid", "amb", "conf", "depth")
        met = ops.unionByName(own).withColumnRenamed("uid", "op").join(consumes, "op")
        consumers = met.select("target", F.col("consumer").alias("uid"), (F.col("amb") | (F.col("provenance") == "Ambiguous")).alias("amb"), _times(F.col("conf")).alias("conf"), (F.col("depth") + 1).alias("depth"))
        producers = own.withColumnRenamed("uid", "op").join(edges.where("kind = 'Produces'").select(F.col("dst").alias("op"), F.col("src").alias("producer"), "provenance", "confidence"), "op")
        producers = producers.select("target", F.col("producer").alias("uid"), (F.col("provenance") == "Ambiguous").alias("amb"), F.col("confidence").cast("float").alias("conf"), F.lit(1).alias("depth"))
        more = consumers.unionByName(producers).where((F.col("conf") >= least) & (F.col("depth") <= options.depth))
        more = settle(more.groupBy("target", "uid", "amb", "depth").agg(F.max("conf").alias("conf")))
        columns = ["target", "uid", "amb", "conf", "depth"]
        states = states.select(*columns).unionByName(ops.select(*columns)).unionByName(more.select(*columns)).unionByName(reach(more, edges, options).select(*columns))
    found = _merged(states).where("uid <> target").join(nodes.dropDuplicates(["uid"]).select("uid", "name"), "uid")
    return found.select("target", "uid", "name", "depth", "confidence", "ambiguous", will_break("confidence", "ambiguous").alias("will_break"))


def ranked(found: DataFrame) -> DataFrame:
    """Greatest confidence first, then uid."""
    return found.orderBy(F.col("confidence").desc(), "uid")


def explain(nodes: DataFrame, edges: DataFrame, targets: DataFrame, options: Options = Options()) -> DataFrame:
    """target, uid, hop, from, to, edge_kind, provenance, confidence, running_confidence: the surest path to each vertex of the plain walk."""
    empty = "cast(array() as array<struct<to:string,from:string,edge_kind:string,provenance:string,edge_confidence:float,running:float>>)"
    start = targets.select(F.col("uid").alias("target")).distinct().select("target", F.col("target").alias("uid"), F.lit(False).alias("amb"), F.lit(1.0).cast("float").alias("conf"), F.lit(0).alias("depth"), F.expr(empty).alias("path"))
    states = reach(start, _ready(nodes, edges, options), options, path=True).where("uid <> target")
    best = states.groupBy("target", "uid").agg(F.max_by("path", F.struct("conf", -F.col("depth"))).alias("path"))
    hops = best.select("target", "uid", F.posexplode("path").alias("hop", "h"))
    return hops.select("target", "uid", (F.col("hop") + 1).alias("hop"), F.col("h.from").alias("from"), F.col("h.to").alias("to"), F.col("h.edge_kind"), F.col("h.provenance"), F.col("h.edge_confidence").alias("confidence"), F.col("h.running").alias("running_confidence"))


def members_with_dependents(nodes: DataFrame, edges: DataFrame, targets: DataFrame, options: Options = Options()) -> DataFrame:
    """target, member, name: members of targets nothing depends on, whose own impact reaches someone other than the target."""
    out = _ready(nodes, edges, options, "Defines", "Contains", "HasColumn")
    quiet = targets.select("uid").distinct().join(_impact(nodes, out, targets, options).select(F.col("target").alias("uid")), "uid", "left_anti")
    members = quiet.join(out.where("kind in ('Defines', 'Contains', 'HasColumn')"), quiet.uid == out.src).select(F.col("src").alias("owner"), F.col("dst").alias("uid")).distinct()
    reached = _impact(nodes, out, members.select("uid").distinct(), options).select(F.col("target").alias("uid"), F.col("uid").alias("who"))
    alive = members.join(reached, "uid").where("who <> owner").select("owner", "uid").distinct()
    return alive.join(nodes.select("uid", "name"), "uid").select(F.col("owner").alias("target"), F.col("uid").alias("member"), "name")


def subgraph(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 2, kinds: tuple[str, ...] = (), most: int | None = 500) -> tuple[DataFrame, DataFrame, bool]:
    """Vertices within `depth` (at most 3) hops in either direction, nearest and then least uid first, at most `most` (None: all); the edges met; whether vertices were left out."""
    used = live(nodes, edges)
    if kinds:
        used = used.where(F.col("kind").isin(*kinds))
    both = used.select(F.col("src").alias("here"), F.col("dst").alias("there")).unionByName(used.select(F.col("dst").alias("here"), F.col("src").alias("there"))).distinct()
    seen = nodes.where(F.col("uid") == start).select("uid", F.lit(0).alias("depth")).distinct()
    for d in range(1, min(depth, 3) + 1):
        new = seen.where(F.col("depth") == d - 1).join(both, seen.uid == both.here).select(F.col("there").alias("uid")).distinct().join(seen, "uid", "left_anti")
        seen = seen.unionByName(new.withColumn("depth", F.lit(d)))
    chosen = seen if most is None else seen.orderBy("depth", "uid").limit(most)
    inside = chosen.select("uid")
    met = used.join(inside, used.src == inside.uid, "left_semi").join(inside, used.dst == inside.uid, "left_semi")
    return chosen.join(nodes, "uid"), met, most is not None and seen.limit(most + 1).count() > most
