"""One-hop views, symbol resolution, change reports and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import scalars
from cairn.store import settle

from . import walk

#: bucket, kind of edge, direction seen from the vertex asked about. Fixed values.
BUCKETS = (
    ("callers", "Calls", "in"), ("callees", "Calls", "out"), ("importers", "Imports", "in"), ("imports", "Imports", "out"), ("members", "Defines", "out"), ("container", "MemberOf", "out"),
    ("producers", "Produces", "in"), ("produces", "Produces", "out"), ("consumers", "Consumes", "in"), ("consumes", "Consumes", "out"), ("assumes", "Assumes", "out"), ("assumed_by", "Assumes", "in"),
    ("runs", "Runs", "out"), ("run_by", "Runs", "in"), ("readers", "Reads", "in"), ("reads", "Reads", "out"), ("writers", "Writes", "in"), ("writes", "Writes", "out"), ("columns", "HasColumn", "out"), ("docs", "Documents", "in"), ("mentions", "Mentions", "in"),
)


def query(nodes: DataFrame, text: str) -> DataFrame:
    """Vertices whose name, fqn or path holds the text, whatever its case."""
    return nodes.where(" or ".join(f"contains(lower({c}), lower(:t))" for c in ("name", "fqn", "path")).replace(":t", "'" + text.replace("'", "''") + "'")).orderBy("uid")


def neighbors(nodes: DataFrame, edges: DataFrame, uid: str, direction: str = "in", kinds: tuple[str, ...] = ()) -> DataFrame:
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges.where(F.col(here) == uid)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    return e.select(F.col(there).alias("uid"), F.col("kind").alias("edge_kind"), "provenance", "confidence").join(nodes, "uid")


def context(nodes: DataFrame, edges: DataFrame, uid: str) -> DataFrame:
    """bucket, uid, name, kind, path of everything one hop away, each once per bucket."""
    e = edges.where((F.col("src") == uid) | (F.col("dst") == uid))
    bucket = None
    for name, kind, way in BUCKETS:
        test = (F.col("kind") == kind) & (F.col("way") == way)
        bucket = F.when(test, F.lit(name)) if bucket is None else bucket.when(test, F.lit(name))
    sides = e.where(F.col("src") == uid).select("kind", F.lit("out").alias("way"), F.col("dst").alias("uid")).unionByName(e.where(F.col("dst") == uid).select("kind", F.lit("in").alias("way"), F.col("src").alias("uid")))
    met = sides.withColumn("bucket", bucket).where("bucket is not null").select("bucket", "uid").distinct()
    return met.join(nodes.select("uid", "name", "kind", "path"), "uid").select("bucket", "uid", "name", "kind", "path")


def resolve(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, uid, tier, n: an exact fqn wins over an exact name; n is how many the winning tier has. symbols: symbol."""
    s = symbols.select("symbol").distinct()
    by_fqn = s.join(nodes, s.symbol == nodes.fqn).select("symbol", "uid", F.lit(1).alias("tier"))
    by_name = s.join(nodes, s.symbol == nodes.name).select("symbol", "uid", F.lit(2).alias("tier"))
    return first_tier(by_fqn.unionByName(by_name), ["symbol"])


def first_tier(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the hits of its least tier, with their number n. The least tier and its count come from sums that are combined before the shuffle."""
    least = hits.groupBy(*keys, "tier").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min_by(F.struct("tier", "n"), "tier").alias("t")).select(*keys, F.col("t.tier").alias("tier"), F.col("t.n").alias("n"))
    return hits.join(least, [*keys, "tier"])


def dead_surface(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Operations that nothing produces and nothing consumes."""
    ops = nodes.where(F.col("kind").isin(*schema.OPERATIONS))
    used = edges.where("kind in ('Produces', 'Consumes')").select(F.col("dst").alias("uid")).distinct()
    return ops.join(used, "uid", "left_anti")


def risk(affected: DataFrame, changed: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row: level, n_affected and reasons. affected: uid, kind; changed: uid; changes: plane, change.

    Under 5 LOW, up to 15 MEDIUM, above HIGH; CRITICAL where a contract changes in a breaking way, an operation is affected, or the effect leaves the packages of the change.
    """
    packages = changed.select(scalars.uid_part("uid", 2).alias("package")).distinct()
    outside = affected.withColumn("package", scalars.uid_part("uid", 2)).join(packages, "package", "left_anti").agg(F.min("uid").alias("outside"))
    sums = affected.agg(F.count("*").alias("n_affected"), F.coalesce(F.bool_or(F.col("kind").isin(*schema.OPERATIONS)), F.lit(False)).alias("operation"))
    one = sums.join(outside, F.lit(True))
    breaking = F.lit(False)
    if changes is not None:
        one = one.join(changes.agg(F.coalesce(F.bool_or((F.col("plane") == "contract") & (F.col("change") != "Added")), F.lit(False)).alias("breaking")), F.lit(True))
        breaking = F.col("breaking")
    critical = breaking | F.col("operation") | F.col("outside").isNotNull()
    n = F.col("n_affected")
    level = F.when(critical, "CRITICAL").when(n < 5, "LOW").when(n <= 15, "MEDIUM").otherwise("HIGH")
    reasons = F.concat_ws("; ", F.when(breaking, F.lit("breaking contract change")), F.when(F.col("operation"), F.lit("affects an operation")), F.when(F.col("outside").isNotNull(), F.lit("crosses packages")))
    return one.select(level.alias("level"), "n_affected", reasons.alias("reasons"))


def symbols_in_file(nodes: DataFrame, path: str) -> DataFrame:
    """Symbols of a file: its code vertices but for containers."""
    return nodes.where(scalars.same_file("path", F.lit(path)) & ~F.col("kind").isin("Repo", "Package", "File", "Module", "Doc", "DocSection"))


def blast(nodes: DataFrame, edges: DataFrame, path: str, options: walk.Options = walk.Options()) -> tuple[DataFrame, DataFrame]:
    """What a change of a file reaches: per vertex the least depth, greatest confidence and any ambiguity over the file's symbols; and the risk."""
    own = symbols_in_file(nodes, path)
    merged = combine(walk.impact(nodes, edges, own.select("uid"), options), own)
    return merged, risk(merged.join(nodes.select("uid", "kind"), "uid"), own)


def combine(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Impacts of several targets as one: per vertex least depth, greatest confidence, any ambiguity; the targets themselves are left out."""
    out = found.join(changed.select("uid").distinct(), "uid", "left_anti").groupBy("uid", "name").agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"), F.bool_or("ambiguous").alias("ambiguous"))
    return out.withColumn("will_break", scalars.will_break("confidence", "ambiguous"))


def doc_refs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """uid, confidence of the sections that document or mention any of the symbols."""
    e = edges.where("kind in ('Documents', 'Mentions')")
    return e.join(symbols.select(F.col("uid").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("uid")).agg(F.max("confidence").alias("confidence"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """keys, change: Added, Removed or Modified."""
    a, b = old.select(*keys, F.col(signature).alias("_old"), F.lit(True).alias("_a")), new.select(*keys, F.col(signature).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "Added").when(F.col("_b").isNull(), "Removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "Modified")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change")


def contract_effect(plane: Column, change: Column) -> Column:
    return F.when((plane == "contract") & (change == "Added"), F.lit("Additive")).when(plane == "contract", F.lit("Breaking"))


def implicated_files(nodes: DataFrame, edges: DataFrame, uid: str) -> DataFrame:
    """path, confidence of the files one call or import away in either direction, and of the definition."""
    e = edges.where(F.col("kind").isin("Calls", "Imports"))
    near = e.where(F.col("dst") == uid).select(F.col("src").alias("uid"), "confidence").unionByName(e.where(F.col("src") == uid).select(F.col("dst").alias("uid"), "confidence"))
    near = near.unionByName(nodes.where(F.col("uid") == uid).select("uid", F.lit(schema.CONFIDENCE["extracted"]).cast("float").alias("confidence")))
    return near.join(nodes.select("uid", "path"), "uid").where("path <> ''").groupBy("path").agg(F.max("confidence").alias("confidence"))


def cut_bytes(text: str, most: int) -> str:
    """The longest start of a text that has at most so many bytes in UTF-8; no character is split."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: max(most, 0)].decode(errors="ignore")


def guidance(sections: DataFrame, total: int = 4800, each: int = 1200) -> DataFrame:
    """uid, tier, confidence, text, truncated, ref_only, note: bodies in order of tier, confidence and uid within a budget of bytes. sections: uid, tier, confidence, path, anchor, body (null: unavailable).

    A body longer than its share or what is left, either less a marker's bytes, is
    cut at a character and ends in the marker, which is paid for as well. Where not even one
    character fits, the budget is spent. Once it is, sections are references only. Empty and
    unavailable bodies cost nothing. As every body that is shown costs a byte or more, only
    the first `total` bodies can change the budget: these alone, none longer than needed, meet in one task.
    """
    order = [F.col("tier").asc(), F.col("confidence").desc(), F.col("uid").asc()]
    place = F.struct("tier", -F.col("confidence"), "uid")
    # a character has a byte or more, so this start decides as the whole body does
    first = sections.where("body <> ''").select("uid", "tier", "confidence", "path", "anchor", F.substring("body", 1, each + 1).alias("body")).orderBy(*order).limit(max(total, 0))

    def spend(batches):
        import pandas as pd

        left = total
        for b in batches:
            rows = []
            for uid, tier, confidence, path, anchor, body in b.itertuples(index=False):
                if left == 0:
                    break
                marker = f"… [truncated — fetch {path}#{anchor}]"
                shown = cut_bytes(body, min(each, left) - len(marker.encode()))
                text = shown if shown == body else shown and shown + marker
                left = left - len(text.encode()) if text else 0
                rows.append((uid, tier, confidence, text, text != body, left))
            yield pd.DataFrame(rows, columns=["uid", "tier", "confidence", "text", "truncated", "left"])

    spent = first.coalesce(1).sortWithinPartitions(*order).mapInPandas(spend, "uid string, tier int, confidence float, text string, truncated boolean, left long")
    spent = settle(spent)
    end = spent.where("left = 0").agg(F.min(place).alias("end")) if total > 0 else None
    out = sections.select("uid", F.col("tier").cast("int"), F.col("confidence").cast("float"), "body").join(spent.select("uid", "text", "truncated"), "uid", "left")
    past = F.lit(True)
    if end is not None:
        out = out.join(F.broadcast(end), F.lit(True))
        past = F.coalesce(place > F.col("end"), F.lit(False))
    ref = past | F.coalesce((F.col("body") != "") & (F.coalesce("text", F.lit("")) == ""), F.lit(False))
    note = F.when(F.col("body").isNull() & ~past, "body unavailable")
    return out.select(
        "uid", "tier", "confidence", F.when(past, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        (~ref & F.coalesce("truncated", F.lit(False))).alias("truncated"), ref.alias("ref_only"), note.alias("note"),
    )


def path_matches(node_path: Column, file: Column) -> Column:
    """Whether a vertex's path means a changed file: equal, or either ends in the other."""
    return (node_path == file) | node_path.endswith(file) | file.endswith(node_path)
