"""One graph and the questions it answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import metrics, overlay, views, walk
from cairn.plans import index as indexing
from cairn.sources import catalog, files


class Graph:
    """Nodes and edges, with the sections and texts that searches and renames read."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None, sources: DataFrame | None = None):
        self.nodes, self.edges, self.entries, self.sources = nodes, edges, entries, sources

    @classmethod
    def of_files(cls, sources: DataFrame, package: str) -> Graph:
        """The graph of a repository's files. sources: path, text."""
        nodes, edges, _ = indexing.index(sources, package)
        docs = nodes.where("kind = 'DocSection'").join(sources.select("path", "text"), "path")
        lines = F.slice(F.split("text", "\n"), F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
        return cls(nodes, edges, docs.select("uid", F.array_join(lines, "\n").alias("body")), sources)

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, package: str, patterns: list[str] = ()) -> Graph:
        kept = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "cs", "sql", "json", "yaml", "yml", "graphql", "gql", "proto", "md", "template", "tf", "tofu", "hcl")
        return cls.of_files(files.read(spark, root, kept, list(patterns)), package)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Graph:
        return cls(*(catalog.load(spark, root, n) for n in ("nodes", "edges", "docs_entries")))

    def save(self, root: str) -> int:
        return catalog.save(root, nodes=self.nodes, edges=self.edges, docs_entries=self.entries if self.entries is not None else self.nodes.sparkSession.createDataFrame([], "uid string, body string"))

    def resolve(self, symbol: str) -> DataFrame:
        """uid, tier, n of what a name means: a uid, else an exact fqn, else an exact name; several rows are candidates."""
        pinned = self.nodes.where(F.col("uid") == symbol).select("uid").distinct()
        if not pinned.isEmpty():
            return pinned.select("uid", F.lit(0).alias("tier"), F.lit(1).cast("long").alias("n"))
        return views.resolve(self.nodes, self.nodes.sparkSession.createDataFrame([(symbol,)], "symbol string")).select("uid", "tier", "n")

    def _one(self, symbol: str) -> str:
        rows = self.resolve(symbol).limit(6).collect()
        if len(rows) != 1:
            raise LookupError(f"{symbol!r} is " + ("unknown" if not rows else "one of " + ", ".join(sorted(r["uid"] for r in rows))))
        return rows[0]["uid"]

    def _target(self, symbol: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(self._one(symbol),)], "uid string")

    def impact(self, symbol: str, options: walk.Options = walk.Options()) -> DataFrame:
        return walk.ranked(walk.impact(self.nodes, self.edges, self._target(symbol), options))

    def explain(self, symbol: str, affected: str, options: walk.Options = walk.Options()) -> DataFrame:
        return walk.explain(self.nodes, self.edges, self._target(symbol), options).where(F.col("uid") == self._one(affected)).orderBy("hop")

    def context(self, symbol: str) -> DataFrame:
        return views.context(self.nodes, self.edges, self._one(symbol))

    def query(self, text: str) -> DataFrame:
        return views.query(self.nodes, text)

    def blast(self, path: str, options: walk.Options = walk.Options()) -> tuple[DataFrame, DataFrame]:
        return views.blast(self.nodes, self.edges, path, options)

    def detect_changes(self, newer: Graph, signature: str = "end_line") -> DataFrame:
        """uid, change from this graph to a newer one."""
        of = lambda g: g.nodes.select("uid", F.col(signature).cast("string").alias("signature")).dropDuplicates(["uid"])
        return views.diff(of(self), of(newer), ["uid"])

    def rename(self, symbol: str, new: str) -> DataFrame:
        """path, line, col, confidence of the places to edit; nothing is written. A symbol of the new name in its file is an error."""
        uid = self._one(symbol)
        if not overlay.collisions(self.nodes, uid, new).isEmpty():
            raise ValueError(f"{new!r} is there already")
        name = self.nodes.where(F.col("uid") == uid).first()["name"]
        near = views.implicated_files(self.nodes, self.edges, uid)
        return overlay.rename_edits(self.sources.join(near.select("path"), "path", "left_semi"), name).join(near, "path").orderBy("path", "line", "col")

    def search_docs(self, text: str, k: int = 5) -> DataFrame:
        return metrics.bm25(self.entries, text, min(max(k, 1), 25))

    def guidance(self, symbol: str, total: int = 4800, each: int = 1200) -> DataFrame:
        """Sections about a symbol: those that document it first, then those that mention it, within a budget of bytes."""
        e = self.edges.where(F.col("dst") == self._one(symbol)).where("kind in ('Documents', 'Mentions')")
        near = e.groupBy(F.col("src").alias("uid")).agg(F.min(F.when(F.col("kind") == "Documents", 1).otherwise(2)).alias("tier"), F.max("confidence").alias("confidence"))
        docs = self.nodes.where("kind = 'DocSection'").select("uid", "path", F.regexp_extract("fqn", "#(.*)$", 1).alias("anchor"))
        return views.guidance(near.join(docs, "uid").join(self.entries, "uid", "left"), total, each).orderBy("tier", F.col("confidence").desc(), "uid")

    def section(self, symbol: str, anchor: str) -> DataFrame:
        """uid, body of one section about a symbol, whole."""
        e = self.edges.where(F.col("dst") == self._one(symbol)).where("kind in ('Documents', 'Mentions')").select(F.col("src").alias("uid")).distinct()
        docs = self.nodes.where((F.col("kind") == "DocSection") & F.col("fqn").endswith(f"#{anchor}")).select("uid")
        return docs.join(e, "uid", "left_semi").join(self.entries, "uid", "left")
