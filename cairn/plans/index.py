"""A repository's files as a graph: facts of sources, contracts, schemas and texts, put together by the linkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import calls, code_links, linkers
from cairn.operators.infra_links import first_of
from cairn.plans import infra
from cairn.store import settle
from cairn.sources import brace_code, contracts, ddl, markdown, python_code


def _uid(language, package: str, path, fqn) -> Column:
    return F.concat_ws("|", language, F.lit(package), path, fqn, F.lit(""))


def _ends(*extensions: str) -> Column:
    return F.col("path").rlike(r"\.(" + "|".join(extensions) + ")$")


def _edges(df: DataFrame, src: str, dst: str, kind) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"), k.alias("kind"), "provenance", F.col("confidence").cast("float").alias("confidence"))


def _sure(df: DataFrame, provenance: str = "Extracted", confidence: float = 1.0) -> DataFrame:
    return df.withColumn("provenance", F.lit(provenance)).withColumn("confidence", F.lit(confidence))


def facts(files: DataFrame) -> DataFrame:
    """Facts of the files in languages there is a parser for. files: path, text."""
    code = [e for ends in brace_code.EXTENSIONS.values() for e in ends if e != "py"]
    return python_code.facts(files.where(_ends("py"))).unionByName(brace_code.facts(files.where(_ends(*code))))


def index(files: DataFrame, package: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and diagnostics (file, error) of a repository. files: path, text."""
    files = files.select("path", "text")
    found = settle(facts(files))
    operations = settle(contracts.operations(files.where(_ends("json", "ya?ml", "graphql", "gql", "proto"))))
    columns = settle(ddl.columns(files.where(_ends("sql"))))
    sections = settle(markdown.anchors(markdown.sections(files.where(_ends("md")))))
    language = lambda c: scalars.code_language(c)

    code = files.where(_ends(*(e for ends in brace_code.EXTENSIONS.values() for e in ends))).select("path")
    modules = code.select(_uid(language("path"), package, F.col("path"), F.lit("<module>")).alias("uid"), F.lit("Module").alias("kind"), scalars.base_name("path").alias("name"), F.lit("<module>").alias("fqn"), "path")
    modules = modules.withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(None).cast("int"))
    symbols = found.where("record = 'symbol' and kind <> 'Module'").select(
        _uid(language("file"), package, F.col("file"), F.col("fqn")).alias("uid"), "kind", "name", "fqn", F.col("file").alias("path"), F.col("line").alias("start_line"), "end_line", F.col("owner").alias("container_fqn")
    )
    symbols = settle(first_of(symbols, ["uid"], ["start_line", "end_line", "kind"]))
    whole = settle(symbols.drop("container_fqn").unionByName(modules))
    place = whole.select(F.col("path").alias("file"), F.col("fqn").alias("owner"), F.col("uid").alias("from"))
    inside = lambda record: found.where(F.col("record") == record).join(place, ["file", "owner"], "left")

    edges = []
    boxed = linkers.containment(symbols.select("uid", "fqn", "container_fqn", F.col("path").alias("file")), _uid(language("file"), package, F.col("file"), F.lit("<module>")))
    edges.append(_edges(_sure(boxed), "src", "dst", F.col("kind")))

    imports = found.where("record = 'import'").select("file", F.col("value").alias("specifier")).distinct()
    paths = code.select("path")
    by_path = linkers.resolve_imports(imports.where(~F.col("file").endswith(".py")), paths).select("file", "specifier", "resolved")
    by_module = code_links.resolve_modules(imports.where(F.col("file").endswith(".py")).withColumnRenamed("specifier", "module"), paths).select("file", F.col("module").alias("specifier"), "resolved")
    told = settle(by_path.unionByName(by_module).where("resolved is not null"))
    met = told.select("file", "resolved").distinct()
    bindings = found.where("record = 'import' and name is not null").select("file", "name", F.col("value").alias("specifier")).join(told, ["file", "specifier"]).select("file", "name", F.col("resolved").alias("target"))
    module = lambda c: _uid(language(c), package, F.col(c), F.lit("<module>"))
    edges.append(_edges(_sure(met.select(module("file").alias("src"), module("resolved").alias("dst"))), "src", "dst", "Imports"))

    calling = inside("call").where("`from` is not null").select(
        F.concat_ws(":", "file", "line", "col", "name").alias("site"), "file", F.col("name").alias("callee"), F.col("from").alias("caller"), "owner",
        F.when(F.col("kind") != "bare", F.col("value")).alias("receiver"), (F.col("kind") == "path").alias("path"),
    )
    called = symbols.select("uid", "name", F.col("path").alias("file"), "kind", "container_fqn")
    for name in calls.RULES:
        ours = lambda df, c="file": df.where(language(c) == name)  # noqa: E731, B023
        linked = calls.link_calls(ours(calling), ours(called), bindings, name)
        best = linked.groupBy("caller", "uid").agg(F.max_by(F.struct("provenance", "confidence"), "confidence").alias("g")).select("caller", "uid", "g.*")
        edges.append(_edges(best, "caller", "uid", "Calls"))

    ops = operations.where("key is not null").withColumn("op", F.concat_ws("|", F.lit("contract"), F.lit(package), F.lower("format"), "key", F.lit("")))
    ops = first_of(ops, ["op"], ["file", "key"])
    handlers = inside("route").select(F.concat_ws(":", "file", "line", "kind").alias("route"), F.col("kind").alias("method"), F.col("value").alias("path"), "file", F.col("name").alias("handler"), F.col("owner").alias("enclosing_fqn"))
    made = linkers.link_producers(handlers, ops).join(code_links.handler_or_enclosing(handlers, whole.select("uid", F.col("path").alias("file"), "name", "fqn")), "route")
    edges.append(_edges(made, "uid", "op", "Produces"))
    asks = inside("http").select(F.concat_ws(":", "file", "line", "col").alias("call"), F.col("kind").alias("method"), F.regexp_replace("value", r"^https?://[^/]*", "").alias("url"), F.col("name").alias("shape"), "from")
    used = linkers.link_consumers(asks.withColumn("shape", F.when(F.contains("url", F.lit("{}")), "Template").otherwise("Literal")), ops).join(asks.select("call", "from"), "call")
    edges.append(_edges(used, "from", "op", "Consumes"))
    resolved = inside("resolver").select(F.concat_ws(":", "file", "line", "col").alias("signal"), F.col("value").alias("key"), F.concat_ws("|", language("file"), F.lit(package), "file", "fqn", F.lit("")).alias("by"))
    edges.append(_edges(code_links.graphql_links(resolved, ops).join(resolved.select("signal", "by"), "signal"), "by", "op", "Produces"))

    table = columns.where("`table` is not null").withColumn("t", _uid(F.lit("data"), package, F.col("file"), F.col("table"))).withColumn("c", _uid(F.lit("data"), package, F.col("file"), F.concat_ws(".", "table", "column")))
    edges.append(_edges(_sure(table.select("t", "c"), confidence=0.95), "t", "c", "HasColumn"))
    keys = table.where("ref_table is not null").select(F.col("c").alias("src"), "ref_table", "ref_column")
    edges.append(linkers.link_foreign_keys(keys, table.select(F.col("c").alias("uid"), "table", "column", "file")))
    statements = inside("sql").select(F.concat_ws(":", "file", "owner").alias("path"), F.col("value").alias("text"))
    refs = ddl.table_references(statements).where("`table` is not null").select(F.regexp_extract("file", "^(.*):", 1).alias("f"), F.regexp_extract("file", "([^:]*)$", 1).alias("enclosing_fqn"), "table", "access")
    tables = table.select(F.col("t").alias("uid"), F.col("table").alias("name"), "file").distinct()
    edges.append(linkers.link_tables(refs.withColumnRenamed("f", "file"), tables, whole.select("uid", F.col("path").alias("file"), "fqn")).select("src", "dst", "kind", "provenance", "confidence"))
    models = found.where("record = 'orm'").select("file", F.col("fqn").alias("owner"), F.col("value").alias("name")).join(place, ["file", "owner"]).join(tables.groupBy("name").agg(F.min_by("uid", "file").alias("t")), "name")
    edges.append(_edges(_sure(models, confidence=0.95), "from", "t", "MapsTo"))

    resources, wired, faults, _ = infra.plane(files, package, modules.select("uid", "path"), ops.where("format = 'GraphQl'").select("key", "op"))
    edges += wired

    doc = sections.withColumn("fqn", F.concat_ws("#", "path", "anchor")).withColumn("uid", _uid(F.lit("doc"), package, F.col("path"), F.col("fqn")))
    named = doc.select(F.col("uid").alias("section"), F.col("path").alias("doc"), F.explode("refs").alias("r")).select("section", "doc", F.col("r.ref").alias("ref"), F.col("r.form").alias("form"))
    mentions = linkers.link_mentions(named, whole.select("uid", "path", "fqn", "name", (F.col("kind") == "Module").alias("path_bearing")))
    edges.append(_edges(mentions, "section", "uid", "Mentions"))

    nothing = F.lit(None).cast("int")
    nodes = [
        whole,
        *resources,
        ops.select(F.col("op").alias("uid"), F.when(F.col("format") == "GraphQl", "GraphqlField").otherwise("ApiOperation").alias("kind"), F.col("key").alias("name"), F.col("key").alias("fqn"), F.col("file").alias("path"), nothing.alias("start_line"), nothing.alias("end_line")),
        table.select(F.col("t").alias("uid"), F.lit("Table").alias("kind"), F.col("table").alias("name"), F.col("table").alias("fqn"), F.col("file").alias("path"), nothing.alias("start_line"), nothing.alias("end_line")).distinct(),
        table.select(F.col("c").alias("uid"), F.lit("Column").alias("kind"), F.col("column").alias("name"), F.concat_ws(".", "table", "column").alias("fqn"), F.col("file").alias("path"), nothing.alias("start_line"), nothing.alias("end_line")),
        doc.select("uid", F.lit("DocSection").alias("kind"), F.col("heading").alias("name"), "fqn", "path", "start_line", "end_line"),
    ]
    errors = [x.where("error is not null").select("file", "error") for x in (found, operations, columns)] + [faults]
    return settle(_union(nodes)), settle(_union(edges)), _union(errors)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
