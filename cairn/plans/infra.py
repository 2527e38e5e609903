"""Templates, policies and units of a repository as a plane of its graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import infra_links
from cairn.sources import infra
from cairn.store import settle

TEMPLATES = r"\.(json|ya?ml|template|tf|tofu)$"
UNIT = r"(^|/)terragrunt\.hcl$"
# Fixed value: the types whose resolvers implement operations.
ROOTS = ("Query", "Mutation", "Subscription")


def uid_of(package: str, path, name) -> Column:
    return F.concat_ws("|", F.lit("infra"), F.lit(package), path, name, F.lit(""))


def action_uid(package: str, action) -> Column:
    return F.concat_ws("|", F.lit("iam"), F.lit(package), F.lit(""), action, F.lit(""))


def _refs(found: DataFrame, name: str) -> DataFrame:
    """src, template, kind, grade, ids of the references of one property."""
    each = found.select(F.col("uid").alias("src"), F.col("file").alias("template"), "kind", "logical_id", F.explode("refs").alias("r")).where(F.col("r.property") == name)
    return each.select("src", "template", "kind", "logical_id", F.col("r.grade").alias("grade"), F.col("r.ids").alias("ids"))


def _single(refs: DataFrame) -> DataFrame:
    """References that name one resource: a choice between several is no hop of a chain."""
    return refs.where(F.col("grade").isin("Resource", "Inferred") & (F.size("ids") == 1)).withColumn("id", F.col("ids")[0])


def _node(uid: str, kind, name: str, path: str) -> list[Column]:
    none = F.lit(None).cast("int")
    return [F.col(uid).alias("uid"), kind.alias("kind"), F.col(name).alias("name"), F.col(name).alias("fqn"), F.col(path).alias("path"), none.alias("start_line"), none.alias("end_line")]


def _sure(edges: DataFrame, kind: str, confidence: float) -> DataFrame:
    return edges.select("src", "dst", F.lit(kind).alias("kind"), F.lit("Extracted").alias("provenance"), F.lit(confidence).cast("float").alias("confidence"))


def plane(files: DataFrame, package: str, modules: DataFrame, fields: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame]:
    """Nodes, edges, errors (file, error) and counters of the infrastructure. files: path, text; modules: uid, path; fields: key, op (operations of GraphQL schemas).

    A policy is no vertex: what it grants goes to the roles it names in its own
    template. A granted action, and a reason why grants can't be told, is a
    vertex of its own. A template with planned resources stands beside the one
    it was planned from.
    """
    parsed = settle(infra.resources(files.where(F.col("path").rlike(TEMPLATES))))
    found = infra_links.first_of(parsed.where("logical_id is not null").withColumn("uid", uid_of(package, F.col("file"), F.col("logical_id"))), ["uid"], ["type"])
    vertices = found.where("kind <> 'Policy'").select("uid", F.col("file").alias("template"), "logical_id", "kind")
    roles, lambdas_of = _refs(found, "role"), _single(_refs(found, "lambda").where("kind = 'AppSyncDataSource'"))
    sources_of = _refs(found, "data_source").where("kind = 'AppSyncResolver'")

    edges = [
        infra_links.references(roles.where("kind <> 'Policy'"), vertices, "Assumes"),
        infra_links.references(_refs(found, "lambda").where("kind = 'AppSyncDataSource'"), vertices, "Routes"),
        infra_links.references(sources_of, vertices, "Routes"),
    ]
    boxed = infra_links.references(_refs(found, "api").where("kind in ('AppSyncDataSource', 'AppSyncResolver')"), vertices, "Contains")
    edges.append(boxed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "provenance", "confidence"))

    handlers = found.where("kind = 'LambdaFn'").select("uid", F.col("file").alias("template"), "code_uri", "handler")
    run = settle(infra_links.runs(handlers, modules))
    edges.append(_sure(run, "Runs", 0.95))

    asked = found.where("kind = 'AppSyncResolver'").where(F.col("type_name").isin(*ROOTS) & F.col("field_name").isNotNull()).select("uid", F.col("file").alias("template"), F.concat_ws(".", "type_name", "field_name").alias("key"))
    met = asked.join(fields.groupBy("key").agg(F.min("op").alias("op")), "key", "left")
    hop = _single(sources_of).select(F.col("src").alias("uid"), F.col("id").alias("source_id"), "grade")
    sources = lambdas_of.select("template", "logical_id", F.col("id").alias("lambda_id"), "grade")
    made = infra_links.produces(met.where("op is not null").join(hop, "uid", "left"), sources, vertices.where("kind = 'LambdaFn'"))
    edges.append(made.select("src", F.col("op").alias("dst"), F.lit("Produces").alias("kind"), "provenance", "confidence"))

    stated = F.concat("granted", F.transform("opaque", lambda r: F.concat(F.lit("<opaque:"), r, F.lit(">"))))
    named = _refs(found, "role").where("kind = 'Policy'").groupBy("src").agg(F.flatten(F.collect_list("ids")).alias("role_ids"))
    policies = found.where("kind = 'Policy'").join(named, found.uid == named.src, "left").select("uid", F.col("file").alias("template"), "role_ids", stated.alias("granted"))
    attached, lost = infra_links.attach_policies(policies, vertices)
    grants = found.where("kind <> 'Policy'").select(F.col("uid").alias("src"), F.explode(stated).alias("action"))
    grants = settle(grants.unionByName(attached.select(F.col("role").alias("src"), F.explode("granted").alias("action"))).distinct())
    edges.append(_sure(grants.select("src", action_uid(package, F.col("action")).alias("dst")), "Grants", 1.0))

    units = files.where(F.col("path").rlike(UNIT)).withColumn("uid", uid_of(package, F.col("path"), F.when(scalars.parent_dir("path") == "", ".").otherwise(scalars.parent_dir("path"))))
    needs = settle(infra.dependencies(units))
    wanted = needs.where("config_path is not null").select(F.col("file").alias("path"), "config_path")
    between = infra_links.unit_dependencies(wanted, units.select("uid", "path"))
    edges.append(_sure(between, "Routes", 0.95))

    folder = units.select("uid", "path").withColumn("name", F.element_at(F.split("uid", r"\|"), 4))
    actions = grants.select("action").distinct().select(action_uid(package, F.col("action")).alias("uid"), "action", F.lit("").alias("path"))
    nodes = [
        vertices.select(*_node("uid", F.col("kind"), "logical_id", "template")),
        actions.select(*_node("uid", F.lit("CloudAction"), "action", "path")),
        folder.select(*_node("uid", F.lit("CloudResource"), "name", "path")),
    ]
    errors = parsed.where("error is not null").select("file", "error").unionByName(needs.where("error is not null").select("file", "error"))
    return nodes, edges, errors, counters(parsed, met, handlers, run, lost, wanted, between)


def counters(parsed: DataFrame, met: DataFrame, handlers: DataFrame, run: DataFrame, lost: DataFrame, wanted: DataFrame, between: DataFrame) -> DataFrame:
    """One row: what of the infrastructure was read and linked, and what was not."""
    read = parsed.agg(
        F.count_distinct(F.when(F.col("error").isNull(), F.col("file"))).alias("templates_detected"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("file"))).alias("templates_failed"),
        F.count("logical_id").alias("resources_total"),
    )
    resolvers = met.agg(F.count("*").alias("resolvers_total"), F.count("op").alias("resolvers_linked"), F.count_if(F.col("op").isNull()).alias("resolvers_unlinked"))
    runs = handlers.join(run.select(F.col("src").alias("uid"), "dst"), "uid", "left").agg(F.count("dst").alias("lambdas_runs_linked"), F.count_if(F.col("handler").isNotNull() & F.col("dst").isNull()).alias("lambdas_handler_unresolved"))
    deps = wanted.agg(F.count("*").alias("deps_total"))
    linked = between.agg(F.count("*").alias("deps_linked"))
    out = read
    for one in (resolvers, runs, lost.select(F.col("n_unattached").alias("policies_unattached")), deps, linked):
        out = out.join(one, F.lit(True))
    return out
