"""Edges between resources of templates, and from resources to code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scalars

from .fan_out import fan_out

#: Confidence of a reference by how it is stated. Fixed values.
STATED = {"Resource": 0.95, "Inferred": 0.70, "Multi": 0.70}
#: Suffixes of a handler's source file, in the order they are named.
HANDLER_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi")


def _confidence(grade: Column) -> Column:
    return F.when(grade == "Resource", STATED["Resource"]).otherwise(STATED["Inferred"]).cast("float")


def references(refs: DataFrame, resources: DataFrame, kind: str) -> DataFrame:
    """src, dst, kind, provenance, confidence: an edge per id that its own template has. refs: src, template, grade, ids; resources: uid, template, logical_id."""
    named = refs.select("src", "template", "grade", F.explode("ids").alias("logical_id"))
    hits = named.join(resources.select("template", "logical_id", F.col("uid").alias("dst")), ["template", "logical_id"])
    out = hits.select("src", "dst", F.lit(kind).alias("kind"), F.when(F.col("grade") == "Resource", "Extracted").otherwise("Inferred").alias("provenance"), _confidence(F.col("grade")).alias("confidence"))
    return out.groupBy("src", "dst", "kind").agg(F.max_by("provenance", "confidence").alias("provenance"), F.max("confidence").alias("confidence"))


def produces(resolvers: DataFrame, sources: DataFrame, lambdas: DataFrame) -> DataFrame:
    """src, op, provenance, confidence: who produces a resolver's operation. Along resolver, data source and function the weakest hop grades; where the chain breaks, the resolver itself produces it.

    resolvers: uid, template, op, source_id, grade; sources: template, logical_id, lambda_id, grade; lambdas: template, logical_id, uid.
    """
    s = sources.select("template", F.col("logical_id").alias("source_id"), "lambda_id", F.col("grade").alias("second"))
    f = lambdas.select("template", F.col("logical_id").alias("lambda_id"), F.col("uid").alias("lambda"))
    chain = resolvers.join(s, ["template", "source_id"], "left").join(f, ["template", "lambda_id"], "left")
    plain = F.col("lambda").isNull() | ((F.col("grade") == "Resource") & (F.col("second") == "Resource"))
    return chain.select(
        F.coalesce("lambda", "uid").alias("src"), "op", F.when(plain, "Extracted").otherwise("Inferred").alias("provenance"),
        F.when(plain, STATED["Resource"]).otherwise(STATED["Inferred"]).cast("float").alias("confidence"),
    )


def runs(lambdas: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst: functions whose handler is exactly one module: template's folder, code folder and the handler without its last name, by any of the suffixes. lambdas: uid, template, code_uri, handler; modules: uid, path."""
    stem = F.regexp_replace("handler", r"\.[^.]*$", "")
    folder = scalars.parent_dir("template")
    base = scalars.normalize_dots(F.concat_ws("/", F.when(folder != "", folder), F.coalesce("code_uri", F.lit(".")), stem))
    tried = lambdas.where("handler is not null").select(F.col("uid").alias("src"), F.explode(F.array(*(F.concat(base, F.lit(s)) for s in HANDLER_SUFFIXES))).alias("path"))
    hits = tried.join(modules.select("path", F.col("uid").alias("dst")), "path")
    return hits.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst")).where("n = 1").select("src", "dst")


def attach_policies(policies: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """role, policy, granted; and one row n_unattached: policies that name no role there is. policies: uid, template, role_ids, granted; roles: uid, template, logical_id."""
    at = ["template", "logical_id"]
    named = policies.select("template", F.col("uid").alias("policy"), "granted", F.explode_outer("role_ids").alias("logical_id"))
    there = roles.where("uid is not null").select(*at, F.col("uid").alias("role")).distinct()
    met = named.select(*at, "policy").join(there.select(*at).distinct().withColumn("met", F.lit(1)), at, "left")
    lost = met.groupBy("policy").agg(F.max("met").alias("met")).agg(F.count_if(F.col("met").isNull()).alias("n_unattached"))
    named = named.distinct()
    # a role of one place meets a policy once; only roles with several ids can meet it again
    places = there.groupBy("role").agg(F.count("*").alias("places"))
    once, more = (there.join(places.where(test), "role", "left_semi") for test in ("places = 1", "places > 1"))
    pairs = lambda r: fan_out(named, r, at).select("role", "policy", "granted")
    return pairs(once).unionByName(pairs(more).distinct()), lost


def unit_dependencies(dependencies: DataFrame, units: DataFrame) -> DataFrame:
    """src, dst of units by folder. dependencies: path (of the unit's file), config_path; units: uid, path."""
    at = units.select(scalars.parent_dir("path").alias("folder"), F.col("uid"))
    want = dependencies.select(scalars.parent_dir("path").alias("own"), scalars.normalize_dots(F.concat_ws("/", scalars.parent_dir("path"), "config_path")).alias("folder"))
    return want.join(at.select("folder", F.col("uid").alias("dst")), "folder").join(at.select(F.col("folder").alias("own"), F.col("uid").alias("src")), "own").select("src", "dst").distinct()


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows equal in keys the first in order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
