"""Grants of policy statements: what is allowed plainly, and why the rest is opaque."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grade(statements: DataFrame) -> DataFrame:
    """opaque: deny-statement, unknown-effect (any but Allow, or none), not-action, missing-action or wildcard; granted: the action of a plain Allow. statements: effect, action, not_action."""
    allowed = F.coalesce(F.col("effect") == "Allow", F.lit(False))
    opaque = (
        F.when(F.col("effect") == "Deny", "deny-statement").when(~allowed, "unknown-effect").when(F.col("not_action").isNotNull(), "not-action")
        .when(F.col("action").isNull(), "missing-action").when(F.contains("action", F.lit("*")), "wildcard")
    )
    return statements.withColumn("opaque", opaque).withColumn("granted", F.when(allowed & F.col("not_action").isNull(), F.col("action")))
