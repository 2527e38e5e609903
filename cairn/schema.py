"""Vocabularies, bands and table schemas of the graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of vertices by plane, kinds of edges, provenances, confidences.
PLANES = {
    "code": ("Repo", "Package", "File", "Module", "Class", "Interface", "Function", "Method"),
    "contract": ("ApiOperation", "GraphqlField"),
    "infra": ("LambdaFn", "IamRole", "AppSyncApi", "AppSyncResolver", "AppSyncDataSource", "CloudResource", "CloudAction"),
    "data": ("Table", "Column"),
    "knowledge": ("Doc", "DocSection"),
}
NODE_KINDS = tuple(k for kinds in PLANES.values() for k in kinds)
EDGE_KINDS = (
    "Defines", "MemberOf", "Imports", "Calls", "Extends", "Implements", "Produces", "Consumes", "Assumes", "Runs", "Routes",
    "Contains", "HasColumn", "ForeignKey", "Reads", "Writes", "MapsTo", "Grants", "RequiresPermission", "Documents", "Mentions",
)
PROVENANCES = ("Extracted", "Resolved", "Observed", "Inferred", "Ambiguous", "Model")
WALKED = ("Calls", "ForeignKey", "HasColumn", "Reads", "Writes", "MapsTo", "Documents", "Mentions")
WALKED_INFRA = ("Assumes", "Routes", "Runs")
OPERATIONS = ("ApiOperation", "GraphqlField")
WILL_BREAK = 0.40
CONFIDENCE = {"structural": 1.0, "resolved": 0.97, "extracted": 0.95, "inferred": 0.80, "ambiguous": 0.35, "unknown_receiver": 0.39, "path_only": 0.65, "operation_id": 0.75, "literal_url": 0.70, "template_url": 0.60}
#: Least and most confidence of edges by provenance.
BANDS = {"Extracted": (0.95, 1.0), "Resolved": (0.97, 0.97), "Inferred": (0.40, 0.80), "Ambiguous": (0.0, 0.3999)}

_s, _i, _f = T.StringType(), T.IntegerType(), T.FloatType()
NODES = T.StructType([T.StructField(n, t) for n, t in (("uid", _s), ("kind", _s), ("name", _s), ("fqn", _s), ("path", _s), ("start_line", _i), ("start_col", _i), ("end_line", _i), ("end_col", _i), ("provenance", _s), ("confidence", _f))])
EDGES = T.StructType([T.StructField(n, t) for n, t in (("src", _s), ("dst", _s), ("kind", _s), ("provenance", _s), ("confidence", _f))])
