"""The graph derived from the relational tables: vertices and edges as SQL that runs alike in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

VIEWS = {
    "v_mod": """SELECT n_nationkey AS k, r_name AS pkg, concat('src/', n_name, '.ts') AS path, concat('ts|', r_name, '|src/', n_name, '.ts|<module>|') AS uid
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_fn": """SELECT c_custkey AS k, m.pkg, m.path, concat('C', c_custkey) AS fqn, concat('ts|', m.pkg, '|', m.path, '|C', c_custkey, '|') AS uid, m.uid AS mod_uid
      FROM customer JOIN v_mod m ON m.k = c_nationkey""",
    "v_cls": """SELECT s_suppkey AS k, m.pkg, m.path, concat('S', s_suppkey) AS fqn, concat('ts|', m.pkg, '|', m.path, '|S', s_suppkey, '|') AS uid, m.uid AS mod_uid
      FROM supplier JOIN v_mod m ON m.k = s_nationkey""",
    "g_nodes": """SELECT concat('ts|', r_name, '||', r_name, '|') AS uid, 'Repo' AS kind, r_name AS name, r_name AS fqn, '' AS path FROM region
      UNION ALL SELECT uid, 'Module', split_part(path, '/', 2), '<module>', path FROM v_mod
      UNION ALL SELECT uid, 'Function', fqn, fqn, path FROM v_fn
      UNION ALL SELECT uid, 'Class', fqn, fqn, path FROM v_cls
      UNION ALL SELECT DISTINCT concat('contract|estate|main/openapi|', p_brand, '|'), 'ApiOperation', p_brand, p_brand, concat('/', lower(p_brand)) FROM part
      UNION ALL SELECT DISTINCT concat('data|estate|schema.sql|', p_type, '|'), 'Table', p_type, p_type, 'schema.sql' FROM part
      UNION ALL SELECT DISTINCT concat('data|estate|schema.sql|', p_type, '.s', p_size, '|'), 'Column', concat('s', p_size), concat(p_type, '.s', p_size), 'schema.sql' FROM part
      UNION ALL SELECT DISTINCT concat('infra|estate|template.yaml|L', o_orderpriority, '|'), 'LambdaFn', concat('L', o_orderpriority), concat('L', o_orderpriority), 'template.yaml' FROM orders
      UNION ALL SELECT DISTINCT concat('infra|estate|template.yaml|R', o_orderstatus, '|'), 'IamRole', concat('R', o_orderstatus), concat('R', o_orderstatus), 'template.yaml' FROM orders
      UNION ALL SELECT concat('doc|estate|docs/', source, '.md|docs/', source, '.md#d', doc_id, '|'), 'DocSection', concat('d', doc_id), concat('docs/', source, '.md#d', doc_id), concat('docs/', source, '.md') FROM documents""",
    "g_edges": """SELECT uid AS src, concat('ts|', pkg, '||', pkg, '|') AS dst, 'MemberOf' AS kind, 'Extracted' AS provenance, CAST(1.0 AS FLOAT) AS confidence FROM v_mod
      UNION ALL SELECT uid, mod_uid, 'MemberOf', 'Extracted', CAST(1.0 AS FLOAT) FROM v_fn
      UNION ALL SELECT mod_uid, uid, 'Defines', 'Extracted', CAST(1.0 AS FLOAT) FROM v_fn
      UNION ALL SELECT uid, mod_uid, 'MemberOf', 'Extracted', CAST(1.0 AS FLOAT) FROM v_cls
      UNION ALL SELECT mod_uid, uid, 'Defines', 'Extracted', CAST(1.0 AS FLOAT) FROM v_cls
      UNION ALL SELECT a.uid, b.uid, 'Calls', CASE o_orderstatus WHEN 'F' THEN 'Extracted' WHEN 'O' THEN 'Inferred' ELSE 'Ambiguous' END,
        CAST(CASE o_orderstatus WHEN 'F' THEN 0.95 WHEN 'O' THEN 0.8 ELSE 0.35 END AS FLOAT)
        FROM orders JOIN v_fn a ON a.k = o_custkey JOIN v_fn b ON b.k = o_orderkey % {nc} WHERE o_orderkey % 7 = 0 AND a.uid <> b.uid
      UNION ALL SELECT a.uid, s.uid, 'Calls', 'Inferred', CAST(0.8 AS FLOAT)
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v_fn a ON a.k = o_custkey JOIN v_cls s ON s.k = l_suppkey WHERE l_orderkey % 50 = 0 AND l_linenumber = 1
      UNION ALL SELECT s.uid, concat('contract|estate|main/openapi|', p_brand, '|'), 'Produces', 'Inferred', CAST(0.8 AS FLOAT)
        FROM part JOIN v_cls s ON s.k = p_partkey % {ns} WHERE p_partkey % 40 = 0
      UNION ALL SELECT f.uid, concat('contract|estate|main/openapi|', p_brand, '|'), 'Consumes', CASE WHEN p_size % 3 = 0 THEN 'Ambiguous' ELSE 'Inferred' END,
        CAST(CASE WHEN p_size % 3 = 0 THEN 0.35 ELSE 0.7 END AS FLOAT) FROM part JOIN v_fn f ON f.k = p_partkey % {nc} WHERE p_partkey % 20 = 1
      UNION ALL SELECT DISTINCT concat('data|estate|schema.sql|', p_type, '|'), concat('data|estate|schema.sql|', p_type, '.s', p_size, '|'), 'HasColumn', 'Extracted', CAST(0.95 AS FLOAT) FROM part
      UNION ALL SELECT DISTINCT f.uid, concat('data|estate|schema.sql|', p_type, '|'), CASE l_returnflag WHEN 'R' THEN 'Reads' ELSE 'Writes' END, 'Extracted', CAST(0.95 AS FLOAT)
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v_fn f ON f.k = o_custkey JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 60 = 0 AND l_returnflag IN ('R', 'A')
      UNION ALL SELECT DISTINCT concat('infra|estate|template.yaml|L', o_orderpriority, '|'), concat('infra|estate|template.yaml|R', o_orderstatus, '|'), 'Assumes', 'Extracted', CAST(0.95 AS FLOAT) FROM orders WHERE o_orderkey % 3 = 0
      UNION ALL SELECT DISTINCT concat('infra|estate|template.yaml|L', o_orderpriority, '|'), m.uid, 'Runs', 'Extracted', CAST(0.95 AS FLOAT)
        FROM orders JOIN v_mod m ON m.k = CAST(substr(o_orderpriority, 1, 1) AS INT)
      UNION ALL SELECT concat('doc|estate|docs/', source, '.md|docs/', source, '.md#d', doc_id, '|'), f.uid, CASE WHEN n_chars % 4 = 0 THEN 'Documents' ELSE 'Mentions' END,
        CASE n_chars % 4 WHEN 0 THEN 'Extracted' WHEN 1 THEN 'Ambiguous' ELSE 'Inferred' END, CAST(CASE n_chars % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.35 ELSE 0.7 END AS FLOAT)
        FROM documents JOIN v_fn f ON f.k = doc_id % {nc}""",
}

#: Leading CTEs of an oracle query.
ORACLE = "WITH RECURSIVE " + ",\n".join(f"{name} AS MATERIALIZED ({text.format(nc='(SELECT count(*) FROM customer)', ns='(SELECT count(*) FROM supplier)')})" for name, text in VIEWS.items())

_BUILT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges, as plans over the tables of a folder."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    sizes = {"nc": spark.table("customer").count(), "ns": spark.table("supplier").count()}
    for name, text in VIEWS.items():
        spark.sql(text.format(**sizes)).createOrReplaceTempView(name)
    return spark.table("g_nodes"), spark.table("g_edges")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same, written once per session and folder: queries over a graph read it, they don't derive it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        from cairn.store import settle

        nodes, edges = build(spark, sf_dir)
        _BUILT[key] = (settle(nodes), settle(edges))
    return _BUILT[key]
