"""Registered queries of the graph engine, each with the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import scalars
from cairn.operators import calls, code_links, infra_links, linkers, metrics, overlay, views, walk
from cairn.plans import derived

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

TABLE = "SELECT min(uid) AS uid FROM g_nodes WHERE kind = 'Table'"
BRAND = "SELECT min(uid) AS uid FROM g_nodes WHERE kind = 'ApiOperation'"
CLASS = "SELECT min(src) AS uid FROM g_edges WHERE kind = 'Produces'"
FUNCTION = "SELECT min(dst) AS uid FROM g_edges WHERE kind = 'Calls' AND provenance = 'Extracted'"


def query(oracle: str | None = None, graph: bool = True):
    """Register a query under its name; `graph` puts the derived graph before its SQL."""

    def register(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLE[f.__name__] = f"{derived.ORACLE}\n{oracle}" if graph else oracle
        return f

    return register


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _least(df: DataFrame, column: str = "uid") -> DataFrame:
    return df.agg(F.min(column).alias("uid"))


def _targets(spark, sf_dir, what: str):
    nodes, edges = derived.graph(spark, sf_dir)
    if what in ("Table", "ApiOperation", "Function", "Class"):
        one = {"Table": lambda: _least(nodes.where("kind = 'Table'")), "ApiOperation": lambda: _least(nodes.where("kind = 'ApiOperation'")), "Class": lambda: _least(edges.where("kind = 'Produces'"), "src"), "Function": lambda: _least(edges.where("kind = 'Calls' and provenance = 'Extracted'"), "dst")}[what]()
    return nodes, edges, one


def _quoted(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


def impact_sql(targets: str, depth: int = 5, least: float = 0.0, contracts: bool = True, infra: bool = True) -> str:
    """CTEs impact(target, uid, name, depth, confidence, ambiguous, will_break) by unrolled levels."""
    kinds = _quoted(walk.Options(infra=infra).kinds())
    out = [f"t AS MATERIALIZED (SELECT DISTINCT uid AS target, uid FROM ({targets}))"]

    def levels(name: str, start: str) -> None:
        """Tables name_1..name_depth of states, from start(target, uid, amb, conf, depth)."""
        for d in range(depth):
            before = f"SELECT target, uid, amb, conf FROM {start} WHERE depth = {d}" + (f" UNION ALL SELECT target, uid, amb, conf FROM {name}_{d}" if d else "")
            out.append(
                f"{name}_{d + 1} AS MATERIALIZED (SELECT f.target, e.src AS uid, (f.amb OR e.provenance = 'Ambiguous') AS amb, max(CAST(f.conf * e.confidence AS FLOAT)) AS conf, {d + 1} AS depth"
                f" FROM ({before}) f JOIN g_edges e ON e.dst = f.uid WHERE e.kind IN ({kinds}) AND CAST(f.conf * e.confidence AS FLOAT) >= CAST({least} AS FLOAT) GROUP BY 1, 2, 3)"
            )

    union = lambda name: " UNION ALL ".join(f"SELECT * FROM {name}_{d + 1}" for d in range(depth))
    out.append("t0 AS MATERIALIZED (SELECT target, uid, FALSE AS amb, CAST(1.0 AS FLOAT) AS conf, 0 AS depth FROM t)")
    levels("w", "t0")
    states = union("w")
    if contracts:
        out.append(f"m1 AS MATERIALIZED (SELECT target, uid, bool_or(amb) AS amb, max(conf) AS conf, min(depth) AS depth FROM ({states}) GROUP BY 1, 2)")
        out.append(f"seeds AS MATERIALIZED (SELECT * FROM m1 WHERE depth < {depth} UNION ALL SELECT * FROM t0)")
        out.append(f"ops AS MATERIALIZED (SELECT s.target, e.dst AS uid, (s.amb OR e.provenance = 'Ambiguous') AS amb, CAST(s.conf * e.confidence AS FLOAT) AS conf, s.depth + 1 AS depth FROM seeds s JOIN g_edges e ON e.src = s.uid AND e.kind = 'Produces' WHERE CAST(s.conf * e.confidence AS FLOAT) >= CAST({least} AS FLOAT))")
        out.append("own AS MATERIALIZED (SELECT t0.* FROM t0 WHERE uid IN (SELECT uid FROM g_nodes WHERE kind IN ('ApiOperation', 'GraphqlField')))")
        out.append(
            f"more AS MATERIALIZED (SELECT target, uid, amb, max(conf) AS conf, depth FROM (SELECT o.target, e.src AS uid, (o.amb OR e.provenance = 'Ambiguous') AS amb, CAST(o.conf * e.confidence AS FLOAT) AS conf, o.depth + 1 AS depth"
            f" FROM (SELECT * FROM ops UNION ALL SELECT * FROM own) o JOIN g_edges e ON e.dst = o.uid AND e.kind = 'Consumes' UNION ALL SELECT o.target, e.src, e.provenance = 'Ambiguous', e.confidence, 1 FROM own o JOIN g_edges e ON e.dst = o.uid AND e.kind = 'Produces')"
            f" WHERE conf >= CAST({least} AS FLOAT) AND depth <= {depth} GROUP BY 1, 2, 3, 5)"
        )
        levels("x", "more")
        states += f" UNION ALL SELECT * FROM ops UNION ALL SELECT * FROM more UNION ALL {union('x')}"
    out.append(f"found AS MATERIALIZED (SELECT target, uid, min(depth) AS depth, max(conf) AS confidence, bool_or(amb) AS ambiguous FROM ({states}) WHERE uid <> target GROUP BY 1, 2)")
    out.append("impact AS MATERIALIZED (SELECT f.target, f.uid, n.name, f.depth, f.confidence, f.ambiguous, (f.confidence >= CAST(0.40 AS FLOAT) AND NOT f.ambiguous) AS will_break FROM found f JOIN (SELECT uid, min(name) AS name FROM g_nodes GROUP BY uid) n ON n.uid = f.uid)")
    return ", " + ",\n".join(out)


def _impact(what: str, options: walk.Options):
    def run(spark, sf_dir):
        nodes, edges, one = _targets(spark, sf_dir, what)
        return walk.impact(nodes, edges, one, options)

    return run


for _name, _what, _sql, _o in (
    ("impact_code", "Table", TABLE, walk.Options(contracts=False)),
    ("impact_full", "Table", TABLE, walk.Options()),
    ("impact_contract_hop", "Class", CLASS, walk.Options()),
    ("impact_contract_target", "ApiOperation", BRAND, walk.Options()),
    ("impact_min_conf", "Table", TABLE, walk.Options(min_confidence=0.3)),
    ("impact_no_infra", "Function", FUNCTION, walk.Options(infra=False, depth=4)),
):
    _QUERIES[_name] = _impact(_what, _o)
    _ORACLE[_name] = derived.ORACLE + impact_sql(_sql, _o.depth, _o.min_confidence, _o.contracts, _o.infra) + " SELECT * FROM impact"


@query(impact_sql(FUNCTION, 4, contracts=False) + " SELECT target, uid, confidence AS explained, confidence AS impact_confidence FROM impact")
def explain_best_path(spark, sf_dir):
    """The last running confidence of each explanation, beside that of impact."""
    nodes, edges, one = _targets(spark, sf_dir, "Function")
    options = walk.Options(depth=4, contracts=False)
    hops = walk.explain(nodes, edges, one, options)
    last = hops.groupBy("target", "uid").agg(F.max_by("running_confidence", "hop").alias("explained"))
    found = walk.impact(nodes, edges, one, options).select("target", "uid", F.col("confidence").alias("impact_confidence"))
    return last.join(found, ["target", "uid"])


_CASES = " ".join(f"WHEN kind = '{k}' AND way = '{w}' THEN '{b}'" for b, k, w in views.BUCKETS)


@query(f", me AS ({FUNCTION}), s AS (SELECT kind, 'out' AS way, dst AS uid FROM g_edges WHERE src = (SELECT uid FROM me) UNION ALL SELECT kind, 'in', src FROM g_edges WHERE dst = (SELECT uid FROM me)), b AS (SELECT DISTINCT CASE {_CASES} END AS bucket, uid FROM s) SELECT b.bucket, n.uid, n.name, n.kind, n.path FROM b JOIN g_nodes n ON n.uid = b.uid WHERE b.bucket IS NOT NULL")
def context_buckets(spark, sf_dir):
    nodes, edges, one = _targets(spark, sf_dir, "Function")
    return views.context(nodes, edges, one.first()["uid"])


@query("SELECT uid, kind, name, fqn, path FROM g_nodes WHERE contains(lower(name), 'brand#1') OR contains(lower(fqn), 'brand#1') OR contains(lower(path), 'brand#1')")
def query_substring(spark, sf_dir):
    return views.query(derived.graph(spark, sf_dir)[0], "Brand#1")


@query(", s AS (SELECT concat('C', c_custkey) AS symbol FROM customer UNION SELECT concat('s', p_size) FROM part), h AS (SELECT symbol, uid, 1 AS tier FROM s JOIN g_nodes ON fqn = symbol UNION ALL SELECT symbol, uid, 2 FROM s JOIN g_nodes ON name = symbol), r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY tier) AS r FROM h) SELECT symbol, uid, tier, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE r = 1")
def resolve_symbol_tiers(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    b = _t(spark, sf_dir, "part").select(F.concat(F.lit("s"), "p_size").alias("symbol"))
    return views.resolve(derived.graph(spark, sf_dir)[0], a.union(b)).select("symbol", "uid", "tier", "n")


@query("SELECT uid, name FROM g_nodes WHERE kind IN ('ApiOperation', 'GraphqlField') AND uid NOT IN (SELECT dst FROM g_edges WHERE kind IN ('Produces', 'Consumes') AND src IN (SELECT uid FROM g_nodes WHERE kind = 'Class'))")
def dead_surface(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    classes = nodes.where("kind = 'Class'").select(F.col("uid").alias("src"))
    return views.dead_surface(nodes, edges.join(classes, "src", "left_semi")).select("uid", "name")


@query(", quiet AS (SELECT uid FROM g_nodes WHERE kind = 'Repo'), mm AS (SELECT DISTINCT q.uid AS target, e.dst AS uid FROM (SELECT uid FROM g_nodes WHERE kind = 'Module' AND uid NOT IN (SELECT dst FROM g_edges WHERE kind NOT IN ('Defines', 'MemberOf', 'Produces', 'Consumes', 'Contains'))) q JOIN g_edges e ON e.src = q.uid AND e.kind IN ('Defines', 'Contains', 'HasColumn')) SELECT DISTINCT mm.target, mm.uid AS member, n.name FROM mm JOIN g_nodes n ON n.uid = mm.uid JOIN g_edges e ON e.dst = mm.uid AND e.kind IN (" + _quoted(walk.Options(depth=1, contracts=False).kinds()) + ") AND e.src <> mm.target")
def members_with_dependents(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    return walk.members_with_dependents(nodes, edges, nodes.where("kind = 'Module'"), walk.Options(depth=1, contracts=False))


@query(f", b AS MATERIALIZED (SELECT src AS here, dst AS there FROM g_edges WHERE kind IN ('Calls', 'Produces') UNION SELECT dst, src FROM g_edges WHERE kind IN ('Calls', 'Produces')), s0 AS ({FUNCTION}), s1 AS (SELECT DISTINCT there AS uid FROM b WHERE here IN (SELECT uid FROM s0)), s2 AS (SELECT DISTINCT there AS uid FROM b WHERE here IN (SELECT uid FROM s1)), a AS (SELECT uid, 0 AS depth FROM s0 UNION ALL SELECT uid, 1 FROM s1 UNION ALL SELECT uid, 2 FROM s2) SELECT a.uid, min(a.depth) AS depth, n.kind FROM a JOIN g_nodes n ON n.uid = a.uid GROUP BY a.uid, n.kind")
def subgraph_d2(spark, sf_dir):
    nodes, edges, one = _targets(spark, sf_dir, "Function")
    return walk.subgraph(nodes, edges, one.first()["uid"], 2, ("Calls", "Produces"), most=None)[0].select("uid", "depth", "kind")


_OWN = "SELECT uid FROM g_nodes WHERE path <> '' AND path = (SELECT min(path) FROM g_nodes WHERE kind = 'Function') AND kind NOT IN ('Repo', 'Package', 'File', 'Module', 'Doc', 'DocSection')"


def _first_file(nodes):
    return nodes.where("kind = 'Function'").agg(F.min("path").alias("p")).first()["p"]


@query(impact_sql(_OWN, 2) + f" SELECT uid, name, min(depth) AS depth, max(confidence) AS confidence, bool_or(ambiguous) AS ambiguous, (max(confidence) >= CAST(0.40 AS FLOAT) AND NOT bool_or(ambiguous)) AS will_break FROM impact WHERE uid NOT IN ({_OWN}) GROUP BY uid, name")
def blast_file(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    return views.blast(nodes, edges, _first_file(nodes), walk.Options(depth=2))[0]


@query(impact_sql(_OWN, 2) + f", a AS (SELECT DISTINCT i.uid, n.kind, split_part(i.uid, '|', 2) AS pkg FROM impact i JOIN g_nodes n ON n.uid = i.uid WHERE i.uid NOT IN ({_OWN})), s AS (SELECT count(*) AS n_affected, coalesce(bool_or(kind IN ('ApiOperation', 'GraphqlField')), FALSE) AS op, coalesce(bool_or(pkg NOT IN (SELECT split_part(uid, '|', 2) FROM ({_OWN}))), FALSE) AS away FROM a) SELECT CASE WHEN op OR away THEN 'CRITICAL' WHEN n_affected < 5 THEN 'LOW' WHEN n_affected <= 15 THEN 'MEDIUM' ELSE 'HIGH' END AS level, n_affected, concat_ws('; ', CASE WHEN op THEN 'affects an operation' END, CASE WHEN away THEN 'crosses packages' END) AS reasons FROM s")
def risk_level(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    return views.blast(nodes, edges, _first_file(nodes), walk.Options(depth=2))[1]


@query("WITH a AS (SELECT CAST(floor(c_acctbal) AS BIGINT) AS k, min(c_nationkey) AS s FROM customer GROUP BY 1), b AS (SELECT CAST(floor(s_acctbal) AS BIGINT) AS k, min(s_nationkey) AS s FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'Added' WHEN b.k IS NULL THEN 'Removed' ELSE 'Modified' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s", graph=False)
def changes_full_outer(spark, sf_dir):
    """Balances of customers as the old state, those of suppliers as the new one."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    old = c.groupBy(F.floor("c_acctbal").cast("long").alias("key")).agg(F.min("c_nationkey").alias("signature"))
    new = s.groupBy(F.floor("s_acctbal").cast("long").alias("key")).agg(F.min("s_nationkey").alias("signature"))
    return views.diff(old, new, ["key"])


_OPS = "SELECT DISTINCT concat(p_brand, '/', p_size % 3) AS op, CASE p_size % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, concat('/v1/', lower(p_brand), '/{}') AS norm_path FROM part"
_ROUTES = "SELECT p_partkey AS route, CASE p_partkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE '<ANY>' END AS method, concat('/v1/', lower(p_brand), CASE p_partkey % 3 WHEN 0 THEN '/:id' WHEN 1 THEN '/{key}' ELSE '/<int:id>' END) AS path FROM part"
_CALLS = "SELECT p_partkey AS call, CASE p_partkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, CASE p_partkey % 3 WHEN 0 THEN concat('/v1/', lower(p_brand), '/', p_size) WHEN 1 THEN concat('/v1/', lower(p_brand), '/{x}') ELSE concat('/v2/', p_size) END AS url, CASE p_partkey % 3 WHEN 0 THEN 'Literal' ELSE 'Template' END AS shape FROM part"


def _sql(spark, sf_dir, text, *tables):
    for t in tables:
        _t(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


@query(f"WITH o AS ({_OPS}), r AS (SELECT route, method, concat('/v1/', split_part(path, '/', 3), '/{{}}') AS np FROM ({_ROUTES})), h AS (SELECT route, op, r.method AS verb, count(*) OVER (PARTITION BY route) AS n FROM r JOIN o ON o.norm_path = r.np AND (r.method = o.method OR r.method = '<ANY>')) SELECT route, op, CASE WHEN n = 1 THEN 'Inferred' ELSE 'Ambiguous' END AS provenance, CAST(CASE WHEN n > 1 THEN 0.35 WHEN verb = '<ANY>' THEN 0.65 ELSE 0.8 END AS FLOAT) AS confidence FROM h", graph=False)
def link_producers(spark, sf_dir):
    return linkers.link_producers(_sql(spark, sf_dir, _ROUTES, "part"), _sql(spark, sf_dir, _OPS, "part"))


@query(f"WITH o AS ({_OPS}), c AS ({_CALLS}), h AS (SELECT call, op, shape, count(*) OVER (PARTITION BY call) AS n FROM c JOIN o ON o.method = c.method AND length(url) - length(replace(url, '/', '')) = 3 AND split_part(url, '/', 2) = 'v1' AND split_part(url, '/', 3) = split_part(norm_path, '/', 3)) SELECT call, op, CASE WHEN n = 1 THEN 'Inferred' ELSE 'Ambiguous' END AS provenance, CAST(CASE WHEN n > 1 THEN 0.35 WHEN shape = 'Literal' THEN 0.7 ELSE 0.6 END AS FLOAT) AS confidence FROM h", graph=False)
def link_consumers_theta(spark, sf_dir):
    return linkers.link_consumers(_sql(spark, sf_dir, _CALLS, "part"), _sql(spark, sf_dir, _OPS, "part"))


_SITES = """SELECT o_orderkey AS site, concat('f', o_custkey % 40) AS file, concat('n', o_orderkey % 60) AS callee, concat('u', o_custkey) AS caller,
  CASE o_custkey % 3 WHEN 0 THEN 'g' ELSE concat('K', o_orderkey % 5, '.m') END AS owner, CASE o_orderkey % 8 WHEN 0 THEN 'self' WHEN 1 THEN 'this' WHEN 2 THEN concat('K', o_orderkey % 5) WHEN 3 THEN 'x' END AS receiver,
  o_orderkey % 8 = 2 AS path FROM orders"""
_SYMS = """SELECT concat('u', c_custkey) AS uid, concat('n', c_custkey % 75) AS name, concat('f', c_nationkey) AS file, CASE c_custkey % 3 WHEN 0 THEN 'Method' ELSE 'Function' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN concat('K', c_custkey % 4) END AS container_fqn FROM customer
  UNION ALL SELECT concat('t', s_suppkey), concat('K', s_suppkey % 5), concat('f', s_nationkey), 'Class', NULL FROM supplier"""
_BINDS = "SELECT concat('f', s_suppkey % 40) AS file, concat('n', s_suppkey % 60) AS name, min(concat('f', s_nationkey)) AS target FROM supplier GROUP BY 1, 2"

# The rules as SQL: all candidates of a site with their tier, then the least tier.
_CALLED = f"WITH s AS ({_SITES}), y AS ({_SYMS}), i AS ({_BINDS}), own AS (SELECT site, caller, uid FROM s JOIN y ON y.file = s.file AND name = callee WHERE receiver IS NULL AND kind <> 'Class'), bound AS (SELECT DISTINCT site, caller, uid FROM s JOIN i ON i.file = s.file AND i.name = callee JOIN y ON y.file = target AND y.name = callee WHERE receiver IS NULL)"
_GRADE = "SELECT site, caller, uid, rule, CASE WHEN rule = 'local' THEN 'Extracted' WHEN rule IN ('imported', 'itself') OR rule IN ('named', 'bare') AND n = 1 THEN 'Inferred' ELSE 'Ambiguous' END AS provenance, CAST(CASE WHEN rule = 'local' THEN 0.95 WHEN rule IN ('imported', 'itself') OR rule IN ('named', 'bare') AND n = 1 THEN 0.8 WHEN rule = 'unknown' THEN {unknown} ELSE 0.35 END AS FLOAT) AS confidence"


def _calls_sql(own: str, bare: str | None, imports: bool, first: bool, unknown: float, beside: str = "") -> str:
    itself = f"SELECT site, caller, uid, 'itself' AS rule, 4 AS tier FROM s JOIN y ON y.file = s.file AND name = callee AND kind = 'Method' AND container_fqn = split_part(owner, '.', 1) WHERE receiver IN ({own}) AND owner LIKE '%.%'"
    other = f"SELECT site, caller, uid, 'unknown', 5 FROM s JOIN y ON name = callee AND kind = 'Method' WHERE receiver NOT IN ({own}){' AND NOT path' if beside else ''}"
    if first:
        tiers = "SELECT site, caller, uid, 'local', 1 FROM own" + (" UNION ALL SELECT site, caller, uid, 'imported', 2 FROM bound" if imports else "")
        tiers += f" UNION ALL SELECT site, caller, uid, 'named', 3 FROM s JOIN y ON name = callee AND kind IN ({bare}) WHERE receiver IS NULL"
    else:
        tiers = "SELECT site, caller, uid, 'bare', 1 FROM (SELECT * FROM own UNION SELECT * FROM bound)"
    graded = f"{_CALLED}, h AS ({itself} UNION ALL {other} UNION ALL {tiers}), k AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY tier) AS k FROM h), g AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM k WHERE k = 1){beside and ', ' + beside} {_GRADE.format(unknown=unknown)} FROM g WHERE caller <> uid"
    return graded + (" UNION ALL SELECT site, caller, uid, 'typed', provenance, confidence FROM q WHERE caller <> uid" if beside else "")


_TYPED = """e AS (SELECT s.*, y.uid, y.file AS loc FROM s LEFT JOIN y ON kind = 'Method' AND name = callee AND container_fqn = receiver WHERE path),
m AS (SELECT site, caller, uid, file = loc AS same, count(*) OVER (PARTITION BY site) AS n FROM e WHERE uid IS NOT NULL),
u AS (SELECT site, caller, callee, receiver IN (SELECT name FROM y WHERE kind = 'Class' UNION SELECT container_fqn FROM y WHERE kind = 'Method') AS known FROM e WHERE uid IS NULL),
w AS (SELECT site, caller, y.uid, known, count(*) OVER (PARTITION BY site) AS n FROM u JOIN y ON y.name = callee AND (kind = 'Method' OR kind = 'Function' AND NOT known)),
q AS (SELECT site, caller, uid, CASE WHEN n > 1 THEN 'Ambiguous' WHEN same THEN 'Extracted' ELSE 'Inferred' END AS provenance, CAST(CASE WHEN n > 1 THEN 0.35 WHEN same THEN 0.95 ELSE 0.8 END AS FLOAT) AS confidence FROM m
  UNION ALL SELECT site, caller, uid, CASE WHEN known OR n > 1 THEN 'Ambiguous' ELSE 'Inferred' END, CAST(CASE WHEN known OR n > 1 THEN 0.35 ELSE 0.8 END AS FLOAT) FROM w)"""


def _linked(spark, sf_dir, language):
    return calls.link_calls(_sql(spark, sf_dir, _SITES, "orders"), _sql(spark, sf_dir, _SYMS, "customer", "supplier"), _sql(spark, sf_dir, _BINDS, "supplier"), language)


@query(_calls_sql("'self'", "'Function'", True, True, 0.35), graph=False)
def link_calls_tiered(spark, sf_dir):
    """Python: own definitions, imported names, functions of the name; self; methods of another object."""
    return _linked(spark, sf_dir, "py")


@query(_calls_sql("'this'", None, True, False, 0.39), graph=False)
def link_calls_ts(spark, sf_dir):
    return _linked(spark, sf_dir, "ts")


@query(_calls_sql("'this'", "'Function', 'Method'", False, True, 0.35), graph=False)
def link_calls_cs(spark, sf_dir):
    return _linked(spark, sf_dir, "cs")


@query(_calls_sql("'self', '&self'", "'Function', 'Method'", False, True, 0.35, _TYPED), graph=False)
def link_calls_rust(spark, sf_dir):
    return _linked(spark, sf_dir, "rust")


@query("WITH s AS (SELECT o_orderkey AS signal, concat('Query.f', o_orderkey % 700) AS key FROM orders), o AS (SELECT concat('op', p_partkey) AS op, concat('Query.f', p_partkey % 900) AS key, CASE WHEN p_partkey % 4 = 0 THEN 'OpenApi' ELSE 'GraphQl' END AS format FROM part), h AS (SELECT signal, op, count(*) OVER (PARTITION BY signal) AS n FROM s JOIN o USING (key) WHERE format = 'GraphQl') SELECT signal, op, CASE WHEN n = 1 THEN 'Extracted' ELSE 'Ambiguous' END AS provenance, CAST(CASE WHEN n = 1 THEN 0.95 ELSE 0.35 END AS FLOAT) AS confidence FROM h", graph=False)
def link_graphql_consumers(spark, sf_dir):
    """Orders as calls of GraphQL operations, parts as operations."""
    signals = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal"), F.concat(F.lit("Query.f"), F.col("o_orderkey") % 700).alias("key"))
    k = F.col("p_partkey")
    ops = _t(spark, sf_dir, "part").select(F.concat(F.lit("op"), k).alias("op"), F.concat(F.lit("Query.f"), k % 900).alias("key"), F.when(k % 4 == 0, "OpenApi").otherwise("GraphQl").alias("format"))
    return code_links.graphql_links(signals, ops, 0.95, "Extracted")


@query("WITH c AS (SELECT concat(p_type, '.', p_size, '@', p_partkey % 3) AS uid, p_type AS t, concat('s', p_size) AS col, concat('f', p_partkey % 3) AS file FROM part), f AS (SELECT t, col, min_by(uid, file) AS dst FROM c GROUP BY 1, 2), k AS (SELECT DISTINCT concat('k', l_partkey) AS src, p_type AS t, concat('s', l_linenumber * 9) AS col FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT src, dst, 'ForeignKey' AS kind, 'Extracted' AS provenance, CAST(0.95 AS FLOAT) AS confidence FROM k JOIN f USING (t, col)", graph=False)
def link_fk(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    columns = p.select(F.concat("p_type", F.lit("."), "p_size", F.lit("@"), F.col("p_partkey") % 3).alias("uid"), F.col("p_type").alias("table"), F.concat(F.lit("s"), "p_size").alias("column"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("file"))
    l = _t(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    keys = l.select(F.concat(F.lit("k"), "l_partkey").alias("src"), F.col("p_type").alias("ref_table"), F.concat(F.lit("s"), F.col("l_linenumber") * 9).alias("ref_column")).distinct()
    return linkers.link_foreign_keys(keys, columns)


@query("WITH r AS (SELECT concat('f', l_suppkey % 50) AS file, concat(CASE l_linestatus WHEN 'F' THEN 'S' ELSE 'x' END, l_suppkey) AS fqn, p_type AS t, CASE l_returnflag WHEN 'R' THEN 'Read' ELSE 'Write' END AS a FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT p_type AS name, min_by(concat(p_type, '@', p_size % 4), concat('x', p_size % 4)) AS dst FROM part GROUP BY 1), c AS (SELECT concat('f', s_suppkey % 50) AS file, concat('S', s_suppkey) AS fqn, concat('S', s_suppkey) AS uid FROM supplier), m AS (SELECT DISTINCT concat('f', s_suppkey % 50) AS file, concat('m', s_suppkey % 50) AS uid FROM supplier) SELECT DISTINCT coalesce(c.uid, m.uid) AS src, dst, CASE a WHEN 'Read' THEN 'Reads' ELSE 'Writes' END AS kind, 'Extracted' AS provenance, CAST(0.95 AS FLOAT) AS confidence FROM r JOIN t ON t.name = r.t LEFT JOIN c ON c.file = r.file AND c.fqn = r.fqn LEFT JOIN m ON m.file = r.file WHERE coalesce(c.uid, m.uid) IS NOT NULL", graph=False)
def link_reads_writes(spark, sf_dir):
    p, s = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    refs = _t(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    refs = refs.select(F.concat(F.lit("f"), F.col("l_suppkey") % 50).alias("file"), F.concat(F.when(F.col("l_linestatus") == "F", "S").otherwise("x"), "l_suppkey").alias("enclosing_fqn"), F.col("p_type").alias("table"), F.when(F.col("l_returnflag") == "R", "Read").otherwise("Write").alias("access"))
    tables = p.select(F.concat("p_type", F.lit("@"), F.col("p_size") % 4).alias("uid"), F.col("p_type").alias("name"), F.concat(F.lit("x"), F.col("p_size") % 4).alias("file"))
    code = s.select(F.concat(F.lit("S"), "s_suppkey").alias("uid"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("file"), F.concat(F.lit("S"), "s_suppkey").alias("fqn"))
    modules = s.select(F.concat(F.lit("m"), F.col("s_suppkey") % 50).alias("uid"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("file"), F.lit("<module>").alias("fqn")).distinct()
    return linkers.link_tables(refs, tables, code.unionByName(modules))


_REFS = "SELECT doc_id AS section, concat('docs/', source, '.md') AS doc, CASE doc_id % 5 WHEN 0 THEN concat('C', doc_id % 1500) WHEN 1 THEN concat('s', doc_id % 50) WHEN 2 THEN CASE WHEN doc_id % 50 = 2 THEN concat('docs/src', doc_id % 9, '.md') ELSE 'nothing' END WHEN 3 THEN 'nothing' ELSE concat('src/', (SELECT min(n_name) FROM nation), '.ts') END AS ref, CASE doc_id % 5 WHEN 2 THEN 'path' WHEN 4 THEN 'path' ELSE 'code' END AS form FROM documents"


@query(f", r AS ({_REFS}), b AS (SELECT uid, path, fqn, name, kind IN ('Module', 'DocSection') AS pb FROM g_nodes), h AS (SELECT section, doc, ref, uid, path, 1 AS tier FROM r JOIN b ON pb AND ref = path WHERE form = 'path' UNION ALL SELECT section, doc, ref, uid, path, 2 FROM r JOIN b ON ref = fqn WHERE form = 'code' UNION ALL SELECT section, doc, ref, uid, path, 3 FROM r JOIN b ON ref = name WHERE form = 'code'), k AS (SELECT *, rank() OVER (PARTITION BY section, doc, ref ORDER BY tier) AS k FROM h), g AS (SELECT *, count(*) OVER (PARTITION BY section, doc, ref) AS n FROM k WHERE k = 1) SELECT DISTINCT section, uid, tier, CASE WHEN n > 1 THEN 'Ambiguous' WHEN tier = 1 THEN 'Extracted' ELSE 'Inferred' END AS provenance, CAST(CASE WHEN n > 1 THEN 0.35 WHEN tier = 1 THEN 0.95 WHEN tier = 2 THEN 0.8 ELSE 0.7 END AS FLOAT) AS confidence FROM g WHERE path <> doc")
def mentions_graded(spark, sf_dir):
    nodes, _ = derived.graph(spark, sf_dir)
    refs = _sql(spark, sf_dir, _REFS, "documents", "nation")
    return linkers.link_mentions(refs, nodes.select("uid", "path", "fqn", "name", F.col("kind").isin("Module", "DocSection").alias("path_bearing")))


_LOCAL = "SELECT uid AS local, concat('contract|estate|shared/openapi|', substr(name, 1, 7), '|') AS canonical FROM g_nodes WHERE kind = 'ApiOperation'"


@query(f", o AS ({_LOCAL}), e AS (SELECT coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, kind, provenance, confidence FROM g_edges LEFT JOIN o a ON a.local = src LEFT JOIN o b ON b.local = dst WHERE kind IN ('Produces', 'Consumes', 'Calls')), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY provenance, confidence) AS k FROM e) SELECT src, dst, kind, provenance, confidence FROM r WHERE k = 1")
def estate_union_repoint(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    owners = nodes.where("kind = 'ApiOperation'").select(F.col("uid").alias("local"), F.concat(F.lit("contract|estate|shared/openapi|"), F.substring("name", 1, 7), F.lit("|")).alias("canonical"))
    return linkers.estate(nodes, edges.where("kind in ('Produces', 'Consumes', 'Calls')").withColumn("ord", F.lit(0)), owners)[1]


@query("SELECT DISTINCT l_partkey AS address, 'plan' AS source FROM lineitem UNION ALL SELECT p_partkey, 'source' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)", graph=False)
def plan_over_hcl_antijoin(spark, sf_dir):
    """Parts sold as planned resources, all parts as written ones."""
    planned = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("address")).distinct().withColumn("source", F.lit("plan"))
    return linkers.plan_over_source(planned, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("address"), F.lit("source").alias("source")))


@query("SELECT kind, provenance, count(*) AS n, round(sum(CAST(confidence AS DOUBLE)), 6) AS confidence_sum FROM g_edges GROUP BY 1, 2")
def coverage_by_kind_provenance(spark, sf_dir):
    return metrics.coverage(derived.graph(spark, sf_dir)[1]).withColumn("confidence_sum", F.round("confidence_sum", 6))


_JUDGED = "SELECT CASE o_orderstatus WHEN 'F' THEN 'Extracted' WHEN 'O' THEN 'Inferred' ELSE 'Ambiguous' END AS provenance, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey % 3 > 0 ELSE TRUE END AS correct, o_orderpriority AS class, o_orderkey % 2 = 0 AS predicted, o_orderkey % 3 > 0 AS expected FROM orders"


@query(f"SELECT provenance, count(*) AS n, count(*) FILTER (correct) AS confirmed, count(*) FILTER (NOT correct) AS denied, count(*) FILTER (correct) / nullif(CAST(count(correct) AS DOUBLE), 0) AS precision FROM ({_JUDGED}) GROUP BY 1", graph=False)
def band_precision(spark, sf_dir):
    return metrics.band_precision(_sql(spark, sf_dir, _JUDGED, "orders"))


@query(f"SELECT class, CASE WHEN count(*) FILTER (predicted) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (predicted AND correct) AS DOUBLE) / count(*) FILTER (predicted) END AS precision, CASE WHEN count(*) FILTER (expected) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (predicted AND correct) AS DOUBLE) / count(*) FILTER (expected) END AS recall FROM ({_JUDGED}) GROUP BY 1", graph=False)
def accuracy_by_class(spark, sf_dir):
    return metrics.overall(_sql(spark, sf_dir, _JUDGED, "orders"))


@query(f"WITH b AS (SELECT CASE provenance WHEN 'Extracted' THEN 0 WHEN 'Inferred' THEN 1 ELSE 2 END AS ord, provenance, count(*) FILTER (correct) / nullif(CAST(count(correct) AS DOUBLE), 0) AS precision FROM ({_JUDGED}) GROUP BY 1, 2) SELECT provenance, precision, coalesce(precision > lag(precision) OVER (ORDER BY ord) + 1e-9, FALSE) AS violates FROM b", graph=False)
def band_monotonic_lag(spark, sf_dir):
    bands = metrics.band_precision(_sql(spark, sf_dir, _JUDGED, "orders")).withColumn("ord", F.when(F.col("provenance") == "Extracted", 0).when(F.col("provenance") == "Inferred", 1).otherwise(2))
    return metrics.monotone(bands)


@query("SELECT uid, split_part(uid, '|', 1) AS language, split_part(uid, '|', 2) AS package, split_part(uid, '|', 4) AS fqn, CASE WHEN instr(fqn, '#') > 0 THEN substr(fqn, instr(fqn, '#') + 1) ELSE fqn END AS anchor, CASE WHEN kind IN ('ApiOperation', 'GraphqlField') THEN 'contract' WHEN kind IN ('LambdaFn', 'IamRole') THEN 'infra' WHEN kind IN ('Table', 'Column') THEN 'data' WHEN kind = 'DocSection' THEN 'knowledge' ELSE 'code' END AS plane FROM g_nodes")
def uid_parts(spark, sf_dir):
    nodes, _ = derived.graph(spark, sf_dir)
    return nodes.select("uid", *(scalars.uid_part("uid", k).alias(n) for k, n in ((1, "language"), (2, "package"), (4, "fqn"))), scalars.anchor("fqn").alias("anchor"), scalars.plane_of("kind").alias("plane"))


@query(f"SELECT route, concat('/v1/', split_part(path, '/', 3), '/{{}}') AS norm_path FROM ({_ROUTES})", graph=False)
def normalize_path(spark, sf_dir):
    return _sql(spark, sf_dir, _ROUTES, "part").select("route", scalars.normalize_path("path").alias("norm_path"))


_HEADINGS = "SELECT source AS path, doc_id AS pos, split_part(text, ' ', 1) AS heading FROM documents"


@query(f"WITH h AS ({_HEADINGS}), s AS (SELECT path, pos, regexp_replace(regexp_replace(lower(heading), '[^a-z0-9 _-]', '', 'g'), '[ -]', '-', 'g') AS slug FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY pos) - 1 AS k FROM s) SELECT path, pos, CASE WHEN k = 0 THEN slug ELSE concat(slug, '-', k) END AS anchor FROM n", graph=False)
def slug_dedupe(spark, sf_dir):
    from cairn.sources import markdown

    h = _t(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("pos"), F.split_part("text", F.lit(" "), F.lit(1)).alias("heading"))
    return markdown.anchors(h).select("path", "pos", "anchor")


@query("SELECT page_id, regexp_matches(url, '/[^/]*\\.[A-Za-z0-9]+$') AS path_shape, regexp_matches(url, '^[a-z0-9-]+$') AS slug_safe, split_part(url, '/', length(url) - length(replace(url, '/', '')) + 1) AS base FROM pages", graph=False)
def path_shape(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", scalars.has_path_shape("url").alias("path_shape"), scalars.slug_safe("url").alias("slug_safe"), scalars.base_name("url").alias("base"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) > 0 AND strlen(x) <= 40)"


@query(f"WITH w AS (SELECT doc_id AS uid, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), h AS (SELECT uid, len(w) AS len, unnest(list_filter(w, lambda x: x IN ('the', 'thonre', 'und', 'anly'))) AS term FROM w), tf AS (SELECT uid, term, count(*) AS tf, any_value(len) AS len FROM h GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT uid, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM tf JOIN df USING (term), s GROUP BY uid) SELECT uid, score, terms, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM r ORDER BY score DESC, uid LIMIT 10", graph=False)
def bm25_topk(spark, sf_dir):
    entries = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("body"))
    return metrics.bm25(entries, "the thonre UND anly", 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT doc_id AS uid, list_aggregate(list_sort(list_distinct(list_filter({_WORDS}, lambda x: x IN ('the', 'und', 'les')))), 'string_agg', ' ') AS terms, len({_WORDS}) AS n_tokens FROM documents WHERE text IS NOT NULL", graph=False)
def matched_terms(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("uid"), scalars.tokens("text").alias("w"))
    hits = F.sort_array(F.array_intersect("w", F.array(F.lit("the"), F.lit("und"), F.lit("les"))))
    return d.select("uid", F.when(F.size(hits) > 0, F.array_join(hits, " ")).alias("terms"), F.size("w").cast("long").alias("n_tokens"))


@query(f", me AS ({FUNCTION}), n AS (SELECT src AS uid, confidence FROM g_edges WHERE kind IN ('Calls', 'Imports') AND dst = (SELECT uid FROM me) UNION ALL SELECT dst, confidence FROM g_edges WHERE kind IN ('Calls', 'Imports') AND src = (SELECT uid FROM me) UNION ALL SELECT uid, CAST(0.95 AS FLOAT) FROM me) SELECT path, max(confidence) AS confidence FROM n JOIN g_nodes USING (uid) WHERE path <> '' GROUP BY 1")
def rename_files(spark, sf_dir):
    nodes, edges, one = _targets(spark, sf_dir, "Function")
    return views.implicated_files(nodes, edges, one.first()["uid"])


@query(f", me AS ({_OWN}) SELECT src AS uid, max(confidence) AS confidence FROM g_edges WHERE kind IN ('Documents', 'Mentions') AND dst IN (SELECT uid FROM me) GROUP BY 1")
def file_doc_refs(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    return views.doc_refs(edges, views.symbols_in_file(nodes, _first_file(nodes)))


@query("SELECT e.kind, e.provenance, count(*) AS n, min(e.confidence) AS least, max(e.confidence) AS most FROM g_edges e JOIN g_nodes a ON a.uid = e.src JOIN g_nodes b ON b.uid = e.dst GROUP BY 1, 2")
def live_edges(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    return walk.live(nodes, edges).groupBy("kind", "provenance").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


_STATEMENTS = "SELECT part.p_partkey AS id, CASE WHEN p_size % 17 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'Deny' WHEN p_size % 5 = 1 THEN 'Maybe' ELSE 'Allow' END AS effect, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '*' ELSE concat('s3:', lower(split_part(p_type, ' ', 1))) END AS action, CASE WHEN p_size % 13 = 0 THEN 'iam:Pass' END AS not_action FROM part"


@query(f"SELECT id, CASE WHEN effect = 'Deny' THEN 'deny-statement' WHEN effect IS NULL OR effect <> 'Allow' THEN 'unknown-effect' WHEN not_action IS NOT NULL THEN 'not-action' WHEN action IS NULL THEN 'missing-action' WHEN contains(action, '*') THEN 'wildcard' END AS opaque, CASE WHEN effect = 'Allow' AND not_action IS NULL THEN action END AS granted FROM ({_STATEMENTS})", graph=False)
def iam_statement_grade(spark, sf_dir):
    from cairn.sources import iam

    return iam.grade(_sql(spark, sf_dir, _STATEMENTS, "part")).select("id", "opaque", "granted")


@query("WITH r AS (SELECT DISTINCT concat(p_brand, '/', p_type) AS uid, p_brand AS template, p_type AS id FROM part), f AS (SELECT concat('s', l_suppkey) AS src, p_brand AS template, l_returnflag AS g, unnest(CASE l_returnflag WHEN 'N' THEN [p_type, p_name] ELSE [CASE l_linestatus WHEN 'O' THEN p_name ELSE p_type END] END) AS id FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT src, uid AS dst, 'Assumes' AS kind, CASE WHEN bool_or(g = 'R') THEN 'Extracted' ELSE 'Inferred' END AS provenance, CAST(CASE WHEN bool_or(g = 'R') THEN 0.95 ELSE 0.70 END AS FLOAT) AS confidence FROM f JOIN r USING (template, id) GROUP BY 1, 2", graph=False)
def infra_references(spark, sf_dir):
    """Brands as templates, types as their resources, suppliers as what refers to them."""
    p = _t(spark, sf_dir, "part")
    resources = p.select(F.concat("p_brand", F.lit("/"), "p_type").alias("uid"), F.col("p_brand").alias("template"), F.col("p_type").alias("logical_id")).distinct()
    sold = _t(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    ids = F.when(F.col("l_returnflag") == "N", F.array("p_type", "p_name")).otherwise(F.array(F.when(F.col("l_linestatus") == "O", F.col("p_name")).otherwise(F.col("p_type"))))
    grade = F.when(F.col("l_returnflag") == "R", "Resource").when(F.col("l_returnflag") == "A", "Inferred").otherwise("Multi")
    refs = sold.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("p_brand").alias("template"), grade.alias("grade"), ids.alias("ids"))
    return infra_links.references(refs, resources, "Assumes")


@query("SELECT CASE WHEN n_name IS NULL THEN concat('r', o_orderkey) ELSE n_name END AS src, o_orderkey AS op, CASE WHEN n_name IS NULL OR (o_orderstatus = 'F' AND c_mktsegment > 'B') THEN 'Extracted' ELSE 'Inferred' END AS provenance, CAST(CASE WHEN n_name IS NULL OR (o_orderstatus = 'F' AND c_mktsegment > 'B') THEN 0.95 ELSE 0.70 END AS FLOAT) AS confidence FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal > 0", graph=False)
def infra_produces_chain(spark, sf_dir):
    """Orders as resolvers, customers as data sources, nations as functions; customers in debt lead nowhere."""
    o, c, n = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    one = F.lit("t").alias("template")
    plain = lambda test: F.when(test, "Resource").otherwise("Inferred").alias("grade")
    resolvers = o.select(F.concat(F.lit("r"), "o_orderkey").alias("uid"), one, F.col("o_orderkey").alias("op"), F.col("o_custkey").alias("source_id"), plain(F.col("o_orderstatus") == "F"))
    sources = c.select(one, F.col("c_custkey").alias("logical_id"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("lambda_id"), plain(F.col("c_mktsegment") > "B"))
    return infra_links.produces(resolvers, sources, n.select(one, F.col("n_nationkey").alias("logical_id"), F.col("n_name").alias("uid")))


@query("WITH m AS (SELECT concat('m', c_custkey) AS uid, c_mktsegment AS type, c_custkey // 2 AS name, c_nationkey AS file FROM customer), s AS (SELECT o_orderkey AS site, s_nationkey AS file, CASE o_orderstatus WHEN 'P' THEN 'none' ELSE c_mktsegment END AS type, o_custkey // 2 AS name FROM orders JOIN customer ON c_custkey = o_orderkey % (SELECT count(*) FROM customer) JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)), h AS (SELECT site, uid, 1 AS tier, TRUE AS known, s.file = m.file AS same FROM s JOIN m USING (type, name) UNION ALL SELECT site, uid, 2, s.type IN (SELECT type FROM m), FALSE FROM s JOIN m USING (name)), r AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY tier) AS k FROM h), n AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM r WHERE k = 1) SELECT site, uid, CASE WHEN n > 1 OR (tier = 2 AND known) THEN 'Ambiguous' WHEN same THEN 'Extracted' ELSE 'Inferred' END AS provenance, CAST(CASE WHEN n > 1 OR (tier = 2 AND known) THEN 0.35 WHEN same THEN 0.95 ELSE 0.80 END AS FLOAT) AS confidence FROM n", graph=False)
def link_calls_qualified(spark, sf_dir):
    """Customers as methods of the type that is their segment, orders as calls of them."""
    o, c, s = (_t(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    methods = c.select(F.concat(F.lit("m"), "c_custkey").alias("uid"), F.col("c_mktsegment").alias("type"), F.floor(F.col("c_custkey") / 2).alias("name"), F.col("c_nationkey").alias("file"))
    calls = o.join(c, F.col("c_custkey") == F.col("o_orderkey") % c.count()).join(s, F.col("s_suppkey") == F.col("o_orderkey") % s.count())
    sites = calls.select(F.col("o_orderkey").alias("site"), F.col("s_nationkey").alias("file"), F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.col("c_mktsegment")).alias("type"), F.floor(F.col("o_custkey") / 2).alias("name"))
    return code_links.qualified_calls(sites, methods)


@query("SELECT c_custkey AS route, coalesce('S' || (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey AND CAST(floor(s_acctbal / 1000) AS BIGINT) = CAST(floor(c_acctbal / 1000) AS BIGINT)), concat('m', c_nationkey)) AS uid FROM customer", graph=False)
def link_handlers(spark, sf_dir):
    """Customers as routes, suppliers of the nation and the same thousand of balance as their handlers, nations as modules."""
    c, s, n = (_t(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    thousand = lambda x: F.floor(F.col(x) / 1000).cast("string")
    routes = c.select(F.col("c_custkey").alias("route"), F.col("c_nationkey").alias("file"), thousand("c_acctbal").alias("handler"), F.lit("<module>").alias("enclosing_fqn"))
    symbols = s.select(F.concat(F.lit("S"), "s_suppkey").alias("uid"), F.col("s_nationkey").alias("file"), thousand("s_acctbal").alias("name"), F.format_string("%012d", "s_suppkey").alias("fqn"))
    return code_links.handler_or_enclosing(routes, symbols.unionByName(n.select(F.concat(F.lit("m"), "n_nationkey").alias("uid"), F.col("n_nationkey").alias("file"), F.lit("-").alias("name"), F.lit("<module>").alias("fqn"))))


@query("WITH n AS (SELECT p_partkey, c_custkey, count(*) OVER (PARTITION BY p_partkey) AS n FROM part JOIN customer ON CAST(floor(p_retailprice) AS BIGINT) = CAST(floor(c_acctbal) AS BIGINT)) SELECT p_partkey, c_custkey FROM n WHERE n = 1", graph=False)
def link_unique_matches(spark, sf_dir):
    left = _t(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("key"))
    right = _t(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("key"))
    return linkers.link_unique(left, right, ["key"], "p_partkey").select("p_partkey", "c_custkey")


@query("SELECT (SELECT count(*) FROM g_nodes) AS n_nodes, (SELECT count(*) FROM g_edges) AS n_edges, (SELECT bool_or(kind IN ('ApiOperation', 'GraphqlField')) FROM g_nodes) AS has_contract, (SELECT bool_or(kind IN ('LambdaFn', 'IamRole')) FROM g_nodes) AS has_infra")
def graph_summary(spark, sf_dir):
    nodes, edges = derived.graph(spark, sf_dir)
    flags = nodes.agg(F.count("*").alias("n_nodes"), F.bool_or(F.col("kind").isin(*schema.OPERATIONS)).alias("has_contract"), F.bool_or(F.col("kind").isin(*schema.PLANES["infra"])).alias("has_infra"))
    return flags.join(edges.agg(F.count("*").alias("n_edges")), F.lit(True))


@query("SELECT concat(p_brand, '.json') AS file, CASE WHEN p_size % 2 = 0 THEN concat('op', p_size) ELSE concat('GET /t/', p_size, '/{}') END AS key, 'GET' AS method, concat('/t/', p_size, '/{}') AS norm_path FROM part GROUP BY p_brand, p_size", graph=False)
def extract_openapi(spark, sf_dir):
    """A document per brand, with a path per size, read back."""
    from cairn.sources import contracts

    p = _t(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    one = F.concat(F.lit('"/t/'), "p_size", F.lit('/{id}": {"get": {'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"operationId": "op'), "p_size", F.lit('"'))).otherwise(""), F.lit("}}"))
    text = F.concat(F.lit('{"openapi": "3.0.0", "paths": {'), F.array_join(F.collect_list(one), ", "), F.lit("}}"))
    files = p.groupBy(F.concat("p_brand", F.lit(".json")).alias("path")).agg(text.alias("text"))
    return contracts.operations(files).select("file", "key", "method", "norm_path")


@query("SELECT DISTINCT replace(p_type, ' ', '_') AS \"table\", concat('s', p_size) AS \"column\", concat('varchar(', p_size, ')') AS sql_type, p_size % 3 <> 0 AS nullable, CASE WHEN p_size % 5 = 0 THEN 'other' END AS ref_table FROM part", graph=False)
def extract_schema(spark, sf_dir):
    """A table's statement per type, with a column per size, read back."""
    from cairn.sources import ddl

    p = _t(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit("_")).alias("t"), "p_size").distinct()
    one = F.concat(F.lit("s"), "p_size", F.lit(" varchar( "), "p_size", F.lit(" )"), F.when(F.col("p_size") % 3 == 0, " NOT NULL").otherwise(""), F.when(F.col("p_size") % 5 == 0, " references x.other (id)").otherwise(""))
    text = F.concat(F.lit("-- a; b\nCREATE TABLE IF NOT EXISTS "), "t", F.lit(" (gone int, "), F.array_join(F.collect_list(one), ",\n"), F.lit("); ALTER TABLE "), "t", F.lit(" DROP COLUMN gone;"))
    files = p.groupBy("t").agg(text.alias("text")).select(F.col("t").alias("path"), "text")
    return ddl.columns(files).select("table", "column", "sql_type", "nullable", "ref_table")


@query("SELECT concat('n', c_nationkey, '.py') AS file, concat('C', c_custkey) AS owner, concat('seg_', lower(c_mktsegment)) AS name, CASE WHEN c_acctbal > 0 THEN 'bank' END AS receiver FROM customer", graph=False)
def extract_python_calls(spark, sf_dir):
    """A module per nation, with a function per customer that calls one of its segment, read back."""
    from cairn.sources import python_code

    c = _t(spark, sf_dir, "customer")
    one = F.concat(F.lit("def C"), "c_custkey", F.lit("():\n    return "), F.when(F.col("c_acctbal") > 0, "bank.").otherwise(""), F.lit("seg_"), F.lower("c_mktsegment"), F.lit("('call(1)')  # call(2)\n"))
    files = c.groupBy(F.concat(F.lit("n"), "c_nationkey", F.lit(".py")).alias("path")).agg(F.array_join(F.collect_list(one), "\n").alias("text"))
    files = files.repartition(4 * spark.sparkContext.defaultParallelism, "path")  # their texts pack so well that all would meet in one task
    return python_code.facts(files).where("record = 'call'").select("file", "owner", "name", F.col("value").alias("receiver"))


@query("SELECT doc_id AS path, CASE WHEN lower(coalesce(text, '')) = coalesce(text, '') THEN 'cached' ELSE 'parsed' END AS made, length(coalesce(text, '')) AS n FROM documents", graph=False)
def parse_cache_reuse(spark, sf_dir):
    """Documents as files, their lower-case texts as what the cache saw."""
    from cairn.sources import files

    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    facts = lambda f, made: f.select("path", F.lit(made).alias("made"), F.char_length("text").cast("long").alias("n"))
    seen = files.with_hash(d.withColumn("text", F.lower("text")))
    cache = facts(seen, "cached").join(seen.select("path", "hash"), "path").withColumn("schema_version", F.lit(3))
    return files.reuse(d, cache, 3, lambda f: facts(f, "parsed")).select("path", "made", "n")


_FOUND = "SELECT l_orderkey AS site, concat('S', l_suppkey) AS uid, 'Inferred' AS provenance, CAST(0.8 AS FLOAT) AS confidence, concat('S', o_custkey) AS caller FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_TOLD = "SELECT o_orderkey AS site, concat('S', min(l_suppkey)) AS uid, concat('S', o_custkey) AS caller FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_orderstatus = 'F' GROUP BY o_orderkey, o_custkey HAVING min(l_suppkey) IS NOT NULL"


@query(f"WITH f AS ({_FOUND}), t AS ({_TOLD}) SELECT site, caller, uid, provenance, confidence FROM f WHERE site NOT IN (SELECT site FROM t) UNION ALL SELECT site, caller, uid, 'Resolved', CAST(0.97 AS FLOAT) FROM t WHERE caller <> uid", graph=False)
def overlay_supersedes(spark, sf_dir):
    """Order lines as what linkers found, returned lines of filled orders as what an index tells."""
    return overlay.supersede(_sql(spark, sf_dir, _FOUND, "lineitem", "orders"), _sql(spark, sf_dir, _TOLD, "lineitem", "orders"))


@query(f"WITH f AS (SELECT DISTINCT site, uid FROM ({_FOUND})), t AS (SELECT site, uid FROM ({_TOLD})), n AS (SELECT site, count(*) AS n FROM f GROUP BY 1) SELECT coalesce(n.site, t.site) AS site, coalesce(n, 0) AS n_found, t.site IS NOT NULL AS covered, t.site IS NOT NULL AND (t.site, t.uid) IN (SELECT (site, uid) FROM f) AS confirmed FROM n FULL OUTER JOIN t ON n.site = t.site", graph=False)
def differential_sites(spark, sf_dir):
    return overlay.differential(_sql(spark, sf_dir, _FOUND, "lineitem", "orders"), _sql(spark, sf_dir, _TOLD, "lineitem", "orders"))


@query("WITH s AS (SELECT s_suppkey, s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT) AS k FROM supplier), e AS (SELECT s_nationkey, k, min(s_suppkey) AS one, count(*) AS n FROM s GROUP BY 1, 2) SELECT c_custkey AS site, concat('S', coalesce(x.s_suppkey, one)) AS uid, CASE WHEN x.s_suppkey IS NOT NULL THEN 1 ELSE 2 END AS tier FROM customer LEFT JOIN s x ON x.s_suppkey = c_custkey AND x.s_nationkey = c_nationkey AND x.k = CAST(floor(c_acctbal / 1000) AS BIGINT) LEFT JOIN e ON e.s_nationkey = c_nationkey AND e.k = CAST(floor(c_acctbal / 1000) AS BIGINT) AND n = 1 WHERE coalesce(x.s_suppkey, one) IS NOT NULL", graph=False)
def overlay_resolves(spark, sf_dir):
    """Customers as call sites and as what an index tells of them, suppliers as symbols: nations are files, keys lines, thousands of balance names."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    key = F.col("c_custkey")
    sites = c.select(key.alias("site"), F.col("c_nationkey").alias("file"), key.alias("line"), F.lit(0).alias("col"))
    occurrences = c.select(F.col("c_nationkey").alias("file"), key.alias("line"), F.lit(0).alias("col"), F.concat(F.lit("sym"), key).alias("symbol"))
    definitions = c.select(F.concat(F.lit("sym"), key).alias("symbol"), F.col("c_nationkey").alias("def_file"), key.alias("def_line"), F.floor(F.col("c_acctbal") / 1000).alias("name"))
    symbols = s.select(F.concat(F.lit("S"), "s_suppkey").alias("uid"), F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("line"), F.floor(F.col("s_acctbal") / 1000).alias("name"))
    return overlay.resolve_sites(sites, occurrences, definitions, symbols)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, line, row, unnest(range(1, length(row) + 1)) AS i FROM l WHERE contains(row, 'und')) SELECT doc_id AS path, line, i - 1 AS col FROM p WHERE substr(row, i, 3) = 'und' AND NOT regexp_matches(substr(row, i + 3, 1), '[A-Za-z0-9_$]') AND (i = 1 OR NOT regexp_matches(substr(row, i - 1, 1), '[A-Za-z0-9_$]'))", graph=False)
def rename_positions(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return overlay.rename_edits(d, "und").select("path", F.col("line").cast("long"), F.col("col").cast("long"))


_SECTIONS = "SELECT concat('d', doc_id) AS uid, CAST(1 + doc_id % 2 AS INT) AS tier, CAST(CASE doc_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 ELSE 0.35 END AS FLOAT) AS confidence, concat('docs/', coalesce(source, ''), '.md') AS path, concat('d', doc_id) AS anchor, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 <> 0 THEN text END AS body FROM documents"


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tier, confidence DESC, uid) AS i, concat('… [truncated — fetch ', path, '#', anchor, ']') AS marker FROM ({_SECTIONS})),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(20000 AS BIGINT) AS remains, '' AS shown, false AS truncated, false AS ref_only
  UNION ALL SELECT i, CASE WHEN coalesce(body, '') = '' THEN remains WHEN part = '' THEN 0 WHEN part = body THEN remains - strlen(part) ELSE remains - strlen(part) - strlen(marker) END,
    CASE WHEN coalesce(body, '') = '' OR part = '' THEN '' WHEN part = body THEN part ELSE concat(part, marker) END, coalesce(body, '') <> '' AND part <> '' AND part <> body, coalesce(body, '') <> '' AND part = ''
  FROM (SELECT *, CASE WHEN strlen(body) <= room THEN body ELSE body[:list_max(list_filter(range(0, room + 1), lambda k: strlen(body[:k]) <= room))] END AS part
    FROM (SELECT s.*, remains, greatest(0, least(1200, remains) - strlen(marker)) AS room FROM g JOIN s ON s.i = g.i + 1 WHERE remains > 0)))
SELECT s.uid, s.tier, s.confidence, coalesce(shown, '') AS text, coalesce(truncated, false) AS truncated, coalesce(ref_only, true) AS ref_only, CASE WHEN g.i IS NOT NULL AND body IS NULL THEN 'body unavailable' END AS note FROM s LEFT JOIN g ON g.i = s.i""", graph=False)
def guidance_budget(spark, sf_dir):
    """Documents as sections about one symbol; some are empty or unavailable."""
    return views.guidance(_sql(spark, sf_dir, _SECTIONS, "documents"), 20000, 1200)


@query("""WITH l AS (SELECT concat('L', c_custkey) AS src, concat(CASE c_custkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN concat('t', c_nationkey, '/src/') ELSE concat('t', c_nationkey, '/') END, 'h', c_custkey % 40) AS stem FROM customer),
m AS (SELECT DISTINCT concat(CASE s_suppkey % 2 WHEN 0 THEN 'src/' ELSE concat('t', s_nationkey, '/src/') END, 'h', s_suppkey % 40) AS stem, CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.pyi' ELSE '.go' END AS ext FROM supplier)
SELECT src, min(concat(stem, ext)) AS dst FROM l JOIN m USING (stem) WHERE ext <> '.go' GROUP BY src HAVING count(*) = 1""", graph=False)
def link_infra_runs(spark, sf_dir):
    """Customers as functions of their nation's template, suppliers as modules."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    k = F.col("c_custkey") % 3
    lambdas = c.select(F.concat(F.lit("L"), "c_custkey").alias("uid"), F.concat(F.lit("t"), "c_nationkey", F.lit("/template.yaml")).alias("template"), F.when(k == 0, "../src").when(k == 1, "src/").alias("code_uri"), F.concat(F.lit("h"), F.col("c_custkey") % 40, F.lit(".main")).alias("handler"))
    kind, at = F.col("s_suppkey") % 3, F.when(F.col("s_suppkey") % 2 == 0, "src/").otherwise(F.concat(F.lit("t"), "s_nationkey", F.lit("/src/")))
    path = F.concat(at, F.lit("h"), F.col("s_suppkey") % 40, F.when(kind == 0, ".ts").when(kind == 1, ".pyi").otherwise(".go"))
    return infra_links.runs(lambdas, s.select(path.alias("path"), path.alias("uid")).distinct())


_POLICIES = "SELECT concat('P', o_orderkey) AS uid, concat('t', o_custkey % 10) AS template, concat('R', o_custkey % 50) AS one, concat('R', o_orderkey % 70) AS two, o_orderpriority AS action FROM orders"
_ROLES = "SELECT concat('S', s_suppkey) AS uid, concat('t', s_suppkey % 10) AS template, concat('R', s_suppkey % 60) AS logical_id FROM supplier"


@query(f"""WITH p AS (SELECT uid, template, one AS logical_id, action FROM ({_POLICIES}) UNION SELECT uid, template, two, action FROM ({_POLICIES})), r AS ({_ROLES}),
m AS (SELECT DISTINCT r.uid AS role, p.uid AS policy, action FROM p JOIN r USING (template, logical_id))
SELECT role, policy, action, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT policy) FROM m) AS n_unattached FROM m""", graph=False)
def attach_policies(spark, sf_dir):
    """Orders as policies that name two roles, suppliers as roles."""
    p = _sql(spark, sf_dir, _POLICIES, "orders").select("uid", "template", F.array("one", "two").alias("role_ids"), F.array("action").alias("granted"))
    met, lost = infra_links.attach_policies(p, _sql(spark, sf_dir, _ROLES, "supplier"))
    return met.select("role", "policy", F.explode("granted").alias("action")).join(lost, F.lit(True))


@query("SELECT DISTINCT concat('U', a.c_custkey) AS src, concat('U', b.c_custkey) AS dst FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_orderkey % 1000 AND b.c_nationkey = o_orderkey % 25", graph=False)
def unit_dependencies(spark, sf_dir):
    """Customers as units in their nation's folder, orders as what they depend on."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    path = F.concat(F.lit("live/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit("/terragrunt.hcl"))
    needs = o.join(c, o.o_custkey == c.c_custkey).select(path.alias("path"), F.concat(F.lit("../../n"), F.col("o_orderkey") % 25, F.lit("/c"), F.col("o_orderkey") % 1000).alias("config_path"))
    return infra_links.unit_dependencies(needs, c.select(F.concat(F.lit("U"), "c_custkey").alias("uid"), path.alias("path")))



def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.ranked(_QUERIES["impact_full"](spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


assert set(schema.WALKED) <= set(schema.EDGE_KINDS)
