"""Walks on small graphs made by hand."""

import pytest

from cairn import schema
from cairn.operators import components, linkers, views, walk


def graph(spark, edges, kinds=None):
    names = sorted({x for e in edges for x in e[:2]} | set(kinds or {}))
    nodes = spark.createDataFrame([(n, (kinds or {}).get(n, "Function"), n, n, f"{n}.ts") for n in names], "uid string, kind string, name string, fqn string, path string")
    return nodes, spark.createDataFrame([(a, b, k, "Ambiguous" if amb else "Inferred", c) for a, b, k, c, amb in edges], "src string, dst string, kind string, provenance string, confidence float")


def found(spark, nodes, edges, target, **options):
    rows = walk.impact(nodes, edges, spark.createDataFrame([(target,)], "uid string"), walk.Options(**options)).collect()
    return {r.uid: (r.depth, round(r.confidence, 4), r.ambiguous, r.will_break) for r in rows}


def test_chain(spark):
    nodes, edges = graph(spark, [("a", "b", "Calls", 0.9, False), ("b", "c", "Calls", 0.8, True)])
    assert found(spark, nodes, edges, "c") == {"b": (1, 0.8, True, False), "a": (2, 0.72, True, False)}
    ranked = walk.ranked(walk.impact(nodes, edges, spark.createDataFrame([("c",)], "uid string"))).collect()
    assert [r.uid for r in ranked] == ["b", "a"]


def test_cycle_and_dangling_edges(spark):
    nodes, edges = graph(spark, [("a", "b", "Calls", 0.5, False), ("b", "a", "Calls", 0.5, True)])
    edges = edges.union(spark.createDataFrame([("ghost", "a", "Calls", "Inferred", 0.9)], edges.schema))
    assert found(spark, nodes, edges, "a") == {"b": (1, 0.5, True, False)}


def test_contract_hop_is_not_recursive(spark):
    kinds = {"op": "ApiOperation", "op2": "ApiOperation"}
    nodes, edges = graph(spark, [("p", "op", "Produces", 0.8, False), ("c", "op", "Consumes", 0.7, False), ("d", "c", "Calls", 1.0, False), ("c", "op2", "Produces", 0.8, False), ("e", "op2", "Consumes", 0.7, False)], kinds)
    assert found(spark, nodes, edges, "p") == {"op": (1, 0.8, False, True), "c": (2, 0.56, False, True), "d": (3, 0.56, False, True)}
    assert found(spark, nodes, edges, "op") == {"p": (1, 0.8, False, True), "c": (1, 0.7, False, True), "d": (2, 0.7, False, True)}
    assert found(spark, nodes, edges, "p", contracts=False) == {}


def test_least_confidence_does_not_let_filtered_ambiguity_through(spark):
    nodes, edges = graph(spark, [("b", "a", "Calls", 0.9, False), ("b", "a", "Calls", 0.35, True), ("c", "b", "Calls", 0.9, False)])
    assert found(spark, nodes, edges, "a", min_confidence=0.5) == {"b": (1, 0.9, False, True), "c": (2, 0.81, False, True)}
    assert found(spark, nodes, edges, "a")["c"] == (2, 0.81, True, False)


def test_explanations_end_at_the_confidence_of_impact(spark):
    nodes, edges = graph(spark, [("b", "a", "Calls", 0.9, False), ("c", "b", "Calls", 0.8, False), ("c", "a", "Reads", 0.5, False), ("d", "c", "MapsTo", 0.95, False)])
    target = spark.createDataFrame([("a",)], "uid string")
    hops = walk.explain(nodes, edges, target).collect()
    last = {}
    for r in sorted(hops, key=lambda r: r.hop):
        last[r.uid] = r
    assert {u: r.running_confidence for u, r in last.items()} == {r.uid: r.confidence for r in walk.impact(nodes, edges, target).collect()}
    assert last["d"].hop == 3 and last["d"]["from"] == "d"


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (10, 25)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, **dict.fromkeys(range(20, 26), 10)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_hold_on_all_derived_edges(spark):
    from cairn.plans import derived

    _, edges = derived.graph(spark, "/root/testdata/sf0.001")
    rows = edges.groupBy("provenance").agg({"confidence": "min"}).collect()
    most = {r.provenance: r[1] for r in edges.groupBy("provenance").agg({"confidence": "max"}).collect()}
    assert {r.provenance for r in rows} == {"Extracted", "Inferred", "Ambiguous"}
    for r in rows:
        low, high = schema.BANDS[r.provenance]
        assert low - 1e-6 <= r[1] and most[r.provenance] <= high + 1e-6


@pytest.mark.parametrize(("n", "want"), [(0, "LOW"), (4, "LOW"), (5, "MEDIUM"), (15, "MEDIUM"), (16, "HIGH")])
def test_risk_bands(spark, n, want):
    affected = spark.createDataFrame([(f"ts|r|f|x{i}|", "Function") for i in range(n)], "uid string, kind string")
    changed = spark.createDataFrame([("ts|r|f|y|",)], "uid string")
    assert views.risk(affected, changed).first().level == want


def test_first_tier_and_grades(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 2)], "site int, uid string, tier int")
    got = {(r.site, r.uid, r.n) for r in views.first_tier(hits, ["site"]).collect()}
    assert got == {(1, "a", 1), (2, "a", 2), (2, "b", 2)}
    graded = linkers.graded(hits.where("site = 2"), ["site"], 0.8).collect()
    assert {(r.provenance, round(r.confidence, 2)) for r in graded} == {("Ambiguous", 0.35)}


def test_imports_resolve_in_order(spark):
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib"), ("src/a.ts", "react/x"), ("src/a.ts", "./none")], "file string, specifier string")
    files = spark.createDataFrame([("src/b.tsx",), ("src/b.ts",), ("lib/index.ts",)], "path string")
    got = {r.specifier: (r.resolved, r.package) for r in linkers.resolve_imports(imports, files).collect()}
    assert got == {"./b": ("src/b.ts", None), "../lib": ("lib/index.ts", None), "react/x": (None, "react"), "./none": (None, None)}


def test_markdown_sections(spark):
    from cairn.sources import markdown

    text = "intro `x.y`\n# One\nsee [a](src/a.ts#L1)\n```\nfoo.bar baz\n# no heading\n```\n# One\n"
    got = markdown.sections(spark.createDataFrame([("d.md", text)], "path string, text string")).collect()
    assert [(r.heading, r.start_line, r.end_line) for r in got] == [("", 1, 1), ("One", 2, 7), ("One", 8, 9)]
    assert [(x.form, x.ref) for x in got[1].refs] == [("path", "src/a.ts"), ("fence", "foo.bar")]
    anchors = {(r.pos, r.anchor) for r in markdown.anchors(spark.createDataFrame([("d", 1, "One Two"), ("d", 2, "One two!"), ("d", 3, "Preamble")], "path string, pos int, heading string")).collect()}
    assert anchors == {(1, "one-two"), (2, "one-two-1"), (3, "preamble-1")}


def test_subgraph_without_limit(spark):
    nodes = spark.createDataFrame([(f"n{k}", "Function", f"n{k}", f"n{k}", "f", 1, 1) for k in range(600)], "uid string, kind string, name string, fqn string, path string, start_line int, end_line int")
    edges = spark.createDataFrame([("n0", f"n{k}", "Calls", "Extracted", 1.0) for k in range(1, 600)], "src string, dst string, kind string, provenance string, confidence double")
    found, met, cut = walk.subgraph(nodes, edges, "n0", 2, most=None)
    assert (found.count(), met.count(), cut) == (600, 599, False)
    found, met, cut = walk.subgraph(nodes, edges, "n0", 2, most=100)
    assert (found.count(), met.count(), cut) == (100, 99, True)
