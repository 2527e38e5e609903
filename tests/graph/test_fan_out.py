"""Pairs of linkers: made in the last step, in the number known before."""

from collections import Counter

import pytest

from cairn import queries
from cairn.operators import code_links
from cairn.operators.fan_out import fan_out

SF = "/root/testdata/sf0.001"


def unmoved(df):
    """Whether nothing joins, counts or moves what the pairs' step gives."""

    def down(node):
        name = node.nodeName()
        below = [node.children().apply(k) for k in range(node.children().size())]
        return name == "Generate" or (name in ("Project", "Filter", "Union") and bool(below) and all(map(down, below)))

    return down(df._jdf.queryExecution().optimizedPlan())


@pytest.mark.parametrize("keys", [None, ["id"]])
def test_equals_a_plain_join(spark, keys):
    left = [(k, k % 4) for k in range(40)] + [(1, 1), (1, 2), (None, 3), (None, 3), (9, None), (50, 9)]
    right = [(0, f"u{k}") for k in range(700)] + [(1, f"v{k}") for k in range(70)] + [(2, "w"), (2, "w"), (2, None), (None, "x"), (8, "y")]
    matches = Counter(k for k, _ in right)
    sums = Counter()
    for i, k in left:
        sums[i] += matches[k] if k is not None else 0
    want = Counter((i, k, sums[i] if keys else matches[k], u) for i, k in left if k is not None for k2, u in right if k2 == k)
    got = fan_out(spark.createDataFrame(left, "id long, k long"), spark.createDataFrame(right, "k long, u string"), ["k"], keys)
    assert got.columns == ["id", "k", "n", "u"]
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["link_graphql_consumers", "link_calls_tiered", "link_calls_ts", "link_calls_cs", "link_calls_rust", "link_calls_qualified"])
def test_pairs_are_not_moved(spark, name):
    assert unmoved(queries.queries()[name](spark, SF))


def test_signals_without_identity_are_linked(spark):
    signals = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "signal long, key string")
    ops = spark.createDataFrame([("x", "a", "GraphQl"), ("y", "b", "GraphQl"), ("z", "a", "OpenApi")], "op string, key string, format string")
    got = {(r.signal, r.op, r.provenance) for r in code_links.graphql_links(signals, ops).collect()}
    assert got == {(None, "x", "Ambiguous"), (None, "y", "Ambiguous"), (1, "x", "Inferred")}
