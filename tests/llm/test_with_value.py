"""Values of keys by Bloom filters, and stages that leave documents where they are."""

import random

import pytest

from cairn.llm import minhash, mixing
from cairn.llm.common import perhaps_among, settle, with_value


@pytest.mark.parametrize("most", [1 << 27, 3000, 1])
def test_every_key_has_its_value(spark, most):
    """Whatever the filters hold, even where they tell nothing."""
    rng = random.Random(6)
    value = {k: rng.choice([0, 0, 1, 3, -1]) for k in [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)]}
    known = settle(spark.createDataFrame(list(value.items()), "key long, value int"))
    rows = spark.createDataFrame([(k, f"of {k}") for k in value for _ in range(1 + k % 2)], "key long, `a.b` string").withColumnRenamed("a.b", "of")
    got = sorted(tuple(r) for r in with_value(rows, known, most).collect())
    assert got == sorted((k, f"of {k}", v) for k, v in value.items() for _ in range(1 + k % 2))


def test_one_value_and_none(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key long, of string")
    known = settle(spark.createDataFrame([(1, 2), (2, 2)], "key long, value int"))
    assert sorted(tuple(r) for r in with_value(rows, known).collect()) == [(1, "a", 2), (2, "b", 2)]
    assert with_value(rows.limit(0), settle(known.limit(0))).collect() == []


def test_no_key_is_left_out(spark):
    keys = settle(spark.range(0, 3000, 3).withColumnRenamed("id", "key"))
    got = {r.key for r in perhaps_among(spark.range(3000).withColumnRenamed("id", "key"), keys).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1200
    assert perhaps_among(keys, settle(keys.limit(0))).collect() == []


@pytest.mark.parametrize("stage", [minhash.one_of_each, mixing.remix])
def test_documents_are_not_moved(spark, stage):
    """Without broadcast joins, as on large tables, a stage shuffles far less than the texts."""
    rng = random.Random(8)
    rows = [(i, "abc"[i % 3], " ".join(f"{rng.getrandbits(64):x}" for _ in range(400))) for i in range(500)]
    rows += [(1000 + i, r[1], r[2]) for i, r in enumerate(rows[:10])]
    docs = settle(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4))
    written = lambda: sum(e.totalShuffleWrite() for e in _all(spark._jsc.sc().statusStore().executorList(False)))
    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        settle(stage(docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert written() - before < sum(len(r[2]) for r in rows) / 5


def _all(found):
    return [found.apply(i) for i in range(found.size())]
