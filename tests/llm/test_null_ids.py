"""Rows without a doc_id are documents of their own, one for each text."""

import random
from collections import Counter

import pytest


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def changed(text: str, k: int) -> str:
    words = text.split()
    words[k] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def unnamed(spark):
    rows = [(1, prose(1)), (2, prose(2)), (None, prose(2)), (None, changed(prose(1), 60)), (None, prose(3)), (None, prose(3)), (None, changed(prose(3), 1)), (None, prose(4)), (None, ""), (None, None), (3, "")]
    return spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_of_null_ids(unnamed):
    from cairn.llm import minhash

    rows = minhash.near_duplicates(unnamed, 80, 3).collect()
    assert len(rows) == 11
    by = Counter((r.doc_id, r.component_id, r.kept) for r in rows)
    assert by[(1, 1, True)] == by[(2, 2, True)] == by[(3, 3, True)] == 1
    assert by[(None, 1, False)] == by[(None, 2, False)] == 1
    assert by[(None, None, True)] in (4, 5) and by[(None, None, True)] + by[(None, None, False)] == 6
    kept = minhash.one_of_each(unnamed, 80, 3)
    assert kept.columns == unnamed.columns
    texts = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(texts) == 6 and {(1, prose(1)), (2, prose(2)), (3, ""), (None, prose(4)), (None, "")} < set(texts)
    assert len({(None, prose(3)), (None, changed(prose(3), 1))} & set(texts)) == 1


def test_repeated_passages_of_null_ids(spark):
    from cairn.llm import substrings

    passage = prose(7, 40)
    texts = {1: "one " + passage, None: prose(8, 30) + passage}
    rows = substrings.dedup_substrings(spark.createDataFrame([*texts.items(), (None, prose(9, 40)), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in rows) == sorted([(1, len(texts[1]), 0), (0, len(texts[None]), len(passage)), (0, len(prose(9, 40)), 0), (0, 0, 0)])


def test_mix_of_null_ids(spark):
    from cairn.llm import mixing

    rows = [(None if i % 3 else i, prose(i, 40 + i % 50), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.mix(docs.selectExpr("coalesce(doc_id, 1000 + crc32(text)) as doc_id", "text", "source")).collect():
        want[r.source_size] += r.taken
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for r in mixing.remix(docs).collect():
        got[sizes[r.source]] += len(r.text.split())
    assert all(abs(got[s] - want[s]) <= 2 * 90 for s in want)


def test_many_sources_keep_their_table_distributed(spark):
    from cairn.llm import mixing

    from .test_against_brute_force import water_level

    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300]), None if i % 97 == 0 else f"s{i % 211:03d}é") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water_level([sizes[s] for s in order]), strict=True))
    source = {i: s for i, _, s in rows}
    assert len(got) == 1500 and all(abs(r.target - want[source[r.doc_id]]) < 1e-6 * (1 + r.target) for r in got)
