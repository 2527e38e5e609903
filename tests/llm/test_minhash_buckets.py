"""Buckets that links with their first class don't join: chains, dense groups, tiles."""

import random

import numpy as np
import pytest

from .test_against_brute_force import components, shingles


def chain(seed: int, n: int, step: int, words: int = 120) -> list[str]:
    """Texts of which each is near the next, and ever less near the farther ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    held = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(held))
        held = held[step:] + [word() for _ in range(step)]
    return out


@pytest.mark.parametrize(("step", "n"), [(2, 60), (14, 60), (6, 40)])
def test_chained_candidates(spark, step, n):
    from cairn.llm import minhash

    texts = [t for k in range(3) for t in chain(k, n, step)]
    random.Random(1).shuffle(texts)
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(range(len(sets)), links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85, 3).collect()}
    assert got == want


def test_tiles_hold_every_open_pair(spark):
    """Whatever the size of tiles, each pair that isn't joined yet meets in some task, and no task is larger than two tiles."""
    from cairn.llm import minhash

    rng = random.Random(3)
    reps = list(range(200))
    group = {r: 0 if r < 120 else rng.choice([r, 500]) for r in reps}
    banded = spark.createDataFrame([(r, 10, b, 7) for r in reps for b in (0, 1)], "rep long, n long, band int, value long")
    shared = spark.createDataFrame([(b, 7, 0, 10, 200) for b in (0, 1)], "band int, value long, head long, head_n long, members long")
    joined = spark.createDataFrame([(r, c) for r, c in group.items() if c != r or r == 0], "node long, component long")
    tasks: dict[str, list[int]] = {}
    for r in minhash.tiled(banded, shared, joined, tile_sets=25).collect():
        tasks.setdefault(r.key, []).append(r.rep)
        assert r.known == group[r.rep]
    assert len({k.split(":")[0] for k in tasks}) == 1  # both bands hold the same
    met = {(a, b) for rows in tasks.values() for a in rows for b in rows}
    assert all((a, b) in met for a in reps for b in reps if group[a] != group[b])
    assert max(map(len, tasks.values())) <= 2 * 45


def test_links_of_what_is_known_are_not_sought_again():
    from cairn.llm import minhash

    s = [np.arange(100, dtype=np.uint64) for _ in range(60)]
    assert minhash.links_among(s, 85, [1] * 60) == []
    assert len(minhash.links_among(s, 85, [1] * 30 + [2] * 30)) == 1
    assert len(minhash.links_among(s[:20], 85, [1] * 10 + [2] * 10)) == 1


def test_rows_of_one_id_with_several_texts(spark):
    from cairn.llm import minhash

    a, b = chain(1, 1, 1)[0], chain(2, 1, 1)[0]
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " more"), (3, a)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 80, 5).collect())
    assert rows == [(1, 1), (1, 1), (2, 1), (3, 1)]
