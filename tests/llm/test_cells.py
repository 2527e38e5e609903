"""Cells of vectors: every link is found whatever the size of cells; a dense group costs bounded memory."""

import numpy as np
import pytest

from cairn.llm import vectors

from .test_against_brute_force import components


@pytest.mark.parametrize("block", [8192, 40, 7])
def test_cells_lose_no_link(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    x = np.concatenate([centres[rng.integers(0, 8, 250)] + rng.normal(size=(250, 12)) * rng.choice([0.05, 0.2, 0.5], 250)[:, None], np.tile(centres[0], (60, 1)) * np.linspace(1, 2, 60)[:, None]])
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    near = (cosine >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert not ((cosine > 0.9 - 1e-9) & (cosine < 0.9 + 1e-9)).any()
    label = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    table = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table, block=block).collect()}
    assert got == {i: (int(near[i].sum()), label[i]) for i in range(len(x))}


def test_near_cells_hold_every_point_within_reach():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(2000, 5))
    cells = vectors.Cells(points, 2000, 60)
    point, cell, own = cells.near(points, 0.5)
    mine = np.empty(2000, int)
    mine[point[own]] = cell[own]
    assert own.sum() == 2000 and len(cells.parts) > 20
    met = set(zip(point.tolist(), cell.tolist(), strict=True))
    distance = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert all((i, mine[j]) in met for i, j in zip(*np.nonzero(distance <= 0.5), strict=True))
    assert vectors.Cells(np.zeros((100, 3)), 1000, 100).parts == [10]


def test_links_of_a_dense_block_are_counted_tile_by_tile():
    """All pairs of 6000 near copies: 18 million links, held for a tile at a time only."""
    rng = np.random.default_rng(2)
    x = vectors.units(np.ones((6000, 8)) + rng.normal(size=(6000, 8)) * 0.01)
    links, label, most = 0, np.arange(6000), 0
    for a, b in vectors.linked_tiles(x, x, x, x, True, 0.9):
        links += len(a)
        most = max(most, len(a))
        vectors.join(label, a, b)
    assert links == 6000 * 5999 // 2 and most <= 1 << 16 and not label.any()
