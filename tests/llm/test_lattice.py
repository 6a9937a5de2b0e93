"""Lattice decoding, and linked vectors against all pairs."""

import numpy as np
import pytest

from pulsegrid.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, node string, keys int"


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (300, 8))
    got = lattice.nearest_points(x)
    near = np.concatenate([[np.zeros(8)], lattice.ROOTS])
    best = ((x[:, None] - (got[:, None] + near)) ** 2).sum(axis=2).argmin(axis=1)
    assert (best == 0).all() and len(np.unique(lattice.ROOTS, axis=0)) == 240
    assert np.allclose((lattice.ROOTS ** 2).sum(axis=1), 2)


def brute(rows, cosine=0.98):
    ok = [k for k, (i, v, label, *_) in enumerate(rows) if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(np.float32(rows[a][1])), np.float64(np.float32(rows[b][1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(b)] = find(a)
    out = []
    for k, r in enumerate(rows):
        ids = [q[0] for n, q in enumerate(rows) if find(n) == find(k) and q[0] is not None]
        low = min(ids, default=None)
        out.append((r[0], links[k], low, low is not None and r[0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile_rows", [7, 512])
def test_links_match_all_pairs(spark, tile_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    rows = [(i, base[i % 30].tolist(), i % 3, "", 0) for i in range(30)]
    for i in range(30, 260):
        x = base[i % 5] / np.linalg.norm(base[i % 5])
        g = rng.normal(size=64)
        rows.append((i, (x + g / np.linalg.norm(g) * rng.uniform(0, .15)).tolist(), 1, "", 0))
    rows += [(1000 + i, [1.0] * 64, 2, "", 0) for i in range(40)] + [(1100, [2.0] * 64, 2, "", 0), (1101, [1.0] * 64, None, "", 0)]
    rows += [(1200, None, 1, "", 0), (1201, [0.0] * 64, 1, "", 0), (1202, [float("nan")] + [1.0] * 63, 2, "", 0), (1203, [float("inf")] * 64, 2, "", 0),
             (1204, [None] + [1.0] * 63, 2, "", 0), (1205, [], 2, "", 0), (1206, [3.0, 4.0], 2, "", 0), (1207, [3.0, 4.1], 2, "", 0),
             (3, base[1].tolist(), 1, "", 0), (None, [1.0] * 64, 2, "", 0), (None, None, 2, "", 0)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile_rows=tile_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = .98 * x + np.sqrt(1 - .98 ** 2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    cells, salt = lattice.Cells(64), np.zeros(3000, np.uint64)
    a, b = cells.keys(x, salt), cells.keys(y, salt)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > .999
    assert (a[:-1, :, None] == a[1:, None, :]).any(axis=(1, 2)).mean() < .02


def test_empty_table(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
