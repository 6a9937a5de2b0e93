"""Single linkage against a plain spanning tree."""

import numpy as np
import pytest

from pulsegrid.operators import linkage as K


def _rows(n=90):
    rng = np.random.default_rng(5)
    rows = [(f"i{k:02d}", (np.array([(k % 3) * 6.0, k % 2]) + rng.normal(size=2)).tolist()) for k in range(n)]
    return rows + [("twin", rows[3][1]), ("twin2", rows[3][1])]


def _groups(d, height):
    label = np.arange(len(d))
    while True:
        new = np.array([label[d[i] <= height].min() for i in range(len(d))])
        if (new == label).all():
            return label
        label = new


def _sets(pairs):
    out = {}
    for item, label in pairs:
        out.setdefault(label, set()).add(item)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("target", [9, 1000])
def test_tree_joins_the_same_groups_at_every_height(spark, target):
    rows = _rows()
    df = spark.createDataFrame(rows, "item string, vec array<double>")
    x, names = np.array([v for _, v in rows]), [i for i, _ in rows]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tree = K.spanning_tree(df, target).collect()
    assert len(tree) == len(rows) - 1
    assert all(t["height"] == pytest.approx(d[names.index(t["src"]), names.index(t["dst"])], abs=1e-6) for t in tree)
    edges = spark.createDataFrame(tree)
    for height in (0.3, 0.8, 1.5):
        got = K.cut_at_height(df, edges, height).collect()
        assert _sets((r["item"], r["label"]) for r in got) == _sets(zip(names, _groups(d, height)))
        assert all(r["label"] == min(s) for r in got for s in _sets((g["item"], g["label"]) for g in got) if r["item"] in s)
    assert len(_sets((r["item"], r["label"]) for r in K.cut_at_count(df, edges, 3).collect())) == 3


def test_no_item_or_one(spark):
    df = spark.createDataFrame([("a", [1.0])], "item string, vec array<double>")
    assert K.spanning_tree(df).count() == 0 and K.spanning_tree(df.limit(0)).count() == 0
    assert [tuple(r) for r in K.cut_at_height(df, K.spanning_tree(df), 1.0).collect()] == [("a", "a")]


@pytest.mark.parametrize("same", [True, False])
def test_pieces_of_two_blocks_give_the_tree_of_all_distances(same):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 3))
    y = x if same else rng.normal(size=(53, 3))
    whole = K._block_tree(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), same)[2]
    src, dst, dist = K._meeting_tree(x, y, same, piece=4)
    both = x if same else np.vstack([x, y])
    assert np.allclose(np.sort(dist), np.sort(whole))
    assert np.allclose(dist, np.sqrt(((both[src] - both[dst]) ** 2).sum(-1)), atol=1e-6)
    assert same or ((src < 70) != (dst < 70)).all()
