"""Single-linkage hierarchy of all items by a minimum spanning tree.

Every two blocks meet once and keep only the spanning tree of their distances,
which preserves who is connected at any height. Boruvka rounds then join
components along their shortest outgoing edges until one tree is left; they read
these edges alone, no distance again. A cut of the tree is a filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import blocks as B
from pulsegrid.operators.graph import components
from pulsegrid.session import cut_lineage


def _block_tree(d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left row, right row, distance)`` of a minimum spanning tree, grown from the first row.

    Rows of two different blocks are joined across the blocks only; each block has its own tree.
    """
    n, m = d.shape
    size = n if same else n + m
    best, parent, open_ = np.full(size, np.inf), np.zeros(size, int), np.ones(size, bool)
    src, dst, dist = np.zeros(size - 1, int), np.zeros(size - 1, int), np.zeros(size - 1)
    now = 0
    for step in range(size - 1):
        open_[now] = False
        if same:
            reach, at = d[now], slice(0, n)
        elif now < n:
            reach, at = d[now], slice(n, size)
        else:
            reach, at = d[:, now - n], slice(0, n)
        nearer = reach < best[at]
        best[at] = np.where(nearer, reach, best[at])
        parent[at] = np.where(nearer, now, parent[at])
        now = int(np.where(open_, best, np.inf).argmin())
        src[step], dst[step], dist[step] = parent[now], now, best[now]
    return src, dst, dist


def _forest(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, size: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of ``size`` rows, found in Boruvka rounds."""
    edge = np.argsort(dist, kind="stable")  # a total order, so that the shortest edges of all groups close no cycle
    label, kept = np.arange(size), []
    while True:
        edge = edge[label[src[edge]] != label[dst[edge]]]
        if not edge.size:
            return np.concatenate([np.empty(0, int), *kept])
        first = np.full(size, edge.size)
        for end in (src, dst):
            np.minimum.at(first, label[end[edge]], np.arange(edge.size))
        kept.append(edge[np.unique(first[first < edge.size])])
        label = B.joined(label, src[kept[-1]], dst[kept[-1]])


def _meeting_tree(x: np.ndarray, y: np.ndarray, same: bool, piece: int = B.BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree over the distances of two blocks: pieces give their trees, and the edges held are cut to one tree
    whenever they are many times the rows."""
    size, shift = (len(x), 0) if same else (len(x) + len(y), len(x))
    held, more, n = [np.empty(0, int), np.empty(0, int), np.empty(0)], [], 0

    def thinned():
        rows = [np.concatenate([held[k], *[m[k] for m in more]]) for k in range(3)]
        at = _forest(*rows, size)
        return [v[at] for v in rows]

    for i in range(0, len(x), piece):
        for j in range(i if same else 0, len(y), piece):
            d = B.euclidean(x[i:i + piece], y[j:j + piece])
            src, dst, dist = _block_tree(d, same and i == j)
            place = np.concatenate([np.arange(i, i + len(d)), shift + np.arange(j, j + d.shape[1])])
            more.append((place[src], place[dst], dist))
            n += len(dist)
            if n > 16 * size:
                held, more, n = thinned(), [], 0
    return tuple(thinned())


def spanning_tree(df: DataFrame, target: int = B.BLOCK_ROWS) -> DataFrame:
    """``(src, dst, height)``: the merges of single linkage over rows ``(item, vec)``, one fewer than items.

    Items are unique and vectors finite and of one length. Among equal distances any tree may result; the groups at every
    height are the same. No item or one gives no rows. The rounds grow with the logarithm of the items.
    """
    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame | None:
        x, y = B.stack(left["vec"]), B.stack(right["vec"])
        if not len(x) or not len(y):
            return None
        src, dst, dist = _meeting_tree(x, y, same)
        names = left["item"].to_numpy() if same else np.concatenate([left["item"].to_numpy(), right["item"].to_numpy()])
        return pd.DataFrame({"src": names[src], "dst": names[dst], "height": dist})

    slim = df.select(F.col("item").cast("string").alias("item"), "vec")
    edge = F.struct("height", "src", "dst")  # a total order, so that the shortest edges of all components close no cycle
    rows = B.meet(slim, "item", kernel, "src string, dst string, height double", target=target, in_strips=True).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "height")
    live = cut_lineage(rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), edge.alias("edge")))
    tree = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge"))
        picked = both.groupBy("a").agg(F.min(F.struct("edge", "b")).alias("m")).select("a", "m.b", "m.edge")
        picked = cut_lineage(picked)
        new = picked.select("edge").distinct()
        tree = new if tree is None else tree.unionByName(new)
        groups = cut_lineage(components(picked.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        at, to = groups.toDF("a", "left"), groups.toDF("b", "right")
        moved = live.join(at, "a").join(to, "b").where(F.col("left") != F.col("right"))
        live = cut_lineage(moved.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(
            F.min("edge").alias("edge")))
    if tree is None:
        return df.sparkSession.createDataFrame([], "src string, dst string, height double")
    return tree.select("edge.src", "edge.dst", "edge.height")


def _labels(items: DataFrame, kept: DataFrame) -> DataFrame:
    names = items.select(F.col("item").cast("string").alias("item"))
    groups = components(kept.select("src", "dst"))
    return names.join(groups, F.col("item") == F.col("node"), "left").select("item", F.coalesce("component", "item").alias("label"))


def cut_at_height(items: DataFrame, tree: DataFrame, height: float) -> DataFrame:
    """``(item, label)`` of the groups joined up to ``height``; a label is the group's smallest item."""
    return _labels(items, tree.where(F.col("height") <= height))


def cut_at_count(items: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """``(item, label)`` of ``k`` groups: all merges but the ``k - 1`` highest. Fewer items than ``k`` stay alone."""
    last = tree.orderBy(F.desc("height"), F.desc("src"), F.desc("dst")).limit(k - 1)
    return _labels(items, tree.join(last, ["src", "dst"], "left_anti"))
