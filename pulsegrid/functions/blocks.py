"""Compare items with each other in bounded blocks instead of emitting pairs.

Rows are cut into blocks of about ``target`` rows; every two blocks that can
hold related rows meet in one task, which returns per-item sums, counts or a
spanning forest, never the pairs themselves. Blocks come from a hash of the
unique item key, so no item, label or dense region can make one block large.
With a coordinate and a reach, rows further apart than the reach along it are
never compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.joins import lookup_join
from pulsegrid.session import cut_lineage

BLOCK_ROWS = 1_000
#: Blocks of a large table at least, and their rows at most, where the kernel goes through them in strips.
LEAST_BLOCKS, STRIP_BLOCK_ROWS = 16, 65_536
#: Distances that a strip holds at a time.
STRIP_CELLS = 4_000_000
#: Rows and columns of a piece of distances that is used once.
TILE = 512
#: Tasks for each core of the session at most, where there are more meetings than that.
TASKS_PER_CORE = 100
Kernel = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


def _slabs(df: DataFrame, coord: Column, reach: float, target: int) -> DataFrame:
    ends = df.agg(F.min(coord).alias("lo"), F.max(coord).alias("hi"), F.count("*").alias("n")).first()
    if ends["lo"] is None:
        return df.withColumn("_slab", F.lit(0).cast("long"))
    width = max(reach * (1 + 1e-9), (ends["hi"] - ends["lo"]) * target / max(ends["n"], 1), 1e-300)
    return df.withColumn("_slab", F.floor((coord - ends["lo"]) / width))


def strips(rows: int, cols: int) -> list[slice]:
    """Rows in pieces whose distances to all ``cols`` stay within ``STRIP_CELLS``."""
    step = max(1, STRIP_CELLS // max(1, cols))
    return [slice(at, min(at + step, rows)) for at in range(0, rows, step)]


def _block_rows(df: DataFrame, rows: int, target: int) -> int:
    """Rows of a block for kernels that need no table of all distances: a row goes out once for each block, so their number is
    kept to what the cores need as long as the blocks fit in a task."""
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(8 * df.sparkSession.sparkContext.defaultParallelism)))
    return max(target, min(-(-rows // blocks), STRIP_BLOCK_ROWS))


def meet(df: DataFrame, key: str, kernel: Kernel, schema: str, coord: Column | None = None,
         reach: float | None = None, target: int = BLOCK_ROWS, in_strips: bool = False) -> DataFrame:
    """Run ``kernel(left, right, same_block)`` once for every two blocks in reach.

    Blocks have about ``target`` rows; ``in_strips`` allows larger ones, for kernels whose memory and output grow with the rows only.
    """
    n_rows = df.count() if coord is None or in_strips else 0
    size = _block_rows(df, n_rows, target) if in_strips else target
    if coord is None:
        blocks = max(1, -(-n_rows // size))
        meetings_n = blocks * (blocks + 1) // 2
        placed = df.withColumns({"_slab": F.lit(0).cast("long"), "_own": F.lit(blocks), "_up": F.lit(0), "_down": F.lit(0)})
    else:
        rows = _slabs(df, coord, reach, target)
        subs = cut_lineage(rows.groupBy("_slab").agg(F.ceil(F.count("*") / size).cast("int").alias("_own")))
        up = subs.select((F.col("_slab") - 1).alias("_slab"), F.col("_own").alias("_up"))
        down = subs.select((F.col("_slab") + 1).alias("_slab"), F.col("_own").alias("_down"))
        plan = subs.join(up, "_slab", "left").join(down, "_slab", "left").fillna(0, ["_up", "_down"])
        n = F.col("_own").cast("long")
        meetings_n = plan.agg(F.sum(n * (n + 1) / 2 + n * F.col("_up"))).first()[0] or 1
        placed = lookup_join(rows, plan, "_slab", "inner")
    placed = placed.withColumn("_b", F.pmod(F.xxhash64(key), F.col("_own")).cast("int"))

    def meetings(count: str, fn) -> Column:
        none = F.expr("CAST(array() AS array<struct<sa:bigint,ba:int,sb:bigint,bb:int,side:int>>)")
        seq = F.sequence(F.lit(0), F.col(count) - 1)
        return F.when(F.col(count) > 0, F.transform(seq, fn)).otherwise(none)

    def tag(sa, ba, sb, bb, side) -> Column:
        return F.struct(sa.cast("long").alias("sa"), ba.cast("int").alias("ba"), sb.cast("long").alias("sb"),
                        bb.cast("int").alias("bb"), side.cast("int").alias("side"))

    s, b = F.col("_slab"), F.col("_b")
    own = meetings("_own", lambda c: tag(s, F.least(b, c), s, F.greatest(b, c),
                                         F.when(b == c, 2).when(b < c, 0).otherwise(1)))
    above = meetings("_up", lambda c: tag(s, b, s + 1, c, F.lit(0)))
    below = meetings("_down", lambda c: tag(s - 1, c, s, b, F.lit(1)))
    # the work grows with the square of the bytes, so tasks are counted by meetings, not by size; as many repeat the rows, so that
    # no task holds the copies of a whole file
    tasks = int(min(max(2 * meetings_n, 1), TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))
    dealt = placed.repartition(tasks, key)
    spread = dealt.withColumn("_m", F.explode(F.concat(own, above, below))).select(*df.columns, "_m.*")

    kinds = {"string": object, "double": "float64", "long": "int64"}
    columns = {name: kinds.get(kind, object) for name, kind in (part.split() for part in schema.split(","))}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        data = pdf.drop(columns=["sa", "ba", "sb", "bb", "side"])
        if (side == 2).any():
            out = kernel(data, data, True)
        elif (side == 0).any() and (side == 1).any():
            out = kernel(data[side == 0], data[side == 1], False)
        else:
            out = None
        if out is None or not len(out):
            return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in columns.items()})
        return out

    return spread.repartition(tasks, "sa", "ba", "sb", "bb").groupBy("sa", "ba", "sb", "bb").applyInPandas(run, schema)


def matrix(col: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows, without an object for each."""
    size = np.diff(col.offsets.to_numpy())
    if col.null_count or (size != size[:1]).any():
        raise ValueError("vectors must be of one length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1) if len(col) else np.empty((0, 0))


def stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.empty((0, 0))


def tiles(a: np.ndarray, b: np.ndarray):
    """``(rows, columns, distances)`` of two blocks piece by piece, around a common centre; a piece stays in a core's cache."""
    mid = a.mean(axis=0)
    a, b = a - mid, b - mid
    a = np.hstack([a, (a * a).sum(1)[:, None], np.ones((len(a), 1))])
    b = np.hstack([-2 * b, np.ones((len(b), 1)), (b * b).sum(1)[:, None]]).T.copy()
    for i in range(0, len(a), TILE):
        for j in range(0, b.shape[1], TILE):
            d = a[i:i + TILE] @ b[:, j:j + TILE]
            yield slice(i, i + len(d)), slice(j, j + d.shape[1]), np.sqrt(np.maximum(d, 0.0, out=d), out=d)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two blocks by one matrix product, around a common centre."""
    if not len(a) or not len(b):
        return np.empty((len(a), len(b)))
    mid = a.mean(axis=0)
    a, b = a - mid, b - mid
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def disagreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of positions with different labels."""
    out = np.zeros((len(a), len(b)))
    for p in range(a.shape[1] if a.ndim == 2 else 0):
        out += a[:, p, None] != b[None, :, p]
    return out / max(1, a.shape[1] if a.ndim == 2 else 1)


METRICS = {"euclidean": euclidean, "disagreement": disagreement}


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups of each ``a`` and ``b`` became one; a label is the smallest row of its group."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def spanning_edges(near: Callable[[slice], np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> pd.DataFrame:
    """One edge per node to the smallest id of its component inside two blocks.

    ``near`` marks the right rows near a strip of left rows; of these only links between groups still apart are followed.
    """
    names = left if same else np.concatenate([left, right])
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), int)
    place[order] = np.arange(len(names))
    rows, cols = place[:len(left)], place if same else place[len(left):]
    label = np.arange(len(names))
    for at in strips(len(rows), len(cols)):
        if not label.any():  # one group already
            break
        r, c = np.nonzero(near(at) & (label[rows[at], None] != label[None, cols]))
        label = joined(label, rows[at][r], cols[c])
    src, dst = names[order], names[order[label]]
    apart = src != dst
    return pd.DataFrame({"src": pd.Series(src[apart], dtype=object), "dst": pd.Series(dst[apart], dtype=object)})
