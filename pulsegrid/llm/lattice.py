"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random to blocks of eight dimensions and each
block is decoded to its nearest point of the E8 lattice. The points of a
table's blocks name the vector's cell; the cells across the nearest faces are
probed too. Vectors that share a cell are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.components import connected
from pulsegrid.llm.simhash import _merge, _tile
from pulsegrid.session import cut_lineage

#: Tables, blocks of eight dimensions of a cell, probed neighbours of a cell, and lattice steps for a unit of 64-dimensional distance.
#: At cosine 0.98 one table misses a link with probability 0.15, all five with 0.0001.
TABLES, BLOCKS, PROBES, SCALE = 5, 2, 2, 3.0
#: Vectors of one cell that are compared in one piece; more are compared piece by piece.
TILE_ROWS = 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: signed pairs of ones, and halves with an even number of minus signs."""
    whole = np.zeros((112, 8))
    for k, ((i, j), (a, b)) in enumerate(product(combinations(range(8), 2), product((1, -1), repeat=2))):
        whole[k, i], whole[k, j] = a, b
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.concatenate([whole, np.array(halves)])


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    row = np.flatnonzero(near.sum(axis=1) % 2)
    col = np.abs(off[row]).argmax(axis=1)
    near[row, col] += np.where(off[row, col] >= 0, 1, -1)
    return near


def nearest_points(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer points and the same moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Cells:
    """Cell keys of unit vectors of one dimension."""

    def __init__(self, dimension: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE):
        rng = np.random.default_rng(dimension)
        self.probes, width = probes, 8 * blocks
        self.planes, self.shifts = [], []
        for _ in range(tables):
            gauss = rng.standard_normal((dimension, width))
            basis = np.linalg.qr(gauss)[0] if dimension >= width else gauss / np.sqrt(width)
            self.planes.append(basis * scale * np.sqrt(dimension / 64))
            self.shifts.append(rng.random(width))
        self.odd = rng.integers(1 << 62, size=width + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _key(self, cell: np.ndarray, table: int, salt: np.ndarray) -> np.ndarray:
        whole = (2 * cell).astype(np.int64).view(np.uint64)
        h = (whole * self.odd[:-2]).sum(axis=1, dtype=np.uint64) + salt * self.odd[-2] + np.uint64(table + 1) * self.odd[-1]
        for shift in (31, 29, 32):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(30))).view(np.int64)

    def keys(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """``tables * (1 + probes)`` keys of each row: its own cells and those across the nearest faces."""
        out = []
        for t, (plane, shift) in enumerate(zip(self.planes, self.shifts)):
            at = unit @ plane + shift
            n, width = at.shape
            cell = nearest_points(at.reshape(-1, 8)).reshape(n, width)
            out.append(self._key(cell, t, salt))
            off = (at - cell).reshape(n, width // 8, 8)
            face = (2 - 2 * off @ ROOTS.T).reshape(n, -1)  # growth of the squared distance by a step over each face
            for col in np.argsort(face, axis=1, kind="stable")[:, :self.probes].T:
                moved = cell.reshape(n, width // 8, 8).copy()
                moved[np.arange(n), col // len(ROOTS)] += ROOTS[col % len(ROOTS)]
                out.append(self._key(moved.reshape(n, width), t, salt))
        return np.stack(out, axis=1)


def _keyed(classes: DataFrame, kind: str, options: dict) -> DataFrame:
    """Adds ``keys`` to distinct vectors; equal labels and dimensions only share keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Cells] = {}
        for batch in batches:
            node, salt, vectors = (batch.column(k) for k in range(3))
            size = np.array([len(v) for v in vectors])
            salt = salt.to_numpy(zero_copy_only=False).view(np.uint64)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = np.array([vectors[int(k)].as_py() for k in rows], np.float64)
                cells = known.setdefault(int(d), Cells(int(d), **options))
                keys = cells.keys(x / np.linalg.norm(x, axis=1, keepdims=True), salt[rows])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([node.take(take), batch.column(3).take(take), vectors.take(take), pa.array(list(keys), pa.list_(pa.int64()))],
                                                 names=["node", "n", "embedding", "keys"])

    return classes.select("node", F.xxhash64("label", F.size("embedding")).alias("salt"), "embedding", "n").mapInArrow(
        run, f"node long, n long, embedding {kind}, keys array<long>")


def _compared(cosine: float):
    def links(key: int, split: bool, node: np.ndarray, n: np.ndarray, own_piece: np.ndarray, vectors: list, keys: list) -> pa.RecordBatch | None:
        x, shared = np.array(vectors, np.float64), np.array(keys, np.int64)
        norms = np.sqrt((x * x).sum(axis=1))
        near = np.triu((x @ x.T) / np.outer(norms, norms) >= cosine, 1)
        if split:  # two pieces: pairs within one of them are compared elsewhere
            near &= own_piece[:, None] != own_piece[None, :]
        i, j = np.nonzero(near)
        own = np.zeros(len(i), bool)
        for at in range(0, len(i), 50_000):  # a pair counts under the smallest key that both have
            a, b = shared[i[at:at + 50_000]], shared[j[at:at + 50_000]]
            both = (a[:, :, None] == b[:, None, :]).any(axis=2)
            own[at:at + 50_000] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == key
        i, j = i[own], j[own]
        if not len(i):
            return None
        count = np.zeros(len(node), np.int64)
        np.add.at(count, i, n[j])
        np.add.at(count, j, n[i])
        root = _merge(np.arange(len(node)), i, j)
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(node[root[some]])], names=["node", "links", "other"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            done, rest = _groups(table, last=False)
            yield from (r for g in done if (r := links(*g)))
        if rest is not None:
            yield from (r for g in _groups(rest, last=True)[0] if (r := links(*g)))

    return run


def _groups(table: pa.Table, last: bool) -> tuple[Iterator[tuple], pa.Table | None]:
    """The pieces (equal key, lo, hi) in a sorted table; unless it is the last one, its final piece may go on and is handed back."""
    heads = [table.column(k).to_numpy() for k in range(3)]
    new = np.r_[True, np.any([h[1:] != h[:-1] for h in heads], axis=0)] if len(table) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    cut = len(table) if last else int(first[-1])

    def each() -> Iterator[tuple]:
        head = table.slice(0, cut)
        node, n, own = (head.column(k).to_numpy() for k in (3, 4, 5))
        vectors, keys = head.column(6), head.column(7)
        bounds = [*first[first < cut], cut]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                yield int(heads[0][a]), bool(heads[1][a] != heads[2][a]), node[a:b], n[a:b], own[a:b], vectors.slice(a, b - a).to_pylist(), keys.slice(a, b - a).to_pylist()

    return each(), None if last else table.slice(cut)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, tile_rows: int = TILE_ROWS, **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``; others are ignored).

    Vectors of equal label and dimension link at a cosine of at least ``cosine`` in double precision. Null or zero vectors,
    those with null or non-finite components and those without label link with nothing and are their own component.
    Copies are compared once and counted each. Rows that repeat an id are rows of their own; a row without id counts for
    others but never names a component. Vectors are told apart by a 64-bit hash of label and components. An empty table
    gives no rows. Cells with more than ``tile_rows`` vectors are compared piece by piece, all pairs of pieces.
    """
    e = F.col("embedding")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    fit = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = F.coalesce(fit & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = cut_lineage(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.when(fit, e.cast(kind)).alias("embedding"),
        F.when(fit, F.xxhash64(F.col("label"), F.size(e), e.cast(kind))).alias("node")))
    classes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("embedding").alias("embedding")))
    keyed = cut_lineage(_keyed(classes, kind, options))
    under = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    met = under.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / tile_rows).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pieces = under.join(met, "key").withColumn("own", own).select("key", "node", "own", F.explode(_tile(F.col("own"), F.col("tiles"))).alias("tile"))
    dealt = pieces.join(keyed, "node").select("key", "tile.lo", "tile.hi", "node", "n", "own", "embedding", "keys")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = cut_lineage(dealt.mapInArrow(_compared(cosine), "node long, links long, other long"))
    return _result(rows.select("vec_id", "node"), classes.select("node", "n", "low"), found)


def _result(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Links and components of the classes, given back to every row."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected(found, "node", "other").withColumnRenamed("node", "member")
    known = classes.join(links, "node", "left").join(groups, F.col("node") == F.col("member"), "left").select(
        "node", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "root").select("node", "n_links", "component_id")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
