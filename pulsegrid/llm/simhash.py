"""SimHash near-duplicates with bit-sliced comparison.

Documents get 64-bit fingerprints, equal ones are compared once. Fingerprints
within the radius agree on some of their bit blocks, so they meet under one
of the block combinations. Fingerprints that meet are stored as vertical bit
planes: word ``k`` of a lane holds bit ``k`` of up to 64 fingerprints. A
comparison adds the differing planes to bitwise counters with carry-save
adders, which updates 64 distances at once, and gives a lane up as soon as
all its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.llm.common import slices, utf8
from pulsegrid.llm.components import connected
from pulsegrid.session import cut_lineage

BITS = 64
#: Shingles hashed at a time, so that a very long text needs little memory.
HASH_ROWS = 1 << 16
#: Fingerprints of one block combination that are compared in one piece; more are compared piece by piece.
TILE_ROWS = 1024
#: Pairs of a fingerprint and a lane compared at a time.
ITEMS = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of a text's word shingles; 0 for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    total = len(tokens) - size + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, HASH_ROWS):
        part = tokens[at:at + HASH_ROWS + size - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(size))))
        hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > total, bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row, by whole texts; null and empty texts get 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(t, words) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_of(text: str = "text", words: int = 3) -> Column:
    """The fingerprint of a column, as 16 hexadecimal digits."""

    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, words)).astype("int64")

    return _digits(run(utf8(text)))


def _digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` bit blocks; two fingerprints within the radius agree on one of them."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _tile(own: Column, tiles: Column) -> Column:
    """The pairs of pieces in which a member of piece ``own`` is compared."""
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(F.least(own, k).alias("lo"), F.greatest(own, k).alias("hi")))


def _within(planes: np.ndarray, queries: np.ndarray, lanes: np.ndarray, wanted: np.ndarray, radius: int) -> Iterator[tuple]:
    """``(item, bits)`` of the wanted lane bits within the radius of an item's query fingerprint."""
    item = np.arange(len(queries))
    levels = radius.bit_length()
    start = (1 << levels) - 1 - radius  # counters begin here, so that passing the radius overflows
    counts = [np.full(len(item), (1 << BITS) - 1 if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros(len(item), np.uint64)
    one = np.uint64(1)
    for k in range(0, BITS, 2):
        x = planes[k][lanes] ^ (np.uint64(0) - (queries >> np.uint64(k) & one))
        y = planes[k + 1][lanes] ^ (np.uint64(0) - (queries >> np.uint64(k + 1) & one))
        if levels:
            low = counts[0]
            both = x ^ y
            counts[0] = low ^ both
            carry = (x & y) | (low & both)
            for level in range(1, levels):
                counts[level], carry = counts[level] ^ carry, counts[level] & carry
            over |= carry
        else:
            over |= x | y
        if k % 8 == 6:
            alive = (~over & wanted) != 0
            if not alive.any():
                return
            if alive.mean() < 0.5:
                item, queries, lanes, wanted, over = item[alive], queries[alive], lanes[alive], wanted[alive], over[alive]
                counts = [c[alive] for c in counts]
    near = ~over & wanted
    some = np.flatnonzero(near)
    yield item[some], near[some]


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining the groups of ``i`` and ``j``; a group's root is its first row."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def tile_links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of equal ``group`` (ascending) within the radius, at most one per fingerprint."""
    n = len(fps)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    within = np.arange(n) - np.repeat(first, sizes)
    per_group = -(-sizes // BITS)
    lane_of_group = np.cumsum(per_group) - per_group
    lane = np.repeat(lane_of_group, sizes) + within // BITS
    bit = (within % BITS).astype(np.uint64)
    begin = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
    filled = np.diff(np.r_[begin, n]).astype(np.uint64)
    one, full = np.uint64(1), ~np.uint64(0)
    valid = full >> (np.uint64(BITS) - filled)
    planes = np.stack([np.add.reduceat((fps >> np.uint64(k) & one) << bit, begin) for k in range(BITS)])
    last_lane = np.repeat(lane_of_group + per_group, sizes)
    items = last_lane - lane  # a fingerprint meets the later ones: the rest of its lane and the lanes after it
    root = np.arange(n)
    ends = np.cumsum(items)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, "right")))
        row = np.repeat(np.arange(at, stop), items[at:stop])
        step = np.arange(len(row)) - np.repeat(np.cumsum(items[at:stop]) - items[at:stop], items[at:stop])
        lanes = lane[row] + step
        later = np.where(bit == 63, np.uint64(0), full << np.minimum(bit + one, np.uint64(63)))
        wanted = valid[lanes] & np.where(step == 0, later[row], full)
        for item, near in _within(planes, fps[row], lanes, wanted, radius):
            which, at_bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            root = _merge(root, row[item[which]], begin[lanes[item[which]]] + at_bit)
        at = stop
    other = np.flatnonzero(root != np.arange(n))
    return fps[other], fps[root[other]]


def _compare(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # the last group so far, which the next batch may continue
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:-1]:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            cut = int(np.searchsorted(group, group[-1]))
            rest = [c[cut:] for c in cols]
            if cut:
                yield _links(group[:cut], cols[-1][:cut], radius)
        if rest is not None:
            yield _links(np.zeros(len(rest[0]), np.int64), rest[-1], radius)

    return run


def _links(group: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    a, b = tile_links(group, fps.view(np.uint64), radius)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, radius: int = 3, blocks: int = 6, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within the radius.

    Keys are counted with partial sums first. Fingerprints alone under a key go no further; those of a key with
    more than ``tile_rows`` are dealt to pieces, and every pair of pieces is compared on its own.
    """
    masks = [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
             for k, m in enumerate(block_masks(radius, blocks))]
    rows = distinct.select("fp", F.explode(F.array(*masks)).alias("key")).select("key.choice", "key.bits", "fp")
    met = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = met.select("choice", "bits", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = rows.join(met, ["choice", "bits"]).select("choice", "bits", "fp", F.explode(_tile(own, F.col("tiles"))).alias("tile"))
    keys = ["choice", "bits", "lo", "hi"]
    dealt = tiled.select("choice", "bits", "tile.lo", "tile.hi", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, blocks: int = 6, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, group)`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``component_id`` is the smallest ``doc_id`` reachable by links of at most ``radius`` differing bits. Null and empty
    texts have fingerprint zero, which links like any other. Rows that repeat an id stay; a row with a null id belongs
    to its group but never names it; ``group``, a fingerprint of the group, names it in any case. An empty table gives no rows.
    """
    known = cut_lineage(fingerprints(docs, words))
    distinct = known.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = connected(fingerprint_links(distinct.select("fp"), radius, blocks, tile_rows), "a", "b")
    member = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(lowest, "root").select("fp", "component_id", "root")
    return known.join(named, "fp").select(
        "doc_id", _digits(F.col("fp")).alias("fingerprint"), "component_id", _digits(F.col("root")).alias("group"))


def representatives(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """The row with the smallest ``doc_id`` of each group of ``near_duplicates``, with all columns of ``docs``.

    Where several rows of the group have this id, or none has any, the row with the smallest text and columns stays.
    """
    groups = cut_lineage(near_duplicates(docs, radius, words))
    ids = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.join(ids.where("n = 1 AND first").select("doc_id"), "doc_id", "left_semi").select(*columns)
    twice = ids.where("n > 1").select(F.col("doc_id").alias("__id"))
    repeated = groups.where("doc_id = component_id").join(twice, F.col("doc_id") == F.col("__id"), "left_semi")
    unclear = groups.where("component_id IS NULL").unionByName(repeated).select("doc_id", "fingerprint", "group").distinct()
    unclear = cut_lineage(unclear.toDF("__id", "__fp", "__group"))
    if unclear.isEmpty():
        return single
    rows = docs.where("doc_id IS NULL").unionByName(docs.join(twice, F.col("doc_id") == F.col("__id"), "left_semi")).withColumn("__of", fingerprint_of(words=words))
    met = rows.join(unclear, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__fp")))
    row = F.struct(F.col("text"), *[c for c, name in zip(columns, docs.columns) if name != "text"])
    best = met.select("__group", row.alias("__row")).groupBy("__group").agg(F.min("__row").alias("__row"))
    return single.unionByName(best.select("__row.*").select(*columns))
