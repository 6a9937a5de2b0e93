"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows that fall between two neighbouring virtual nodes have the same way round
the ring, so the overflow is settled on the counts of these arcs, a table
whose size depends on the parameters alone. Rows then follow by their rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

#: Virtual nodes of a shard, and the parts in which an arc is ranked.
NODES, PARTS = 64, 8


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ascending order, and the shard of each; a shard's nodes do not depend on the others."""
    at = [(xxhash.xxh64_intdigest(f"shard {s} node {v}", 42) - (1 << 63), s) for s in range(shards) for v in range(nodes)]
    places, owner = zip(*sorted(at))
    return np.array(places, np.int64), np.array(owner)


def arc_of(places: np.ndarray, key: Column) -> Column:
    """Index of the first virtual node clockwise of a key's hash."""

    @pandas_udf("int")
    def search(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at.to_numpy(np.int64)) % len(places), dtype="int32")

    return search(F.xxhash64(key))


def capacities(rows: int, shards: int, load_factor: float) -> np.ndarray:
    """Most rows of each shard; at a factor of 1 they add up to all rows and differ by one at most."""
    even = np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)
    return np.maximum(even, int(np.ceil(load_factor * rows / shards))) if load_factor > 1 else even


def overflow(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(arc, first rank, rows, shard)``: what does not fit a full shard goes on clockwise to the next one with room.

    In each round every arc offers what it has left to one virtual node, its own first, so rows move only from full shards.
    """
    room, left, m = capacity.copy(), counts.copy(), len(owner)
    pieces = []
    for step in range(m):
        if not left.any():
            break
        for arc in np.flatnonzero(left):
            shard = owner[(arc + step) % m]
            take = min(left[arc], room[shard])
            if take:
                pieces.append((int(arc), int(counts[arc] - left[arc]), int(take), int(shard)))
                left[arc] -= take
                room[shard] -= take
    return pieces


def _plan(spark, counted: list, owner: np.ndarray, shards: int, load_factor: float) -> DataFrame:
    """Pieces by arc and part: ranks from ``first`` to below ``until`` go to ``shard`` from slot ``slot`` on."""
    arcs, parts = len(owner), PARTS
    table = np.zeros((arcs, parts), np.int64)
    for row in counted:
        table[row["arc"], row["part"]] = row["n"]
    starts = np.cumsum(table, axis=1) - table
    counts = table.sum(axis=1)
    used = np.zeros(shards, np.int64)
    out = []
    for arc, first, rows, shard in overflow(counts, owner, capacities(int(counts.sum()), shards, load_factor)):
        for part in range(parts):
            a = max(first, int(starts[arc, part]))
            b = min(first + rows, int(starts[arc, part] + table[arc, part]))
            if a < b:
                base = int(starts[arc, part])
                out.append((arc, part, a - base, b - base, shard, int(used[shard])))
                used[shard] += b - a
    return spark.createDataFrame(out, "arc int, part int, first long, until long, shard int, slot long")


def _placed(docs: DataFrame, columns: list[str], shards: int, load_factor: float, nodes: int) -> DataFrame:
    """``columns`` of ``docs`` with ``shard``, ``slot`` and the struct ``__ring`` by which the rows were ranked."""
    places, owner = ring(shards, nodes)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        arc_of(places, key).alias("arc"), F.pmod(F.xxhash64(key, crc), F.lit(PARTS)).cast("int").alias("part"),
        F.xxhash64(key).alias("at"), crc.alias("crc"), F.octet_length(text).alias("bytes"), key.alias("key")).alias("__ring"))
    counted = keyed.select("__ring.arc", "__ring.part").groupBy("arc", "part").agg(F.count("*").alias("n")).collect()
    order = Window.partitionBy("__ring.arc", "__ring.part").orderBy("__ring.at", "__ring.crc", "__ring.bytes", "__ring.key")
    ranked = keyed.withColumn("__rank", F.row_number().over(order) - 1)
    plan = F.broadcast(_plan(docs.sparkSession, counted, owner, shards, load_factor))
    here = (F.col("__ring.arc") == plan["arc"]) & (F.col("__ring.part") == plan["part"])
    here = here & (F.col("__rank") >= plan["first"]) & (F.col("__rank") < plan["until"])
    return ranked.join(plan, here).select(
        *[ranked[f"`{c}`"] for c in columns], plan["shard"], (plan["slot"] + F.col("__rank") - plan["first"]).alias("slot"), "__ring")


def ring_shards(docs: DataFrame, shards: int = 24, load_factor: float = 1.0, nodes: int = NODES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    A shard holds ``load_factor`` times the mean number of rows at most; at 1 the counts differ by one at most. A row's
    key is its ``doc_id``, a null id counts as empty text; rows that repeat an id stand next to each other on the ring.
    Columns named ``shard`` or ``slot`` are replaced. An empty table gives no rows. Only counts of the ``shards * nodes``
    arcs in 8 parts each reach the driver, and the pieces that come back are about as many, a few more for each overflow.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    return _placed(docs, columns, shards, load_factor, nodes).drop("__ring")


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each of ``docs`` with its size, checksum and place; rows are dealt by equal counts."""
    return _placed(docs, ["doc_id"], shards, 1.0, NODES).select(
        "doc_id", (F.col("__ring.bytes") + 8).cast("long").alias("size"), F.col("__ring.crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
