"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Totals of all subtrees come from
rounds of joins: leaves are raked into their parents, links of unary chains are
compressed, until only roots are left; the rounds are then undone in reverse,
which gives each contracted node its total. The number of rounds grows with the
logarithm of the number of nodes, not with the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.session import cut_lineage, cut_to_files

#: Conversations of one hundred share a base; up to five of its first turns are put in front.
BASE, FORKS = 100, 6
ROOT = "root"
_WORDS = [f"{c}{k}" for c in "xy" for k in (0, 1)]


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows by ranges of ``order`` with their range as ``part``: a conversation of very many turns fills several."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()))


def _running(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``sum_<value>`` over the key's rows up to each one: inside its range, and over the ranges before."""
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(key, "part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = ranges.select(key, "part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values])
    inside = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.select("*", *[F.sum(v).over(inside).alias(f"inside_{v}") for v in values])
    return here.join(offsets, [key, "part"]).select(*rows.columns, *[(F.col(f"inside_{v}") + F.col(f"before_{v}")).alias(f"sum_{v}") for v in values])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, role, text)``: turns numbered from 0 by turn (null first), role and text; null role or text is empty."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(1).alias("one"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["turn", "role", "text", "copy"]  # rows that repeat may fill several ranges, too
    ranged = _ranged(rows.withColumn("copy", F.monotonically_increasing_id()), "conv_id", *order)
    return _running(ranged, "conv_id", order, ["one"]).select("conv_id", (F.col("sum_one") - 1).alias("i"), "role", "text")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forked conversations: ``(conv_id)`` of all, and their turns ``(conv_id, d, role, text)`` with d from 1.

    Conversation c starts with the first h turns of c - c % 100, where h = crc32(decimal c) % 6, and goes on with its own turns
    after its first h. Rows without ``conv_id`` belong to no conversation; rows that repeat stay turns of their own.
    """
    own = cut_lineage(ordered_turns(conversations))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FORKS).alias("h")
    ids = own.select("conv_id").distinct().select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    first = own.where(F.col("i") < FORKS - 1).select(F.col("conv_id").alias("base"), "i", "role", "text")
    shared = ids.join(first, "base").where("i < h").select("conv_id", (F.col("i") + 1).alias("d"), "role", "text")
    starts = first.groupBy("base").agg(F.count("*").alias("n"))
    fork = ids.join(starts, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("n"))
    rest = own.join(fork, "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("n") + 1).alias("d"), "role", "text")
    return ids.select("conv_id"), shared.unionByName(rest)


def _name(depth: Column, sums: list[Column]) -> Column:
    """The name of a sequence of turns, from 128 hashed bits."""
    cols = [depth, *sums]
    return F.concat_ws("-", F.hex(F.xxhash64(*cols)), F.hex(F.xxhash64(*cols[::-1], F.lit(1))))


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, node, parent, size)``: for each turn the names of the turns up to it and before it, and its code points.

    A turn adds the hashed bits of its place, role and text to those of its sequence, so running sums name all prefixes.
    """
    hashed = turns.select("conv_id", "d", F.length("text").cast("long").alias("size"),
                          F.xxhash64("d", "role", "text").alias("x"), F.xxhash64("text", "role", "d", F.lit(1)).alias("y"))
    words = [F.shiftrightunsigned(c, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"{c}{k}") for c in "xy" for k in (0, 1)]
    summed = _running(_ranged(hashed.select("conv_id", "d", "size", *words), "conv_id", "d"), "conv_id", ["d"], _WORDS)
    node = _name(F.col("d"), [F.col(f"sum_{w}") for w in _WORDS])
    parent = _name(F.col("d") - 1, [F.col(f"sum_{w}") - F.col(w) for w in _WORDS])
    return summed.select("conv_id", F.col("d").alias("depth"), node.alias("node"), F.when(F.col("d") == 1, ROOT).otherwise(parent).alias("parent"), "size")


def _coin(side: int, step: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == side


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``(node, *values)`` summed over each node's subtree, itself included. ``tree`` has ``node``, ``parent`` (null: a root) and values.

    Each round rakes all leaves into their parents and then compresses the links of unary chains whose ends drew different
    coins. A chain's upper node keeps what it held (``held_``): its total less that is the compressed node's.
    """
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("kids"))
    live = cut_to_files(tree.join(kids, F.col("node") == F.col("of"), "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values))
    raked, rounds = [], []
    while not live.where("parent IS NOT NULL").isEmpty():
        leaves = live.where("kids = 0 AND parent IS NOT NULL")
        raked.append(leaves.select("node", *values))
        fallen = leaves.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"add_{v}") for v in values])
        left = live.where("kids > 0 OR parent IS NULL").join(fallen, F.col("node") == F.col("of"), "left")
        left = cut_to_files(left.select("node", "parent", (F.col("kids") - F.coalesce("n", F.lit(0))).alias("kids"),
                                       *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]))
        upper = left.where((F.col("kids") == 1) & _coin(1, len(rounds))).select(F.col("node").alias("up"), *[F.col(v).alias(f"held_{v}") for v in values])
        lower = left.where((F.col("kids") > 0) & _coin(0, len(rounds)) & F.col("parent").isNotNull())
        pairs = cut_to_files(lower.join(upper, F.col("parent") == F.col("up")).select(
            F.col("node").alias("down"), "up", F.col("kids").alias("down_kids"), *[f"held_{v}" for v in values], *[F.col(v).alias(f"add_{v}") for v in values]))
        rounds.append(pairs)
        stay = left.join(pairs.select(F.col("down").alias("node")), "node", "left_anti")
        stay = stay.join(pairs.select("up", "down_kids", *[f"add_{v}" for v in values]), F.col("node") == F.col("up"), "left").drop("up")
        stay = stay.join(pairs.select("up", "down"), F.col("parent") == F.col("down"), "left")
        live = cut_to_files(stay.select("node", F.coalesce("up", "parent").alias("parent"), F.coalesce("down_kids", "kids").alias("kids"),
                                       *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]))
    totals = live.select("node", *values)
    for leaves in raked:
        totals = totals.unionByName(leaves)
    for pairs in reversed(rounds):
        if not pairs.isEmpty():
            above = totals.join(pairs, F.col("node") == F.col("up")).select(F.col("down").alias("node"), *[(F.col(v) - F.col(f"held_{v}")).alias(v) for v in values])
            totals = totals.unionByName(cut_to_files(above))
    return totals


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id are read once; no list of a node's ids is held."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for name, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256(b"%d" % i)
            else:
                digest.update(b",%d" % i)
        yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in done], pa.string()), "ends_sha256": pa.array([d for _, d in done], pa.string())})
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the comma-joined ascending decimal ids ``conv_id`` of each ``node``."""
    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_digests, "node string, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the conversations ``(conv_id)`` with turns ``(conv_id, d, role, text)``, d from 1 without gaps.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree: code points of a node's last text, times its members but one) and ``ends_sha256``.
    The hash of ids ends at the node is sequential by its definition: one task streams a node's ids in order and holds none.
    Conversations without turns are members of the root only. Very long texts are hashed whole; extra columns are ignored;
    a table without conversations has no nodes.
    """
    steps = cut_lineage(prefixes(turns))
    nodes = steps.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
                                      F.count("*").alias("n_convs"), F.max("size").alias("size"))
    root = ids.agg(F.lit(ROOT).alias("node"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"),
                   F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("size")).where("n_convs > 0")
    nodes = nodes.unionByName(root)
    kids = nodes.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(kids, F.col("node") == F.col("of"), "left").select(
        "node", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    totals = subtree_totals(nodes.select("node", "parent", leaf, F.col("saved").alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("last.node", F.lit(ROOT)).alias("node"), "conv_id")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.drop("saved").join(totals, "node").join(above, "parent", "left").join(ends_digest(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


#: The same rows from whole prefixes as text: a node is a list of turns, its subtree the nodes that some member passes.
ORACLE = """
WITH RECURSIVE polynomial(i, k, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM polynomial WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM polynomial WHERE k = 8),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 100 AS base FROM own),
digits(c, pos, crc) AS (
    SELECT c, 0, 4294967295::BIGINT FROM ids
    UNION ALL SELECT c, pos + 1, xor(crc // 256, t[xor(crc % 256, ascii(substr(c::VARCHAR, pos + 1, 1))) + 1]) FROM digits, crc_table WHERE pos < length(c::VARCHAR)),
forks AS (SELECT c, base, xor(crc, 4294967295) % 6 AS h FROM digits JOIN ids USING (c) WHERE pos = length(c::VARCHAR)),
counted AS (SELECT f.*, least(h, (SELECT count(*) FROM own o WHERE o.c = f.base)) AS n FROM forks f),
turns AS (
    SELECT f.c, o.i + 1 AS d, o.role, o.text FROM counted f JOIN own o ON o.c = f.base WHERE o.i < f.h
    UNION ALL SELECT f.c, o.i - f.h + f.n + 1, o.role, o.text FROM counted f JOIN own o ON o.c = f.c WHERE o.i >= f.h),
steps AS (SELECT c, d, length(text) AS size, list([role, text]) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM turns),
passed AS (SELECT c, d, size, path FROM steps UNION ALL SELECT c, 0, 0, [] FROM ids),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size FROM passed GROUP BY path, d),
named AS (SELECT p.c, p.d, n.conv_id, n.n_convs, n.size FROM passed p JOIN nodes n USING (path, d)),
kids AS (SELECT n.conv_id, n.d, count(DISTINCT k.conv_id) AS n_children FROM named n LEFT JOIN named k ON k.c = n.c AND k.d = n.d + 1 GROUP BY ALL),
below AS (SELECT DISTINCT a.conv_id, a.d, b.conv_id AS sub, b.d AS sub_d, b.n_convs, b.size FROM named a JOIN named b ON b.c = a.c AND b.d >= a.d),
sums AS (SELECT b.conv_id, b.d, count_if(k.n_children = 0)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
    FROM below b JOIN kids k ON k.conv_id = b.sub AND k.d = b.sub_d GROUP BY ALL),
lasts AS (SELECT n.conv_id, n.d, string_agg(n.c::VARCHAR, ',' ORDER BY n.c) AS ends
    FROM named n JOIN (SELECT c, max(d) AS d FROM passed GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
    sha256(coalesce(l.ends, '')) AS ends_sha256
FROM nodes n JOIN kids k USING (conv_id, d) JOIN sums s USING (conv_id, d) LEFT JOIN lasts l USING (conv_id, d)
LEFT JOIN (SELECT DISTINCT c, d, conv_id FROM named) p ON p.c = n.conv_id AND p.d = n.d - 1
"""
