"""The trie against a plain one built from lists, and the contraction on odd trees."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pulsegrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, d long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    member = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            member[tuple(ts[:d])].append(c)
    kids, out = Counter(q[:-1] for q in member if q), []
    for path, cs in member.items():
        below = [(q, m) for q, m in member.items() if q[:len(path)] == path]
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(path))
        out.append((min(cs), len(path), min(member[path[:-1]]) if path else None, len(cs), kids[path], sum(kids[q] == 0 for q, _ in below),
                    sum((len(m) - 1) * len(q[-1][1]) for q, m in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "", None, "ünï", "a long text " * 50])) for c in (0, 3, 17, 99, 100, 101, 155, 260, 7, 301) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "nobody's"), (5, None, "user", "x"), (5, 1, None, None), (5, 1, None, None), (5, None, "user", "x"), (60, 0, "user", "only")]
    rows += [(77, t % 8, "user", "in a long one") for t in range(20)] + [(177, t, "bot", "chain") for t in range(12)]
    return rng.sample(rows, len(rows))


@pytest.mark.parametrize("seed", [1])
def test_against_plain_trie(spark, seed):
    rows = rows_of(seed)
    table = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(table))
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_contraction_of_chains_stars_and_forests(spark):
    rng = random.Random(4)
    parent = {0: None, 1000: None} | {k: k - 1 for k in range(1, 30)} | {k: 1000 for k in range(1001, 1100)} | {k: rng.choice([0, 5, 29, k - 1]) for k in range(2000, 2100) if k > 2000}
    parent[2000] = 1050
    weight = {k: rng.randint(0, 9) for k in parent}
    want = dict(weight)
    for k in parent:
        up = parent[k]
        while up is not None:
            want[up] += weight[k]
            up = parent[up]
    tree = spark.createDataFrame([(str(k), None if p is None else str(p), weight[k], 1) for k, p in parent.items()], "node string, parent string, w long, one long")
    got = {int(r["node"]): r["w"] for r in prefix_trie.subtree_totals(tree, ["w", "one"]).collect()}
    assert got == want


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    ids = spark.createDataFrame([(4,), (9,), (10,)], "conv_id long")
    row = prefix_trie.prefix_trie(ids, spark.createDataFrame([], "conv_id long, d long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(4, 0, None, 3, 0, 1, 0, hashlib.sha256(b"4,9,10").hexdigest())]
