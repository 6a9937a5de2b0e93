"""The ring against a row-by-row walk, and its balance."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from pulsegrid.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string, arc int"


def rows():
    return [(i, f"text {i % 50}", "x", "y", i) for i in range(500)] + [(None, None, None, None, None)] * 3 + [(7, "again", "", "", 0)] * 200 + [
        (900, "", "", "", 0), (901, "é" * 30_000, "", "", 0)]


def test_counts_slots_and_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sharding.shard_digest(docs).collect()
    assert len(got) == len(rows()) and {r["law"] for r in got} == {"rows"}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, __import__("zlib").crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_digest(docs.repartition(3)).collect()))
    whole = sharding.ring_shards(docs)
    assert whole.columns == ["doc_id", "text", "arc", "shard", "slot"] and whole.count() == len(rows())


@pytest.mark.parametrize("factor", [1.0, 1.1, 5.0])
def test_rows_go_on_clockwise_only_past_full_shards(spark, factor):
    data = [(i, str(i), "", "", 0) for i in range(400)]
    got = sharding.ring_shards(spark.createDataFrame(data, SCHEMA), 6, factor, 8).collect()
    places, owner = sharding.ring(6, 8)
    cap = sharding.capacities(400, 6, factor)
    load = Counter(r["shard"] for r in got)
    assert all(load[s] <= cap[s] for s in range(6))
    for r in got:
        at = int(np.searchsorted(places, xxhash.xxh64(str(r["doc_id"]), 42).intdigest() - (1 << 64) * (xxhash.xxh64(str(r["doc_id"]), 42).intdigest() >> 63))) % 48
        for step in range(48):
            if owner[(at + step) % 48] == r["shard"]:
                break
            assert load[owner[(at + step) % 48]] == cap[owner[(at + step) % 48]]  # it passed full shards only


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.createDataFrame([(i, str(i), "", "", 0) for i in range(2000)], SCHEMA)
    old, new = ({r["doc_id"]: r["shard"] for r in sharding.ring_shards(docs, k, 1.25).collect()} for k in (10, 11))
    assert sum(old[i] != new[i] for i in old) < 2000 * 0.4


def test_empty_table(spark):
    assert sharding.shard_digest(spark.createDataFrame([], SCHEMA)).count() == 0
