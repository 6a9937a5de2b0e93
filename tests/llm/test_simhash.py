"""SimHash groups against a brute-force comparison."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=3):
    fps = {}
    for i, t in rows:
        fps.setdefault(plain_fingerprint(t), []).append(i)
    keys, root = list(fps), {}
    for k in keys:
        root[k] = k

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for k in keys:
        ids.setdefault(find(k), []).extend(x for x in fps[k] if x is not None)
    return sorted(((i, f"{k:016x}", min(ids[find(k)], default=None)) for k in keys for i in fps[k]), key=str)


@pytest.mark.parametrize("tile_rows", [2, 1024])
def test_groups_match_brute_force(spark, tile_rows):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)) for _ in range(12)]
    rows = [(i, base[i % 12] if i < 40 else " ".join(w if rng.random() > .004 else "Zz" for w in base[i % 4].split())) for i in range(160)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (7, base[0]), (7, base[0]), (None, base[1]), (None, "only"), (503, "ÄÖ ü X y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(-1))
    found = simhash.near_duplicates(docs, tile_rows=tile_rows).collect()
    got = [tuple(r)[:3] for r in found]
    assert len({(r['component_id'], r['group']) for r in found}) == len({r['group'] for r in found})
    assert {r['fp'] for r in docs.select(simhash.fingerprint_of().alias('fp')).collect()} == {r['fingerprint'] for r in found}
    assert sorted(got, key=str) == plain_groups(rows)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_tiles_find_every_near_pair(radius):
    import numpy as np
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.array([int(centre[k % 5]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for k in range(700)], np.uint64)
    group = np.sort(rng.integers(0, 4, 700))
    a, b = simhash.tile_links(group, fps, radius)
    root = {(g, int(f)): (g, int(f)) for g, f in zip(group, fps)}
    linked = {(int(x), int(y)) for x, y in zip(a, b)}

    def parts(pairs):
        up = {k: k for k in range(700)}

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for i, j in pairs:
            up[find(i)] = find(j)
        return {frozenset(k for k in range(700) if find(k) == r) for r in {find(k) for k in range(700)}}

    near = [(i, j) for i in range(700) for j in range(i) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius]
    told = [(i, j) for i in range(700) for j in range(700) if group[i] == group[j] and (int(fps[i]), int(fps[j])) in linked]
    same = [(i, j) for i in range(700) for j in range(i) if group[i] == group[j] and fps[i] == fps[j]]
    assert parts(near) == parts(told + same)
    assert root


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    text = " ".join(str(k) for k in range(70_000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)
