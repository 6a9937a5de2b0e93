"""Removed bytes against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from pulsegrid.llm import suffix_dedup

SCHEMA = "doc_id long, text string, key string, found string, at long"


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, length):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefghé ß\n") for _ in range(n))

    shared = [noise(n) for n in (length - 9, length, length + 1, length + 57, 3 * length)]
    rows = [(i, noise(rng.randint(0, 700)) + rng.choice(shared) + noise(rng.randint(0, 300)) + rng.choice(["", rng.choice(shared)])) for i in range(50)]
    exact = ["%04d" % k * 0 + noise(300).encode().decode() for k in range(4)]
    core = "".join(rng.choice("xyz") for _ in range(length))
    rows += [(60 + k, e + core[k % 2:length - k // 2] + noise(50)) for k, e in enumerate(exact)]
    copy = noise(1500)
    rows += [(70 + k, copy) for k in range(6)] + [(80, copy[:700] + "#" + copy[701:]), (81, "ab" * 900), (82, "z" * 1200), (83, "z" * (length + 1)), (84, "z" * (length - 1))]
    rows += [(None, None), (90, ""), (91, " "), (None, shared[3]), (7, noise(900)), (7, noise(900)), (92, "same " * 30), (92, "same " * 30)]
    return rows


@pytest.mark.parametrize("length,prime,chunk", [(400, 11, 1 << 22), (400, 11, 4000), (40, 3, 1500)])
def test_against_all_strings(spark, monkeypatch, length, prime, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    rows = rows_of(length + chunk, length)
    docs = spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA).repartition(3)
    spans = suffix_dedup.repeated_spans(docs, length, prime)
    got = suffix_dedup.digest(spans)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, length)


def test_kept_bytes_and_empty_table(spark):
    rows = [(1, "a" * 10 + "b" * 500 + "c"), (2, "d" * 5), (3, None)]
    docs = spark.createDataFrame([(*r, "", "", 1) for r in rows], SCHEMA)
    spans = suffix_dedup.repeated_spans(docs)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.without_spans(docs, spans).collect()} == {1: b"a" * 10 + b"c", 2: b"ddddd", 3: b""}
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("prime", [2, 3, 7, 11, 13])
def test_cover_has_each_difference_once(prime):
    period, places = suffix_dedup.difference_cover(prime)
    assert sorted((x - y) % period for x in places for y in places if x != y) == list(range(1, period))


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    import numpy as np
    data = np.random.default_rng(1).integers(0, 3, 5000, np.uint8)
    at = np.arange(0, 4700, 3)
    want = suffix_dedup.hashes(data, at, np.full(len(at), 300))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert (suffix_dedup.hashes(data, at, np.full(len(at), 300)) == want).all()
