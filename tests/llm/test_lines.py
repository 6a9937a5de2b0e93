"""Fuzzy line groups against a comparison of all pairs."""

import os
import random
import re
from collections import Counter
from urllib.parse import urlparse

import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF
from pyspark.sql import functions as F

from pulsegrid.llm import lines, queries

SCHEMA = "doc_id long, text string, line string, k int, dropped string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(spark, rows, radius, similarity=.8):
    seen = []
    for i, t, *_ in rows:
        for n, line in enumerate((t or "").split("\n")):
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if len(norm.split()) >= 5:
                seen.append((i, n, norm))
    texts = sorted({x for *_, x in seen})
    key = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64(F.split("t", " ")).alias("k")).collect()}
    known = {r["k"]: r["fp"] % (1 << 64) for r in lines.occurrences(spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string")).collect()}
    fp = {t: known[key[t]] for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for n, a in enumerate(texts):
        for b in texts[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= radius and 1 - edits(a, b) / max(len(a), len(b)) >= similarity:
                root[find(a)] = find(b)
    first = {}
    for i, n, t in sorted(seen, key=lambda s: (s[0] is None, s[0] or 0, s[1])):
        first.setdefault(find(t), (i, n))
    out = {i: [0, set()] for i, *_ in rows}
    for i, n, t in seen:
        out[i][0] += 1
        if first[find(t)] != (i, n):
            out[i][1].add(n)
    return {i: (n, sorted(d)) for i, (n, d) in out.items()}, len(texts), len({find(t) for t in texts})


@pytest.mark.parametrize("radius,blocks", [(3, 5), (12, 13)])
def test_dropped_lines_match_all_pairs(spark, radius, blocks):
    rng = random.Random(6)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(4, 30))) for _ in range(25)]

    def line():
        words = rng.choice(base[:10] if rng.random() < .7 else base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["abc", "Zed", words[0]])
        return rng.choice([" ", "  ", ", "]).join(words).capitalize() + rng.choice(["", ".", " !"])

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6))), "x", 0, "") for i in range(60)]
    rows += [(100, None, "", 0, ""), (101, "", "", 0, ""), (102, "\n\n", "", 0, ""), (103, "--- !!!", "", 0, ""), (104, "long words here again and " * 3000, "", 0, ""),
             (None, rows[3][1] + "\n" + base[0], "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want, texts, groups = brute(spark, rows, radius)
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in lines.dropped_lines(docs, radius=radius, blocks=blocks).collect()}
    assert got == want and groups < texts


def test_texts_keep_their_other_lines(spark):
    rows = [(1, "one two three four five\nshort\nsix seven eight nine ten", "", 0, ""), (2, "x\nOne two, three four five!\nshort", "", 0, ""), (3, None, "", 0, "")] + [(4, "", "", 0, "")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.without_dropped(docs, lines.dropped_lines(docs))
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == [(1, rows[0][1]), (2, "x\nshort"), (3, None), (4, ""), (4, "")]


def test_empty_table(spark):
    assert lines.dropped_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_follow_the_angle(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(40)]
    rows = [(0, " ".join(base)), (1, " ".join(base[1:] + ["new"])), (2, " ".join(rng.choice(words) for _ in range(40)))]
    fp = {r["doc_id"]: r["fp"] for r in lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near, far = ((fp[0] ^ fp[k]) % (1 << 64) for k in (1, 2))
    assert near.bit_count() <= 10 and 20 <= far.bit_count() <= 44


def test_query_compares_lines_of_few_words(spark, tmp_path):
    rows = [(1, "Menu\n\none two three four five\nonelonglinewithoutspaces"), (2, "menu.\nONE, two three four five\nsee also"), (3, "See also!\n---\nonelonglinewithoutspaces\nother")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in queries.op2_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (3, []), 2: (3, [0, 1]), 3: (3, [0, 2])}


def test_table_of_lines_takes_little_disk(spark, monkeypatch):
    rng = random.Random(9)
    kept, cut = [], lines.cut_to_files
    monkeypatch.setattr(lines, "cut_to_files", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(9)) for _ in range(20))) for i in range(400)]
    lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    size = sum(os.path.getsize(urlparse(f).path) for f in kept[0].inputFiles())
    assert kept[0].count() == 8000 and size < 32 * 8000  # a row of five numbers takes more than 48 bytes in memory


def test_fingerprints_are_the_sides_of_random_directions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1"]) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=lines.FEATURES).transform(docs.select("doc_id", F.split("text", " ").alias("words")))
    lsh = BucketedRandomProjectionLSH(inputCol="tf", outputCol="sides", bucketLength=1e9, numHashTables=lines.BITS, seed=lines.SEED)
    want = {r["doc_id"]: sum(1 << i for i, s in enumerate(r["sides"]) if s[0] < 0) for r in lsh.fit(tf).transform(tf).collect()}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in lines.occurrences(docs, 1).collect()} == want
    assert {fp >> 63 for fp in want.values()} == {0, 1}


def test_lines_that_meet_alone_are_not_stored(spark, monkeypatch):
    rng = random.Random(9)
    kept, cut = [], lines.cut_to_files
    monkeypatch.setattr(lines, "cut_to_files", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [(i, "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) for _ in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines.dropped_lines(docs, blocks=4).count()
    fps = [r["fp"] % (1 << 64) for r in lines.occurrences(docs).collect()]
    met = [n for m in lines.block_masks(3, 4) for n in Counter(fp & m for fp in fps).values()]
    stored = [df.count() for df in kept if "bits" in df.columns]
    assert sum(n == 2 for n in met) > 50 and max(stored) <= sum(n for n in met if n > 2)


def test_common_words_change_no_edit_distance(spark):
    rng = random.Random(5)
    texts = sorted({" ".join(rng.choice(["a", "ab", "b", "bab"]) for _ in range(rng.randint(1, 7))) for _ in range(60)})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    distinct = lines.distinct_lines(lines.occurrences(docs, 1))
    key = {texts[r["id"]]: r["k"] for r in distinct.collect()}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    found = lines._similar(docs, distinct, spark.createDataFrame([(key[a], key[b]) for a, b in pairs], "a long, b long"), 0.6)
    want = {(key[a], key[b]) for a, b in pairs if 1 - edits(a, b) / max(len(a), len(b)) >= 0.6 - 1e-9}
    assert {tuple(r) for r in found.collect()} == want and 0 < len(want) < len(pairs)
