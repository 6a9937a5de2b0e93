"""Found items against word-for-word containment, paraphrases, and the sketch against a full decomposition."""

import random

import numpy as np
import pytest

from pulsegrid.llm import decontaminate as d
from pulsegrid.llm.common import table

SCHEMA = "doc_id long, text string, item_id string, words int"


def contained(docs, items):
    out = set()
    for i, t in docs:
        joined = b" " + b" ".join(d.words_of((t or "").encode())) + b" "
        out |= {(i, k) for k, x in items if x and b" " + b" ".join(d.words_of(x.encode())) + b" " in joined}
    return out


def test_finds_every_contained_item_and_little_else(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in d.contamination(docs, bench).collect()}
    want = contained([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert want and want <= got and len(got - want) <= 1


def test_paraphrases_copies_and_odd_rows(spark):
    rng = random.Random(4)
    pool = [f"word{k}" for k in range(3000)]
    item = [" ".join(rng.choice(pool) for _ in range(30)) + f". The answer is number {k} of all." for k in range(6)]
    items = [(k, t, "", 0) for k, t in enumerate(item)] + [(10, item[0], "", 0), (11, None, "", 0), (12, "", "", 0), (None, "no id here", "", 0)]
    noise = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    near = item[1].split()
    near[5], near[12], near[20] = "other", "changed", "words"
    rows = [(1, noise(300) + " " + item[0].upper() + " " + noise(50), "", 0), (2, noise(100) + " " + " ".join(near), "", 0), (3, noise(400), "", 0),
            (4, None, "", 0), (5, "", "", 0), (None, item[2], "", 0), (6, item[3], "", 0), (6, noise(90_000) + " " + item[4], "", 0), (7, " ".join(reversed(item[5].split())), "", 0)]
    got = d.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string, common int")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (None, 2), (6, 3), (6, 4)}
    finder = next(d.finders(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string, common int")))
    flags = spark.createDataFrame(rows, SCHEMA).where(d.is_contaminated(finder)).collect()
    assert len(flags) == 5


@pytest.mark.parametrize("words,share", [(16, .1), (16, .33), (36, .33)])
def test_items_that_many_documents_hold(spark, words, share):
    rng = random.Random(words)
    common, rare = [f"c{k}" for k in range(200)], [f"r{k}" for k in range(4000)]
    text = lambda n: [rng.choice(common if rng.random() < .5 else rare) for _ in range(n)]
    items = [(k, " ".join(text(words if k == 0 else 40))) for k in range(60)]
    rows, holding = [], set()
    for i in range(400):
        own = text(rng.randint(60, 300))
        if rng.random() < share:
            at = rng.randint(0, len(own))
            own[at:at] = items[0][1].split()
            holding.add(i)
        rows.append((i, " ".join(own)))
    got = d.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 0 and r["common"] == 1} == holding


def test_no_items_or_documents(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    assert d.contamination(docs, none).count() == 0
    assert d.contamination(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_common_words_match_dynamic_programming(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)] for n in (rng.randint(1, 70), rng.randint(0, 150)))
    masks = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if False else _next(row, x, b)
    assert d.common_words(a, b, masks) == row[-1]


def _next(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[k]))
    return out


def test_sketch_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"t{g}w{rng.integers(4)}" for _ in range(60)) for g in range(3) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = next(d.blocks(spark.createDataFrame([(0, " ".join(f"t{g}w{k}" for g in range(3) for k in range(4)))], "item_id long, text string")))
    weights, basis = d.latent_basis(docs, bench, rank=4, oversample=8)
    a = []
    for t in texts:
        codes = [bench.vocabulary[w] for w in d.words_of(t.encode())]
        for s in range(0, len(codes), d.PASSAGE):
            row = np.zeros(12)
            np.add.at(row, codes[s:s + d.PASSAGE], weights[codes[s:s + d.PASSAGE]])
            a.append(row)
    own = np.zeros(12)
    np.add.at(own, bench.passages()[1][0], weights[bench.passages()[1][0]])
    passages = sum(60 // d.PASSAGE + 1 for _ in texts)
    gram = np.array(a).T @ np.array(a) + passages * np.outer(own, own)
    top = np.linalg.eigh(gram)[1][:, -3:]
    assert np.linalg.norm(basis @ (basis.T @ top) - top) < 1e-3
