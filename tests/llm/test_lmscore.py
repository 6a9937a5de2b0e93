"""Backoff scores against plain counting."""

import math
import random
from collections import Counter

import pytest

from pulsegrid.llm import lmscore

SCHEMA = "doc_id long, text string, chunk string, n_words string"


def plain(rows):
    texts = [(t or "").encode().lower().split() for _, t, *_ in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    n, out = sum(one.values()), []
    for (i, *_), t in zip(rows, texts):
        total, short = 0.0, 0
        for k, w in enumerate(t):
            c = two[t[k - 1], w] if k else 0
            total += math.log(c / one[t[k - 1]]) if c >= 2 else math.log((.4 if k else 1) * one[w] / n)
            short += bool(k) and c < 2
        out.append((i, len(t), short, round(total, 6), round(total / len(t), 6) if t else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets,rows_at_once", [(3, 7), (256, 512)])
def test_scores_match_plain_counting(spark, monkeypatch, buckets, rows_at_once):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "THE", "the"] * 10
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), "", "") for i in range(200)]
    rows += [(900, None, "", ""), (901, "", "", ""), (None, "w1 w2", "", ""), (5, "w1  w2\tw3\n", "", ""), (5, "w1 w2 w3", "", ""), (902, "a b " * 5000, "", ""), (903, "lonely", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lmscore.stupid_backoff(docs, buckets=buckets).collect()
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), None if r[4] is None else round(r[4], 6)) for r in got), key=str) == plain(rows)


def test_empty_table(spark):
    assert lmscore.stupid_backoff(spark.createDataFrame([], SCHEMA)).count() == 0
