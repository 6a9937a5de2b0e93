"""Restored spelling, and held-out accuracy on planted insults."""

import itertools
import random

import numpy as np
import pytest

from pulsegrid.llm import toxicity
from pulsegrid.llm.common import table, training_rows, held_out

CORPUS = ("the idiot and the stupid loser went to see a good clown with trash in the street " * 20).encode()


@pytest.fixture(scope="module")
def costs():
    n = toxicity.character_counts([CORPUS]).astype(float).reshape((28,) * 3)
    pairs = n.sum(axis=0) + 0.5
    pairs /= pairs.sum(axis=1, keepdims=True)
    return -np.log((n + 2 * pairs[None]) / (n.sum(axis=2, keepdims=True) + 2))


@pytest.mark.parametrize("text,word", [("an 1d1ot here", "idiot"), ("so stuuuuupid", "stupid"), ("l o s e r", "loser"), ("c.l.o.w.n !", "clown"),
                                       ("tr@$h", "trash"), ("id*ot", "idiot"), ("$tupid", "stupid"), ("T-R-A-S-H", "trash")])
def test_disguises_are_undone(costs, text, word):
    assert word in toxicity.Restorer(costs).words(text.encode())


def test_plain_text_is_left_alone(costs):
    plain = "good street, see 12 and 3.5 or a.b@mail: 2024-01-01 x"
    assert {"good", "street", "see", "and", "or"} <= toxicity.Restorer(costs).words(plain.encode())
    assert toxicity.Restorer(costs).words(b"") == set()


def test_viterbi_finds_the_cheapest_reading(costs):
    rng = random.Random(1)
    for _ in range(60):
        span = "".join(rng.choice("ab01$u!") for _ in range(rng.randint(1, 6)))
        runs = [(c, len(list(g))) for c, g in itertools.groupby(span)]
        best = min((sum(c for _, c in pick) + word_cost("".join(t for t, _ in pick), costs), "".join(t for t, _ in pick))
                   for pick in itertools.product(*[toxicity._readings(c, n) for c, n in runs]))
        got = toxicity.decode(span, costs.tolist())
        assert min(sum(c for _, c in pick) for pick in itertools.product(*[toxicity._readings(c, n) for c, n in runs])
                   if "".join(t for t, _ in pick) == got) + word_cost(got, costs) == pytest.approx(best[0])


def word_cost(word, costs):
    a = b = 0
    total = 0.0
    for c in word:
        k = toxicity._class(c)
        total += costs[a][b][k]
        a, b = (b, k) if k else (0, 0)
    return total + costs[a][b][0]


def test_character_counts_match_a_plain_count():
    text = "Ab é-ab".encode()
    got = toxicity.character_counts([text]).reshape((28,) * 3)
    assert got[0, 0, 1] == 2 and got[0, 1, 2] == 2 and got[1, 2, 0] == 2 and got[0, 0, 27] == 1 and got.sum() == 8


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = docs.where(held_out()).select("doc_id", toxicity.toxicity(model).alias("score")).join(labels, "doc_id").collect()
    hit = sum((r["score"] >= .5) == bool(r["toxic"]) for r in got)
    caught = [r["score"] >= .5 for r in got if r["toxic"]]
    # some toxic rows lost their insults to junk before they came here
    assert len(got) > 400 and hit / len(got) > .98 and np.mean(caught) > .85


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, words int"
    rows = [(1, None, "", 0), (None, "idiot", "", 0), (2, "", "", 0), (3, "idi0t " * 100_000, "", 0), (3, "idiot", "", 0), (4, "fine words", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, None), (4, None, 0), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = docs.select("doc_id", toxicity.toxicity(model).alias("score")).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert training_rows(labels, "toxic").count() <= 3
    nothing = toxicity.fit(docs.limit(0), labels.limit(0))
    assert docs.limit(0).select(toxicity.toxicity(nothing)).count() == 0
    assert nothing.score({"idiot"}) == 0.0
