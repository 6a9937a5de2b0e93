"""The discriminant against a plain computation, and held-out accuracy."""

import numpy as np

from pulsegrid.llm import quality
from pulsegrid.llm.common import held_out, table


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = quality.quality(docs, labels).where(held_out()).join(labels, "doc_id").collect()
    good = [r["score"] >= .3 for r in got if r["quality"] == 1]
    bad = [r["score"] < .3 for r in got if r["quality"] == 0]
    assert np.mean(good) > .97 and np.mean(bad) > .9


def test_scores_match_a_plain_density(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (300, 15)), rng.normal(1, 2, (200, 15))]
    y = [0] * 300 + [1] * 200
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(stats, labels, shrink=0.0, ridge=0.0)
    kept = [r["doc_id"] for r in stats.where(~held_out()).select("doc_id").collect()]
    own = {k: x[[i for i in kept if y[i] == k]] for k in (0, 1)}
    prior = (len(own[1]) + .5) / (len(kept) + 1)
    want = []
    for r in x:
        d = [np.log(p) - .5 * np.linalg.slogdet(np.cov(o.T, bias=True))[1]
             - .5 * (r - o.mean(0)) @ np.linalg.inv(np.cov(o.T, bias=True)) @ (r - o.mean(0)) for o, p in ((own[0], 1 - prior), (own[1], prior))]
        want.append(1 / (1 + np.exp(d[0] - d[1])))
    assert np.allclose(model.scores(x), want, atol=1e-6)


def test_odd_rows(spark):
    schema = "doc_id long, text string, x int, score string, label int"
    rows = [(1, None, 0, "", 0), (None, "a b", 0, "", 0), (2, "", 0, "", 0), (3, "w " * 300_000, 0, "", 0), (3, "again", 0, "", 0), (4, "fine words.", 0, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, None) for i in (1, 2, 3, 4, None) if i] + [(3, None, 1), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
