"""The stages on a small table against what their operators say, and the whole run."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, mixing, simhash, toxicity
from pulsegrid.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = table(spark, SMALL, "documents")
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    mild = stage["toxicity"](spark, docs, SMALL).checkpoint()
    restorer = toxicity.Restorer(model.costs)
    want = {r["doc_id"] for r in docs.collect() if model.score(restorer.words(r["text"].encode())) < .5}
    assert {r["doc_id"] for r in mild.collect()} == want and mild.columns == columns

    one = stage["near_dedup"](spark, mild, SMALL).checkpoint()
    assert {r["doc_id"] for r in one.collect()} == {r["component_id"] for r in simhash.near_duplicates(mild).collect()} and one.columns == columns
    assert one.count() == one.select("doc_id").distinct().count()

    clean = stage["decontamination"](spark, one, SMALL).checkpoint()
    dirty = {r["doc_id"] for r in decontaminate.contamination(one, table(spark, SMALL, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - dirty and clean.columns == columns

    mixed = stage["mixing"](spark, clean, SMALL).checkpoint()
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixing.mixture(clean).collect() if r["copies"]})

    placed = stage["sharding"](spark, mixed, SMALL)
    assert placed.count() == mixed.count() and placed.columns == [*columns, "shard", "slot"]
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, placed.collect()))


ROWS = [(1, "some words stand here in this text", "en", "a", 3, "x"), (1, "some words stand here in this text", "en", "a", 3, "x"), (2, None, None, None, None, None),
        (None, "another text of some length here", "en", "a", 3, "x"), (None, "another text of some length here", "en", "a", 3, "y"), (3, "", "", "", 0, "x"),
        (4, "long " * 50_000, "en", "b", 1, "x"), (0, "some words stand here in this text", "en", "a", 3, "x"), (0, "quite different words are found in here", "en", "a", 3, "x"),
        (5, "alone but repeated with an id", "en", "a", 1, "z"), (5, "alone but repeated with an id", "en", "a", 1, "a")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_odd_rows_pass_every_stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
        if name == "near_dedup":
            assert Counter((r["doc_id"], r["text"] and r["text"][:9]) for r in docs.collect()) == (Counter(
                {(0, "some word"): 1, (0, "quite dif"): 1, (2, None): 1, (None, "another t"): 1, (4, "long long"): 1, (5, "alone but"): 1}) if rows else Counter())
            assert not rows or docs.where("doc_id = 5").first()["shard"] == "a"
    assert (docs.count() > 0) == bool(rows) and docs.select(F.count_if(F.col("shard").isNull())).first()[0] == 0
