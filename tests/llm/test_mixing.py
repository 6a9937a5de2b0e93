"""The mixture against DuckDB's SQL and against its own promises."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, draw int"


def rows():
    out = [(i, "w " * (i % 7), "big", "x", 1) for i in range(600)]
    out += [(1000 + i, "v\t" * (1 + i % 3), s, None, 2) for s in ("a", "b", "é", None, "z") for i in range(20)]
    return out + [(2000, None, "a", None, 0), (2001, "", "empty", None, 0), (None, "x y", "a", None, 0), (3, "long " * 50_000, "one", None, 0)]


def test_matches_sql(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    con = duckdb.connect()
    frame = pd.DataFrame(data, columns=["doc_id", "text", "source", "size", "draw"]).astype({"doc_id": "Int64"})
    con.register("documents", frame)
    want = sorted(con.execute(f"SELECT doc_id, source, size, source_size, target, copies, taken FROM ({mixing.ORACLE})").fetchall(), key=str)
    got = sorted((tuple(r) for r in mixing.mixture(docs).collect()), key=str)
    assert got == want


def test_targets_are_met(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mixture(docs).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("size").alias("longest"),
        F.max("copies").alias("most")).collect()
    total = sum(r["size"] for r in got)
    assert abs(sum(r["target"] for r in got) - total) < 1e-6 * total
    for r in got:
        assert r["target"] <= 3 * r["size"] + 1e-9 and r["most"] <= 3 and abs(r["taken"] - r["target"]) <= r["longest"]


def test_documents_are_repeated_whole(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plan = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mixture(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    seen = {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert seen == {k: n for k, n in plan.items() if n}


def test_empty_and_wordless_tables(spark):
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mixture(spark.createDataFrame([(1, "", "a", None, 0), (2, None, None, None, 0)], SCHEMA)).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0)] * 2


def test_rows_without_an_id_or_with_the_same_one_decide_by_text(spark):
    data = [(None, "w " * (1 + k % 20) + str(k), "A", None, 0) for k in range(200)] + [(7, "v " * (1 + k % 9) + str(k), "B", None, 0) for k in range(300)]
    for r in mixing.mixture(spark.createDataFrame(data, SCHEMA)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 21
