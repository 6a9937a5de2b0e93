"""Mixing sources to target weights by capped water-filling.

All of it is DataFrame expressions. Per source there is one water level check
and one cut on a seeded draw, so the documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import utf8
from pulsegrid.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a draw, the bits that one narrowing step looks at, and the steps before the last rows are ranked.
DRAW_BITS, STEP_BITS, STEPS = 60, 10, 3
#: Up to so many sources (a few numbers each) a table with a row for each source is broadcast.
FEW_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int) -> Column:
    """A document's place in the seeded order of its source; only rows of equal id and text share it."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(utf8()))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank from 0 by code point, null last, counted over ordered partitions."""
    parts = cut_lineage(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("inside", inside).join(before, "part").select("source", "source_size", (F.col("before") + F.col("inside")).alias("rank"))


def source_targets(narrow: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """``(source, source_size, target)``: shares of all sizes by weights 1 to ``weights`` in turn, none above ``epochs`` times its size."""
    ranked = _ranked(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    known = cut_lineage(ranked.select("source", "source_size", (F.col("rank") % weights + 1).alias("weight")))
    cap = (F.col("source_size") * epochs).cast("double")
    level, full = 0.0, 0
    while True:  # each round fills the sources that the level passes; the level only rises
        capped = cap < F.lit(level) * F.col("weight")
        now = known.agg(F.count_if(capped).alias("full"), F.sum("source_size").alias("all"),
                        F.sum(F.when(capped, F.col("source_size") * epochs).otherwise(0)).alias("filled"),
                        F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        if level and now["full"] == full or not now["open"]:
            break
        level, full = (now["all"] - now["filled"]) / now["open"], now["full"]
        if not level:
            break
    share = F.lit(level) * F.col("weight")
    return known.select("source", "source_size", F.when(cap < share, cap).otherwise(share).alias("target"))


def _with_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """A left join on the source in which null meets null.

    With ``few`` sources the right side is sent to all tasks, so a source with most of the rows does not meet in one;
    else Spark shuffles both and splits what is skewed.
    """
    right = right.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if few else right
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def mixing_plan(narrow: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """``(source, source_size, target, whole, cut)``: whole repetitions, and the last draw that gets one more.

    The documents of a source stand in the order of their draws; those before the one in which the remainder of the
    target falls are repeated once more, and that one if half of it or more lies below. The cut is found by sums over
    ranges of draws, 10 bits of them at a time, so no task holds a source.
    """
    targets = source_targets(narrow, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    few = targets.count() <= FEW_SOURCES
    plan = cut_lineage(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    left = DRAW_BITS
    for _ in range(STEPS):
        inside = _with_source(narrow, state, few).where(F.shiftright("draw", left) == F.col("prefix"))
        step = F.shiftright("draw", left - STEP_BITS)
        sums = inside.groupBy("source", "rest", "below", step.alias("prefix")).agg(F.sum("size").alias("n"))
        state = _crossed(sums, "prefix").select("source", "rest", "prefix", F.col("start").alias("below"))
        left -= STEP_BITS
    inside = _with_source(narrow, state, few).where(F.shiftright("draw", left) == F.col("prefix"))
    sums = inside.groupBy("source", "rest", "below", "draw").agg(F.sum("size").alias("n"))
    last = _crossed(sums, "draw").select(
        "source", F.when(2 * F.col("start") + F.col("n") <= 2 * F.col("rest"), F.col("draw")).otherwise(F.col("draw") - 1).alias("cut"))
    return _with_source(plan, last, False).select(
        "source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"))


def _crossed(sums: DataFrame, order: str) -> DataFrame:
    """Of each source the first range at whose end the sizes pass ``rest``; a source has at most 2^10 ranges here."""
    by = Window.partitionBy("source").orderBy(order)
    ends = sums.withColumn("end", F.col("below") + F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    passed = ends.where("end > rest").withColumn("k", F.row_number().over(by)).where("k = 1")
    return passed.withColumn("start", F.col("end") - F.col("n"))


def narrow_documents(docs: DataFrame, seed: int) -> DataFrame:
    return cut_lineage(docs.select("doc_id", "source", word_count().alias("size"), draw(seed).alias("draw")))


def mixture(docs: DataFrame, weights: int = 3, epochs: int = 3, seed: int = 11) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``copies`` is how often the mix repeats the row and ``taken`` is its words times that. Null texts have size 0, a
    null source is a source of its own, rows of equal id (or none) and text share one draw and so one decision.
    Ties do not occur but between such rows. An empty table gives no rows.
    """
    narrow = narrow_documents(docs, seed)
    plan = cut_lineage(mixing_plan(narrow, weights, epochs))
    copies = (F.col("whole") + F.when(F.col("draw") <= F.col("cut"), 1).otherwise(0)).alias("copies")
    return _with_source(narrow, plan, plan.count() <= FEW_SOURCES).select(
        "doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, weights: int = 3, epochs: int = 3, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    plan = cut_lineage(mixing_plan(narrow_documents(docs, seed), weights, epochs))
    few = plan.count() <= FEW_SOURCES
    plan = plan.select(F.col("source").alias("__mix_source"), F.col("whole").alias("__mix_whole"), F.col("cut").alias("__mix_cut"))
    more = F.when(draw(seed) <= F.col("__mix_cut"), 1).otherwise(0)
    times = F.array_repeat(F.lit(0), (F.col("__mix_whole") + more).cast("int"))
    taken = docs.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_copy", F.explode(times))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same mixture in DuckDB's SQL, with the production parameters.
ORACLE = r"""
WITH narrow AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CAST('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS draw FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM narrow GROUP BY source
), filled AS (
  SELECT *, row_number() OVER o AS k, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM ranked WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)
), level AS (
  SELECT (total - capped)::DOUBLE / open AS level FROM filled
  WHERE NOT (3 * source_size)::DOUBLE < (total - capped)::DOUBLE / open * weight ORDER BY k LIMIT 1
), target AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM ranked, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM target
), drawn AS (
  SELECT n.source, draw, sum(size)::BIGINT AS n, target - whole * source_size AS rest
  FROM narrow n JOIN plan p ON n.source IS NOT DISTINCT FROM p.source GROUP BY ALL
), summed AS (
  SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY draw ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM drawn
)
SELECT doc_id, n.source, size, source_size, target, whole + (2 * (upto - n.n) + n.n <= 2 * rest AND source_size > 0)::BIGINT AS copies,
  size * copies AS taken
FROM (SELECT x.*, s.upto, s.n, s.rest FROM narrow x JOIN summed s ON x.draw = s.draw AND x.source IS NOT DISTINCT FROM s.source) n
JOIN plan p ON n.source IS NOT DISTINCT FROM p.source
"""
