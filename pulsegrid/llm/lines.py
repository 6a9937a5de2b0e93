"""Fuzzy line deduplication in DataFrame expressions alone.

Lines get SimHash fingerprints from Spark's hashed word counts and random
projections. Lines within the radius
agree on some combination of bit blocks (pigeonhole), where they meet. Each is
checked against the smallest line it meets first; only lines that are still in
different groups are then paired with each other, so a large group of copies
does not give all its pairs. Edit similarity decides on every link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.components import connected
from pulsegrid.llm.simhash import _signed, block_masks
from pulsegrid.session import cut_to_files

#: Differing bits, blocks of which two agree, least edit similarity, and words of a line that is compared at all.
RADIUS, BLOCKS, SIMILARITY, MIN_WORDS = 3, 5, 0.8, 5
#: Hashed word counts that the fingerprints' random directions weigh.
FEATURES, BITS, SEED = 1 << 14, 64, 7


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` of all lines of whole texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_words(line: Column) -> Column:
    """A line's lower-case words, stretches of letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, line_no, k, size, fp)`` of every line of at least ``min_words`` words; ``k`` is the hash of its words.

    Bit ``i`` of the SimHash ``fp`` tells on which side of random direction ``i`` the line's word counts lie.
    """
    words = line_table(docs).select("doc_id", "line_no", F.explode(F.array(line_words(F.col("line")))).alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=FEATURES).transform(words.where(F.size("words") >= min_words))
    sides = BucketedRandomProjectionLSH(inputCol="tf", outputCol="sides", bucketLength=1e9, numHashTables=BITS, seed=SEED)
    hashed = sides.fit(counted).transform(counted)  # one bucket on each side of a direction: -1 or 0
    side = lambda fp, s: F.shiftrightunsigned(fp, 1).bitwiseOR(F.when(vector_to_array(s)[0] < 0, F.lit(-1 << BITS - 1)).otherwise(F.lit(0).cast("long")))
    # one small lambda: 64 expressions side by side make a method that the JVM does not compile
    return hashed.select("doc_id", "line_no", F.xxhash64("words").alias("k"), F.length(F.array_join("words", " ")).alias("size"),
                         F.aggregate("sides", F.lit(0).cast("long"), side).alias("fp"))


def distinct_lines(seen: DataFrame) -> DataFrame:
    """``(k, fp, size, id, no, n)`` of the different lines of ``seen``: a place ``id``, ``no`` where each stands, and how often it does."""
    known = [F.first(F.col(c)).alias(name) for c, name in (("fp", "fp"), ("size", "size"), ("doc_id", "id"), ("line_no", "no"))]
    return seen.groupBy("k").agg(*known, F.count("*").alias("n"))


def _close(a: tuple[Column, Column], b: tuple[Column, Column], radius: int, similarity: float) -> Column:
    """Whether two lines, each a fingerprint and a length, may be similar."""
    near = F.bit_count(a[0].bitwiseXOR(b[0])) <= radius
    return near & (F.least(a[1], b[1]) >= similarity * F.greatest(a[1], b[1]))


def _without_start(pairs: DataFrame) -> DataFrame:
    """Word lists ``x`` and ``y`` without their common first words, and turned round."""
    apart = F.array_position(F.zip_with("x", "y", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    pairs = pairs.withColumn("start", F.when(apart > 0, apart).otherwise(F.size("x") + 1))
    return pairs.withColumns({c: F.reverse(F.slice(c, F.col("start"), F.size(c))) for c in ("x", "y")}).drop("start")


def _similar(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of line hashes whose words have at least the edit similarity; one line each is looked up again."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = distinct.select("k", "id", "no").join(asked, "k")
    found = line_table(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("line_no") == F.col("no")))
    texts = found.select("k", F.explode(F.array(line_words(F.col("line")))).alias("words")).where(F.xxhash64("words") == F.col("k"))
    texts = texts.groupBy("k").agg(F.first("words").alias("words"))
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    longer = F.greatest(*[F.length(F.array_join(c, " ")) for c in ("x", "y")])
    both = _without_start(_without_start(both.withColumn("most", F.floor(longer * F.lit(1 - similarity) + 1e-9).cast("int"))))  # common ends take no edits
    both = both.withColumns({c: F.concat_ws(" ", F.array(F.lit("")), c) for c in ("x", "y")})  # a space before each word that is left
    few = F.expr("levenshtein(x, y, least(most, 8 + most div 10))") >= 0  # a narrow band of edits settles most pairs
    return both.where(F.when(few, True).otherwise(F.expr("levenshtein(x, y, most)") >= 0)).select("a", "b")


def line_groups(docs: DataFrame, distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """``(k, label)`` of the ``distinct`` lines that are linked to others, by all links of lines of different text."""
    masks = [_signed(m) for m in block_masks(radius, blocks)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    met = distinct.select("k", "fp", "size", F.explode(keys).alias("key")).select("key.choice", "key.bits", "k", "fp", "size")
    by_key = Window.partitionBy("bits", "choice").orderBy("k")  # one shuffle gives each key's lines their smallest one
    smallest = [F.first(c).over(by_key).alias(f"first_{c}") for c in ("k", "fp", "size")]
    member = met.select("*", *smallest, F.row_number().over(by_key).alias("rank"), F.lead("k").over(by_key).alias("next")).where("rank > 1")
    near = _close((F.col("fp"), F.col("size")), (F.col("first_fp"), F.col("first_size")), radius, similarity)
    # the smallest line is compared with all others here, so two lines that meet alone are done with
    member = cut_to_files(member.select("choice", "bits", "k", "fp", "size", ((F.col("rank") > 2) | F.col("next").isNotNull()).alias("more"), F.when(near, F.col("first_k")).alias("b")).where("more OR b IS NOT NULL"))
    star = cut_to_files(member.where("b IS NOT NULL").select(F.col("k").alias("a"), "b").distinct())
    links = cut_to_files(_similar(docs, distinct, star, similarity))
    groups = connected(links, "a", "b")
    other = member.where("more").join(groups, F.col("k") == F.col("node"), "left").select("choice", "bits", "k", "fp", "size", F.coalesce("component", "k").alias("label"))
    other = cut_to_files(other)
    earlier = [F.col("a.fp").bitwiseXOR(F.col("b.fp")).bitwiseAND(F.lit(m)) == 0 for m in masks]
    met_before = reduce(lambda x, y: x | y, [(F.col("a.choice") > i) & e for i, e in enumerate(earlier)])  # a pair counts under its first key
    close = _close((F.col("a.fp"), F.col("a.size")), (F.col("b.fp"), F.col("b.size")), radius, similarity)
    across = other.alias("a").join(other.alias("b"), (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits"))
                                   & (F.col("a.k") < F.col("b.k")) & (F.col("a.label") != F.col("b.label")) & close & ~met_before)
    across = cut_to_files(across.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")))
    if not across.isEmpty():
        links = links.unionByName(_similar(docs, distinct, across, similarity))
        groups = connected(links, "a", "b")
    return groups.toDF("k", "label")


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, radius: int = RADIUS, blocks: int = BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, n_lines, dropped)`` for every id of ``docs``: compared lines, and the numbers (from 0) of those to drop.

    Lines are equal if their words are (A line's hash has 64 bits); different ones are linked if their fingerprints differ
    in at most ``radius`` bits and ``1 - edits / longer length`` is at least ``similarity``. Of each connected group the
    first line by ``doc_id`` (null last) and number stays. Lines under ``min_words`` words are left alone. Null and empty
    texts have no lines. Rows that repeat an id, or have none, count as one document: a line number is dropped if any of
    its lines is. An empty table gives no rows.
    """
    seen = cut_to_files(occurrences(docs, min_words))
    distinct = cut_to_files(distinct_lines(seen))
    groups = line_groups(docs, distinct, radius, blocks, similarity).withColumnRenamed("k", "member")
    # only lines that stand twice or are linked can be dropped
    shared = distinct.join(groups, F.col("k") == F.col("member"), "left").where("n > 1 OR label IS NOT NULL").select("k", F.coalesce("label", "k").alias("label"))
    labelled = cut_to_files(seen.select("doc_id", "line_no", "k").join(shared, "k").select("doc_id", "line_no", "label"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    kept = labelled.groupBy("label").agg(F.min(place).alias("kept")).select(F.col("label").alias("group"), "kept")
    drop = labelled.join(kept, F.col("label") == F.col("group")).where(place != F.col("kept"))
    drop = drop.groupBy(F.col("doc_id").alias("in")).agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    counts = seen.groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("n_lines"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.join(counts, F.col("doc_id").eqNullSafe(F.col("of")), "left").join(drop, F.col("doc_id").eqNullSafe(F.col("in")), "left")
    return ids.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_dropped(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with all their columns and the remaining lines as ``text``."""
    plan = dropped.select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped")).where(F.size("dropped") > 0)
    kept = F.filter(F.split("text", "\n"), lambda line, n: ~F.array_contains(F.col("__dropped"), n))
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
