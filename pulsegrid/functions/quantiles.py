"""Exact quantiles of large columns without gathering a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer. That is fine for an item's series, which the calendar bounds, but not
for a whole table. Here each wanted order statistic is bracketed by approximate
quantiles and the bracket is narrowed, two scans for all columns per step, until
one value is left or the open brackets of all columns together hold few values.
Values that equal an end of a bracket are counted apart, so a value that occurs
any number of times is found as soon as it is cut at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Values of all columns together that one row may hold.
IN_MEMORY_VALUES = 2_000
_ACCURACY = 2_000


def _interpolate(stats: dict[int, float], p: float, n: int) -> float | None:
    if n == 0:
        return None
    h = p * (n - 1)
    lo, hi = math.floor(h), math.ceil(h)
    return stats[lo] + (stats[hi] - stats[lo]) * (h - lo)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    in_memory: int = IN_MEMORY_VALUES) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column, nulls ignored; the wanted columns are kept between the scans."""
    if not cols:
        return {}
    kept = df.select(*[f"`{c}`" for c in cols]).persist()
    try:
        return _narrowed(kept, cols, probs, in_memory)
    finally:
        kept.unpersist()


def _long(df: DataFrame, x: list[Column], spans: list[tuple[float, float]] | None = None) -> DataFrame:
    """``(i, x)``: the values of each column, those within its span if spans are given.

    One expression for all columns: a plan with some for each of a hundred columns takes longer to compile than to run.
    """
    long = df.select(F.posexplode(F.array(*x)).alias("i", "x")).where("x IS NOT NULL")
    if spans is None:
        return long
    low, high = (F.get(F.lit([s[end] for s in spans]), "i") for end in (0, 1))
    return long.where(F.col("x").between(low, high))


def _between_cuts(df: DataFrame, x: dict[str, Column], cuts: dict[str, set[float]]) -> dict[str, list[tuple[int, int, float, float]]]:
    """``(place, values, smallest, largest)`` of each column in order; odd places hold the values equal to a cut.

    Cuts are values of the column, so an open place always has fewer distinct values than the bracket it was cut from.
    """
    marks = F.lit([sorted(v for v in cuts[c] if v == v) + [math.nan] * any(v != v for v in cuts[c]) for c in x])
    place = F.aggregate(F.get(marks, "i"), F.lit(0), lambda s, v: s + (F.col("x") > v).cast("int") + (F.col("x") >= v).cast("int"))
    rows = _long(df, list(x.values())).withColumn("place", place).groupBy("i", "place").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i", "place").collect()
    out: dict[str, list] = {c: [] for c in x}
    for r in rows:
        out[list(x)[r["i"]]].append((r["place"], r["n"], r["lo"], r["hi"]))
    return out


def _narrowed(df: DataFrame, cols: list[str], probs: list[float], in_memory: int) -> dict[str, list[float | None]]:
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    head = {cols[r["i"]]: r for r in _long(df, list(x.values())).groupBy("i").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}  # a row for each column
    size = {c: head[c]["n"] if c in head else 0 for c in cols}
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    # open brackets: (column, rank) -> [low, high, values below low, values inside]
    open_: dict[tuple[str, int], list] = {}
    for c, n in size.items():
        for p in probs if n else []:
            for r in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                open_[(c, r)] = [head[c]["lo"], head[c]["hi"], 0, n]
    while open_:
        for (c, r), (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                found[c][r] = lo
                del open_[(c, r)]
        small, held, spans = {}, 0, set()
        for key, b in sorted(open_.items(), key=lambda kb: kb[1][3]):
            span = (key[0], b[0], b[1])
            held += 0 if span in spans else b[3]
            if held > in_memory:
                break
            spans.add(span)
            small[key] = b
        if small:
            index = {s: i for i, s in enumerate(sorted(spans))}
            lists: dict[int, list[float]] = {}
            for r in _long(df, [x[c] for c, _, _ in index], [(lo, hi) for _, lo, hi in index]).collect():  # bounded by ``in_memory``
                lists.setdefault(r["i"], []).append(r["x"])
            lists = {i: sorted(v, key=lambda y: (y != y, y)) for i, v in lists.items()}
            for (c, r), b in small.items():
                found[c][r] = lists[index[(c, b[0], b[1])]][r - b[2]]
                del open_[(c, r)]
        if not open_:
            break
        wanted: dict[tuple[str, float, float], set[float]] = {}
        for (c, r), (lo, hi, below, inside) in open_.items():
            wanted.setdefault((c, lo, hi), set()).update(
                max(0.0, min(1.0, (r - below) / inside + d)) for d in (-2 / _ACCURACY, 2 / _ACCURACY))
        shares = sorted(set().union(*wanted.values()))
        near = _long(df, [x[c] for c, _, _ in wanted], [(lo, hi) for _, lo, hi in wanted]).groupBy("i").agg(
            F.percentile_approx("x", shares, _ACCURACY).alias("q")).collect()
        near = {r["i"]: dict(zip(shares, r["q"])) for r in near}
        cuts: dict[str, set[float]] = {}
        for i, ((c, _, _), at) in enumerate(wanted.items()):
            cuts.setdefault(c, set()).update(near[i][p] for p in at)
        parts = _between_cuts(df, {c: x[c] for c in cuts}, cuts)
        for c, r in list(open_):
            below = 0
            for place, n, lo, hi in parts[c]:
                if r < below + n:
                    break
                below += n
            if place % 2:  # a cut itself, however often it occurs
                found[c][r] = lo
                del open_[(c, r)]
            else:
                open_[(c, r)] = [lo, hi, below, n]
    return {c: [_interpolate(found[c], p, size[c]) for p in probs] for c in cols}
