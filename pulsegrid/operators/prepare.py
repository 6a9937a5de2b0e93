"""Imputation, outliers, scaling, transforms and feature selection on wide feature tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.joins import spread_work
from pulsegrid.functions.quantiles import exact_quantiles
from pulsegrid.functions.stats import finite, safe_corr
from pulsegrid.operators.quality import null_report

# Name parts that place a feature in a group (a feature may be in several).
FEATURE_GROUPS = {
    "basic_stats": ["mean", "std", "min", "max", "median", "iqr", "skew", "kurt"],
    "temporal": ["trend", "acf", "seasonal", "week", "day", "hour"],
    "complexity": ["entropy", "fractal", "hjorth", "complex", "perm"],
    "spectral": ["spec", "freq", "energy", "power", "fourier"],
    "peaks": ["peak", "exceed", "duration", "above", "episode"],
    "percentiles": ["percentile", "quantile", "load_", "asym_", "ratio_"],
    "canonical": ["DN_", "SB_", "CO_", "SP_", "FC_", "IN_", "MD_", "SC_", "PD_"],
}
PROFILE_COLUMNS = (
    [f"avg_hour_norm_{h}" for h in range(24)] + [f"avg_day_norm_{d}" for d in range(7)]
    + ["night_day_ratio", "weekend_week_ratio"])


# ---------------------------------------------------------------- missing values

def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, smallest on ties, from per-value counts."""
    out: dict[str, str | None] = {}
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        out[c] = counts.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c)))).first()[0]
    return out


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}


def _fill(df: DataFrame, values: dict) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in known.items()}) if known else df


def impute_median_mode(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return _fill(df, {**medians(df, numeric), **modes(df, categorical)})


def missing_strategy(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """By share of nulls: below 5 % median, below 15 % mean, else an indicator and the median.

    Text columns get ``Unknown``. The nearest-neighbour rule used in the middle
    band sees one column only and so always falls back to the mean.
    """
    share = {r["column_name"]: r["percentage"] for r in null_report(df, numeric).collect()}
    mid = [c for c in numeric if 5 <= share[c] < 15]
    far = [c for c in numeric if share[c] >= 15]
    by_median = [c for c in numeric if 0 < share[c] < 5] + far
    values: dict = medians(df, by_median)
    if mid:
        values.update(df.agg(*[F.avg(c).alias(c) for c in mid]).first().asDict())
    out = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in far}) if far else df
    return _fill(out, {**values, **dict.fromkeys(categorical, "Unknown")})


def impute_from_train(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fill both sets with medians of the training set; infinite values count as missing."""
    clean = lambda d: d.withColumns({c: finite(F.col(c).cast("double")) for c in cols})
    a, b = clean(train), clean(test)
    values = medians(a, cols)
    return _fill(a, values), _fill(b, values)


# ---------------------------------------------------------------- outliers

def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spans = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
    live = np.flatnonzero(spans > 0)
    if depth == 0 or len(x) <= 1 or not live.size:
        nodes[at] = (-1, 0.0, -1, -1, len(x))
        return at
    f = int(rng.choice(live))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    low = x[:, f] < cut
    left = _grow(x[low], rng, depth - 1, nodes)
    right = _grow(x[~low], rng, depth - 1, nodes)
    nodes[at] = (f, cut, left, right, len(x))
    return at


def _path_norm(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, key: str, cols: list[str], trees: int = 100, sample: int = 256,
                     seed: int = 42) -> DataFrame:
    """Anomaly score of each row.

    Every tree grows in its own task on about ``sample`` rows (the size the method itself sets),
    picked by hash from the whole table; the forest (trees x sample nodes, whatever the table size) is then sent to all rows.
    """
    n = df.count()
    grain = 1 << 52
    pick = min(1.0, sample / max(n, 1))
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])
    tree = F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed + 1)), F.lit(grain)) < math.ceil(grain * pick)))
    chosen = df.select(key, x.alias("x"), tree.alias("tree"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        rows = np.stack(pdf["x"].to_numpy())
        nodes: list = []
        _grow(rows, np.random.default_rng([seed, int(pdf["tree"].iloc[0])]), math.ceil(math.log2(max(2, len(rows)))), nodes)
        f, cut, left, right, size = zip(*nodes)
        return pd.DataFrame([{"f": f, "cut": cut, "lft": left, "rgt": right, "size": size, "n": len(rows)}])

    forest = [
        (np.array(r["f"]), np.array(r["cut"]), np.array(r["lft"]), np.array(r["rgt"]), np.array(r["size"]), r["n"])
        for r in spread_work(chosen, "tree").groupBy("tree").applyInPandas(
            fit, "f array<int>, cut array<double>, lft array<int>, rgt array<int>, size array<int>, n int").collect()]
    norm = float(np.mean([_path_norm(t[5]) for t in forest])) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        rows = np.stack(x.to_numpy())
        depth = np.zeros(len(rows))
        for f, cut, left, right, size, _ in shared.value:
            at = np.zeros(len(rows), int)
            for _ in range(64):
                inner = np.flatnonzero(f[at] >= 0)
                if not inner.size:
                    break
                here = at[inner]
                at[inner] = np.where(rows[inner, f[here]] < cut[here], left[here], right[here])
                depth[inner] += 1
            depth += _path_norm(size[at])
        return pd.Series(2.0 ** (-depth / len(shared.value) / norm))

    return df.withColumn("anomaly", score(x))


def drop_outliers(df: DataFrame, key: str, cols: list[str], share: float = 0.05, seed: int = 42) -> DataFrame:
    """Remove the ``share`` of rows with the highest anomaly score."""
    scored = isolation_scores(df, key, cols, seed=seed)
    cut = exact_quantiles(scored, ["anomaly"], [1 - share])["anomaly"][0]
    return scored.filter(F.col("anomaly") <= cut).drop("anomaly")


# ---------------------------------------------------------------- selection

def variance_keep(df: DataFrame, cols: list[str], threshold: float = 0.01,
                  always: list[str] = PROFILE_COLUMNS) -> list[str]:
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if c in always or (row[c] is not None and row[c] > threshold)]


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Feature by feature correlations; the result is as small as the number of columns.

    Standardised first, so a large mean does not cost digits; constant columns give NaN.
    """
    vec = df.select(array_to_vector(standard_array(df, cols)).alias("v"))
    m = Correlation.corr(vec, "v").first()[0].toArray()
    flat = np.flatnonzero(np.array(list(_spread(df, cols).values())) == 0)
    m[flat, :] = m[:, flat] = np.nan
    return m


def correlated_pairs(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[tuple[str, str, float]]:
    m = np.abs(correlation_matrix(df, cols))
    return [(cols[i], cols[j], float(m[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols)) if m[i, j] > limit]


def correlated_drop(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """The later column of every strongly correlated pair, in column order."""
    later = {b for _, b, _ in correlated_pairs(df, cols, limit)}
    return [c for c in cols if c in later]


def feature_groups(cols: list[str]) -> dict[str, list[str]]:
    return {g: [c for c in cols if any(p in c for p in parts)] for g, parts in FEATURE_GROUPS.items()}


def target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Absolute correlation with the target, nulls first set to the median; one scan."""
    filled = _fill(df, medians(df, cols))
    rows = [F.struct(F.lit(c).alias("feature"), F.abs(safe_corr(F.col(c).cast("double"), F.col(target))).alias("correlation"))
            for c in cols]
    return filled.agg(F.array(*rows).alias("r")).selectExpr("inline(r)")


def bucket(col: Column, edges: list[float]) -> Column:
    """How many distinct edges lie below the value."""
    return sum((F.when(col > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))


def binned_mutual_information(df: DataFrame, cols: list[str], target: str, bins: int = 10,
                              discrete: bool = False) -> DataFrame:
    """Mutual information of quantile-binned features with the (binned) target, in nats.

    Values leave the table as counts per (feature, bin, target bin).
    """
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, cols if discrete else [*cols, target], probs)
    y = F.col(target).cast("int") if discrete else bucket(F.col(target), edges[target])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), bucket(F.col(c), edges[c]).alias("b")) for c in cols
                      if edges[c][0] is not None])
    usable = df.select(y.alias("y"), F.explode(pairs).alias("e")).select("y", "e.feature", "e.b")
    cells = usable.groupBy("feature", "b", "y").agg(F.count("*").alias("c"))
    n = cells.groupBy("feature").agg(F.sum("c").alias("n"))
    nb = cells.groupBy("feature", "b").agg(F.sum("c").alias("nb"))
    ny = cells.groupBy("feature", "y").agg(F.sum("c").alias("ny"))
    c = F.col("c")
    info = F.sum(c / F.col("n") * F.log(c * F.col("n") / (F.col("nb") * F.col("ny"))))
    return (
        cells.join(n, "feature").join(nb, ["feature", "b"]).join(ny, ["feature", "y"])
        .groupBy("feature").agg(F.greatest(info, F.lit(0.0)).alias("mi")))


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def _importance_table(df: DataFrame, cols: list[str], importances) -> DataFrame:
    rows = [(c, float(importances[i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def regression_importance(df: DataFrame, cols: list[str], target: str, seed: int = 42) -> DataFrame:
    forest = RandomForestRegressor(
        labelCol=target, numTrees=50, maxDepth=12, minInstancesPerNode=5, featureSubsetStrategy="sqrt",
        subsamplingRate=0.25, seed=seed)
    filled = _fill(df, medians(df, cols))
    return _importance_table(df, cols, forest.fit(_assembled(filled, cols)).featureImportances)


def classification_importance(df: DataFrame, cols: list[str], label: str, seed: int = 42) -> DataFrame:
    forest = RandomForestClassifier(labelCol=label, numTrees=100, seed=seed)
    return _importance_table(df, cols, forest.fit(_assembled(df, cols)).featureImportances)


def combined_score(corr: DataFrame, importance: DataFrame, mi: DataFrame) -> DataFrame:
    """Mean of the three scores, each divided by its largest value (0 when that is not positive)."""
    joined = corr.join(importance, "feature", "left").join(mi, "feature", "left")
    parts = ["correlation", "importance", "mi"]
    top = joined.agg(F.struct(*[F.max(c).alias(c) for c in parts])).scalar()
    wide = joined.withColumn("_t", top)
    norm = [F.when(F.col(f"_t.{c}") > 0, F.col(c) / F.col(f"_t.{c}")).otherwise(0.0) for c in parts]
    have = sum((n.isNotNull().cast("int") for n in norm), F.lit(0))
    total = sum((F.coalesce(n, F.lit(0.0)) for n in norm), F.lit(0.0))
    return wide.select("feature", F.try_divide(total, have).alias("combined_score"))


def choose_features(scores: DataFrame, pairs: list[tuple[str, str, float]], k: int = 100) -> list[str]:
    """Top ``k`` by score without the weaker side of any correlated pair."""
    top = [(r["feature"], r["combined_score"] or 0.0) for r in
           scores.orderBy(F.desc_nulls_last("combined_score"), "feature").limit(k).collect()]
    value = dict(top)
    weaker = {(b if value[a] >= value[b] else a) for a, b, _ in pairs if a in value and b in value}
    return [f for f, _ in top if f not in weaker]


def compact_static(df: DataFrame, key: str = "ci_name", k: int = 256, prefix: str = "fx_") -> DataFrame:
    """Numeric columns only, one averaged row per item, constants dropped, the ``k`` most varying kept."""
    numeric = [c for c, t in df.dtypes if c != key and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    one = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in numeric])
    stats = one.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(numeric) for p, f in
                      (("lo", F.min), ("hi", F.max), ("v", F.var_samp))],
                    *[F.bool_or(F.col(c).isNull()).alias(f"nul{i}") for i, c in enumerate(numeric)]).first()
    def varies(i):
        lo, hi = stats[f"lo{i}"], stats[f"hi{i}"]
        return lo is not None and (lo != hi or stats[f"nul{i}"])
    live = [i for i in range(len(numeric)) if varies(i)]
    if len(live) > k:
        live = sorted(live, key=lambda i: (-(stats[f"v{i}"] or 0.0), i))[:k]
    return one.select(key, *[F.col(numeric[i]).alias(prefix + numeric[i]) for i in live])


# ---------------------------------------------------------------- scaling and transforms

def _spread(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    return {c: row[c] or 0.0 for c in cols}


def standard_array(df: DataFrame, cols: list[str]) -> Column:
    """Array of population z-scores; constant columns and nulls become 0."""
    row = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    parts = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        ok = m is not None and s is not None and s > 0
        parts.append(F.coalesce((F.col(f"`{c}`").cast("double") - m) / s, F.lit(0.0)) if ok else F.lit(0.0))
    return F.array(*parts)


def encode(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``vec`` = z-scores followed by one-hot categories; unseen categories are kept apart."""
    out = df.withColumn("vec", standard_array(df, numeric))
    if not categorical:
        return out
    stages = [
        StringIndexer(inputCols=categorical, outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical],
                      handleInvalid="keep", dropLast=False),
        VectorAssembler(inputCols=[f"_h_{c}" for c in categorical], outputCol="_hot"),
    ]
    hot = Pipeline(stages=stages).fit(out).transform(out)
    return hot.withColumn("vec", F.concat("vec", vector_to_array("_hot"))).select(*df.columns, "vec")


def pca_scores(df: DataFrame, k: int | None = None, share: float | None = None, vec: str = "vec",
               out: str = "scores") -> DataFrame:
    """Principal component scores: a fixed number or enough for a share of the variance."""
    dim = df.select(F.size(vec)).first()[0]
    wide = df.withColumn("_v", array_to_vector(F.col(vec)))
    k = dim if k is None else min(k, dim)
    model = PCA(k=k, inputCol="_v", outputCol="_s").fit(wide)
    if share is not None:
        run = np.cumsum(model.explainedVariance.toArray())
        k = min(k, int(np.searchsorted(run, share)) + 1)
    scored = model.transform(wide)
    return scored.withColumn(out, F.slice(vector_to_array("_s"), 1, k)).drop("_v", "_s")


def yeo_johnson(x: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, two) - 1) / two)
    return F.when(x >= 0, up).otherwise(down)


def power_lambdas(df: DataFrame, cols: list[str], tol: float = 1e-4, points: int = 9) -> dict[str, float]:
    """Most likely power per column, to within ``tol``: each pass tries a few powers of every column in one aggregate.

    A bracket moves on while its best power lies on its edge and the likelihood still gains, and shrinks around it else.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("e")).select("e.*")
    long = long.filter("x IS NOT NULL").persist()
    brackets, best = {c: (-2.0, 2.0) for c in cols}, {c: (1.0, -math.inf) for c in cols}
    try:
        while brackets:
            grid = {c: np.linspace(lo, hi, points) for c, (lo, hi) in brackets.items()}
            table = df.sparkSession.createDataFrame([(c, [float(z) for z in g]) for c, g in grid.items()], "feature string, lam array<double>")
            # a variance reads its value several times: each power is taken once, before
            moved = long.join(F.broadcast(table), "feature").select(  # a row for each column
                "feature", "x", *[yeo_johnson(F.col("x"), F.col("lam")[i]).alias(f"y{i}") for i in range(points)])
            tried = moved.groupBy("feature").agg(
                F.sum(F.sign("x") * F.log1p(F.abs("x"))).alias("j"), F.count("*").alias("n"),
                *[F.var_pop(f"y{i}").alias(f"v{i}") for i in range(points)])
            found = {r["feature"]: r for r in tried.collect()}
            for c, g in grid.items():
                r = found.get(c)
                like = np.full(points, -math.inf)
                for i in range(points if r else 0):
                    v = r[f"v{i}"]
                    if v is not None and 0 < v < math.inf:
                        like[i] = -r["n"] / 2 * math.log(v) + (g[i] - 1) * r["j"]
                at = int(like.argmax())
                gain = like[at] - best[c][1] if like[at] > -math.inf else 0.0
                if gain > 0:
                    best[c] = (float(g[at]), float(like[at]))
                edge, width = at in (0, points - 1), g[-1] - g[0]
                if not gain > 0 and (edge or like[at] == -math.inf) or width <= 2 * tol:
                    del brackets[c]
                elif edge:
                    brackets[c] = (float(g[at] - width / 2), float(g[at] + width / 2))
                else:
                    brackets[c] = (float(g[at - 1]), float(g[at + 1]))
    finally:
        long.unpersist()
    return {c: lam for c, (lam, _) in best.items()}


def power_transform(df: DataFrame, cols: list[str]) -> DataFrame:
    """Yeo-Johnson transform of each column, then population z-scores."""
    lam = power_lambdas(df, cols)
    out = df.withColumns({c: yeo_johnson(F.col(c).cast("double"), F.lit(lam.get(c, 1.0))) for c in cols})
    row = out.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return out.withColumns({
        c: (F.col(c) - row[f"m{i}"]) / (row[f"s{i}"] if row[f"s{i}"] else 1.0)
        for i, c in enumerate(cols) if row[f"m{i}"] is not None})


# Coefficients of the rational approximation of the inverse normal distribution (AS 241), ascending powers.
_MIDDLE = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
            33430.575583588128105, 2509.0809287301226727],
           [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610,
            28729.085735721942674, 5226.4952788528545610])
_TAIL = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
          0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
         [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966,
          5.47593808499534494600e-4, 1.05075007164441684324e-9])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution of probabilities held within 1e-7 of both ends, by one rational approximation for whole arrays."""
    p = np.clip(p, 1e-7, 1 - 1e-7)
    q = p - 0.5
    middle = 0.180625 - q * q
    tail = np.sqrt(-np.log(np.minimum(p, 1 - p))) - 1.6  # at most 4.02 here, so one tail formula is enough
    power = np.polynomial.polynomial.polyval
    inner = q * power(middle, _MIDDLE[0]) / power(middle, _MIDDLE[1])
    outer = np.sign(q) * power(tail, _TAIL[0]) / power(tail, _TAIL[1])
    return np.where(np.abs(q) <= 0.425, inner, outer)


def quantile_normal(df: DataFrame, cols: list[str], knots: int = 1000) -> DataFrame:
    """Map each column to normal scores through approximate quantile knots."""
    probs = [i / (knots - 1) for i in range(knots)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10 * knots).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    table = {c: np.array(row[f"q{i}"]) for i, c in enumerate(cols) if row[f"q{i}"]}
    ref = np.array(probs)
    schema = ", ".join(f"`{n}` {'double' if n in table else t}" for n, t in df.dtypes)

    def run(batches):
        for pdf in batches:
            for c, q in table.items():
                x = pdf[c].to_numpy(float)
                # ties take the middle of their knots, from both directions
                p = (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1])) / 2
                pdf[c] = np.where(np.isnan(x), np.nan, normal_quantile(p))
            yield pdf

    out = df.mapInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in table}) if table else out
