"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Statistics of whole texts are transformed towards normal shape. Each class gets
a mean and a covariance shrunk towards the pooled one and towards a multiple
of the identity; its Cholesky factor is computed once and scores are
differences of Mahalanobis log-densities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.llm.common import slices, training_rows, utf8
from pulsegrid.session import cut_lineage

STATISTICS = ("words", "word_length", "word_length_spread", "letters", "capitals", "digits", "stops", "symbols", "odd_endings", "bare_symbols",
              "distinct_words", "commonest_word", "repeated_lines", "line_words", "sentence_words")
_LOWER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_STOP, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(3))
_STOP[list(b".,;:?'\"-()")] = _SPACE[[9, 10, 11, 12, 13, 32]] = _HIGH[128:] = True
_CLASS = np.select([_LOWER, _UPPER, _DIGIT, _STOP, _SPACE, _HIGH], [0, 1, 2, 3, 4, 5], 6)
_PLAIN_END = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?'\"-()") | set(range(128, 256))


def _share(x: float) -> float:
    """A share on a log-odds scale that stays finite at 0 and 1."""
    return math.log((x + 0.005) / (1.005 - x))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text; an empty text is one without words."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) if text else np.zeros(7)
    solid = max(1, size - int(kinds[4]))
    lengths = np.array([len(w) for w in words]) if n else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    n1 = max(1, n)
    bare = sum(c for w, c in counts.items() if not any(_CLASS[b] in (0, 1, 2, 5) for b in w))
    odd = sum(c for w, c in counts.items() if w[-1] not in _PLAIN_END)
    ends = text.count(b".") + text.count(b"?")
    return [
        math.log1p(n), math.log1p(lengths.mean()), math.log1p(lengths.std()), _share((kinds[0] + kinds[1] + kinds[5]) / solid),
        _share(kinds[1] / max(1, kinds[0] + kinds[1])), _share(kinds[2] / solid), _share(kinds[3] / solid), _share(kinds[6] / solid),
        _share(odd / n1), _share(bare / n1), _share(len(counts) / n1), _share(max(counts.values(), default=0) / n1),
        _share(1 - len(set(lines)) / max(1, len(lines))), math.log1p(n / max(1, len(lines))), math.log1p(n / (1 + ends)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [statistics(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """``prior`` is the share of class 1; ``means`` and ``factors`` (lower Cholesky) are by class, of standardised statistics."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor, share in zip(self.means, self.factors, (1 - self.prior, self.prior)):
            apart = np.linalg.solve(factor, (z - mean).T)
            density.append(math.log(share) - np.log(np.diag(factor)).sum() - 0.5 * (apart ** 2).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Number, sum and sum of outer products of ``x`` by ``label``, added up in the tasks first."""
    d = len(STATISTICS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            for k in total:
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["label", "at", "v"])

    added = labelled.select("label", "x").mapInArrow(run, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for row in added.collect():  # 2 (1 + d + d^2) rows
        out[row["label"]][row["at"]] = row["v"]
    return {k: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in out.items()}


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """From all labelled rows of training; without two rows of each class every score is the smoothed share of label 1."""
    known = moments(stats.join(training_rows(labels, "quality"), "doc_id"))
    n0, n1 = known[0][0], known[1][0]
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    if min(n0, n1) < 2:
        return Discriminant(prior)
    n = n0 + n1
    centre = (known[0][1] + known[1][1]) / n
    whole = (known[0][2] + known[1][2]) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(whole), 1e-6))
    means, covariances = [], []
    for count, total, outer in (known[0], known[1]):
        mean = total / count
        covariances.append((outer / count - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = (n0 * covariances[0] + n1 * covariances[1]) / n
    factors = []
    for own in covariances:
        mixed = (1 - shrink) * own + shrink * pooled
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / len(mixed), 1e-3) * np.eye(len(mixed))
        factors.append(np.linalg.cholesky((mixed + mixed.T) / 2))
    return Discriminant(prior, centre, scale, means, factors)


def score(model: Discriminant, x: str = "x") -> Column:
    @pandas_udf("double")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(part.to_numpy())) if len(part) else np.zeros(0))

    return run(F.col(x))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``: the probability of label 1 by the discriminant.

    Null and empty texts are scored as texts without words. Rows that repeat an id, or have none, are scored each by its
    own text; every row of a labelled id is learnt from. Without labels every score is 0.5. An empty table gives no rows.
    """
    stats = cut_lineage(document_statistics(docs))
    return stats.select("doc_id", score(fit(stats, labels)).alias("score"))
