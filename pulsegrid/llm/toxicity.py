"""Toxicity of restored text: a noisy channel undoes disguised spelling before a lexicon scores the words.

A suspicious stretch of text (look-alike symbols, stretched or masked letters,
letters set apart) becomes a lattice of the letters it may stand for. Viterbi
decoding under a character language model of the whole corpus picks the
likeliest reading. Scores come from a non-negative logistic model over words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.llm.common import slices, training_rows, utf8
from pulsegrid.session import cut_lineage

# Letters that a symbol may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
SEPARATORS = " .-_~'*"
ANY = "abcdefghijklmnopqrstuvwxyz"
#: Classes of the language model: 0 is a boundary, 1 to 26 the letters, 27 any other letter.
CLASSES = 28
#: Channel costs in nats: a look-alike, a symbol that stands for itself, a masked letter, a separator, a changed run of letters.
LOOK_COST, KEEP_COST, MASK_COST, SPLIT_COST, RUN_COST = 0.7, 6.0, 2.0, 0.4, 2.5

_SYMBOL = re.escape("".join(LOOKALIKES))
_SET_APART = rf"(?<![^\W_])(?:[a-z{_SYMBOL}][ .\-_~*]{{1,2}}){{2,}}[a-z{_SYMBOL}](?![^\W_])"
_INSIDE = rf"[a-z{_SYMBOL}*]*(?:[{_SYMBOL}*][a-z]|([a-z])\1\1)[a-z{_SYMBOL}*]*"
SUSPICIOUS = re.compile(f"{_SET_APART}|{_INSIDE}")
WORDS = re.compile(r"[^\W\d_]+")
#: A cheap test that holds wherever SUSPICIOUS can match.
TRIGGER = re.compile(rf"[{_SYMBOL}*][a-z]|([a-z])\1\1|(?<![^\W_])[a-z{_SYMBOL}][ .\-_~*]{{1,2}}[a-z{_SYMBOL}][ .\-_~*]{{1,2}}[a-z{_SYMBOL}](?![^\W_])")
#: Labelled rows the word model is fitted on, and the words it may use.
SAMPLE_ROWS, LEXICON_WORDS = 20_000, 400
#: Lengths of the word beginnings that count beside whole words, so that inflected insults are met, and the most
#: different words of one beginning that add to a score.
PREFIXES, PREFIX_WORDS = (4, 5, 6), 3


def character_counts(texts: Iterable[bytes]) -> np.ndarray:
    """Counts of class triples; before a word's second letter the context is the boundary alone."""
    table = bytearray(256)
    for k, c in enumerate(ANY.encode(), 1):
        table[c] = table[c - 32] = k
    for c in range(0xC0, 256):
        table[c] = 27
    tail = bytes(range(0x80, 0xC0))  # the rest of a letter of more than one byte
    out = np.zeros(CLASSES ** 3, np.int64)
    for text in texts:
        codes = np.frombuffer(b"\0\0" + text.translate(bytes(table), tail) + b"\0", np.uint8).astype(np.int32)
        before = np.where(codes[1:-1] == 0, 0, codes[:-2])
        out += np.bincount((before * CLASSES + codes[1:-1]) * CLASSES + codes[2:], minlength=CLASSES ** 3)
    return out


def language_model(docs: DataFrame) -> np.ndarray:
    """``-log P(c | a, b)`` by class, interpolated with the pair model, from the counts of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for part in slices(batches):
            total += character_counts(part.column(0).to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["triple", "n"])

    counted = docs.select(utf8().alias("text")).mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    n = np.zeros(CLASSES ** 3)
    for row in counted.collect():  # 28^3 rows at most
        n[row["triple"]] = row["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    n[0, 0, 0] = 0
    pairs = n.sum(axis=0) + 0.5
    pairs /= pairs.sum(axis=1, keepdims=True)
    return -np.log((n + 20 * pairs[None]) / (n.sum(axis=2, keepdims=True) + 20))


def _class(letter: str) -> int:
    k = ord(letter) - 96
    return k if 1 <= k <= 26 else 27 if letter.isalpha() else 0


def _readings(char: str, run: int) -> list[tuple[str, float]]:
    """What a run of equal characters may stand for, with the channel's cost."""
    if char in SEPARATORS and char != "*":
        return [("", SPLIT_COST), (char * run, KEEP_COST)]
    if char == "*":
        return [("", SPLIT_COST * 2), (char * run, KEEP_COST)] + [(c, MASK_COST) for c in ANY] * (run == 1)
    if char in LOOKALIKES:
        once = [(c * k, LOOK_COST + 0.3 * abs(run - k)) for c in LOOKALIKES[char] for k in sorted({1, min(run, 2)})]
        return once + [(char * run, KEEP_COST)]
    if run == 1:
        return [(char, 0.0)]
    return [(char, RUN_COST if run == 2 else 0.3), (char * 2, 0.0 if run == 2 else 0.6)]


def decode(span: str, costs: np.ndarray | list) -> str:
    """The likeliest reading of a suspicious stretch."""
    paths = {(0, 0): (0.0, "")}
    at = 0
    while at < len(span):
        char, run = span[at], 1
        while at + run < len(span) and span[at + run] == char:
            run += 1
        at += run
        readings = [(text, cost, [_class(c) for c in text]) for text, cost in _readings(char, run)]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a0, b0), (spent, out) in paths.items():
            for text, cost, classes in readings:
                a, b, total = a0, b0, spent + cost
                for c in classes:
                    total += costs[a][b][c]
                    a, b = (b, c) if c else (0, 0)
                old = after.get((a, b))
                if old is None or total < old[0]:
                    after[a, b] = (total, out + text)
        paths = after
    return min((spent + costs[a][b][0], out) for (a, b), (spent, out) in paths.items())[1]


class Restorer:
    """Restores texts; equal stretches are decoded once."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.known = costs.tolist(), {}

    def _span(self, match: re.Match) -> str:
        span = match.group()
        if span not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[span] = decode(span, self.costs)
        return self.known[span]

    def words(self, text: bytes) -> set[str]:
        """Different words of the restored text."""
        plain = text.decode("utf-8", "replace").lower()
        if TRIGGER.search(plain):
            plain = SUSPICIOUS.sub(self._span, plain)
        return set(WORDS.findall(plain))


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)  # of words, and of beginnings with a star
    bias: float = -math.inf

    def score(self, words: set[str]) -> float:
        known = self.weights.keys()
        total = self.bias + sum(self.weights[w] for w in sorted(words & known))
        for k in PREFIXES:
            starts = Counter(s for w in words if len(w) > k and (s := w[:k] + "*") in known)
            total += sum(self.weights[s] * min(n, PREFIX_WORDS) for s, n in sorted(starts.items()))
        return 1 / (1 + math.exp(-total)) if total > -700 else 0.0


def _sample(docs: DataFrame, labels: DataFrame, costs: np.ndarray, rows: int) -> DataFrame:
    """``(doc_id, label, words)`` of the labelled rows with the smallest hashes, at most ``rows``."""
    chosen = training_rows(labels, "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for part in slices(batches):
            words = [sorted(restorer.words(t)) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "label", "words"])

    texts = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    found = texts.mapInArrow(run, "doc_id long, label int, words array<string>")
    least = found.orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(rows)
    return cut_lineage(least.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism))  # the limit leaves one partition


def _longer(k: int):
    return lambda w: F.length(w) > k


def _start(k: int):
    return lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))


def _features(words: Column) -> Column:
    """The words, and the beginning of each one that is longer."""
    starts = [F.transform(F.filter(words, _longer(k)), _start(k)) for k in PREFIXES]
    return F.concat(words, *starts)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Non-negative weights and a bias by accelerated proximal steps on the L1-penalised logistic loss."""
    n, d = x.shape
    w, bias = np.zeros(d), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    lead, steep = np.ones(d), 1.0
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        lead = x.T @ (x @ (lead / np.linalg.norm(lead)))
        steep = float(np.linalg.norm(lead))
    rate = 4 * n / (1.2 * (steep + n))
    seen_w, seen_b, t = w, bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ seen_w + seen_b, -30, 30)))
        w2 = np.maximum(0, seen_w - rate * ((x.T @ (p - y)) / n + penalty))
        b2 = seen_b - rate * float((p - y).mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        seen_w, seen_b = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lexicon: int = LEXICON_WORDS) -> Model:
    """The channel's language model from all documents, the word model from at most ``rows`` labelled ones.

    Without labels of both kinds every score is the same: the share of toxic rows, smoothed, or 0 without any label.
    """
    model = Model(language_model(docs))
    sample = _sample(docs, labels, model.costs, rows)
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return model
    model.bias = math.log((toxic + 0.5) / (n - toxic + 0.5))
    if toxic in (0, n):
        model.bias = min(model.bias, -1.0) if not toxic else max(model.bias, 1.0)
        return model
    sample = sample.withColumn("row", F.monotonically_increasing_id())
    each = sample.select("row", "label", F.explode(_features(F.col("words"))).alias("word")).groupBy("row", "label", "word").agg(F.count("*").alias("n"))
    seen = each.groupBy("word").agg(
        F.sum("label").alias("pos"), F.count("*").alias("df")).where("pos >= 3")
    mean = F.col("df") * (toxic / n)
    odd = seen.withColumn("z", (F.col("pos") - mean) / F.sqrt(mean * (1 - toxic / n) + 1e-9)).where("z > 3")
    words = sorted(r["word"] for r in odd.orderBy(F.desc("z"), "word").limit(lexicon).collect())
    if not words:
        return model
    order = {r["row"]: (k, r["label"]) for k, r in enumerate(sample.select("row", "label").orderBy("row").collect())}
    at = {w: k for k, w in enumerate(words)}
    x, y = np.zeros((n, len(words)), np.float32), np.array([label for _, label in order.values()], np.float32)
    for r in each.where(F.col("word").isin(words)).select("row", "word", "n").collect():  # of a bounded sample and lexicon
        x[order[r["row"]][0], at[r["word"]]] = min(r["n"], PREFIX_WORDS)
    weights, model.bias = _logistic(x, y, penalty=2e-4)
    model.weights = {w: round(float(v), 9) for w, v in zip(words, weights) if v > 0}
    return model


def toxicity(model: Model) -> Column:
    """The score of each row's whole ``text``; empty and null texts get the score of no words."""

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model.costs)
        for part in texts:
            yield part.map(lambda t: model.score(restorer.words(t)))

    return score(utf8())
