"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages of all documents, over the words of the benchmark, are
factorised by a randomised SVD whose sketch is summed over the tasks.
Passages that cover a benchmark passage in the latent space, and then by the
words themselves, are candidates; the longest common subsequence with the
whole item and its answer decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.llm.common import slices, utf8

#: Words of a passage; passages of the search start every ``PASSAGE / 2`` words.
PASSAGE = 32
RANK, OVERSAMPLE = 64, 16
#: Least share of a benchmark passage that a candidate covers, by its latent length and by the weight of its words.
#: Other words beside the passage do not lower either share.
COVERED = 0.4
#: Least common subsequence (share of the item's words) alone and with the answer present.
COMMON, COMMON_WITH_ANSWER = 0.8, 0.6
#: Weight of a word that stands in every benchmark passage.
LEAST_WEIGHT = 0.1
#: Benchmark items handled at a time, and words of an answer that count.
ITEMS, ANSWER_WORDS = 2_000, 4
#: Passages of a text that are compared at a time, so that a very long text needs little memory.
ROWS = 512
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass
class Benchmark:
    """One block of items: words by item, answers (the words of the last sentence), and passages as (item, words)."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]

    def passages(self) -> tuple[np.ndarray, list[np.ndarray]]:
        owner, parts = [], []
        for k, words in enumerate(self.words):
            coded = np.array([self.vocabulary[w] for w in words])
            pieces = max(1, -(-(len(coded) - PASSAGE) // (PASSAGE // 2)) + 1) if len(coded) > PASSAGE else 1
            starts = np.linspace(0, max(0, len(coded) - PASSAGE), pieces).astype(int)
            for s in starts:
                owner.append(k)
                parts.append(coded[s:s + PASSAGE])
        return np.array(owner), parts


def _answer(text: bytes) -> list[bytes]:
    """The words of the last sentence; short ones do not count as evidence."""
    sentences = [s for s in (words_of(x) for x in text.replace(b"\n", b" ").replace(b"?", b".").split(b".")) if s]
    return sentences[-1] if sentences and len(sentences[-1]) >= ANSWER_WORDS else []


def blocks(benchmark: DataFrame, items: int = ITEMS) -> Iterator[Benchmark]:
    """Items with words, ordered by id, in blocks of at most ``items``; equal texts are one item (its smallest id)."""
    distinct = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id"))
    block: list[tuple[int, bytes]] = []

    def made() -> Benchmark:
        words = [words_of(t) for _, t in block]
        listed = sorted({w for ws in words for w in ws})
        return Benchmark([i for i, _ in block], words, [_answer(t) for _, t in block], {w: k for k, w in enumerate(listed)})

    for row in distinct.where("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if words_of(row["text"]):
            block.append((row["item_id"], bytes(row["text"])))
        if len(block) == items:
            yield made()
            block = []
    if block:
        yield made()


def _coded(text: bytes, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and codes of a text's benchmark words, and the number of all its words."""
    words = words_of(text)
    get = vocabulary.get
    codes = np.array([get(w, -1) for w in words], np.int32)
    at = np.flatnonzero(codes >= 0)
    return at, codes[at], len(words)


def word_weights(bench: Benchmark) -> np.ndarray:
    """Inverse frequency of each word over the benchmark's passages.

    Documents have no say in it: an item that many of them hold keeps its weight.
    """
    parts = bench.passages()[1]
    held = np.bincount(np.concatenate([np.unique(p) for p in parts]), minlength=len(bench.vocabulary))
    return np.log((len(parts) + 1) / (held + 1.0)) + LEAST_WEIGHT


def _sketch(docs: DataFrame, vocabulary: dict[bytes, int], weights: np.ndarray, omega: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of passages, and ``A'A omega`` over the TF-IDF passages ``A`` of all documents, added up in the tasks and then by word."""
    weighted = (omega * weights[:, None]).astype(np.float32)
    size, width = weighted.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, width))  # the last row counts passages
        for part in slices(batches):
            held, rows, passages = [], [], 0
            for text in part.column(0).to_pylist():
                at, codes, n = _coded(text, vocabulary)
                held.append(codes)
                rows.append(passages + at // PASSAGE)
                passages += n // PASSAGE + 1
            codes, rows = np.concatenate(held), np.concatenate(rows)
            total[size] += passages
            if not len(codes):
                continue
            new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            projected = np.add.reduceat(weighted[codes], new, axis=0)
            order = np.argsort(codes, kind="stable")
            of = np.cumsum(np.r_[False, rows[1:] != rows[:-1]])[order]
            first = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
            total[codes[order][first]] += np.add.reduceat(projected[of], first, axis=0)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["word", "v"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for k, word in enumerate(batch.column(0).to_pylist()):
                total[word] = total[word] + v[k] if word in total else v[k].copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["word", "v"])

    parts = docs.select(utf8().alias("text")).mapInArrow(run, "word long, v array<double>")
    out = np.zeros((size + 1, width))
    for row in parts.repartition("word").mapInArrow(add, "word long, v array<double>").toLocalIterator():  # one row for each benchmark word
        out[row["word"]] = row["v"]
    return round(out[size, 0]), out[:size] * weights[:, None]


def latent_basis(docs: DataFrame, bench: Benchmark, rank: int = RANK, oversample: int = OVERSAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, V)``: word weights, and right singular vectors from one sketch of the passages' Gram matrix (Nystrom's form).

    The benchmark's passages join those of the documents with as much weight in all, so that their words keep a direction
    even where few documents use them.
    """
    vocabulary = bench.vocabulary
    weights = word_weights(bench)
    width = min(len(vocabulary), rank + oversample)
    omega = np.linalg.qr(np.random.default_rng(7).standard_normal((len(vocabulary), width)))[0]
    passages, y = _sketch(docs, vocabulary, weights, omega)
    parts = bench.passages()[1]
    for words in parts:
        np.add.at(y, words, max(1, passages) / len(parts) * weights[words][:, None] * (omega * weights[:, None])[words].sum(axis=0))
    core = omega.T @ y
    factor = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / width * np.eye(width))
    u, _, _ = np.linalg.svd(np.linalg.solve(factor, y.T).T, full_matrices=False)
    return weights, u[:, :rank]


def common_words(item: list[bytes], region: list[bytes], masks: dict[bytes, int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    full = (1 << len(item)) - 1
    row = full
    for word in region:
        match = masks.get(word)
        if match:
            met = row & match
            row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


class Finder:
    """Finds the items of one block in whole texts."""

    def __init__(self, bench: Benchmark, weights: np.ndarray, basis: np.ndarray):
        self.bench = bench
        self.table = (basis * weights[:, None]).astype(np.float32)
        self.owner, parts = bench.passages()
        queries = np.stack([self.table[p].sum(axis=0) for p in parts])
        self.lengths = np.maximum(np.linalg.norm(queries, axis=1), 1e-12)
        self.queries = (queries / self.lengths[:, None]).T.copy()
        distinct = [np.unique(p) for p in parts]
        self.asked = np.zeros((len(parts), max(map(len, distinct))), np.int64)
        self.worth = np.zeros(self.asked.shape)  # 0 in the places that shorter passages leave empty
        for k, p in enumerate(distinct):
            self.asked[k, :len(p)] = p
            self.worth[k, :len(p)] = weights[p] / weights[p].sum()
        self.masks = []
        for words in bench.words:
            masks: dict[bytes, int] = {}
            for k, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)

    def candidates(self, text: bytes) -> list[tuple[int, int]]:
        """``(item, passage start)`` of the latent neighbours that share enough of the item's words."""
        at, codes, n = _coded(text, self.bench.vocabulary)
        half = PASSAGE // 2
        cells = at // half
        found: set[tuple[int, int]] = set()
        for begin in range(0, n // half + 1, ROWS):  # a passage is two cells, so one more cell is read
            lo, hi = np.searchsorted(cells, [begin, begin + ROWS + 1])
            if lo < hi:
                found.update(self._near(cells[lo:hi] - begin, codes[lo:hi], min(ROWS, n // half + 1 - begin), begin * half))
        return sorted(found)

    def _near(self, cells: np.ndarray, codes: np.ndarray, rows: int, start: int) -> Iterator[tuple[int, int]]:
        new = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        sums = np.zeros((rows + 1, self.table.shape[1]), np.float32)
        sums[cells[new]] = np.add.reduceat(self.table[codes], new, axis=0)
        row, query = np.nonzero((sums[:-1] + sums[1:]) @ self.queries >= COVERED * self.lengths)
        if not len(row):
            return iter(())
        words, column = np.unique(codes, return_inverse=True)
        place = np.zeros(len(self.table), np.int64)  # 0 for words that do not occur
        place[words] = np.arange(1, len(words) + 1)
        holds = np.zeros((rows + 1, len(words) + 1), bool)
        holds[cells, column + 1] = True
        holds[:-1] |= holds[1:]
        keep = []
        for k in range(0, len(row), 1 << 14):
            q = query[k:k + (1 << 14)]
            keep.append((holds[row[k:k + (1 << 14), None], place[self.asked[q]]] * self.worth[q]).sum(axis=1) >= COVERED)
        keep = np.concatenate(keep)
        return zip(self.owner[query[keep]].tolist(), (start + row[keep] * (PASSAGE // 2)).tolist())

    def matches(self, text: bytes) -> list[tuple[int, float, bool]]:
        """``(item, common share, answer present)`` of the items found in a text, each with its best passage."""
        found: dict[int, tuple[float, bool]] = {}
        words: list[bytes] | None = None
        for item, start in self.candidates(text):
            words = words if words is not None else words_of(text)
            wanted = self.bench.words[item]
            if item in found and found[item][0] == 1:
                continue
            region = words[max(0, start - len(wanted)):start + PASSAGE + len(wanted)]
            share = common_words(wanted, region, self.masks[item]) / len(wanted)
            if share < COMMON_WITH_ANSWER:
                continue
            answer = bool(self.bench.answers[item]) and b" %s " % b" ".join(self.bench.answers[item]) in b" %s " % b" ".join(region)
            if share >= COMMON or answer:
                found[item] = max(found.get(item, (0.0, False)), (share, answer))
        return [(item, *best) for item, best in sorted(found.items())]


def finders(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Iterator[Finder]:
    """A finder for each block of the benchmark; each block has its own words and so its own latent space."""
    for bench in blocks(benchmark):
        yield Finder(bench, *latent_basis(docs, bench, rank))


def contamination(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """``(doc_id, item_id, common, answer)`` for each benchmark item found in a row of ``docs``, and no row for clean ones.

    ``common`` is the longest common subsequence as a share of the item's words; ``answer`` tells whether the item's last
    sentence stands there word for word. Null and empty texts hold nothing, items without words or id are left out, items
    with equal texts count once, rows that repeat an id are each searched. Without items or documents there are no rows.
    """
    schema = "doc_id long, item_id long, common double, answer boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for finder in finders(docs, benchmark, rank):

        def run(batches: Iterable[pa.RecordBatch], finder: Finder = finder) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = [(i, finder.bench.ids[k], share, answer) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                        for k, share, answer in finder.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                        zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["doc_id", "item_id", "common", "answer"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, schema))
    return out


def is_contaminated(finder: Finder) -> Column:
    """Whether a row's whole ``text`` holds an item of the finder's block."""

    @pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(finder.matches(t))).astype(bool)

    return run(utf8())
