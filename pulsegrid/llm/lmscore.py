"""Stupid-backoff scores under a word model counted over the whole corpus.

Documents are taken in chunks. A chunk's distinct n-grams are dealt to buckets
by their hash; a bucket holds its part of the count table and joins it to the
n-grams of every chunk, each of which asks once whatever its documents repeat.
So a very common word costs a row for each chunk, not for each use. The counts
go back to the chunks, where the scores of a document's words are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import utf8

#: Documents of a chunk at most, and words from which on a chunk takes no further document.
CHUNK_ROWS, CHUNK_WORDS = 512, 200_000
#: Factor for each step to a shorter context, and the least count of a word pair in the table.
BACKOFF, MIN_COUNT = 0.4, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * np.uint64(0xD6E8FEB86659FD93)) ^ ((second << np.uint64(32)) | (second >> np.uint64(32)))
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """Words of some documents as numbers, and the distinct words and word pairs by bucket."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, words: np.ndarray, buckets: int):
        """``codes`` number the words; ``starts`` tell where each document begins; ``words`` are the hashes of the numbers."""
        inner = np.ones(len(codes), bool)
        inner[starts[starts < len(codes)]] = False
        self.second = np.flatnonzero(inner)  # words with one before them in their document
        pair = codes[self.second - 1].astype(np.int64) * len(words) + codes[self.second]
        self.pairs, self.pair_of, self.pair_counts = np.unique(pair, return_inverse=True, return_counts=True)
        self.word_counts = np.bincount(codes, minlength=len(words))
        low = np.uint64(buckets)
        self.word_bucket = (words % low).astype(np.int32)
        # a pair's bucket follows from those of its words, so that the chunk can find it again without the hashes
        one, two = self.pairs // max(1, len(words)), self.pairs % max(1, len(words))
        mixed = self.word_bucket[one].astype(np.int64) * 31 + self.word_bucket[two]
        self.pair_bucket = (mixed % buckets).astype(np.int32)
        self.word_hashes, self.ends = words, (one, two)

    def pair_hashes(self) -> np.ndarray:
        return _pair_hash(self.word_hashes[self.ends[0]], self.word_hashes[self.ends[1]])


def _packed(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of each hash, as a column of 32 and one of 8 bits; the bucket holds further bits, more with more buckets."""
    return (hashes >> np.uint64(32)).astype(np.uint32).tobytes() + (hashes >> np.uint64(24)).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    high = np.frombuffer(data, np.uint32, n).astype(np.uint64) << np.uint64(8)
    return high | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins and ends in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_SCHEMA = "chunk long, bucket int, kind int, data binary, counts binary, docs array<long>, lengths array<int>"
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("counts", pa.binary()),
                    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
_TEXTS, _WORDS, _PAIRS = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _exploded(buckets: int):
    """Chunks of documents as rows: the numbered text, and for each bucket the hashes and counts of its words and pairs."""

    def rows(chunk: int, ids: list, lengths: list[int], codes: list[int], known: dict[bytes, int]) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in known], np.uint64)
        order = np.argsort(hashes % np.uint64(buckets), kind="stable")  # words are renumbered by bucket
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers = place[np.array(codes, np.int64)] if codes else np.zeros(0, np.int64)
        starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, np.int64)
        own = Chunk(numbers, starts, hashes[order], buckets)
        wide = np.uint16 if len(known) <= 1 << 16 else np.uint32
        cuts = np.searchsorted(own.word_bucket, np.arange(buckets + 1)).astype(np.uint32)
        out = [(chunk, -1 - (chunk ^ chunk >> 32) % (1 << 30), _TEXTS, numbers.astype(wide).tobytes(), cuts.tobytes(), ids, lengths)]
        pairs, pair_hashes = _by_bucket(own.pair_bucket, buckets), own.pair_hashes()
        for kind, (at, cut), h, n in ((_WORDS, (np.arange(len(order)), cuts), own.word_hashes, own.word_counts), (_PAIRS, pairs, pair_hashes, own.pair_counts)):
            h, n = h[at], n[at].astype(np.uint32)
            out += [(chunk, b, kind, _packed(h[cut[b]:cut[b + 1]]), n[cut[b]:cut[b + 1]].tobytes(), None, None) for b in np.flatnonzero(np.diff(cut)).tolist()]
        return _batch(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, lengths, codes, known = [], [], [], {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = text.as_py().lower().split()
                codes += [known.setdefault(w, len(known)) for w in words]
                ids.append(doc_id.as_py())
                lengths.append(len(words))
                if len(ids) == CHUNK_ROWS or len(codes) >= CHUNK_WORDS:
                    yield rows(chunk, ids, lengths, codes, known)
                    chunk += 1
                    ids, lengths, codes, known = [], [], [], {}
        if ids:
            yield rows(chunk, ids, lengths, codes, known)

    return run


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns in sorted batches."""
    head, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if head is not None and row[:keys] != head:
                yield head, held
                held = []
            head = row[:keys]
            held.append(row[keys:])
    if held:
        yield head, held


def _joined(min_count: int):
    """Of each bucket, counts summed over the chunks and joined to what the chunks ask for; 0 where the table has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, kind), asked in _runs(batches, 2):
            if kind == _TEXTS:
                yield from (_batch([(c, bucket, kind, d, n, docs, lengths)]) for c, d, n, docs, lengths in asked)
                continue
            hashes = np.concatenate([_unpacked(a[1]) for a in asked])
            counts = np.concatenate([np.frombuffer(a[2], np.uint32) for a in asked])
            order = np.argsort(hashes, kind="stable")
            new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
            total = np.add.reduceat(counts[order].astype(np.uint64), np.flatnonzero(new))
            total[total < (min_count if kind == _PAIRS else 1)] = 0
            answer = np.empty(len(hashes), np.uint64)
            answer[order] = total[np.cumsum(new) - 1]
            wide = np.uint32 if answer.max(initial=0) < 1 << 32 else np.uint64
            size = np.cumsum([0, *[len(a[2]) // 4 for a in asked]])
            for at in range(0, len(asked), 1000):
                yield _batch([(a[0], bucket, kind, answer[size[k]:size[k + 1]].astype(wide).tobytes(), None, None, [size[k + 1] - size[k]])
                              for k, a in enumerate(asked[at:at + 1000], at)])

    return run


def _answers(rows: list[tuple]) -> np.ndarray:
    """Counts by bucket one after the other."""
    parts = [np.frombuffer(data, np.uint32 if len(data) == 4 * lengths[0] else np.uint64).astype(np.uint64) for _, data, _, lengths in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _scored(buckets: int, words_in_all: int, backoff: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(((pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), b.column(3), b.column(4), b.column(5), b.column(6)],
                                                          names=list("abcdefg"))) for b in batches), 1):
            by_kind = {k: [(r[1], r[2], r[4], r[5]) for r in rows if r[0] == k] for k in (_WORDS, _PAIRS)}
            _, _, data, cuts, ids, lengths = next(r for r in rows if r[0] == _TEXTS)
            cuts, lengths = np.frombuffer(cuts, np.uint32), np.array(lengths, np.int64)
            total, distinct = int(lengths.sum()), int(cuts[-1])
            codes = np.frombuffer(data, np.uint16 if total and len(data) == 2 * total else np.uint32).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            # places in their bucket stand for the hashes: only the buckets matter here
            stand_in = np.repeat(np.arange(buckets, dtype=np.uint64), np.diff(cuts))
            own = Chunk(codes, starts, stand_in, buckets)
            word = _answers(by_kind[_WORDS]).astype(float)
            pair = np.zeros(len(own.pairs))
            pair[_by_bucket(own.pair_bucket, buckets)[0]] = _answers(by_kind[_PAIRS])
            assert len(word) == distinct
            value = np.log(word / words_in_all)[codes]
            seen = pair[own.pair_of]
            value[own.second] = np.where(seen > 0, np.log(np.maximum(seen, 1) / word[codes[own.second - 1]]), math.log(backoff) + value[own.second])
            sums = np.add.reduceat(np.r_[value, 0.0], np.minimum(starts, total)) if len(starts) else np.zeros(0)
            sums = np.where(lengths > 0, sums, 0.0)
            backed = np.zeros(total)
            backed[own.second] = seen == 0
            shorter = np.where(lengths > 0, np.add.reduceat(np.r_[backed, 0.0], np.minimum(starts, total)), 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(shorter.astype(np.int64)), pa.array(sums)],
                                             names=["doc_id", "n_words", "n_backed_off", "log_score"])

    return run


def stupid_backoff(docs: DataFrame, buckets: int | None = None, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """``(doc_id, n_words, n_backed_off, log_score, mean_log_score)`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are stretches without ASCII white space, A-Z in lower case. A word scores ``log(c(pair) / c(word before))`` if
    the pair's count is at least ``min_count``, else ``log(backoff * c(word) / all words)``; the first word of a document
    has no pair and no backoff. Counts are those of all rows. ``log_score`` is the sum over the whole text, 0 for null and
    empty texts (whose mean is null). Rows that repeat an id count and are scored each. An empty table gives no rows.
    ``buckets`` grows with the shuffle partitions unless given, so that a bucket fits one task at any size.
    """
    spark = docs.sparkSession
    buckets = buckets or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    exploded = docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(_exploded(buckets), _SCHEMA)
    dealt = exploded.repartition("bucket")  # the texts have negative buckets of their own
    order = ["bucket", "kind", "chunk"]
    joined = dealt.select("bucket", "kind", "chunk", "data", "counts", "docs", "lengths").sortWithinPartitions(*order).mapInArrow(_joined(min_count), _SCHEMA)
    total = docs.agg(F.coalesce(F.sum(_word_count()), F.lit(0))).first()[0]
    back = joined.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    scored = back.mapInArrow(_scored(buckets, max(1, total), backoff), "doc_id long, n_words long, n_backed_off long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def _word_count():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
