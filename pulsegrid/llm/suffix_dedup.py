"""Repeated byte strings by a difference cover and suffix buckets that are sorted one at a time.

Positions of a perfect difference set modulo a period are the cover sample: any
two places of a text have the same offset, below the period, to sample places
of both. So two equal strings of the wanted length hold equal sample strings at
one offset, and a suffix can only tie with another one if a sample suffix behind
it does. Sample suffixes are ranked first: those whose prefix occurs again go
on, all others settle their ties. Strings at sample places that repeat settle
the inside of long ties; what stays open are suffixes at the ends of ties,
which are sorted last. Every sort deals hashes of prefixes to buckets by value,
and a task sorts one bucket at a time. Chunks of documents ask once for each
hash they hold, so a string that stands everywhere gives a row a chunk. Open
suffixes may tie with settled ones, of which one occurrence of each stretch
between settled strings is sorted with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import slices, utf8
from pulsegrid.session import cut_lineage, cut_to_buckets

#: Bytes of a string that counts as repeated, and the prime that gives the cover: period p*p+p+1 with p+1 sample places.
LENGTH, PRIME = 400, 11
#: Text bytes of a chunk (a longer text is a chunk of its own), and bytes hashed at a time.
CHUNK_BYTES, PIECE = 1 << 20, 1 << 18
#: Buckets of suffixes for each partition of the input; a bucket is what a task sorts at once.
BUCKETS_PER_PARTITION = 4
_RNG = np.random.default_rng(20)
_CODES = _RNG.integers(0, 1 << 64, (2, 256), np.uint64)
_STEPS = [int(x) | 1 for x in _RNG.integers(0, 1 << 63, 2, np.uint64)]
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])


@lru_cache(None)
def difference_cover(prime: int) -> tuple[int, list[int]]:
    """``(period, places)``: every residue but 0 is the difference of just one pair of places.

    Zeros of a linear recurrence of order three over the prime field, with coefficients that make them such a set.
    """
    period = prime * prime + prime + 1
    for a, b, c in product(range(prime), range(prime), range(1, prime)):
        state, places = (0, 0, 1), []
        for i in range(period):
            if state[0] == 0:
                places.append(i)
            state = (state[1], state[2], (a * state[2] + b * state[1] + c * state[0]) % prime)
        if len(places) == prime + 1 and len({(x - y) % period for x in places for y in places}) == period:
            return period, places
    raise ValueError(f"{prime} is not a prime")


@lru_cache(None)
def _cover(prime: int, size: int) -> np.ndarray:
    """The first places of the cover, at least up to ``size``."""
    period, places = difference_cover(prime)
    return (np.arange(size // period + 1)[:, None] * period + np.array(places)).ravel()


@lru_cache(None)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(size, _STEPS[which], np.uint64)
    back = np.full(size, pow(_STEPS[which], -1, 1 << 64), np.uint64)
    step[0] = back[0] = 1
    return np.cumprod(step), np.cumprod(back)


def hashes(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit polynomial hashes of so many bytes at the ascending places ``at``, piece by piece."""
    out = np.empty(len(at), np.uint64)
    longest = int(lengths.max(initial=1))
    power, back = _powers(which, PIECE + (1 << (longest - 1).bit_length()))
    for lo in range(0, len(data), PIECE):
        i, j = np.searchsorted(at, [lo, lo + PIECE])
        if i == j:
            continue
        part = data[lo:lo + PIECE + longest]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[which][part] * power[:len(part)])])
        here = at[i:j] - lo
        out[i:j] = (total[here + lengths[i:j]] - total[here]) * back[here]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _packed(values: np.ndarray, width: int = 4) -> bytes:
    """The low bytes of whole numbers, plane by plane, so that high bytes compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(body: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _steps(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=0))


def _ascending(body: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(body)).astype(np.int64)


#: Of a document's bytes and what is known of it, the places whose strings are asked for, and the strings' lengths.
Places = Callable[[np.ndarray, dict], tuple[np.ndarray, np.ndarray | int]]


def _asks(rows: list[tuple[bytes, bytes, dict]], places: Places, exact: bool, leader: bool, buckets: int, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """A chunk's distinct hashes for each bucket, and to itself its keys, places and the hashes that it repeats."""
    asked = [places(np.frombuffer(data, np.uint8), known) for _, data, known in rows]
    at = [x for x, _ in asked]
    n = np.array([len(x) for x in at])
    if not n.sum():
        return
    sizes = np.array([len(data) for _, data, _ in rows])
    starts = np.cumsum(sizes) - sizes
    where = np.concatenate(at) + np.repeat(starts, n)
    data = np.frombuffer(b"".join(d for _, d, _ in rows), np.uint8)
    lengths = np.concatenate([np.broadcast_to(y, len(x)) for x, y in asked])
    h = hashes(data, where, lengths)
    more = hashes(data, where, lengths, 1) if exact else np.zeros(len(h), np.uint64)
    order = np.lexsort((more, h)) if exact else np.argsort(h, kind="stable")
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])]
    count = np.diff(np.r_[np.flatnonzero(new), len(h)])
    twice = np.zeros(len(h), bool)
    twice[order] = np.repeat(count > 1, count)
    first = np.sort(order[new]) if exact else np.sort(np.minimum.reduceat(order, np.flatnonzero(new)))
    bucket = ((h[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    deal = np.argsort(bucket, kind="stable")
    first, bucket = first[deal], bucket[deal]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for lo, hi in zip(cuts, cuts[1:]):
        own = first[lo:hi]
        body = [_steps(own), np.packbits(twice[own]).tobytes(), _packed(h[own], 5)] + ([_packed(more[own], 8)] if exact else [])
        yield int(bucket[lo]), chunk, len(own).to_bytes(4, "little") + b"".join(body)
    keys = b"".join(k for k, _, _ in rows)
    yield -1 - chunk, chunk, b"".join([len(rows).to_bytes(4, "little"), keys, _packed(n), np.packbits(twice & (not leader)).tobytes(),
                                       _packed(np.concatenate([np.diff(x, prepend=0) for x in at]))])


def _bucket(exact: bool, leader: bool):
    """Sorts one bucket and answers each chunk which of its hashes stand in another chunk, too, or twice in one.

    With ``leader``, each hash's first chunk is told.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bodies, chunks = table.column("body").to_pylist(), table.column("chunk").to_pylist()
        if key[0].as_py() < 0:
            return pa.table({"chunk": pa.array(chunks, pa.int64()), "own": pa.array([True] * len(chunks)), "body": pa.array(bodies, pa.binary())})
        own, twice, low, more = [], [], [], []
        for body in bodies:
            n, at = int.from_bytes(body[:4], "little"), 4
            bits = -(-n // 8)
            own.append(_ascending(body[at:at + 4 * n]))
            twice.append(np.unpackbits(np.frombuffer(body, np.uint8, bits, at + 4 * n), count=n))
            low.append(_unpacked(body[at + 4 * n + bits:at + 9 * n + bits], 5))
            if exact:
                more.append(_unpacked(body[at + 9 * n + bits:], 8))
        h, flag = np.concatenate(low), np.concatenate(twice)
        second = np.concatenate(more) if exact else np.zeros(len(h), np.uint8)
        order = np.lexsort((second, h)) if exact else np.argsort(h)
        h, second = h[order], second[order]
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (second[1:] != second[:-1])])
        sizes = np.diff(np.r_[starts, len(h)])
        again = np.zeros(len(h), bool)
        if leader:
            again[order[starts]] = True
        else:
            again[order] = np.repeat((sizes > 1) | (np.maximum.reduceat(flag[order], starts) > 0), sizes)
        stops = np.cumsum([len(x) for x in own])
        told = [(c, _steps(x[again[s - len(x):s]])) for c, x, s in zip(chunks, own, stops) if again[s - len(x):s].any()]
        return pa.table({"chunk": pa.array([c for c, _ in told], pa.int64()), "own": pa.array([False] * len(told), pa.bool_()), "body": pa.array([b for _, b in told], pa.binary())})

    return run


def _chunk_places(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The places of each document of a chunk whose strings are repeated."""
    own = table.column("own").to_pylist()
    bodies = table.column("body").to_pylist()
    body = bodies[own.index(True)]
    docs, at = int.from_bytes(body[:4], "little"), 4
    keys = [body[at + 32 * k:at + 32 * k + 32] for k in range(docs)]
    at += 32 * docs
    n = _unpacked(body[at:at + 4 * docs]).astype(np.int64)
    at, total = at + 4 * docs, int(n.sum())
    bits = -(-total // 8)
    again = np.unpackbits(np.frombuffer(body, np.uint8, bits, at), count=total).astype(bool)
    for mine, told in zip(own, bodies):
        if not mine:
            again[_ascending(told)] = True
    steps = _unpacked(body[at + bits:]).astype(np.int64)
    found = []
    for k, stop, m in zip(keys, np.cumsum(n), n):
        marks = again[stop - m:stop]
        if marks.any():
            found.append((k, np.cumsum(steps[stop - m:stop])[marks].astype(np.int32)))
    return pa.table({"key": pa.array([k for k, _ in found], pa.binary()), "at": pa.array([p for _, p in found], pa.list_(pa.int32()))})


def repeated_places(texts: DataFrame, places: Places, buckets: int, exact: bool = True, leader: bool = False) -> DataFrame:
    """``(key, at)``: for the texts ``(key?, data, known columns)`` the asked places whose strings are asked for anywhere else, too.

    With ``leader``, one of the places that ask for the same string, whether or not there are others.

    Without a ``key`` column it is the text's SHA-256. A text that occurs in several rows asks in each. With ``exact``
    strings are told apart by 128 hashed bits, else by some 50, which is enough for a first choice.
    """
    names = [c for c in texts.columns if c not in ("key", "data")]
    keyed = "key" in texts.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            asks = list(_asks(held, places, exact, leader, buckets, made))
            return pa.RecordBatch.from_arrays([pa.array([a[k] for a in asks], f.type) for k, f in enumerate(_SENT)], schema=_SENT)

        for part in slices(batches):
            data = part.column(part.schema.get_field_index("data")).to_pylist()
            keys = part.column(part.schema.get_field_index("key")).to_pylist() if keyed else [hashlib.sha256(d).digest() for d in data]
            known = [part.column(part.schema.get_field_index(c)) for c in names]
            for i, (k, d) in enumerate(zip(keys, data)):
                held.append((k, d, {c: _whole(v[i].values) for c, v in zip(names, known)}))
                size += len(d)
                if size >= CHUNK_BYTES:
                    yield from slices([sent()])
                    held, size, made = [], 0, made + 1
        if held:
            yield from slices([sent()])

    asked = texts.mapInArrow(run, "bucket long, chunk long, body binary")
    told = asked.groupBy("bucket").applyInArrow(_bucket(exact, leader), "chunk long, own boolean, body binary")
    return told.groupBy("chunk").applyInArrow(_chunk_places, "key binary, at array<int>")


def _whole(array) -> np.ndarray:
    return np.zeros(0, np.int64) if array is None else np.asarray(array).astype(np.int64)


def sample_places(length: int, prime: int) -> Places:
    """All places of the cover whose prefix fits: what is left of ``length`` after the largest offset."""
    need = length - difference_cover(prime)[0] + 1

    def run(data: np.ndarray, known: dict) -> tuple[np.ndarray, int]:
        if len(data) < length:
            return np.zeros(0, np.int64), need
        cover = _cover(prime, 1 << (len(data) - 1).bit_length())
        return cover[:np.searchsorted(cover, len(data) - need, "right")], need

    return run


def string_places(length: int) -> Places:
    """The sample places that may start a repeated string: their prefix is repeated."""

    def run(data: np.ndarray, known: dict) -> tuple[np.ndarray, int]:
        return known["sample"][known["sample"] + length <= len(data)], length

    return run


def _gaps(found: np.ndarray, length: int) -> np.ndarray:
    """From each settled string to the next one that it touches or overlaps, else 0."""
    gap = np.diff(found, append=found[-1:])
    return np.where(gap <= length, gap, 0)


def stretches(length: int) -> Places:
    """What lies between settled strings that overlap, both included; the last one of a run by itself."""

    def run(data: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
        return known["found"], _gaps(known["found"], length) + length

    return run


def covered(size: int, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each of ``size`` bytes lies in a string of ``length`` at one of the places."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def open_places(length: int, prime: int) -> Places:
    """The suffixes that samples leave open, and those of the stretches this text was chosen for.

    Open is a suffix less than a period before a repeated sample prefix, if some of its bytes are not yet settled.
    """
    period = difference_cover(prime)[0]

    def run(data: np.ndarray, known: dict) -> tuple[np.ndarray, int]:
        n, sample, found = len(data), known["sample"], known["found"]
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, np.maximum(sample - period + 1, 0), 1)
        np.add.at(change, sample + 1, -1)
        asked = np.flatnonzero(np.cumsum(change)[:n - length + 1] > 0)
        done = np.concatenate([[0], np.cumsum(covered(n, found, length))])
        asked = asked[done[asked + length] - done[asked] < length]
        chosen = np.isin(found, known["leads"])
        size = np.maximum(_gaps(found, length)[chosen], 1)
        inside = np.repeat(found[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.union1d(asked, inside), length

    return run


def chosen_places(length: int) -> Places:
    """What a first, shorter comparison left over."""
    return lambda data, known: (known["maybe"], length)


def _kept(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for key, data, *at in zip(*(c.to_pylist() for c in part.columns)):
                gone = covered(len(data), np.concatenate([_whole(x) for x in at]), length)
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((key, [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])], hashlib.sha256(kept).hexdigest()))
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array([r[2] for r in rows], pa.string())], names=["key", "spans", "kept_sha256"])

    return run


def _once(length: int):
    """A task's texts that are long enough, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches):
            rows = []
            for data in part.column(0).to_pylist():
                if len(data) >= length and (key := hashlib.sha256(data).digest()) not in seen:
                    seen.add(key)
                    rows.append((key, data))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["key", "data"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, prime: int = PRIME) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept_sha256)`` for every row of ``docs``.

    ``spans`` (start, stop) are the maximal runs of bytes that lie in a string of ``length`` bytes which also starts anywhere
    else, in this text or another; ``kept_sha256`` is of the other bytes. Overlaps count, and strings are judged on the input.
    Null texts are empty; shorter texts than ``length`` have no spans; a text that occurs in two rows is one span in both.
    Very long texts are one chunk and hashed piece by piece. Null and repeated ids stay rows; other columns are ignored; an
    empty table gives no rows. ``length`` has to exceed the cover's period.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    data = rows.select("data")
    buckets = max(16, BUCKETS_PER_PARTITION * rows.rdd.getNumPartitions())
    sample = repeated_places(data, sample_places(length, prime), buckets, exact=False)
    sample = cut_lineage(sample.groupBy("key").agg(F.first("at").alias("sample")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = data.mapInArrow(_once(length), "key binary, data binary").repartition(tasks, "key").join(sample, "key").dropDuplicates(["key"])
    texts = cut_to_buckets(texts.select("key", "data", "sample"), "key", tasks)  # the joins below move no texts
    found = cut_lineage(repeated_places(texts, string_places(length), buckets).toDF("key", "found"))
    settled = texts.join(found, "key", "left")
    leads = cut_lineage(repeated_places(settled.where("found IS NOT NULL"), stretches(length), buckets, leader=True).toDF("key", "leads"))
    maybe = cut_lineage(repeated_places(settled.join(leads, "key", "left"), open_places(length, prime), buckets, exact=False).toDF("key", "maybe"))
    ends = cut_lineage(repeated_places(texts.join(maybe, "key"), chosen_places(length), buckets).toDF("key", "ends"))
    spans = settled.drop("sample").join(ends, "key", "left").where("found IS NOT NULL OR ends IS NOT NULL").select("key", "data", "found", "ends")
    spans = spans.mapInArrow(_kept(length), "key binary, spans array<struct<start long, stop long>>, kept_sha256 string")
    heads = rows.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.unhex(F.sha2("data", 256)).alias("key"))
    copies = heads.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("size")).where("n > 1")
    whole = copies.select("key", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))).alias("all"))
    known = spans.join(whole, "key", "full").select(
        "key", F.coalesce("all", "spans").alias("spans"), F.when(F.col("all").isNotNull(), hashlib.sha256(b"").hexdigest()).otherwise(F.col("kept_sha256")).alias("kept"))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return heads.join(known, "key", "left").select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept", F.lower(F.hex("key"))).alias("kept_sha256"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, kept)``: the bytes outside the spans, for tables whose ids are given and differ."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, texts, cuts = (c.to_pylist() for c in part.columns)
            kept = []
            for text, cut in zip(texts, cuts):
                stops = [0, *(s["stop"] for s in cut)]
                kept.append(b"".join(text[a:b] for a, b in zip(stops, [*(s["start"] for s in cut), len(text)])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    return rows.join(spans.select("doc_id", "spans"), "doc_id").select("doc_id", "data", "spans").mapInArrow(run, "doc_id long, kept binary")


def digest(spans: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
