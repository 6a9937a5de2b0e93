"""Alignment of two tokenizers' tokens by pointer jumping, and how often the whole corpus aligns a pair of ids.

Both token sequences cover the same bytes. Every token points to its
farthest-right overlapping token; doubling all pointers of a batch at once ends
at the last token of each group of tokens that overlap each other directly or
through others. Documents travel in chunks that ask once for each id pair they
hold, so a pair that stands everywhere gives a row a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import slices, utf8
from pulsegrid.session import cut_lineage

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level vocabularies cut texts before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk of documents is closed at so many documents or links; both only bound what a task holds.
CHUNK_DOCS, CHUNK_LINKS = 4096, 1 << 20
#: Text bytes tokenised at a time, at least one text.
BATCH_BYTES = 1 << 21
_ROWS = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string, "
         "idx int, a int, b int, n long")
_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("links", pa.binary()), ("groups_sha256", pa.string()), ("idx", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}


class Tokenizers:
    """Both vocabularies in a task: encoders, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.ranks = rank_encoder(self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.written = np.array([n + end for end in ",|;" for n in names], object)  # an id with what follows it

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both; empty ones where there is no text or the bytes are not the text's."""
        full = [t for t in texts if t]
        spaced = [" " + t for t in full]
        a = ([self.ranks.encode_ordinary(t) for t in spaced] if self.ranks
             else [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)] if full else [])
        b = self.b.encode(full, num_threads=1) if full else []
        done = iter(zip(full, a, b))
        return [self._checked(*next(done)) if t else ([], []) for t in texts]

    def _checked(self, text: str, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        want = b" " + text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else ([], [])


def rank_encoder(tokenizer):
    """The same byte-level merges as a rank table, which encodes three times as fast; None for any other kind of tokenizer.

    Ids have to ascend in the order of the merges, and texts to be cut by the usual pattern without other changes.
    """
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = not (spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")
                 or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if model["type"] != "BPE" or not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    letters, entries = byte_letters(), model["vocab"]
    merged = [entries["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != list(range(len(letters), len(letters) + len(merged))) or len(entries) != len(letters) + len(merged) or not all(set(e) <= set(letters) for e in entries):
        return None
    ranks = {bytes(letters[c] for c in e): i for e, i in entries.items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


@lru_cache(2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The group of every A and then every B token, by the B token that ends the group; ends ascend and share their last.

    An A token points to the B token that holds its last byte, a B token to the A token that does unless both end there.
    """
    n = len(a_ends)
    over = np.searchsorted(a_ends, b_ends)
    at_end = a_ends[over] == b_ends if len(b_ends) else np.zeros(0, bool)
    to = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.where(at_end, n + np.arange(len(b_ends)), over)])
    while True:
        twice = to[to]
        if np.array_equal(twice, to):
            return to - n
        to = twice


class Aligned:
    """The groups and links of a batch of encoded documents, all computed at once."""

    def __init__(self, tok: Tokenizers, ids: list[tuple[list[int], list[int]]]):
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int32, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        self.a_ends, self.b_ends = np.cumsum(tok.a_len[self.a]), np.cumsum(tok.b_len[self.b])
        self.label = group_labels(self.a_ends, self.b_ends)
        self.a_doc, self.b_doc = (np.repeat(np.arange(len(ids)), n) for n in (self.n_a, self.n_b))
        ends = np.zeros(len(self.b), bool)
        ends[self.label] = True
        self.n_groups = np.bincount(self.b_doc[ends], minlength=len(ids))
        at = np.searchsorted(self.b_ends, self.a_ends)
        both = self.b_ends[at] == self.a_ends if len(self.a) else np.zeros(0, bool)
        self.link_a, self.link_b, self.link_doc = self.a[both], self.b[at[both]], self.a_doc[both]

    def written(self, tok: Tokenizers) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        key = self.label * 2 + side
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([self.a, self.b])[order]
        after = np.full(len(key), 2)
        if len(key):
            after[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] // 2 == key[:-1] // 2, 1, 2))
        parts = tok.written[after * (len(tok.written) // 3) + ids]
        stops = np.cumsum(self.n_a + self.n_b)
        return ["".join(parts[s - k:s])[:-1] for s, k in zip(stops, self.n_a + self.n_b)]


def _batches(part: Iterable[tuple[int | None, bytes]]) -> Iterator[list[tuple[int | None, bytes]]]:
    held, size = [], 0
    for row in part:
        held.append(row)
        size += len(row[1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for part in slices(batches):
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def token_groups(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """``(doc_id, a_ids, a_ends, a_group, b_ids, b_ends, b_group)`` for every row of ``docs``.

    Ends are byte offsets into a space and the text; groups count from 0 in each document. Null or empty texts, and
    texts that a tokenizer does not keep byte for byte, have empty arrays. Very long texts are encoded whole. Repeated
    rows and null ids stay rows; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        for held in _batches(_rows(batches)):
            al = Aligned(tok, tok.encode([t.decode() for _, t in held]))
            columns = [pa.array([d for d, _ in held], pa.int64())]
            starts = np.cumsum(al.n_b) - al.n_b
            first = np.cumsum(al.n_groups) - al.n_groups
            number = np.unique(al.label, return_inverse=True)[1] if len(al.label) else al.label
            origin = np.concatenate([[0], al.b_ends])[starts]
            for n, doc, values in ((al.n_a, al.a_doc, (al.a, al.a_ends - origin[al.a_doc], number[:len(al.a)] - first[al.a_doc])),
                                   (al.n_b, al.b_doc, (al.b, al.b_ends - origin[al.b_doc], number[len(al.a):] - first[al.b_doc]))):
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in values]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "a_ends", "a_group", "b_ids", "b_ends", "b_group"])

    arrays = ", ".join(f"{k} array<int>" for k in ("a_ids", "a_ends", "a_group", "b_ids", "b_ends", "b_group"))
    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, f"doc_id long, {arrays}")


class _Chunk:
    """Documents of a task whose id pairs are asked for together."""

    def __init__(self, number: int):
        self.number, self.docs, self.pairs, self.links = number, [], [], 0

    def add(self, doc_ids: list, al: Aligned, digests: list[str]) -> None:
        pairs = al.link_a.astype(np.int64) << 32 | al.link_b
        per_doc = np.bincount(al.link_doc, minlength=len(doc_ids))
        self.docs += zip(doc_ids, al.n_a, al.n_b, al.n_groups, digests, per_doc)
        self.pairs.append(pairs)
        self.links += len(pairs)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each document with its links as places in the chunk's list of pairs, and that list."""
        distinct, place, n = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        place = place.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
        stops = np.cumsum([d[5] for d in self.docs])
        links = [place[s - d[5]:s].tobytes() for s, d in zip(stops, self.docs)]
        doc = pa.RecordBatch.from_pydict({
            "doc_id": pa.array([d[0] for d in self.docs], pa.int64()), "n_a": [d[1] for d in self.docs], "n_b": [d[2] for d in self.docs],
            "n_groups": [d[3] for d in self.docs], "links": pa.array(links, pa.binary()), "groups_sha256": [d[4] for d in self.docs]})
        yield from slices([_filled(doc, self.number)])
        pair = pa.RecordBatch.from_pydict({"idx": pa.array(np.arange(len(distinct), dtype=np.int32)), "a": pa.array((distinct >> 32).astype(np.int32)),
                                           "b": pa.array((distinct & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n.astype(np.int64))})
        yield _filled(pair, self.number)


def _filled(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    have = dict(zip(batch.schema.names, batch.columns)) | {"chunk": pa.array(np.full(batch.num_rows, chunk))}
    return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _summed(key, docs: pa.Table, told: pa.Table) -> pa.Table:
    """The corpus-wide counts of a chunk's pairs, summed over each document's links."""
    count, best = np.zeros((2, told.num_rows), np.int64)
    at = told.column("idx").to_numpy()
    count[at], best[at] = told.column("total").to_numpy(), told.column("best").to_numpy()
    wide = np.uint16 if told.num_rows <= 1 << 16 else np.uint32
    links = [np.frombuffer(x, wide) for x in docs.column("links").to_pylist()]
    sums = {"n_links": [len(x) for x in links], "n_best": [int(best[x].sum()) for x in links], "count_sum": [int(count[x].sum()) for x in links]}
    names = ["doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256"]
    return pa.table({n: pa.array(sums[n], pa.int64()) if n in sums else docs.column(n) for n in names})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(a, b, total, best)``: links that hold the pair, and whether none of the pairs with this ``b`` has more (0 or 1)."""
    total = cut_lineage(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    most = total.groupBy("b").agg(F.max("total").alias("most"))
    return total.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def alignment(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    A link is a pair of tokens that end at the same byte; its count is how often the corpus links its two ids. ``n_best``
    are the links whose count no other link with their B id exceeds, ties included. Null and empty texts, and texts that a
    tokenizer does not keep byte for byte, have zeros and ''. Very long texts are encoded whole; repeated rows and null ids
    stay rows and count each time; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, made = tokenizers(a_path, b_path), 0
        chunk = _Chunk(TaskContext.get().partitionId() << 32)
        for held in _batches(_rows(batches)):
            al = Aligned(tok, tok.encode([t.decode() for _, t in held]))
            chunk.add([d for d, _ in held], al, [w and hashlib.sha256(w.encode()).hexdigest() for w in al.written(tok)])
            if len(chunk.docs) >= CHUNK_DOCS or chunk.links >= CHUNK_LINKS:
                yield from chunk.rows()
                made += 1
                chunk = _Chunk(TaskContext.get().partitionId() << 32 | made)
        if chunk.docs:
            yield from chunk.rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, _ROWS)
    rows = cut_lineage(rows)  # texts are encoded once
    asked = rows.where("idx IS NOT NULL").select("chunk", "idx", "a", "b", "n")
    told = asked.join(pair_counts(asked), ["a", "b"]).select(F.col("chunk").alias("of"), "idx", "total", "best")
    found = rows.where("idx IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256")
    return found.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(
        _summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
