"""License scans: phrases and identifier tags by one Aho-Corasick automaton, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import slices, utf8

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices, as words.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "apache license version 2 0": "apache-2.0", "bsd license": "bsd", "3 clause bsd license": "bsd-3-clause",
    "2 clause bsd license": "bsd-2-clause", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl-1.0",
    "mozilla public license": "mpl", "eclipse public license": "epl", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0",
    "artistic license": "artistic", "creative commons": "creative-commons", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0 1 0": "cc0-1.0", "public domain": "public-domain", "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "without warranty of any kind": "warranty-disclaimer",
}
TAG = "spdx license identifier"
# Licences that ask for little more than notice.
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "bsl-1.0", "cc0-1.0", "unlicense", "0bsd", "cc-by-4.0"}
#: Weight of the evidence of a tag, a notice and a base phrase.
TAG_WEIGHT, NOTICE_WEIGHT, BASE_WEIGHT = 0.95, 0.7, 0.6

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAG_LINE = re.compile(rb"spdx[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+identifier(?![0-9A-Za-z\x80-\xff])[ \t]*:?([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_ORDER = {"or": 1, "and": 2, "with": 3}


def automaton() -> ahocorasick.Automaton:
    """All phrases with a space on both sides, over texts whose words are joined by one space."""
    out = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {}
    for phrase, label in BASE.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    kinds[TAG] = [("tag", "")]
    for phrase, found in kinds.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, found))
    out.make_automaton()
    return out


@dataclass(frozen=True)
class Licence:
    """What an expression comes to: its licences, and whether permissive ones suffice."""

    names: frozenset[str]
    permissive: bool


def evaluate(expression: str) -> Licence | None:
    """A licence expression by shunting-yard; ``with`` binds before ``and``, that before ``or``. None if it is malformed."""
    values: list[Licence] = []
    waiting: list[str] = []

    def apply() -> bool:
        if len(values) < 2:
            return False
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            if len(left.names) != 1 or len(right.names) != 1:
                return False
            values.append(Licence(frozenset([f"{min(left.names)}-with-{min(right.names)}"]), left.permissive))
        else:
            values.append(Licence(left.names | right.names, (left.permissive and right.permissive) if op == "and" else (left.permissive or right.permissive)))
        return True

    operand = True  # whether an operand has to come next
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word == "(":
            if not operand:
                return None
            waiting.append(word)
        elif word == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif word in _ORDER:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _ORDER[waiting[-1]] >= _ORDER[word]:
                if not apply():
                    return None
            waiting.append(word)
            operand = True
        else:
            if not operand:
                break  # the expression is over and other words follow
            values.append(Licence(frozenset([word]), word in PERMISSIVE))
            operand = False
    if operand:
        return None
    while waiting:
        if waiting[-1] == "(" or not apply():
            return None
    return values[0] if len(values) == 1 else None


def scan_text(text: bytes, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[str, str, int]], list[tuple[str, bool]]]:
    """Number of words; ``(kind, label, first word)`` of each place; licence names of the tags, each with its expression's verdict."""
    words = text.translate(_WORD).split()
    joined = b" " + b" ".join(words) + b" "
    places: list[tuple[str, str, int]] = []
    tags = False
    at = counted = 0
    for end, (size, found) in machine.iter(joined.decode("latin-1")):
        start = end - size + 1
        # patterns may begin before the last one that was found did
        counted = counted + joined.count(b" ", at, start) if start >= at else counted - joined.count(b" ", start, at)
        at = start
        for kind, label in found:
            tags |= kind == "tag"
            places.append((kind, label, counted))
    named: list[tuple[str, bool]] = []
    if tags:
        for line in _TAG_LINE.findall(text):
            known = evaluate(line.decode("latin-1"))
            named += [(n, known.permissive) for n in sorted(known.names)] if known else [("unparsed", False)]
    return len(words), places, named


SCHEMA = "doc_id long, n_words long, places array<struct<kind:string,label:string,word:long>>, tags array<struct<label:string,permissive:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, places, tags)`` of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``places`` are all stretches of words that spell a base phrase, a notice or a tag, with the number of their first word;
    ``tags`` are the licences that tagged expressions name, with the verdict on the whole expression. Null and empty texts
    have no words and no places. Rows that repeat an id are scanned each. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        place = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64())]))
        tag = pa.list_(pa.struct([("label", pa.string()), ("permissive", pa.bool_())]))
        for part in slices(batches):
            counts, places, tags = zip(*[scan_text(t, machine) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(counts, pa.int64()),
                pa.array([[dict(zip(("kind", "label", "word"), p)) for p in ps] for ps in places], place),
                pa.array([[dict(zip(("label", "permissive"), t)) for t in ts] for ts in tags], tag)], names=["doc_id", "n_words", "places", "tags"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, SCHEMA)


def _labels(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """One line for each document: base places and labels, all labels, whether tags are permissive, and a score.

    The score is the chance that at least one of the distinct labels is right, by the weights of their evidence.
    """
    def of(kind: str) -> Column:
        return F.filter("places", lambda p: p["kind"] == kind)

    base, notices = of("base"), of("notice")
    starts = F.transform(base, lambda p: p["word"])
    names = [F.transform(a, lambda p: p["label"]) for a in (base, notices, F.col("tags"))]
    doubt = F.lit(1.0)
    for labels, weight in zip(names, (BASE_WEIGHT, NOTICE_WEIGHT, TAG_WEIGHT)):
        doubt = doubt * F.pow(F.lit(1 - weight), F.size(F.array_distinct(labels)))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(names[0]).alias("base_labels"), _labels(*names).alias("labels"), F.round(1 - doubt, 9).alias("score"),
        F.when(F.size("tags") > 0, F.forall("tags", lambda t: t["permissive"])).alias("permissive"))
