"""Scans against plain searches, and expressions against Python's own operators."""

import random
import re

import pytest

from pulsegrid.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places}))


def test_base_places_match_a_plain_search(spark):
    rng = random.Random(2)
    pool = ["cc", "by", "CC-BY", "general", "public", "license", "General Public License.", "all", "rights", "reserved", "é", "x_y", "9", "ALL\nRIGHTS", "cc by cc by"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))), "", 0) for i in range(300)]
    rows += [(1000, None, "", 0), (1001, "", "", 0), (None, "cc by", "", 0), (3, "all rights reserved " * 20_000, "", 0), (3, "ünïcödé CC BY", "", 0)]
    got = licenses.digest(licenses.scan(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *plain(t)) for i, t, *_ in rows), key=str)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
    ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) AND BSD-3-Clause */", {"gpl-2.0-with-linux-syscall-note", "bsd-3-clause"}),
    ("SPDX-License-Identifier: OR MIT", {"unparsed"}),
    ("Released under the MIT License.", {"mit"}),
    ("licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc"}),
])
def test_tags_and_notices(spark, text, labels):
    got = licenses.digest(licenses.scan(spark.createDataFrame([(1, text, "", 0)], SCHEMA))).first()
    assert set(got["labels"].split(",")) == labels


def test_expressions_follow_python(spark=None):
    rng = random.Random(8)

    def make(depth):
        if depth == 0 or rng.random() < .3:
            return rng.choice(["mit", "gpl-3.0", "isc", "agpl-3.0"])
        text = f" {rng.choice(['and', 'OR', 'AND', 'or'])} ".join(make(depth - 1) for _ in range(rng.randint(2, 3)))
        return f"({text})" if rng.random() < .6 else text

    for _ in range(200):
        e = make(4)
        got = licenses.evaluate(e)
        names = set(re.findall(r"[a-z]+-?[0-9.]*", e.lower())) - {"and", "or"}
        want = eval(re.sub(r"mit|isc", "True", re.sub(r"a?gpl-3.0", "False", e.lower())))
        assert got.names == names and got.permissive == want, e


@pytest.mark.parametrize("bad", ["", "and", "mit and", "(mit", "mit)", "mit or or isc", "(mit or isc) with x", "mit (isc)"])
def test_malformed_expressions(bad):
    assert licenses.evaluate(bad) is None


def test_empty_table(spark):
    assert licenses.digest(licenses.scan(spark.createDataFrame([], SCHEMA))).count() == 0
