"""Token groups, links and corpus counts against a plain recount by byte offsets."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import alignment
from pulsegrid.llm.common import table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "two  spaces", "tab\tand\nline \n", "▁ under", "naïve café — “quotes”", "日本語のテキスト", "emoji 👩‍👩‍👧 end", "x" * 300,
       "<|endoftext|> and <s> are text", "<0x41>", "é combining", " nbsp", "ﬁ ligature", "word " * 300, " lead", "trail ", "\x00 zero", "ａｂｃ"]


def plain(texts):
    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    letters = alignment.byte_letters()
    entry = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if set(t) <= set(letters)}
    rows, count = [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        words_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[5] == ">" else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        want = b" " + (text or "").encode()
        if not text or b"".join(entry[i] for i in ids_a) != want or b"".join(words_b) != want:
            ids_a, ids_b, words_b = [], [], []
        ends_a = dict(zip(np.cumsum([len(entry[i]) for i in ids_a]).tolist(), ids_a))
        ends_b = dict(zip(np.cumsum([len(w) for w in words_b]).tolist(), ids_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [",".join(str(i) for e, i in x.items() if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts) for x in (ends_a, ends_b)]
        links = [(ends_a[e], ends_b[e]) for e in cuts]
        count.update(links)
        rows.append((len(ids_a), len(ids_b), len(cuts), links, ";".join(f"{x}|{y}" for x, y in zip(groups[::2], groups[1::2]))))
    most = Counter()
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    return [(na, nb, g, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), w and hashlib.sha256(w.encode()).hexdigest()) for na, nb, g, ls, w in rows]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_against_offsets(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_DOCS", chunk)
    texts = ODD + [r["text"] for r in table(spark, SMALL, "documents").limit(40).collect()] + ["a"] * 5
    rows = [(None if i % 17 == 3 else i // 2, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, idx int").repartition(3)
    got = alignment.alignment(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r[0], *p)) for r, p in zip(rows, plain(texts)))


def test_groups_by_token(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r, (n_a, n_b, n_groups, *_) in zip(alignment.token_groups(docs).orderBy("doc_id").collect(), plain(ODD)):
        assert (len(r["a_ids"]), len(r["b_ids"]), len(set(r["a_group"]))) == (n_a, n_b, n_groups) and sorted(set(r["a_group"])) == list(range(n_groups))
        for g in range(n_groups):
            assert max(e for e, x in zip(r["a_ends"], r["a_group"]) if x == g) == max(e for e, x in zip(r["b_ends"], r["b_group"]) if x == g)
        assert not n_a or r["a_ends"][-1] == len(b" " + ODD[r["doc_id"]].encode())


def test_pointers_reach_the_last_token_of_long_groups():
    a = np.arange(2, 20001, 2)  # ends 2, 4, ...; the other ends 1, 3, ... meet them only at the end
    b = np.append(np.arange(1, 20000, 2), 20000)
    assert set(alignment.group_labels(a, b)) == {len(b) - 1}
    assert list(alignment.group_labels(np.array([1, 4, 6]), np.array([1, 2, 6]))) == [0, 2, 2, 0, 2, 2]


def test_rank_table_encodes_alike(spark):
    tok = alignment.tokenizers(alignment.A_PATH, alignment.B_PATH)
    texts = [t for t in ODD if t] + [f"{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x3000, 7)]
    assert tok.ranks is not None
    assert [tok.ranks.encode_ordinary(t) for t in texts] == [tok.a.encode(t, add_special_tokens=False).ids for t in texts]
    other = Tokenizer.from_file(os.path.join(os.path.dirname(alignment.A_PATH), "word_bpe_49k.json"))
    assert alignment.rank_encoder(other) is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(docs).count() == 0 and alignment.token_groups(docs).count() == 0
    assert alignment.pair_counts(docs.select(F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(1).alias("n"))).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000 + "x" * 5000)], "doc_id long, text string")
    row = alignment.alignment(docs).first()
    assert row["n_groups"] > 60_000 and row["n_links"] == row["n_groups"] <= min(row["n_a"], row["n_b"])
