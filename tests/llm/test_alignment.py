from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from plain_alignment import by_hand

from gneiss.llm import alignment

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def same(spark, docs):
    got = sorted(map(tuple, alignment.align(docs).select(*COLUMNS).collect()), key=lambda r: tuple((v is not None, v) for v in r))
    assert got == by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_whole_table(spark):
    same(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark, odd, none):
    same(spark, odd)
    assert alignment.align(none).count() == 0


def test_odd_texts_in_small_blocks(spark, monkeypatch):
    texts = [
        " leading", "  two blanks", "trailing ", " ", "   ", "\n", "a\n b", "a \nb", "tab\tand blank", "<|endoftext|> and <s> </s> <unk> <0x41>", "under▁line", "\u0000nul",
        "日本語の文章 with some 漢字", "😀👩‍👩‍👧 family", "é combining", "a" * 3000, "1234567890 " * 50, "don't we'll I'd", "\x1c\x1d odd \x85 white", "　wide　", "ﬁ ligature ½ ²", "ǅ ԱԲ ꟁ 𐐀",
        "x " * 500, "aaa  bbb   ccc", "!!!???...", "\r\n\r\n", "http://a.b/c?d=e&f=g", "ab" * 2000,
    ]
    same(spark, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))


def test_wide_groups_count_by_different_ids():
    pairs = alignment.pairs_of(None, None)
    old = alignment.WIDE_GROUP
    texts = [" " + "ab" * 300, " " + "a" * 700, " word " + "=" * 333, " 漢字" * 20]
    try:
        whole = pairs.learn(texts)
        alignment.WIDE_GROUP = 1
        split = pairs.learn(texts)
    finally:
        alignment.WIDE_GROUP = old
    for t in texts:
        b1, b2 = alignment.Block(pairs.shift), alignment.Block(pairs.shift)
        b1.add(1, [whole[t]], 1)
        b2.add(1, [split[t]], 1)
        assert b1.docs == b2.docs and np.array_equal(b1.keys[0], b2.keys[0]) and np.array_equal(b1.times[0], b2.times[0])


@pytest.mark.parametrize("n, edges", [(1, []), (5, [(0, 4), (4, 2), (1, 3)]), (2000, [(i, i + 1) for i in range(1999)])])
def test_components(n, edges):
    u, v = (np.array([e[k] for e in edges], int) for k in (0, 1))
    got, want = alignment.components(n, u, v), list(range(n))
    for _ in range(n):
        new = list(want)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == want:
            break
        want = new
    assert got.tolist() == want


def test_short_bytes():
    v = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert alignment.long(alignment.short(v), len(v)).tolist() == v.tolist()


def test_chunks_met_lately_are_not_encoded_again(monkeypatch):
    pairs, learned = alignment.Pairs(public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.MODEL_B)), Counter()
    learn = pairs.learn
    monkeypatch.setattr(pairs, "learn", lambda chunks: learned.update(c.strip() for c in chunks) or learn(chunks))
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 40)
    for step in range(30):
        now = {"common", *(f"w{step}x{i}" for i in range(7))}
        pairs.lookup(now)
        assert now <= pairs.known.keys() and len(pairs.known) + len(pairs.before) <= 40 + 2 * len(now)
    assert learned["common"] == 1 and learned["w3x3"] == 1


@pytest.mark.parametrize("most", [50_000, 20])
def test_chunks_encoded_together(monkeypatch, most):
    monkeypatch.setattr(alignment, "JOINED_BYTES", most)
    pairs = alignment.pairs_of(None, None)
    chunks = [" plain", " don't", " 'll", "  two", " end ", " a\n", " a\n\n", " \x1cb", " 漢字", " über", " it's\tso", " " + "ab" * 40, " x", " 1234567", " ---", "   "]
    got, ids, many = pairs.tokens_a(chunks)
    ends = np.cumsum(many)
    assert sorted(got) == sorted(chunks)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, many)] == [pairs.slow.encode(c, add_special_tokens=False).ids for c in got]
    calls, fast = [], pairs.fast
    monkeypatch.setattr(pairs, "fast", SimpleNamespace(encode_to_numpy=lambda *a, **k: calls.append(1) or fast.encode_to_numpy(*a, **k), encode_ordinary=lambda *a: calls.append(1) or fast.encode_ordinary(*a)))
    pairs.learn([f" w{i}" for i in range(1000)])
    assert len(calls) < 1000
