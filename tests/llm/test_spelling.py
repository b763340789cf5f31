import zlib
from collections import Counter

import pytest
from oracle import connect, differences

from gneiss.llm import spelling

SF = "/root/testdata/sf0.001"


def by_hand(words, ratio=10):
    alphabet = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in alphabet for k in (0, 1)}
        near = sorted((x for x in near if x in words and x != w), key=lambda x: (-words[x], x))
        out[w] = (near[0] if near and words[near[0]] >= ratio * n else None, len(near))
    rows = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, words[w], n_near, words[form] if form else None))
    return sorted(rows, key=str)


def test_equals_sql(spark):
    _, wrong = differences(connect(SF), spelling.ORACLE, spelling.op11_spelling(spark, SF))
    assert not wrong


def test_chains_ties_doubled_letters_and_anagrams(spark):
    words = {"letterss": 1, "letters": 10, "lettters": 3, "lettres": 500, "lettre": 5000, "retells": 7, "letterz": 100, "lettera": 100, "äöüÄÖÜß": 2, "äöüÄÖÜs": 40, "x" * 5000: 1, "x" * 5001: 12}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == by_hand(words)
    assert {r["word"]: r["root"] for r in got.collect()}["letterss"] == "lettera"
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


@pytest.mark.parametrize("letters, length", [("ab", 7), ("abc", 6), ("éß", 8)])
def test_dense_words(spark, rng, letters, length):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(length - 2, length))): rng.choice([1, 2, 30, 400, 5000]) for _ in range(150)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == by_hand(words)


def test_vocabulary_of_odd_rows(spark, odd, none):
    want = Counter()
    for r in odd.collect():
        import re

        for run in re.findall(spelling.RUN, r["text"] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r["word"]: r["n"] for r in spelling.vocabulary(odd).collect()} == want
    assert spelling.vocabulary(none).count() == 0
