import math
from collections import Counter, defaultdict

from gneiss.llm import jaccard
from textgen import prose


def brute(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    by = defaultdict(set)
    for i, t in rows:
        by[shingles(t)].add(i)
    sets = [x for x in by if x]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                links[i] += len(by[sets[j]])
                links[j] += len(by[a])
                root[find(i)] = find(j)
    least = {}
    for i, a in enumerate(sets):
        least[find(i)] = min(least.get(find(i), math.inf), min(by[a]))
    out = {d: (least[find(i)], links[i] + len(by[a]) - 1) for i, a in enumerate(sets) for d in by[a]}
    return out | {d: (d, 0) for d in by.get(frozenset(), ())}


def near_copies(rng, n, words):
    rows, k = [], 0
    for _ in range(n):
        base = prose(rng, words).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
            rows.append((k, " ".join(t)))
            k += 1
    return rows


def test_against_all_pairs(spark, rng):
    rows = near_copies(rng, 60, 90) + [(10_000 + i, f"common words {i} here and there") for i in range(20)] + [(10_100, "common words 3 here and there"), (10_101, None), (10_102, "")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_large_group_in_blocks(spark, rng, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    base = prose(rng, 200).split()
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_posterior_keeps_pairs_at_the_threshold():
    assert all(m <= 0.8 * n for n, m in jaccard.LEAST)
    assert jaccard.least_matches(0.8, 1e-2)[-1][1] > jaccard.least_matches(0.8, 1e-6)[-1][1]


def test_odd_rows(spark, odd, none):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert got[2] == (1, 2) and got[8] == (1, 2) and got[1] == (1, 2) and got[3] == (3, 0) and got[4] == (4, 0)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 4, 5, 6, 7, 9, 10, 11]
    assert jaccard.classes(none).count() == 0 and jaccard.keep_one(none).count() == 0
