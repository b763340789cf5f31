import hashlib
from collections import Counter

import pytest

from gneiss.llm import repeats
from textgen import prose


def brute(rows):
    n = repeats.LENGTH
    seen = Counter(raw[s : s + n] for raw in rows for s in range(len(raw) - n + 1))
    out = []
    for raw in rows:
        runs = []
        for s in range(len(raw) - n + 1):
            if seen[raw[s : s + n]] > 1:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + n
                else:
                    runs.append([s, s + n])
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + raw[at:a], b
        out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + raw[at:]).hexdigest()))
    return out


def corpus(rng):
    passage, other = prose(rng, 110), prose(rng, 200)
    t = [prose(rng, 80) + passage + prose(rng, 60) for _ in range(6)] + [passage[30:520] + prose(rng, 30), other + "!" + other, "a" * 3000, "ab" * 700, prose(rng, 300), "é" * 500]
    t += [prose(rng, 20) + other[k : k + 430] + prose(rng, 20) for k in range(0, 300, 60)]
    return [*t, t[2], None, "", "short"]


@pytest.mark.parametrize("group", [1000, 3])
def test_against_all_windows(spark, rng, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = corpus(rng)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(repeats.remove_repeats(df).collect(), key=lambda r: r["doc_id"])]
    assert got == brute([(t or "").encode() for t in texts])


def test_intervals_of_a_sorted_list():
    assert sorted(repeats.prefix_intervals([2, 3, 3, 0, 1])) == [(1, 4, 5), (2, 0, 3), (3, 1, 3)]


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(odd).collect())
    assert got == sorted((i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert repeats.remove_repeats(none).count() == 0


def test_planted_passages_show_in_the_columns_of_the_contract(spark, rng, tmp_path):
    passages = [prose(rng, 120) for _ in range(4)]
    short = " ".join(prose(rng, 60).split()[:51])[:399]
    texts = [prose(rng, 40 + 10 * i) + (passages[i % 4] if i < 20 else short if i < 24 else "") + prose(rng, 30) for i in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.op6_repeats(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    removed = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert all(removed[i] >= len(passages[i % 4]) for i in range(20)) and not any(removed[i] for i in range(20, 40))


def test_hot_windows_are_a_row_per_bucket_and_a_task_per_bucket(spark, rng):
    """Many texts share an anchor: their entries are not a row per text and bucket, and no task has two buckets."""
    passage, buckets = prose(rng, 120), 40
    texts = [prose(rng, 80) + passage + prose(rng, 60) for _ in range(60)]
    at = [[{"pos": len(t) // 2, "h": 1, "hot": True}] for t in texts]
    rows = [(hashlib.md5(t.encode()).digest(), t, a) for t, a in zip(texts, at, strict=True)]
    ctx = repeats.contexts(spark.createDataFrame(rows, "key binary, text string, at array<struct<pos:int,h:long,hot:boolean>>").coalesce(1), buckets)
    assert ctx.where(f"kind = {repeats.WINDOW_KIND}").count() == buckets
    tasks = [{r["h"] for r in p} for p in repeats.dealt(ctx, buckets).rdd.glom().collect()]
    assert len(tasks) == buckets and {len(t) for t in tasks} == {1}


def test_hot_windows_that_meet_only_in_their_bucket(spark, rng, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    monkeypatch.setattr(repeats, "HELD_ENTRIES", 1)
    texts = corpus(rng)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(repeats.remove_repeats(df).collect(), key=lambda r: r["doc_id"])]
    assert got == brute([(t or "").encode() for t in texts])
