import random
import zlib
from collections import defaultdict

import numpy as np

from gneiss.llm import packing


def check(docs, rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in docs}
    seen = defaultdict(int)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
    return sequences, ids, seen


def test_packs_all_ids_once(spark, odd):
    rows = packing.pack(odd, capacity=256).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    sequences, ids, seen = check(docs, rows, 256)
    times = defaultdict(int)
    for i, _ in docs:
        times[i] += 1
    assert all(seen[i] == len(ids[i]) * times[i] for i in ids)
    assert sum(r["length"] for r in rows) / (len(sequences) * 256) > 0.98


def test_more_partitions_than_scratch_tables_have(spark):
    n = 4 * spark.sparkContext.defaultParallelism
    docs = spark.range(0, 6 * n, 1, 3 * n + 1).selectExpr("id as doc_id", "repeat('some words ', cast(1 + id % 5 as int)) as text")
    assert docs.rdd.getNumPartitions() > n
    rows = packing.pack(docs, capacity=64).collect()
    assert len(rows) == 6 * n and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], rows, 64)


def test_plan_equals_best_fit_decreasing():
    r = random.Random(5)
    for capacity in (10, 64, 2048):
        lengths = [r.randint(1, capacity) for _ in range(400)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.plan_windows(counts, capacity)
        left: list[int] = []
        for x in sorted(lengths, reverse=True):
            fit = min((c for c in left if c >= x), default=None)
            if fit is None:
                left.append(capacity - x)
            else:
                left[left.index(fit)] -= x
        key = plan["length"] * (1 << 48) + plan["rank"]
        windows = defaultdict(list)
        for x, n in counts.items():
            for k in range(n):
                at = np.searchsorted(key, x * (1 << 48) + k, side="right") - 1
                windows[int(plan["window"][at] + k - plan["rank"][at])].append((int(plan["offset"][at]), x))
        assert len(windows) == len(left)
        assert sorted(capacity - sum(x for _, x in w) for w in windows.values()) == sorted(left)
        for w in windows.values():
            at = 0
            for offset, x in sorted(w):
                assert offset == at
                at += x


def test_word_ids_equal_the_tokenizer():
    w = packing.WordIds(packing.vocabulary_path())
    for text in ["don't we've Ünïcode ÀÉ ß µm ªº x² ½ <|endoftext|>a b", "Ωmega İstanbul ΣΑΣ 你好，世界", "a\x1cb it's*** 's's t'll _a_b", "", "  ", "tail... end!? (x)y"]:
        assert list(np.frombuffer(w.ids(text), "<u4")) == w.encode(text, add_special_tokens=False).ids


def test_empty(spark, none):
    assert packing.pack(none).count() == 0
