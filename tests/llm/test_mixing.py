import re
from collections import defaultdict

from gneiss.llm import mixing
from textgen import prose


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free} | {s: 2.0 * sizes[s] for s in full}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_and_taken(spark, rng):
    rows = [(i, prose(rng, rng.choice([1, 5, 30, 200])), rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("doc_id", "source", "mix.*").collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = water(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size(rows[r["doc_id"]][1]) and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 0.03 * want[s] + 200 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5)).select("doc_id", "source", "mix.*").collect())) if None not in sizes else True
    out = mixing.emit(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


def test_one_offset_gives_each_boundary_once(spark):
    df = spark.createDataFrame([(i, "one two", "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").sum("mix.copies").collect()
    want = {r["source"]: r["target"] / 2 for r in mixing.mix(df).select("source", "mix.target").distinct().collect()}
    assert all(abs(r[1] - want[r[0]]) <= 1 for r in got)


def test_odd_rows(spark, odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.drop("mix").columns == odd.columns
    assert all(r["t"] == 0 for r in got.where("text is null or trim(text) = ''").select(got["mix.taken"].alias("t")).collect())
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


def test_null_sources_clashing_columns_and_many_strata(spark):
    names = ["size", "key", "level", "stratum", "place", "mix", "copy", "cell", "of_key"]
    rows = [(i, "word " * (1 + i % 7), None if i % 3 == 0 else f"s{i % 2}", *range(len(names))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    assert mixing.emit(df).columns == df.columns
    assert {tuple(r) for r in mixing.emit(df).select(*names).collect()} == {tuple(range(len(names)))}
    for strata in (1, 16, 64):
        got = mixing.mix(df, strata=strata, into="m").groupBy("source").agg({"m.taken": "sum", "m.target": "max"}).collect()
        assert len(got) == 3 and all(abs(taken - target) <= 0.05 * target for r in got for taken, target in [(r["sum(m.taken AS taken)"] if "sum(m.taken AS taken)" in r else r[1], r[2])])
