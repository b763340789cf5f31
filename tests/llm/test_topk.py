import math
import random

from pyspark.sql import functions as F

from gneiss.llm import topk


def test_against_all_products(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [math.nan] * 8), (303, [math.inf] * 8), (304, []), (305, rowed := [0.5] * 8), (306, rowed), (307, [0.0] * 8), (308, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int")
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in ints:
        if q % 10 == 0:
            s = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q))[:5]
            want |= {(q, k + 1): (i, -x) for k, (x, i) in enumerate(s)}
    got = topk.topk(df, df.where(F.col("vec_id") % 10 == 0), block=64, group=16).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_stops_early_on_a_skewed_list():
    import numpy as np

    n = 4000
    block = np.zeros((n, 4))
    block[:, 0] = np.arange(n)
    reads = []

    class Counted(np.ndarray):
        pass

    order = np.argsort(block, axis=0, kind="stable").T.copy()
    s, p = topk.threshold_topk(np.array([1.0, 0, 0, 0]), -1, block, np.arange(n), order, 5, None)
    assert list(p) == [n - 1, n - 2, n - 3, n - 4, n - 5] and not reads


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in topk.topk(df, df.where("vec_id = 0")).collect()] == [(0, 1)]
    assert topk.topk(df.limit(0), df.limit(0)).count() == 0


def test_components_of_any_size_and_clashing_columns(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1e9, -3e9, 1.5, 7e15]) * r.random() for _ in range(6)]) for i in range(40)] + [(40, [1e300] * 6), (41, [-1e300] * 6)]
    df = spark.createDataFrame([(i, v, 0, 0, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, id int, v int, b int, floor double")
    low, high = -(2**63), 2**63 - 1
    ints = {i: [min(max(math.floor(256 * x), low), high) for x in v] for i, v in rows}
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.topk(df, df, k=3, block=8, group=4).collect()}
    for q in ints:
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, min(max(-x, low), high)) for x, i in best]


def test_a_repeated_query_is_one(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    twice = df.where("vec_id = 3").unionByName(df.where("vec_id = 3"))
    assert [r["vec_id"] for r in topk.topk(df, twice, block=4).orderBy("rank").collect()] == [19, 18, 17, 16, 15]
