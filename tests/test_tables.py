import pytest
from oracle import connect, differences

from gneiss.plans import more_tables, rule_tables, tables  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(tables.SQL))
def test_equals_sql(spark, con, name):
    _, wrong = differences(con, tables.SQL[name], tables.QUERIES[name](spark, SF))
    assert not wrong


def test_pagerank_against_plain_code(spark):
    from gneiss.operators import graph

    nodes = [f"n{i}" for i in range(12)]
    edges = [(f"n{i}", f"n{(i * i + 3) % 12}") for i in range(11)] + [("n1", "n4"), ("n1", "n4"), ("n2", "n0")]
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    for personal in (None, {"n3", "n5"}):
        p = {n: 1 / len(personal) if personal and n in personal else 0 if personal else 1 / 12 for n in nodes}
        rank = dict(p)
        for _ in range(8):
            new = {n: 0.15 * p[n] for n in nodes}
            lost = sum(rank[n] for n in nodes if not out[n])
            for n in nodes:
                for b in out[n]:
                    new[b] += 0.85 * rank[n] / len(out[n])
            rank = {n: new[n] + 0.85 * lost * p[n] for n in nodes}
        total = sum(rank.values())
        v = spark.createDataFrame([(n,) for n in nodes], "node_id string")
        e = spark.createDataFrame([(a, b, "calls") for a, b in edges], "src string, dst string, kind string")
        who = spark.createDataFrame([(n,) for n in personal], "node_id string") if personal else None
        got = {r["node_id"]: r["rank"] for r in graph.pagerank(v, e, iterations=8, personal=who).collect()}
        assert all(abs(got[n] - rank[n] / total) < 1e-9 for n in nodes)
