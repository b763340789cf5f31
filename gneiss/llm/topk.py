"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are cut into blocks; a block keeps, for each dimension, its rows in order of that component.  A query reads
the lists from the end its sign asks for, in growing steps, scores what it meets by random access, and stops when the
kth score beats the threshold, the score a row could reach that no list has shown yet.  Queries are rows, too,
and are dealt to blocks in groups, so no task needs all queries or all candidates.

There are two rounds.  In the first a query reads one block only; its kth score there is a floor for the kth score of all.  In
the second it reads the other blocks and also stops, often before the first row, where the threshold falls below that floor.

Components are floor(scale * x) as integers.  Vectors that are null, empty or hold a null or non-finite component take
no part; vectors of unequal length are compared over the dimensions both have.  Ties go to the smaller id.  A row is
never its own partner (rows with the query's id are left out); repeated rows are partners of equal score, each with its
own rank; a query id that repeats is one query, its smallest vector.  With fewer than k candidates all are returned; an empty table gives an empty result.  Components beyond 64 bits
count as the largest or smallest of them; scores are exact at any size and ranked so, but shown within 64 bits.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean

BLOCK = 16_384
QUERY_GROUP = 256
SCALE = 256
FIRST_DEPTH = 32


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties by smaller id; scores may be Python integers."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def threshold_topk(q: np.ndarray, own: int, block: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int, floor: int | None):
    """(scores, positions) of the k best rows of block for q, where they can be among the k best of all: not below `floor`.

    block holds integers, as float64 where products are exact in it, else as Python integers; order[d] lists the rows by
    component d, ascending.
    """
    n = len(block)
    dims = np.flatnonzero(q)
    seen = np.zeros(n, bool)
    best_s, best_p = np.zeros(0, block.dtype), np.zeros(0, np.int64)
    depth, at = FIRST_DEPTH, 0
    while at < n:
        if len(dims):
            edge = np.array([block[order[d, n - 1 - at], d] if q[d] > 0 else block[order[d, at], d] for d in dims], block.dtype)
            bound = q[dims] @ edge  # no unseen row scores more
            if (len(best_s) == k and best_s[-1] > bound) or (floor is not None and bound < floor):
                break
        to = min(n, at + depth)
        if len(dims):
            got = np.concatenate([order[d, n - to : n - at] if q[d] > 0 else order[d, at:to] for d in dims])
            new = np.zeros(n, bool)
            new[got] = True
            new &= ~seen
        else:
            new, to = ~seen, n
        seen |= new
        rows = np.flatnonzero(new)
        rows = rows[ids[rows] != own]
        s, p = np.concatenate([best_s, block[rows] @ q]), np.concatenate([best_p, rows])
        keep = best_of(s, ids[p], k)
        best_s, best_p, at, depth = s[keep], p[keep], to, depth * 2
    return best_s, best_p


def as_integers(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    return df.where(ok & (F.size(v) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


FOUND = "query_id long, vec_id long, score decimal(38,0)"


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of integers, filled up with zeros to the longest."""
    lengths = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(x) for x in lengths]) if len(lengths) else []] = values.flatten().to_numpy()
    return out


class Block:
    """Candidates in order of id, with their lists."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        width = max(m.shape[1] for _, m in parts)
        ids = np.concatenate([i for i, _ in parts])
        m = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in parts])
        o = np.argsort(ids, kind="stable")
        self.ids, self.ints = ids[o], m[o]
        self.order = np.argsort(self.ints, axis=0, kind="stable").T.copy()
        self.floats, self.objects = self.ints.astype(np.float64), None
        self.largest = float(np.abs(self.floats).max(initial=0))

    def best(self, q: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(id, score) of the k best rows."""
        v = np.zeros(self.ints.shape[1], np.int64)
        v[: min(len(v), len(q))] = q[: len(v)]
        if self.largest * float(np.abs(v.astype(np.float64)).max(initial=0)) * len(v) >= 2**53:
            if self.objects is None:
                self.objects = self.ints.astype(object)
            rows, v = self.objects, v.astype(object)
        else:
            rows, v = self.floats, v.astype(np.float64)
        s, p = threshold_topk(v, own, rows, self.ids, self.order, k, floor)
        return [(int(self.ids[i]), int(x)) for i, x in zip(p, s, strict=True)]


def search(both: DataFrame, k: int) -> DataFrame:
    """FOUND rows from both(b, g, id, v, floor), sorted by block b, the candidates (g = -1) before the queries."""

    def run(batches):
        parts, block, current = [], None, None
        for batch in batches:
            bs, gs = batch.column("b").to_numpy(), batch.column("g").to_numpy()
            cuts = np.flatnonzero(np.diff(bs) | np.diff(gs)) + 1
            out = []
            for i, j in zip([0, *cuts], [*cuts, len(bs)], strict=True):
                if i == j:
                    continue
                piece = batch.slice(i, j - i)
                ids, m = piece.column("id").to_numpy(), matrix(pa.array(piece.column("v")))
                if gs[i] < 0:
                    if current != bs[i]:
                        parts, current, block = [], bs[i], None
                    parts.append((ids, m))
                    continue
                if current != bs[i]:
                    continue  # a block without candidates
                block = block or Block(parts)
                for own, row, floor in zip(ids.tolist(), m, piece.column("floor").to_pylist(), strict=True):
                    out += [(own, i, Decimal(s)) for i, s in block.best(row, own, k, None if floor is None else int(floor))]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(lean(run), FOUND)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
         block: int = BLOCK, group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries`."""
    scratch = Scratch(vectors.sparkSession, "topk")
    c = scratch.save(as_integers(vectors, id_col, vec_col, scale), "candidates")
    q = scratch.save(as_integers(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n_blocks = max(1, -(-c.count() // block))
    n_groups = max(1, -(-q.count() // group))
    block_of = lambda: F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    no_floor = F.lit(None).cast("decimal(38,0)").alias("floor")
    rows = c.select(block_of().alias("b"), F.lit(-1).cast("long").alias("g"), "id", "v", no_floor)
    q = q.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_groups)).alias("g"))

    def round_of(asked: DataFrame) -> DataFrame:
        return search(rows.unionByName(asked).repartition(n_blocks, "b").sortWithinPartitions("b", "g", "id"), k)

    found = scratch.save(round_of(q.select(block_of().alias("b"), "g", "id", "v", no_floor)), "first")
    if n_blocks > 1:
        floors = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("id", "floor")
        others = q.join(floors, "id", "left").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("b"), "g", "id", "v", "floor")
        found = found.unionByName(round_of(others.where(F.col("b") != block_of())))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    shown = F.least(F.greatest("score", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", shown.alias("score"))


def op7_topk(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk(e, e.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
