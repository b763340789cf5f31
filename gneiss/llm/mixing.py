"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document expects ``rate = target / source_size`` copies.  Documents are put in one fixed order
(size class, stratum, size, doc_id); the prefix sum of expected copies at rank r is ``rate * r``.  With one offset u
per source a document is emitted once for each integer in ``(rate * (r - 1) + u, rate * r + u]``.  Ordering by size
makes the sample stratified by size, so the words taken stay near the target although sizes have a long tail.

Ranks need no task that holds a source: size classes are logarithmic and each is cut into hashed strata, whose number is
in proportion to the rows, so a cell (source, class, stratum) is ranked by itself; cell counts are prefix-summed within
their class and classes within their source.  A document size shared by a third of all rows is spread over the strata.

Defined cases: null text has size 0; size-0 documents are taken 0 times or more but always take 0 words; a null source
is a source of its own and comes last; equal rows are ranked separately, in any order, so their sum does not depend on
it; an empty table gives an empty result; rate never exceeds 2, so nothing is taken more than twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, fresh

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STRATA = 16
STRATA_ROWS = 50_000_000  # so many rows have STRATA strata, twice as many have twice as many
CLASSES_PER_OCTAVE = 8


def word_count(text: Column) -> Column:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target): water-filling under the cap most * source_size.

    Sources are few, so a window over all of them is a small, bounded task.  Sorted by cap per weight, the first k
    sources are at their caps; the others share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (k + 1).cast("int")).cast("long")
    s = sizes.select("source", "source_size", w.alias("w"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every),
        "all_w": F.sum("w").over(every),
        "done": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "done_w": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    level = (F.col("total") * F.lit(share) - F.col("done") * F.lit(most)) / (F.col("all_w") - F.col("done_w"))
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("source_size") * most)
    final = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("w")).alias("r"), "level"))).over(every)
    s = s.withColumn("final", final["level"])
    capped = (F.col("source_size") * most).cast("double")
    target = F.when(F.col("final").isNull(), capped).otherwise(F.least(capped, F.col("final") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def strata_for(docs: DataFrame) -> int:
    """In proportion to the rows: a cell that held every row would have STRATA_ROWS / STRATA of them at any scale."""
    return STRATA * max(1, -(-docs.select("doc_id").count() // STRATA_ROWS))


def mix(docs: DataFrame, seed: str = "mix", share: float = SHARE, weights=WEIGHTS, strata: int | None = None, into: str = "mix") -> DataFrame:
    """Every row of docs with struct `into` (in place of a column of that name): size, source_size, target, copies, taken."""
    size, key, level, stratum, place = fresh(docs, "size", "key", "level", "stratum", "place")
    strata = strata or strata_for(docs)

    def placed(df: DataFrame) -> DataFrame:
        """df with its size, source key, size class and stratum; each is computed once, in a projection of its own."""
        df = df.withColumn(size, word_count(F.col("text")))
        bits = F.length(F.bin(size))
        digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        return df.withColumns({
            key: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            level: (bits * 16 + F.floor(F.col(size) * CLASSES_PER_OCTAVE / F.pow(F.lit(2.0), bits - 1))).cast("int"),
            stratum: F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long"), F.lit(strata)).cast("int"),
        })

    cells = placed(docs.select("doc_id", "text", "source")).select("source", F.col(key).alias("key"), F.col(level).alias("level"), F.col(stratum).alias("stratum"), F.col(size).alias("size"))
    cells = cells.groupBy("key", "source", "level", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    cells = Scratch(docs.sparkSession, "mixing").save(cells, "cells")
    # counts are summed over classes first, then within a class: neither window holds more than a source's classes or a class's strata
    by_class = cells.groupBy("key", "level").agg(F.sum("n").alias("n"))
    lower = Window.partitionBy("key").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.select("key", "level", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))
    upto = Window.partitionBy("key", "level").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("inside", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(by_class, ["key", "level"]).withColumn("offset", F.col("below") + F.col("inside"))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, share, weights=weights).withColumn("goal_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    goal = goal.select("goal_key", "source_size", "target")
    of_key, of_level, of_stratum, cell = fresh(docs.select("*", *[F.lit(0).alias(c) for c in (size, key, level, stratum, place)]), "of_key", "of_level", "of_stratum", "cell")
    offsets = offsets.join(goal, F.col("key") == F.col("goal_key")).select(
        F.col("key").alias(of_key), F.col("level").alias(of_level), F.col("stratum").alias(of_stratum), F.struct("offset", "source_size", "target").alias(cell))

    within = Window.partitionBy(key, level, stratum).orderBy(size, "doc_id")
    ranked = placed(docs).withColumn(place, F.row_number().over(within))
    ranked = ranked.join(offsets, (F.col(key) == F.col(of_key)) & (F.col(level) == F.col(of_level)) & (F.col(stratum) == F.col(of_stratum)))
    c = F.col(cell)
    rank = c["offset"] + F.col(place)
    rate = F.when(c["source_size"] > 0, c["target"] / c["source_size"]).otherwise(0.0)
    hex8 = F.substring(F.md5(F.concat(F.lit(seed), F.col(key))), 1, 8)
    u = F.conv(hex8, 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u)).cast("long")
    out = F.struct(F.col(size).alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), copies.alias("copies"), (copies * F.col(size)).alias("taken"))
    return ranked.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() != into.lower()], out.alias(into))


def emit(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each row repeated as often as it was taken, with the columns of docs."""
    into, copy = fresh(docs, "mix", "copy")
    mixed = mix(docs, into=into, **kw).where(F.col(into)["copies"] > 0)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(into)["copies"]))).select(*[F.col(f"`{x}`") for x in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", *[f"mix.{c}" for c in ("size", "source_size", "target", "taken", "copies")])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1] AS w FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(source_size) OVER o, 0) AS done, coalesce(sum(w) OVER o, 0) AS done_w FROM w
  WINDOW o AS (ORDER BY source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total * 1.5::DOUBLE - done * 2) / (all_w - done_w) AS level FROM c),
f AS (SELECT *, (SELECT arg_min(level, source_size / w) FROM l WHERE level * w <= source_size * 2) AS final FROM l),
t AS (SELECT coalesce('s' || source, 'n') AS key, source_size,
  CASE WHEN final IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, final * w) END AS target FROM f),
p AS (SELECT *, coalesce('s' || source, 'n') AS key, length(bin(size)) * 16 + floor(size * 8 / pow(2.0, length(bin(size)) - 1)) AS level,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT % 16 AS stratum FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, stratum, size, doc_id) AS r FROM p),
e AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix' || r.key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r JOIN t ON r.key = t.key),
o AS (SELECT *, (floor(rate * r + u) - floor(rate * (r - 1) + u))::BIGINT AS copies FROM e)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM o
"""
