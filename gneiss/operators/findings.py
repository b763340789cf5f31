"""Findings as rows: counts, orders, filters, baseline, ignores and the gate.

Findings have at least file, rule_id, severity, and where needed verdict_kind, line, evidence, seq (scan order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.core import RANKS, SEVERITIES, evidence_hash, finding_fingerprint, severity_rank
from gneiss.operators.ranks import numbered


def counts_per_file(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file and a zero-filled count per severity; with `files` also files without a finding."""
    per = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    out = findings.groupBy("file").agg(*per)
    if files is not None:
        out = files.select("file").join(out, "file", "left").na.fill(0, list(SEVERITIES))
    return out


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def by_rule_and_file(findings: DataFrame) -> DataFrame:
    """Counts by rule, by file and in total, in one pass over grouping sets."""
    sets = findings.groupingSets([["rule_id"], ["file"], []], "rule_id", "file")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def scan_totals(results: DataFrame) -> DataFrame:
    """One row from results(suppressed, ignored, n_findings)."""
    return results.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_findings", "suppressed", "ignored")])


def worst_first(findings: DataFrame) -> list[Column]:
    return [F.desc(s) for s in SEVERITIES]


def ranked_files(findings: DataFrame) -> DataFrame:
    """Files with their place, most severe first (lexicographic over severities), ties by name."""
    counts = counts_per_file(findings)
    placed = numbered(counts, [*worst_first(counts), F.col("file")], "place")
    return placed.select("file", *SEVERITIES, F.col("place").cast("int").alias("place"))


def worst_files(findings: DataFrame, n: int) -> DataFrame:
    counts = counts_per_file(findings)
    return counts.orderBy(*worst_first(findings), "file").limit(n)


def busiest_files(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(n)


def most_severe(findings: DataFrame, n: int) -> DataFrame:
    """The n most severe findings; ties keep file and scan order."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "seq").limit(n)


def at_least(findings: DataFrame, floor: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= RANKS[floor])


def with_severities(findings: DataFrame, *severities: str) -> DataFrame:
    return findings.where(F.col("severity").isin(*severities))


def gate(findings: DataFrame, floor: str) -> DataFrame:
    """One row: whether an automatic finding at or above the floor exists."""
    hit = (F.col("verdict_kind") == "auto") & (severity_rank(F.col("severity")) >= RANKS[floor])
    return findings.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("failed"), F.count(F.when(hit, 1)).alias("n"))


def fingerprinted(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", finding_fingerprint(F.col("file"), F.col("rule_id"), F.col("evidence")))


def beyond_baseline(findings: DataFrame, baseline: DataFrame, order: str = "seq") -> DataFrame:
    """Findings after as many per fingerprint as the baseline holds are taken off, in scan order (multiset difference)."""
    held = baseline.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("held"))
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy(order))
    out = findings.withColumn("_n", n).join(held, "fingerprint", "left")
    return out.where(F.col("_n") > F.coalesce("held", F.lit(0))).drop("_n", "held")


def ignored_mask(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """findings with `ignored`: some rule of ignores(rule_id, file, line, evidence_hash) covers it.

    A rule covers by rule id, then by file if it has one, then by line: by the evidence's hash where the rule has
    one, else by number.
    """
    entry = F.struct("file", "line", "evidence_hash")
    i = ignores.groupBy("rule_id").agg(F.collect_set(entry).alias("_covers"))  # written by hand: few a rule
    here = lambda e: F.when(e["evidence_hash"].isNotNull(), e["evidence_hash"] == evidence_hash(F.col("evidence"))).otherwise(e["line"] == F.col("line"))
    covers = F.exists("_covers", lambda e: (e["file"].isNull() | (e["file"] == F.col("file"))) & (e["line"].isNull() | here(e)))
    return findings.join(i, "rule_id", "left").withColumn("ignored", F.coalesce(covers, F.lit(False))).select(*findings.columns, "ignored")


def not_ignored(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    return ignored_mask(findings, ignores).where(~F.col("ignored")).drop("ignored")


def detail(findings: DataFrame, file: str, rule_id: str, line: int | None = None) -> DataFrame:
    """The findings of a rule in a file, of one line if that is given."""
    out = findings.where((F.col("path") == file) & (F.col("rule_id") == rule_id))
    return (out if line is None else out.where(F.col("line") == line)).orderBy("line")


def directory_rollup(findings: DataFrame) -> DataFrame:
    """Counts per severity for every directory above a finding; the root is the empty path."""
    parts = F.split("file", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    per = findings.groupBy("file").agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])
    return per.select(F.explode(above).alias("prefix"), *SEVERITIES).groupBy("prefix").agg(*[F.sum(s).alias(s) for s in SEVERITIES])


def runs(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Runs of consecutive line numbers per key: first, last, length (gaps and islands)."""
    island = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return lines.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")).where(F.col("place") <= k)


def first_match(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("place")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def read_after_commit(events: DataFrame) -> DataFrame:
    """Attribute reads after a commit that expired the object: as-of plus range, in one ordered pass per function.

    events(path, fn, name, line, what): what is bind or refresh (of a name), access (of a name) or commit (name null).  For
    each access the latest bind or refresh before it is found; it is reported if a commit lies between.
    """
    accesses = events.where("what <> 'commit'")
    before = Window.partitionBy("path", "fn", "name").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    bound = F.max(F.when(F.col("what").isin("bind", "refresh"), F.col("line"))).over(before)
    a = accesses.withColumn("since", F.coalesce(bound, F.lit(0))).where("what = 'access'")
    c = events.where("what = 'commit'").select("path", "fn", F.col("line").alias("committed"))
    on = (a["path"] == c["path"]) & (a["fn"] == c["fn"]) & (c["committed"] > a["since"]) & (c["committed"] < a["line"])
    return a.join(c, on, "left_semi").select("path", "fn", "name", "line")
