"""Lines and directives of text files, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the suppression directive in a # or // comment: any tool's word and ": skip" or ": skip-file", but for words of formatters and notes
DIRECTIVE = r"(?i)(?:#|//)\s*(?!(?:isort|fmt|yapf|black|ruff|pylint|mypy|pytest|todo|note|fixme|xxx)\s*:)[a-z][\w-]*\s*:\s*skip(-file)?\b(?:\s*:\s*([A-Za-z0-9,\s_-]+))?"


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """path, line, text and the kept columns; line ends are LF, CR LF or CR, a final one opens no line."""
    body = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n$", "")
    some = files.where(F.length(F.coalesce("text", F.lit(""))) > 0)
    return some.select("path", *keep, F.posexplode(F.split(body, "\n", -1)).alias("i", "t")).select("path", *keep, (F.col("i") + 1).alias("line"), F.col("t").alias("text"))


def code_lines(files: DataFrame, comment: str = "#") -> DataFrame:
    """Lines that are not wholly a comment."""
    return lines(files).where(~F.ltrim("text").startswith(comment))


def codes(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, r"[,\s]+"), lambda c: F.upper(F.trim(c))), lambda c: c != "")


def directives(files: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """path, line, whole_file, codes (empty: all rules).

    comments(path, line, logical_line) limits directives to real comments and adds the line on which the statement
    around a comment begins.
    """
    hits = lines(files).where(F.col("text").rlike(DIRECTIVE))
    if comments is not None:
        hits = hits.join(comments.select("path", "line", "logical_line"), ["path", "line"])
    else:
        hits = hits.withColumn("logical_line", F.col("line"))
    whole = F.regexp_extract("text", DIRECTIVE, 1) != ""
    out = hits.select("path", F.explode(F.array_distinct(F.array("line", "logical_line"))).alias("line"), whole.alias("whole_file"), codes(F.regexp_extract("text", DIRECTIVE, 2)).alias("codes"))
    return out.distinct()


def unsuppressed(findings: DataFrame, dirs: DataFrame) -> DataFrame:
    """findings(path, line, rule_id, ...) that no directive of their line or file covers."""
    d = dirs.select(F.col("path").alias("d_path"), F.col("line").alias("d_line"), "whole_file", "codes")
    on = (F.col("path") == F.col("d_path")) & (F.col("whole_file") | (F.col("line") == F.col("d_line"))) & ((F.size("codes") == 0) | F.array_contains("codes", F.upper("rule_id")))
    return findings.join(d, on, "left_anti")


def comment_blocks(comments: DataFrame, least_words: int = 1) -> DataFrame:
    """path, first, last, prose from comments(path, line, text): runs of consecutive standalone comment lines."""
    from gneiss.operators.findings import runs

    prose = comments.where(F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}"), F.lit(0))) >= least_words)
    blocks = runs(comments.select("path", "line"), ["path"])
    joined = prose.select("path", F.col("line").alias("at")).join(blocks, "path").where("at between first and last")
    return joined.groupBy("path", "first", "last").agg(F.count(F.lit(1)).alias("prose"))
