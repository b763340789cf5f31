"""Output of external scanners and package manifests as findings.  The scanners run outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.core import anchor_line, basename, strip

OSV = "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string>>>>>>>"


def antivirus(lines: DataFrame, column: str = "value") -> DataFrame:
    """path, signature, heuristic from lines '<path>: <signature> FOUND'."""
    p = r"^(.*): (.+) FOUND\s*$"
    out = lines.where(F.col(column).rlike(p)).select(F.regexp_extract(column, p, 1).alias("path"), F.regexp_extract(column, p, 2).alias("signature"))
    return out.withColumn("heuristic", F.col("signature").rlike(r"^(PUA|Heuristics)\."))


def antivirus_findings(hits: DataFrame) -> DataFrame:
    rule = F.when(F.col("heuristic"), "AV-MAL-HEURISTIC").otherwise("AV-MAL-MATCH")
    severity, verdict = F.when(F.col("heuristic"), "high").otherwise("blocking"), F.when(F.col("heuristic"), "candidate").otherwise("auto")
    return hits.select("path", F.lit(1).alias("line"), F.col("signature").alias("evidence"), rule.alias("rule_id"), F.lit("malware").alias("category"), severity.alias("severity"), verdict.alias("verdict_kind"))


def vulnerabilities(reports: DataFrame, column: str = "value") -> DataFrame:
    """lockfile, package, version, ids, malicious from dependency scanner reports in JSON."""
    r = reports.select(F.from_json(column, OSV).alias("r")).select(F.explode("r.results").alias("x"))
    p = r.select(F.col("x.source.path").alias("lockfile"), F.explode("x.packages").alias("p"))
    ids = F.transform("p.vulnerabilities", lambda v: v["id"])
    out = p.select("lockfile", F.col("p.package.name").alias("package"), F.col("p.package.version").alias("version"), ids.alias("ids"))
    return out.where(F.size("ids") > 0).withColumn("malicious", F.exists("ids", lambda i: i.startswith("MAL-")))


def dependency_findings(found: DataFrame, texts: DataFrame, include_vulnerabilities: bool = False) -> DataFrame:
    """Findings on the line of the lockfile that names the package; texts(path, text)."""
    v = found if include_vulnerabilities else found.where("malicious")
    v = v.join(texts.select(F.col("path").alias("lockfile"), "text"), "lockfile", "left")
    rule = F.when(F.col("malicious"), "DEP-MAL-KNOWN").otherwise("DEP-VULN-KNOWN")
    line = F.coalesce(anchor_line(F.col("text"), F.col("package"), F.col("version")), F.lit(1))
    evidence = F.concat_ws(" ", F.concat_ws("@", "package", "version"), F.array_join("ids", ","))
    return v.select(F.col("lockfile").alias("path"), line.alias("line"), evidence.alias("evidence"), rule.alias("rule_id"), F.lit("supply-chain").alias("category"), F.when(F.col("malicious"), "blocking").otherwise("high").alias("severity"), F.when(F.col("malicious"), "auto").otherwise("candidate").alias("verdict_kind"))


def install_hooks(files: DataFrame) -> DataFrame:
    """Scripts that a package manifest runs on installation."""
    m = files.where(basename(F.col("path")) == "package.json")
    hooks = F.array(*[F.struct(F.lit(h).alias("hook"), F.get_json_object("text", f"$.scripts.{h}").alias("run")) for h in ("preinstall", "install", "postinstall")])
    rows = m.select("path", "text", F.explode(hooks).alias("h")).where(F.length(strip(F.coalesce("h.run", F.lit("")))) > 0)
    line = anchor_line(F.col("text"), F.concat(F.lit('"'), F.col("h.hook"), F.lit('"')))
    return rows.select("path", line.alias("line"), F.substring(strip(F.col("h.run")), 1, 200).alias("evidence"), F.lit("MF-SUPPLY-INSTALL-HOOK").alias("rule_id"), F.lit("supply-chain").alias("category"), F.lit("medium").alias("severity"), F.lit("candidate").alias("verdict_kind"))
