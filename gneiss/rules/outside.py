"""Rules that are no predicate over facts: their findings are made by scanners, manifests and the code graph, and join in plans.audit.

Here they have their catalogue entry; as rules over facts they find nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.rules.base import rule


def _elsewhere(facts):
    return facts.limit(0).withColumn("evidence", F.lit(""))


for _id, _category, _severity, _verdict in (
    ("AV-MAL-MATCH", "malware", "blocking", "auto"),
    ("AV-MAL-HEURISTIC", "malware", "high", "candidate"),
    ("DEP-MAL-KNOWN", "supply-chain", "blocking", "auto"),
    ("DEP-VULN-KNOWN", "supply-chain", "high", "candidate"),
    ("MF-SUPPLY-INSTALL-HOOK", "supply-chain", "medium", "candidate"),
    ("SH-STYLE-LONG-COMMENT", "style", "low", "candidate"),
    ("GRAPH-GOD-CONCEPT", "oop-composition", "suggestion", "candidate"),
    ("GRAPH-SCATTERED-CONCEPT", "oop-composition", "suggestion", "candidate"),
    ("GRAPH-NAMING-INCONSISTENCY", "style", "suggestion", "candidate"),
):
    rule(_id, _category, _severity, _verdict, "elsewhere")(_elsewhere)
