"""The rule registry.  A rule maps fact tables to rows (path, line, evidence); its metadata live in the same entry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """run maps facts to hits.  A rule that is one condition on a fact also has it in `when`, with the evidence and, in
    `needs`, the pattern of an import that the file must have; such rules share one pass.  `across`: what it finds in one file
    depends on others; `units` then gives the names by which a fact is compared with others, as an array, and the rule's rows say
    theirs in `unit`, so that only what shares a name with a change is looked at again.  `beside`: kinds of facts that it also reads
    in the files of those.  `reads`: the kinds of facts that it reads, in all; none where that is not said, which means any."""

    rule_id: str
    category: str
    severity: str
    verdict: str
    language: str
    run: Callable[[DataFrame], DataFrame]
    refs: tuple[str, ...] = field(default=())
    framework: str | None = None
    when: Callable[[], tuple[Column, Column]] | None = None
    needs: str | None = None
    across: bool = False
    units: Callable[[], Column] | None = None
    beside: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()


RULES: dict[str, Rule] = {}
ENTRY_POINTS: list[str] = []  # names that the project's entry points reach; set by the audit


def rule(rule_id: str, category: str, severity: str, verdict: str = "auto", language: str = "python", refs: str = "", framework: str | None = None, when=None, needs: str | None = None, units=None, beside: tuple[str, ...] = (), reads: str = ""):
    def add(f):
        if rule_id in RULES:
            raise ValueError(f"{rule_id} is registered twice")
        RULES[rule_id] = Rule(rule_id, category, severity, verdict, language, f, tuple(refs.split()), framework, when, needs, units is not None, units, beside, tuple(reads.split()))
        return f

    return add


def load() -> dict[str, Rule]:
    """All rules.  Their predicates are column expressions, so a session must be running."""
    import gneiss.rules.outside
    import gneiss.rules.python
    import gneiss.rules.shell
    import gneiss.rules.typescript  # noqa: F401

    return RULES


def kinds_read(rules: list[Rule]) -> tuple[str, ...] | None:
    """The kinds of facts that some rules read; none if one of them does not say."""
    return tuple(sorted({k for r in rules for k in r.reads})) if all(r.reads for r in rules) else None


def one_pass(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, line, rule_id, evidence of rules that are one condition each: facts are read once for all of them."""
    items = []
    for r in rules:
        condition, evidence = r.when()
        items.append(F.when(condition, F.struct(F.lit(r.rule_id).alias("rule_id"), evidence.cast("string").alias("evidence"))))
    hits = facts.select("path", "line", F.explode(F.array_compact(F.array(*items))).alias("h")).select("path", "line", "h.*")
    needy = [r for r in rules if r.needs]
    if not needy:
        return hits
    imports = F.array_compact(F.array(*[F.when(F.col("name").rlike(r.needs), F.lit(r.rule_id)) for r in needy]))
    have = facts.where("kind = 'import'").select("path", F.explode(imports).alias("rule_id")).distinct()
    asks = F.col("rule_id").isin([r.rule_id for r in needy])
    return hits.where(~asks).unionByName(hits.where(asks).join(have, ["path", "rule_id"], "left_semi"))


def by_unit(facts: DataFrame) -> DataFrame:
    """facts with rule_id and unit: a row for each name by which a rule across files compares a fact with others."""
    named = lambda r: lambda u: F.struct(F.lit(r.rule_id).alias("rule_id"), u.alias("unit"))
    items = [F.when(F.col("language") == r.language, F.transform(r.units(), named(r))) for r in load().values() if r.across]
    return facts.withColumn("x", F.explode(F.flatten(F.array_compact(F.array(*items))))).select(*facts.columns, "x.rule_id", "x.unit")


def sharing(facts: DataFrame, units: DataFrame) -> DataFrame:
    """facts with rule_id: those that share one of units(rule_id, unit) under a rule, and those the rule reads beside them; one pass for all rules."""
    near = by_unit(facts).join(units, ["rule_id", "unit"], "left_semi").select(*facts.columns, "rule_id").checkpoint()
    out = near
    for r in load().values():
        if r.beside:
            paths = near.where(F.col("rule_id") == r.rule_id).select("path").distinct()
            out = out.unionByName(facts.where(F.col("kind").isin(*r.beside) & (F.col("language") == r.language)).join(paths, "path", "left_semi").withColumn("rule_id", F.lit(r.rule_id)))
    return out


FOUND = "path string, line int, evidence string, rule_id string, category string, severity string, verdict_kind string, unit string"


def findings(facts: DataFrame, language: str = "python", only: list[str] | None = None, across: bool | None = None) -> DataFrame:
    """path, line, evidence, rule_id, category, severity, verdict_kind, unit of all rules of a language, or of those that look across files, or not."""
    chosen = [r for r in load().values() if r.language == language and (only is None or r.rule_id in only) and across in (None, r.across)]
    if not chosen:
        return facts.sparkSession.createDataFrame([], FOUND)
    simple, parts = [r for r in chosen if r.when is not None], []
    if simple:
        parts.append(one_pass(facts, simple))
    parts += [r.run(facts).withColumn("rule_id", F.lit(r.rule_id)) for r in chosen if r.when is None]
    out = None
    for p in parts:
        p = p.select("path", F.col("line").cast("int").alias("line"), F.coalesce("evidence", F.lit("")).alias("evidence"), "rule_id", F.col("unit" if "unit" in p.columns else "path").alias("unit"))
        out = p if out is None else out.unionByName(p)
    meta = facts.sparkSession.createDataFrame([(r.rule_id, r.category, r.severity, r.verdict) for r in chosen], "rule_id string, category string, severity string, verdict_kind string")
    out = out.distinct().join(F.broadcast(meta), "rule_id")  # one row a rule
    return out.select("path", "line", "evidence", "rule_id", "category", "severity", "verdict_kind", "unit")


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(r.rule_id, r.category, r.severity, r.verdict, r.language, list(r.refs), r.framework) for r in load().values()]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, verdict_kind string, language string, refs array<string>, framework string")


def listed(rules: DataFrame, category: str | None = None, framework: str | None = None, standard: str | None = None) -> DataFrame:
    """The catalogue by category, framework or the prefix of a reference."""
    out = rules if category is None else rules.where(F.col("category") == category)
    out = out if framework is None else out.where(F.col("framework") == framework)
    return out if standard is None else out.where(F.exists("refs", lambda r: r.startswith(standard + ":")))
