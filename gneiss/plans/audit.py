"""The audit of a file tree, in full or incremental, and its streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.facts import LANGUAGES, dealt, python, typescript  # noqa: F401
from gneiss.facts import lines as L
from gneiss.functions.core import RANKS, content_hash, severity_rank
from gneiss.operators import findings as ops
from gneiss.operators import ledger
from gneiss.rules import base
from gneiss.sources import config as C
from gneiss.sources import files as S
from gneiss.sources import scanners

COLUMNS = [f.split()[0] for f in base.FOUND.split(", ")][:-1]  # without the unit


def in_language(files: DataFrame, *names: str) -> DataFrame:
    return files.where(S.language(F.col("path")).isin(*names))


def facts_of(files: DataFrame) -> DataFrame:
    """The facts of files(path, text) in every registered language, with `language`."""
    out = None
    for name, facts in LANGUAGES.items():
        found = facts(in_language(files, name)).withColumn("language", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def kinds_in(facts: DataFrame) -> dict[str, set[str]]:
    """The kinds of facts that there are, by language: some dozens at most."""
    out: dict[str, set[str]] = {}
    for r in facts.select("language", "kind").distinct().collect():
        out.setdefault(r["language"], set()).add(r["kind"])
    return out


def applicable(language: str, kinds: dict[str, set[str]] | None) -> list[str] | None:
    """The rules of a language that read any of those kinds; the others find nothing and need not be planned.  None: all."""
    if kinds is None:
        return None
    have = kinds.get(language, set())
    return [r.rule_id for r in base.load().values() if r.language == language and have and (not r.reads or have & set(r.reads))]


def of_facts(facts: DataFrame, across: bool | None = None, kinds: dict[str, set[str]] | None = None) -> DataFrame:
    """Findings of the rules over facts; across: only those of rules that look across files, or only the others; kinds: those in facts, if known."""
    out = None
    for language in LANGUAGES:
        found = base.findings(facts.where(F.col("language") == language).drop("language"), language, applicable(language, kinds), across).select(*COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out


def of_lines(files: DataFrame) -> DataFrame:
    """Findings of the rules over lines and manifests: shell, configuration, install hooks."""
    placed = files.withColumn("language", S.language(F.col("path")))
    shell = base.findings(L.code_lines(placed.where("language = 'shell'")), "shell")
    plain = base.findings(L.lines(placed.where("language is null")), "config")
    out = shell.select(*COLUMNS).unionByName(plain.select(*COLUMNS))
    return out.unionByName(scanners.install_hooks(files).select(*COLUMNS)).unionByName(long_shell_comments(placed).select(*COLUMNS))


def raw_findings(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Findings of all rules on files(path, text), before any policy."""
    return of_facts(facts if facts is not None else facts_of(files)).unionByName(of_lines(files))


def long_shell_comments(placed: DataFrame, most: int = 3) -> DataFrame:
    sh = L.lines(placed.where("language = 'shell'"))
    comments = sh.where(F.ltrim("text").startswith("#"))
    first = sh.where(~F.ltrim("text").startswith("#") & (F.trim("text") != "")).groupBy("path").agg(F.min("line").alias("starts"))
    blocks = L.comment_blocks(comments, 2).where(F.col("prose") > most).join(first, "path").where("first > starts")
    return blocks.select("path", F.col("first").alias("line"), F.col("prose").cast("string").alias("evidence"), F.lit("SH-STYLE-LONG-COMMENT").alias("rule_id"), F.lit("style").alias("category"), F.lit("low").alias("severity"), F.lit("candidate").alias("verdict_kind"))


def directives_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Skip directives: in Python only those of real comments."""
    comments = facts.where("language = 'python' and kind = 'comment'").select("path", "line", F.col("n").alias("logical_line"))
    is_python = S.language(F.col("path")).eqNullSafe("python")
    return L.directives(files.where(is_python), comments).unionByName(L.directives(files.where(~is_python)))


def roles_of(files: DataFrame, facts: DataFrame, config: dict) -> DataFrame:
    flags = facts.where("kind = 'module' and language = 'python'").select("path", "flags")
    found = S.role(F.col("path"), F.col("text"), F.coalesce("flags", F.expr("cast(array() as array<string>)")), config.get("role_globs"))
    return files.join(flags, "path", "left").select("path", found.alias("role"))


def settings(config: dict) -> None:
    base.ENTRY_POINTS[:] = sorted(config.get("entry_points", ()))


def plan_of(spark: SparkSession, roles: DataFrame, config: dict) -> DataFrame:
    return C.plan(roles, C.matrix(spark, base.load(), config), [o.get("path", "*") for o in config.get("overrides", [])])


def under_plan(found: DataFrame, plan: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of rules that run, with the plan's severity and verdict; files not in known(path) (lockfiles, scanned trees) keep their own."""
    p = plan.select("path", "rule_id", F.col("severity").alias("s"), F.col("verdict").alias("v"))
    more = [c for c in found.columns if c not in COLUMNS]
    placed = found.join(p, ["path", "rule_id"]).select("path", "line", "evidence", "rule_id", "category", F.col("s").alias("severity"), F.col("v").alias("verdict_kind"), *more)
    return placed.unionByName(found.join(known.select("path").distinct(), "path", "left_anti").select(*placed.columns))


def outside_findings(files: DataFrame, facts: DataFrame, roles: DataFrame, antivirus: DataFrame | None, dependencies: DataFrame | None, graph: bool) -> list[DataFrame]:
    """Findings of scanners, from their output, and of the code graph."""
    out = []
    if antivirus is not None:
        out.append(scanners.antivirus_findings(scanners.antivirus(antivirus)))
    if dependencies is not None:
        out.append(scanners.dependency_findings(scanners.vulnerabilities(dependencies), files, True))
    if graph:
        from gneiss.plans import codegraph

        mine = facts.where("language = 'python'").drop("language")
        nodes, edges, _ = codegraph.build(mine, roles)
        out.append(codegraph.findings(nodes, edges, mine))
    return [f.select(*COLUMNS) for f in out]


def audit(spark: SparkSession, files: DataFrame, config: dict | None = None, ignores: DataFrame | None = None, baseline: DataFrame | None = None,
          antivirus: DataFrame | None = None, dependencies: DataFrame | None = None, graph: bool = False) -> DataFrame:
    """Findings on files(path, text) after directives, configuration, ignores and baseline, in that order.

    antivirus: lines of a scanner's output; dependencies: reports of a dependency scanner in JSON; graph: build the code graph
    and report what it shows.
    """
    config = config or {}
    settings(config)
    facts = facts_of(dealt(files, "path")).checkpoint()
    roles = roles_of(files, facts, config)
    found = L.unsuppressed(raw_findings(files, facts), directives_of(files, facts))
    for more in outside_findings(files, facts, roles, antivirus, dependencies, graph):
        found = found.unionByName(more)
    return policed(under_plan(found, plan_of(spark, roles, config), files), ignores, baseline)


def policed(found: DataFrame, ignores: DataFrame | None, baseline: DataFrame | None) -> DataFrame:
    """Findings less those that are ignored, and those of a baseline."""
    out = found.withColumn("file", F.col("path")).withColumn("seq", F.struct("path", "line", "rule_id"))
    out = out if ignores is None else ops.not_ignored(out, ignores)
    return out if baseline is None else ops.beyond_baseline(ops.fingerprinted(out), baseline).drop("fingerprint")


def audit_tree(spark: SparkSession, root: str, target: str = "", **kw) -> DataFrame:
    """The audit of the tracked files under root."""
    tree = S.read_tree(spark, root, S.tracked_files(root))
    return audit(spark, S.audited(tree.select("path", "text"), target=target), C.of_project(root), **kw)


def audit_edit(spark: SparkSession, root: str, path: str, floor: str = "high", config: dict | None = None) -> DataFrame:
    """After an edit: the findings of one file at or above a floor, of the rules that need no other file."""
    files = S.read_files(spark, root, [path])
    facts = facts_of(files)
    found = of_facts(facts, across=False).unionByName(of_lines(files))
    found = L.unsuppressed(found, directives_of(files, facts))
    config = C.of_project(root) if config is None else config
    return displayed(under_plan(found, plan_of(spark, roles_of(files, facts, config), config), files), floor).orderBy(severity_rank(F.col("severity")).desc(), "line", "rule_id")


def blocks(found: DataFrame, floor: str = "high") -> bool:
    return bool(ops.gate(found, floor).first()["failed"])


def again_across(facts: DataFrame, units: DataFrame, whole: list[str]) -> DataFrame:
    """Findings, with unit, of the rules across files for units(rule_id, unit): each rule reads the facts that share a unit, and of what it
    finds there only those units count.  Rules named in `whole` run over all facts."""
    near, out = base.sharing(facts, units).checkpoint(), None
    present = kinds_in(near)
    due = {x for language in LANGUAGES for x in applicable(language, present)} | set(whole)
    for r in base.load().values():
        if not r.across or r.rule_id not in due:
            continue
        mine = facts if r.rule_id in whole else near.where(F.col("rule_id") == r.rule_id).drop("rule_id")
        found = base.findings(mine.where(F.col("language") == r.language).drop("language"), r.language, [r.rule_id])
        found = found if r.rule_id in whole else found.join(units.where(F.col("rule_id") == r.rule_id).select("unit"), "unit", "left_semi")
        found = found.select(*COLUMNS, "unit")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else facts.sparkSession.createDataFrame([], base.FOUND).select(*COLUMNS, "unit")


def incremental(spark: SparkSession, index, repo: str, files: DataFrame, config: dict | None = None, whole: bool = True, versions: dict[str, str] | None = None,
                antivirus: DataFrame | None = None, dependencies: DataFrame | None = None, graph: bool = False, removed: DataFrame | None = None) -> DataFrame:
    """Runs only what has changed, and returns the repository's findings: those that a full audit would give.

    Changed files are parsed, and their facts take the place of the old ones.  A rule of one file runs on it again if the file or the
    rule's fingerprint changed.  A rule across files compares facts by units (a name, a signature); the units of the changed files' old and
    new facts are looked at again, over the facts of all files that share one, and their old findings are retracted.  So what is
    shuffled grows with the units that a change touches, and a change of such a rule's fingerprint runs it over all facts.
    whole: files are the whole repository, and what is not among them is pruned; else they are added to what is known, less the paths of
    removed(path).
    versions: what else a rule's results depend on, as {rule: version of a scanner and its signatures}.
    Findings of scanners and of the graph are those of this run.
    """
    config = config or {}
    settings(config)
    rules = base.load()
    hashes = files.select("path", content_hash(F.col("text")).alias("sha")).checkpoint()
    seen = index.read("files", repo).select("path", F.col("sha256").alias("sha")).checkpoint()
    stale = ledger.stale_facts(hashes, seen.withColumnRenamed("sha", "content_hash")).checkpoint()
    gone = seen.select("path").join(hashes, "path", "left_anti").checkpoint() if whole else seen.select("path").limit(0)
    if removed is not None and not whole:
        gone = seen.select("path").join(removed, "path", "left_semi").join(hashes, "path", "left_anti").checkpoint()
    touched = stale.unionByName(gone).distinct()
    changed = dealt(files.join(stale, "path", "left_semi"), "path")
    known = hashes.select("path") if whole else hashes.select("path").union(seen.select("path")).distinct().join(gone, "path", "left_anti")
    before = index.read("facts", repo).drop("repo").join(touched, "path", "left_semi").checkpoint()
    fresh = facts_of(changed).checkpoint()
    index.put("facts", repo, fresh, touched)
    index.put("directives", repo, directives_of(changed, fresh), touched)
    facts, dirs = index.read("facts", repo).drop("repo"), index.read("directives", repo).drop("repo")

    roles = roles_of(files, facts, config).checkpoint()
    plan = ledger.with_versions(plan_of(spark, roles, config), versions).checkpoint()
    done = index.read("file_rules", repo).drop("repo")
    todo = ledger.missed_rules(hashes, plan, seen, done).checkpoint()
    again = todo.select("path").distinct()
    read_again = facts.join(again, "path", "left_semi").checkpoint()
    mine = of_facts(read_again, False, kinds_in(read_again)).unionByName(of_lines(files.join(again, "path", "left_semi")))
    mine = mine.join(todo.select("path", "rule_id"), ["path", "rule_id"], "left_semi").withColumn("unit", F.col("path"))

    across = [r for r in rules.values() if r.across]
    stored = index.read("findings", repo).drop("repo")
    # rules that no longer run on a file, with what they had found or done there
    off = lambda df: df.join(hashes.select("path"), "path", "left_semi").join(plan.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_anti")
    lost = off(stored).select("rule_id", "unit")
    changed_rules = [r["rule_id"] for r in todo.where((F.col("reason") == "rule") & F.col("rule_id").isin([r.rule_id for r in across])).select("rule_id").distinct().collect()]  # at most one a rule
    both = before.unionByName(fresh)
    units = lost.where(F.col("rule_id").isin([r.rule_id for r in across])).unionByName(stored.where(F.col("rule_id").isin(changed_rules)).select("rule_id", "unit"))
    units = units.unionByName(base.by_unit(both).select("rule_id", "unit")).distinct().checkpoint()
    in_force = plan.select("path", "rule_id", "severity", "verdict")
    in_force = in_force.unionByName(done.join(known, "path", "left_semi").join(hashes, "path", "left_anti").select(*in_force.columns))
    found = L.unsuppressed(mine.unionByName(again_across(facts, units, changed_rules)), dirs)
    outside = [r.rule_id for r in rules.values() if r.rule_id.split("-")[0] in OUTSIDE]
    for more in outside_findings(files, facts, roles, antivirus, dependencies, graph):
        found = found.unionByName(more.withColumn("unit", F.col("path")))
    found = under_plan(found, in_force, known).checkpoint()
    retracted = todo.select("rule_id", F.col("path").alias("unit")).unionByName(units).unionByName(lost)
    retracted = retracted.unionByName(stored.join(gone, "path", "left_semi").select("rule_id", "unit")).unionByName(stored.where(F.col("rule_id").isin(outside)).select("rule_id", "unit")).checkpoint()

    now = F.current_timestamp()
    ran = plan.join(todo.select("path", "rule_id"), ["path", "rule_id"]).select("path", "rule_id", "fingerprint", "severity", "verdict", now.alias("last_scanned")).checkpoint()
    idle = off(done).select("path", "rule_id").unionByName(done.join(gone, "path", "left_semi").select("path", "rule_id")).checkpoint()
    meta = files.join(stale, "path", "left_semi").select("path", content_hash(F.col("text")).alias("sha256"), F.size(F.split("text", "\n")).alias("lines"), S.language(F.col("path")).alias("language"), now.alias("last_scanned"))
    index.put("findings", repo, found, retracted)
    index.put("file_rules", repo, ran, idle)
    index.put("files", repo, meta.join(roles.select("path", "role"), "path"), gone)
    return index.read("findings", repo)


OUTSIDE = ("AV", "DEP", "GRAPH")  # prefixes of rules whose findings come from scanners and the graph


def displayed(found: DataFrame, floor: str | None = None, rules: tuple[str, ...] = (), only: DataFrame | None = None) -> DataFrame:
    """Display filters: they come after the gate and change nothing else."""
    out = found if floor is None else found.where(severity_rank(F.col("severity")) >= RANKS[floor])
    out = out.where(F.col("rule_id").isin(*rules)) if rules else out
    return out if only is None else out.join(only, "path", "left_semi")
