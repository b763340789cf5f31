"""Command line: python -m gneiss.cli COMMAND ... ; each command is a short plan over the library."""

from __future__ import annotations

import argparse
import difflib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gneiss
from gneiss.facts import profile
from gneiss.facts import python as P
from gneiss.functions.core import SEVERITIES, evidence_hash
from gneiss.operators import findings as ops
from gneiss.operators import graph
from gneiss.plans import audit as A
from gneiss.plans import codegraph, plugins
from gneiss.rules import base
from gneiss.sources import config as C
from gneiss.sources import files as S
from gneiss.sources import reports as R
from gneiss.sources.index import Index


def session() -> SparkSession:
    spark = SparkSession.builder.appName("gneiss").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    gneiss.ship(spark)
    gneiss.checkpoints(spark)
    return spark


def tree(spark: SparkSession, args) -> DataFrame:
    only = None if args.all_files else S.tracked_files(args.root)
    return S.audited(S.read_tree(spark, args.root, only).select("path", "text"), target=args.target or "", vendored=args.vendored)


def rows(df: DataFrame, n: int | None = None) -> list[dict]:
    """All rows, or the first n; held a partition at a time on their way."""
    return [json.loads(x) for x in (df if n is None else df.limit(n)).toJSON().toLocalIterator()]


def known_rules(spark, names: list[str]) -> list[str]:
    """The names, or an error that says what may have been meant."""
    for n in names:
        if n not in base.load():
            near = difflib.get_close_matches(n, list(base.load()), 1, 0.6)
            raise SystemExit(f"unknown rule {n}" + (f"; did you mean {near[0]}?" if near else ""))
    return names


def scan(spark, args) -> int:
    config = C.of_project(args.root)
    plugins.load(config, args.root)
    index = Index(spark, args.index) if args.index else None
    ignores = index.read("ignores", args.repo) if index else None
    baseline = spark.read.parquet(args.baseline) if args.baseline else None
    outside = {"antivirus": spark.read.text(args.antivirus) if args.antivirus else None, "dependencies": spark.read.text(args.dependencies, wholetext=True) if args.dependencies else None}
    files = tree(spark, args)
    if index:  # only changed files are parsed; a target is a part of the tree, so nothing is pruned then
        raw = A.incremental(spark, index, args.repo, files, config, whole=not args.target, versions=dict(args.versions), graph=args.graph, **outside)
        raw = raw.join(files.select("path").distinct(), "path", "left_semi") if args.target else raw
        found = A.policed(raw.drop("repo", "unit"), ignores, baseline).drop("seq").checkpoint()
    else:
        found = A.audit(spark, files, config, ignores, baseline, graph=args.graph, **outside).drop("seq").checkpoint()
    if args.write_baseline:
        R.write_baseline(found, args.write_baseline)
    failed = bool(args.fail_on) and A.blocks(found, args.fail_on)
    only = None
    if args.changed_since is not None:
        changed = S.changed_files(args.root, args.changed_since or S.default_base(args.root) or "HEAD")
        only = S.paths_frame(spark, changed or [])
    shown = A.displayed(found, args.min_severity, tuple(known_rules(spark, args.rule)), only)
    print(R.REPORTERS[args.format](shown, args.limit))
    return int(failed)


def edit(spark, args) -> int:
    """One file after an edit: its findings at or above a floor; the exit code says whether there are any."""
    found = rows(A.audit_edit(spark, args.root, args.path, args.min_severity))
    print(json.dumps(found))
    return int(bool(found))


def detail(spark, args) -> int:
    """What is known of a finding: from the index, else from a new look at the file."""
    known_rules(spark, [args.rule])
    found = rows(ops.detail(Index(spark, args.index).read("findings", args.repo), args.path, args.rule, args.line))
    print(json.dumps(found or rows(ops.detail(A.audit_edit(spark, args.root, args.path, SEVERITIES[-1]), args.path, args.rule, args.line))))
    return 0


def report(spark, args) -> int:
    f = Index(spark, args.index).read("findings", args.repo)
    print(R.REPORTERS[args.format](f, args.limit))
    return 0


def discover(spark, args) -> int:
    files = tree(spark, args)
    placed = files.select("path", S.language(F.col("path")).alias("language"), S.role(F.col("path"), F.col("text")).alias("role"))
    placed = placed.where(F.col("role") == args.role) if args.role else placed
    print(json.dumps({"roles": {r["role"]: r["n"] for r in ops.histogram(placed, "role").collect()}, "files": rows(placed.orderBy("path"))}))
    return 0


def manifest(spark, args) -> int:
    print(json.dumps(rows(profile.manifest(A.facts_of(tree(spark, args)).drop("language")).orderBy("path", "line"))))
    return 0


def aggregate(spark, args) -> int:
    index = Index(spark, args.index)
    files = index.read("files", args.repo).select("path")
    found = index.read("findings", args.repo)
    print(R.roll_up(files.union(found.select("path")).distinct(), found, index.read("ignores", args.repo)))
    return 0


def rules(spark, args) -> int:
    c = base.listed(base.catalogue(spark), args.category, args.framework, args.standard)
    print(json.dumps(rows(c.orderBy("rule_id"))))
    return 0


def registry(spark, args) -> int:
    """What is registered: rules by language and category, languages with facts, reporters, plugins that load."""
    config = C.load(args.root)
    counts = base.catalogue(spark).groupBy("language", "category").count().orderBy("language", "category")
    print(json.dumps({"rules": rows(counts), "languages": sorted(A.LANGUAGES), "reporters": sorted(R.REPORTERS), "plugins": plugins.load(config, args.root)}))
    return 0


def ignore(spark, args) -> int:
    index = Index(spark, args.index)
    if args.action == "add":
        known_rules(spark, [args.rule])
        row = spark.createDataFrame([(args.rule, args.file, args.line, args.evidence, args.reason)], "rule_id string, file string, line long, e string, reason string")
        row = row.select("rule_id", "file", "line", F.when(F.col("e").isNotNull(), evidence_hash(F.col("e"))).alias("evidence_hash"), "reason", F.current_timestamp().alias("created_at"))
        old = index.read("ignores", args.repo).drop("repo")
        same = (F.col("rule_id") == args.rule) & F.col("file").eqNullSafe(F.lit(args.file)) & F.col("line").eqNullSafe(F.lit(args.line).cast("long"))
        index.replace("ignores", args.repo, old.where(~same).unionByName(row))
    elif args.action in ("rm", "clear"):
        keep = F.lit(False) if args.action == "clear" else F.col("rule_id") != args.rule
        left = index.read("ignores", args.repo).where(keep).drop("repo")
        index.forget_table("ignores", args.repo) if left.isEmpty() else index.replace("ignores", args.repo, left)
    print(json.dumps(rows(index.read("ignores", args.repo))))
    return 0


def index_command(spark, args) -> int:
    index = Index(spark, args.index)
    if args.action == "forget":
        index.forget(args.repo)
    print(json.dumps(rows(ops.counts_per_file(index.read("findings", args.repo).withColumn("file", F.col("path"))).orderBy("file"))))
    return 0


def graph_command(spark, args) -> int:
    files = tree(spark, args).where(S.language(F.col("path")) == "python")
    nodes, edges, named = codegraph.current(spark, Index(spark, args.index), args.repo, files) if args.index else codegraph.build(P.facts(files).checkpoint())
    if args.action == "build":
        out = {"nodes": nodes.count(), "edges": edges.count(), "clusters": named.count()}
    elif args.action == "overview":
        out = graph.overview(nodes, edges, named, graph.god_concepts(nodes, edges))
    elif args.action == "search":
        out = rows(graph.search(nodes, args.symbol, args.limit or 20))
    elif args.action == "clusters":
        out = rows(named.orderBy(F.desc("member_count"), "cluster_id"), args.limit)
    elif args.action == "concept":
        out = rows(graph.concept(nodes, named, args.symbol), args.limit)
    elif args.action in ("export", "ego", "cluster"):
        if args.action == "export":
            view = graph.visible(nodes, edges, args.kind, args.symbol)
        elif args.action == "ego":
            view = graph.ego(nodes, edges, graph.resolve(nodes, args.symbol).select("node_id"), args.depth)
        else:
            view = graph.cluster_subgraph(nodes, edges, int(args.symbol))
        payload = R.graph_payload(*view, args.most)
        print({"dot": lambda: R.dot(payload), "text": lambda: graph.outline(payload["nodes"], payload["edges"]), "json": lambda: json.dumps(payload, default=str), "html": lambda: R.graph_page(payload)}[args.format]())
        return 0
    else:
        found = [r["node_id"] for r in graph.resolve(nodes, args.symbol).orderBy(F.desc("rank"), "node_id").select("node_id").collect()]
        if not found:
            out = {}
        elif args.action == "related":
            out = rows(graph.related(nodes, edges, found[0], args.limit or 10))
        elif args.action == "usages":
            out = {"resolved": found[0], "ambiguous": found[1:], "usages": rows(graph.usages(nodes, edges, found[0]))}
        else:
            seed = spark.createDataFrame([(found[0],)], "node_id string")
            out = rows(graph.neighbors(edges, seed, args.depth).where("hops > 0").join(nodes.select("node_id", "kind"), "node_id", "left").orderBy("hops", "node_id"), args.limit)
    print(json.dumps(out, default=str))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gneiss")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *, index=False, target=True):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        if target:
            s.add_argument("root")
            s.add_argument("--target", default="")
            s.add_argument("--all-files", action="store_true", help="also files that git ignores")
            s.add_argument("--vendored", action="store_true", help="also installed and built packages")
        s.add_argument("--index", required=index, default=None)
        s.add_argument("--repo", default="default")
        s.add_argument("--limit", type=int, help="only so many rows; all where it is not given (20 of a search, 10 of what is related)")
        return s

    s = add("scan", scan)
    s.add_argument("--format", choices=list(R.REPORTERS), default="markdown")
    s.add_argument("--min-severity", choices=SEVERITIES)
    s.add_argument("--fail-on", choices=SEVERITIES)
    s.add_argument("--rule", action="append", default=[])
    s.add_argument("--baseline")
    s.add_argument("--write-baseline")
    s.add_argument("--changed-since", nargs="?", const="")
    s.add_argument("--antivirus", help="file with the output of a scanner")
    s.add_argument("--dependencies", help="report of a dependency scanner in JSON")
    s.add_argument("--graph", action="store_true", help="build the code graph and report what it shows")
    s.add_argument("--versions", action="append", default=[], type=lambda x: tuple(x.split("=", 1)), metavar="RULE=VERSION", help="version of a scanner that a rule relies on")
    s = add("edit", edit)
    s.add_argument("path")
    s.add_argument("--min-severity", choices=SEVERITIES, default="high")
    s = add("detail", detail, index=True)
    s.add_argument("path")
    s.add_argument("rule")
    s.add_argument("--line", type=int)
    add("report", report, index=True, target=False).add_argument("--format", choices=list(R.REPORTERS), default="markdown")
    add("discover", discover).add_argument("--role")
    add("manifest", manifest)
    add("aggregate", aggregate, index=True, target=False)
    s = add("rules", rules, target=False)
    for o in ("category", "framework", "standard"):
        s.add_argument(f"--{o}")
    add("registry", registry)
    s = add("ignore", ignore, index=True, target=False)
    s.add_argument("action", choices=["add", "list", "rm", "clear"])
    s.add_argument("rule", nargs="?")
    for o in ("file", "evidence", "reason"):
        s.add_argument(f"--{o}")
    s.add_argument("--line", type=int)
    add("index", index_command, index=True, target=False).add_argument("action", choices=["list", "forget"])
    s = add("graph", graph_command)
    s.add_argument("action", choices=["build", "overview", "search", "usages", "neighbors", "related", "concept", "clusters", "export", "ego", "cluster"])
    s.add_argument("symbol", nargs="?", default="")
    s.add_argument("--depth", type=int, default=1)
    s.add_argument("--format", choices=["dot", "text", "json", "html"], default="dot")
    s.add_argument("--kind", action="append", default=[])
    s.add_argument("--most", type=int, help="only the best ranked nodes")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or session(), args)


if __name__ == "__main__":
    sys.exit(main())
