"""Reports of findings.  Counting, choosing and ordering is done in Spark; the driver takes rows one partition at a time and writes them on.

Nothing is left out unless the caller asks for the first `most`.  The full JSON and SARIF reports are also written by executors.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.core import SEVERITIES, finding_fingerprint, severity_rank
from gneiss.operators import findings as ops

LEVELS = {"blocking": "error", "high": "error", "medium": "warning", "low": "note", "suggestion": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _file(findings: DataFrame) -> DataFrame:
    return findings.withColumn("file", F.col("path")) if "file" not in findings.columns else findings


def first(df: DataFrame, most: int | None) -> Iterator:
    """Rows of an ordered frame, all or the first `most`, held a partition at a time."""
    return (df if most is None else df.limit(most)).toLocalIterator()


def worst_first(findings: DataFrame) -> DataFrame:
    """The most severe first, then by file, line and rule."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "rule_id")


def totals(findings: DataFrame) -> dict[str, int]:
    got = {r["severity"]: r["n"] for r in ops.severity_totals(findings).collect()}
    return {s: got.get(s, 0) for s in SEVERITIES}


def grouped(findings: DataFrame) -> DataFrame:
    """path, findings: the list of each file, in order of line and rule."""
    item = F.struct("line", "rule_id", "severity", "verdict_kind", "evidence")
    return findings.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("findings"))


def json_lines(findings: DataFrame, path: str) -> None:
    """The full report: one JSON object per file, written by the executors."""
    grouped(findings).write.mode("overwrite").json(path)


def summary(findings: DataFrame) -> dict:
    f = _file(findings)
    rows = list(first(ops.by_rule_and_file(f).orderBy(F.desc("n"), "rule_id", "file"), None))
    by = lambda key: {r[key]: r["n"] for r in rows if r[key]}
    return {"totals": totals(f), "by_rule": by("rule_id"), "by_file": by("file"), "count": next((r["n"] for r in rows if r["level"] == 3), 0)}


def full(findings: DataFrame, most: int | None = None) -> dict:
    """All findings, or the worst `most`; `count` says how many there are."""
    f = _file(findings)
    n, rows = totals(f), list(first(worst_first(f), most))
    rules = {r["rule_id"]: {"category": r["category"], "severity": r["severity"], "verdict": r["verdict_kind"]} for r in rows}
    shown = [{"file": r["path"], "line": r["line"], "rule": r["rule_id"], "severity": r["severity"], "evidence": r["evidence"]} for r in rows]
    return {"totals": n, "count": sum(n.values()), "shown": len(rows), "rules": rules, "findings": shown}


def compact(findings: DataFrame, most: int = 50) -> dict:
    """The worst findings, with what is said of a rule said once."""
    f = _file(findings)
    rows = list(first(worst_first(f), most))
    rules = {r["rule_id"]: {"severity": r["severity"], "verdict": r["verdict_kind"]} for r in rows}
    return {"totals": totals(f), "rules": rules, "findings": [{"file": r["path"], "line": r["line"], "rule": r["rule_id"]} for r in rows], "shown": len(rows)}


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, severity, file, line, result: the findings as SARIF results in JSON."""
    f = _file(findings)
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("severity")]
    text = F.when(F.coalesce("evidence", F.lit("")) == "", F.col("rule_id")).otherwise(F.col("evidence"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    prints = F.create_map(F.lit("finding/v1"), finding_fingerprint(F.col("file"), F.col("rule_id"), F.col("evidence")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), prints.alias("partialFingerprints"), F.array(place).alias("locations"))
    return f.select("rule_id", "severity", "file", "line", F.to_json(result).alias("result"))


def _sarif(results: Iterator[str], rules: list[str], tool: str) -> Iterator[str]:
    head = json.dumps({"tool": {"driver": {"name": tool, "rules": [{"id": i} for i in rules]}}})
    yield f'{{"version": "2.1.0", "$schema": "{SARIF_SCHEMA}", "runs": [{head[:-1]}, "results": ['
    for k, r in enumerate(results):
        yield ("," if k else "") + r
    yield "]}]}"


def sarif(findings: DataFrame, tool: str = "gneiss", most: int | None = None) -> str:
    rules = sorted(r["rule_id"] for r in findings.select("rule_id").distinct().collect())
    return "\n".join(_sarif((r["result"] for r in first(worst_first(sarif_results(findings)), most)), rules, tool))


def write_sarif(findings: DataFrame, path: str, tool: str = "gneiss") -> None:
    """The full report, written by the executors: one whole SARIF document per partition."""

    def document(batches):
        import pandas as pd

        rows = pd.concat([pd.DataFrame(columns=["rule_id", "result"]), *batches])
        if len(rows):
            yield pd.DataFrame({"value": ["".join(_sarif(iter(rows["result"]), sorted(set(rows["rule_id"])), tool))]})

    sarif_results(findings).select("rule_id", "result").mapInPandas(document, "value string").write.mode("overwrite").text(path)


def markdown_lines(findings: DataFrame, most: int | None = None) -> Iterator[str]:
    f = _file(findings)
    t = totals(f)
    yield from ("# Findings", "", ", ".join(f"{t[s]} {s}" for s in SEVERITIES), "", "| file | " + " | ".join(SEVERITIES) + " |", "|---|" + "---|" * len(SEVERITIES))
    for r in first(ops.counts_per_file(f).orderBy(*ops.worst_first(f), "file"), most):
        yield f"| {r['file']} | " + " | ".join(str(r[s]) for s in SEVERITIES) + " |"
    yield ""
    for r in first(worst_first(f), most):
        yield f"- `{r['path']}:{r['line']}` **{r['rule_id']}** ({r['severity']}) {r['evidence'] or ''}"


def markdown(findings: DataFrame, most: int | None = None) -> str:
    return "\n".join(markdown_lines(findings, most)) + "\n"


def html_lines(findings: DataFrame, most: int | None = None) -> Iterator[str]:
    """A directory tree with counts rolled up to each directory, and a section of findings for each file."""
    f = _file(findings)
    yield f"<!doctype html><meta charset=utf-8><table><tr><th>path</th>{''.join(f'<th>{s}</th>' for s in SEVERITIES)}</tr>"
    for r in first(ops.directory_rollup(f).orderBy("prefix"), most):
        depth = r["prefix"].count("/") + bool(r["prefix"])
        yield f"<tr><td style='padding-left:{depth}em'>{html.escape(r['prefix'].rsplit('/', 1)[-1] or '.')}</td>{''.join(f'<td>{r[s]}</td>' for s in SEVERITIES)}</tr>"
    yield "</table>"
    for r in first(grouped(f).orderBy("path"), most):
        yield f"<section><h2>{html.escape(r['path'])}</h2><ul>"
        yield from (f"<li>{x['line']} {x['rule_id']} ({x['severity']}) <code>{html.escape(x['evidence'] or '')}</code></li>" for x in r["findings"])
        yield "</ul></section>"


def html_tree(findings: DataFrame, most: int | None = None) -> str:
    return "\n".join(html_lines(findings, most))


def roll_up(files: DataFrame, findings: DataFrame, ignores: DataFrame | None = None, most: int | None = None) -> str:
    """AUDIT.md from the index, without a scan: files with most findings first."""
    f = _file(findings)
    f = f if ignores is None else ops.not_ignored(f, ignores)
    counts = ops.counts_per_file(f, files.withColumnRenamed("path", "file"))
    n = sum(F.col(s) for s in SEVERITIES)
    counts = counts.withColumn("n", n).where("n > 0")
    whole = counts.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    out = [f"# AUDIT\n\n{files.count()} files, {whole['n']} findings in {whole['files']} files\n", "| file | findings | " + " | ".join(SEVERITIES) + " |", "|---|---|" + "---|" * len(SEVERITIES)]
    out += [f"| {r['file']} | {r['n']} | " + " | ".join(str(r[s]) for s in SEVERITIES) + " |" for r in first(counts.orderBy(F.desc("n"), "file"), most)]
    return "\n".join(out) + "\n"


def status(findings: DataFrame, now: float) -> str:
    return json.dumps({"totals": totals(findings), "at": now})


def write_baseline(findings: DataFrame, path: str) -> None:
    """The bag of fingerprints, sorted, one a row."""
    ops.fingerprinted(_file(findings)).select("fingerprint").orderBy("fingerprint").write.mode("overwrite").parquet(path)


def graph_payload(nodes: DataFrame, edges: DataFrame, most: int | None = None, findings: DataFrame | None = None) -> dict:
    """The nodes, or the `most` best-ranked, with their findings, and all edges among them."""
    from gneiss.operators.graph import induced, with_findings

    top = nodes.orderBy(F.desc("rank"), "node_id")
    top = (top if most is None else top.limit(most)).checkpoint()
    kept = edges if most is None else induced(edges, top)
    shown = top if findings is None else with_findings(top, findings)
    return {"nodes": [r.asDict(True) for r in shown.orderBy(F.desc("rank"), "node_id").toLocalIterator()], "edges": [r.asDict() for r in kept.orderBy("src", "dst", "kind").toLocalIterator()]}


def dot(payload: dict) -> str:
    q = lambda s: json.dumps(str(s))
    lines = [f"  {q(n['node_id'])} [label={q(n.get('name') or n['node_id'])}];" for n in payload["nodes"]]
    return "digraph g {\n" + "\n".join(lines + [f"  {q(e['src'])} -> {q(e['dst'])} [label={q(e['kind'])}];" for e in payload["edges"]]) + "\n}\n"


PAGE = """<!doctype html><meta charset=utf-8><title>code graph</title>
<input id=q placeholder=search><select id=k><option value="">all kinds</option></select><svg id=g viewBox="-1.2 -1.2 2.4 2.4" width=900 height=900></svg><ul id=l></ul>
<script>
const data = DATA, at = new Map(), S = 'http://www.w3.org/2000/svg';
data.nodes.forEach((n, i) => { const a = 2 * Math.PI * i / data.nodes.length; at.set(n.node_id, [Math.cos(a), Math.sin(a)]); });
for (const kind of [...new Set(data.nodes.map(n => n.kind))].sort()) k.append(new Option(kind, kind));
const draw = (tag, attrs) => { const e = document.createElementNS(S, tag); for (const x in attrs) e.setAttribute(x, attrs[x]); g.append(e); return e; };
function show() {
  const seen = data.nodes.filter(n => n.node_id.toLowerCase().includes(q.value.toLowerCase()) && (!k.value || n.kind === k.value));
  const ids = new Set(seen.map(n => n.node_id)); g.replaceChildren(); l.replaceChildren();
  for (const e of data.edges) if (ids.has(e.src) && ids.has(e.dst)) { const [a, b] = at.get(e.src), [c, d] = at.get(e.dst); draw('line', { x1: a, y1: b, x2: c, y2: d, stroke: '#bbb', 'stroke-width': .002 }); }
  for (const n of seen) { const [a, b] = at.get(n.node_id); draw('circle', { cx: a, cy: b, r: .012 }).append(Object.assign(document.createElementNS(S, 'title'), { textContent: n.node_id })); l.append(Object.assign(document.createElement('li'), { textContent: n.kind + ' ' + n.node_id })); }
}
q.oninput = k.onchange = show; show();
</script>
"""


def graph_page(payload: dict) -> str:
    """One self-contained page: search, kinds, nodes on a circle and their edges."""
    return PAGE.replace("DATA", json.dumps(payload, default=str).replace("</", "<\\/"), 1)


def worst_severity(findings: DataFrame) -> int:
    return findings.agg(F.max(severity_rank(F.col("severity")))).first()[0]


# how findings are shown, by name; a plugin may add a format
REPORTERS = {
    "json": lambda findings, most=None: json.dumps(full(findings, most)), "compact": lambda findings, most=None: json.dumps(compact(findings, 50 if most is None else most)), "summary": lambda findings, most=None: json.dumps(summary(findings)),
    "sarif": lambda findings, most=None: sarif(findings), "markdown": lambda findings, most=None: markdown(findings), "html": lambda findings, most=None: html_tree(findings),
}
