"""More operators on the test tables and on small fixtures, each with the same query, or the rows it must give, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import core as C
from gneiss.operators import communities, crossfile, findings, graph, ledger, patterns, resolve
from gneiss.plans.tables import EDGES_SQL, F_SQL, L_SQL, NODES_SQL, document_lines, event_findings, query, star_graph, table


def values(columns: str, rows: list[tuple]) -> str:
    """SELECT of fixed rows."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def text(c) -> F.Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- paths, roles, configuration

PLACES = ("src", "node_modules/x", "app/migrations", "tests", "build/lib", "alembic/versions", "docs/node_modules.d")
SUFFIXES = (".py", ".d.ts", "_pb2.py", ".tsx", ".sh", ".md")
PATH_SQL = f"""p AS (SELECT concat({list(PLACES)}[p_size % {len(PLACES)} + 1], '/f', p_partkey, {list(SUFFIXES)}[p_partkey % {len(SUFFIXES)} + 1]) AS path, p_partkey, p_size FROM part)"""


def part_paths(spark, sf) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    path = F.concat(pick(PLACES, F.col("p_size")), F.lit("/f"), text("p_partkey"), pick(SUFFIXES, F.col("p_partkey")))
    return table(spark, sf, "part").select(path.alias("path"), "p_partkey", "p_size")


@query(f"""WITH {PATH_SQL} SELECT path FROM p WHERE NOT regexp_matches(path, '(^|/)(node_modules|build)/') AND NOT regexp_matches(path, '([.]d[.]ts|_pb2[.]py)$') AND NOT regexp_matches(path, '(^|/)(migrations/|alembic/versions/)')""")
def audited_files(spark, sf):
    from gneiss.sources.files import audited

    return audited(part_paths(spark, sf)).select("path")


@query(f"WITH {PATH_SQL} SELECT path FROM p WHERE regexp_matches(path, '^app/migrations/') AND NOT regexp_matches(path, '([.]d[.]ts|_pb2[.]py)$')")
def audited_target(spark, sf):
    from gneiss.sources.files import audited

    return audited(part_paths(spark, sf), target="app/migrations").select("path")


@query(f"WITH {PATH_SQL} SELECT path, CASE WHEN regexp_matches(path, '[.]py$') THEN 'python' WHEN regexp_matches(path, '[.]tsx?$') THEN 'typescript' WHEN regexp_matches(path, '[.]sh$') THEN 'shell' END AS language FROM p")
def file_languages(spark, sf):
    from gneiss.sources.files import language

    return part_paths(spark, sf).select("path", language(F.col("path")).alias("language"))


@query(f"""WITH {PATH_SQL} SELECT path, CASE WHEN p_partkey % 10 = 0 THEN 'generated' WHEN regexp_matches(path, '_pb2[.]py$') OR p_size % 4 = 0 THEN 'generated' WHEN regexp_matches(path, '^tests/.*[.]py$') THEN CASE WHEN p_size % 4 = 1 THEN 'test' ELSE 'test_support' END
  WHEN p_size % 4 = 2 THEN 'script' ELSE 'production' END AS role FROM p""")
def file_roles(spark, sf):
    from gneiss.sources.files import role

    body = F.element_at(F.array(*[F.lit(x) for x in ("# Generated by x\n", "def test_a():\n    pass\n", "if __name__ == '__main__':\n    go()\n", "x = 1\n")]), (F.col("p_size") % 4 + 1).cast("int"))
    p = part_paths(spark, sf)
    return p.select("path", role(F.col("path"), body, overrides={"generated": ["*0.py", "*0.d.ts", "*0_pb2.py", "*0.tsx", "*0.sh", "*0.md"]}).alias("role"))


@query(f"""WITH {PATH_SQL}, r(rule_id, severity) AS (VALUES ('R1', 'low'), ('R2', 'medium'), ('R3', 'high')), x AS (SELECT path, rule_id, severity, path LIKE 'src/%' AS o, path LIKE 'tests/%' AS t FROM p, r)
SELECT path, rule_id, CASE WHEN rule_id = 'R1' THEN CASE WHEN o THEN 'blocking' ELSE 'medium' END ELSE severity END AS severity, CASE WHEN rule_id = 'R2' THEN 'auto' ELSE 'candidate' END AS verdict
FROM x WHERE NOT (rule_id = 'R3' AND t) AND NOT (rule_id = 'R2' AND o)""")
def rules_in_force(spark, sf):
    from gneiss.rules.base import Rule
    from gneiss.sources import config

    rules = {i: Rule(i, c, s, "candidate", "python", None) for i, c, s in (("R1", "style", "low"), ("R2", "security", "medium"), ("R3", "security", "high"))}
    settings = {
        "categories": {"style": {"min_severity": "medium"}}, "rules": {"R2": {"verdict": "auto"}}, "roles": {"test": {"disable": ["R3*"]}},
        "overrides": [{"path": "src/*", "rules": {"R1": {"severity": "blocking"}, "R2": {"enabled": False}}}],
    }
    files = part_paths(spark, sf).select("path", F.when(F.col("path").startswith("tests/"), "test").otherwise("production").alias("role"))
    return config.plan(files, config.matrix(spark, rules, settings), ["src/*"]).select("path", "rule_id", "severity", "verdict")


@query("""SELECT p_partkey, concat('{"a": {"b": ', p_size, ', "c": ["', p_brand, '"]}, "d": "', p_name, '"}') AS merged, true AS one, true AS same, p_size <> 7 AS other FROM part""")
def configuration_layers(spark, sf):
    """Two layers of settings per row of part, merged, and fingerprints of what is in force: the order of keys does not matter, values do."""
    import json

    from gneiss.sources.config import deep_merge, rule_fingerprint

    def layered(batches):
        for pdf in batches:
            merged = [json.dumps(deep_merge({"a": {"b": int(n), "c": [int(k)]}}, {"a": {"c": [brand]}, "d": name})) for k, n, brand, name in zip(pdf.p_partkey, pdf.p_size, pdf.p_brand, pdf.p_name, strict=True)]
            prints = [(rule_fingerprint("1", {"x": 1, "y": int(n)}), rule_fingerprint("1", {"y": int(n), "x": 1}), rule_fingerprint("1", {"x": 1, "y": 7})) for n in pdf.p_size]
            yield pdf[["p_partkey"]].assign(merged=merged, one=[len(p[0]) == 16 for p in prints], same=[p[0] == p[1] for p in prints], other=[p[0] != p[2] for p in prints])

    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    return rows.mapInPandas(layered, "p_partkey long, merged string, one boolean, same boolean, other boolean")


@query(f"""WITH {F_SQL}, d AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM f) SELECT file, line FROM d WHERE NOT (line % 7 = 0) AND NOT (line % 5 = 0 AND rule_id IN ('view', 'click'))""")
def without_directives(spark, sf):
    from gneiss.facts import lines

    f = event_findings(spark, sf).withColumn("path", text("line")).withColumn("at", F.col("line")).withColumn("line", F.lit(1))
    note = F.when(F.col("at") % 7 == 0, "x = 1  # tool: skip").when(F.col("at") % 5 == 0, "y = 2  # tool: skip: VIEW, click").otherwise("z = 3  # fmt: skip")
    dirs = lines.directives(f.select("path", note.alias("text")))
    return lines.unsuppressed(f, dirs).select("file", F.col("at").alias("line"))


@query(f"""WITH {L_SQL}, c AS (SELECT doc_id, line_no, line FROM l WHERE contains(line, ',')), r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM c)
SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) FILTER (len(regexp_extract_all(line, '[A-Za-z]{{2,}}')) >= 2) AS prose FROM r GROUP BY doc_id, g HAVING count(*) FILTER (len(regexp_extract_all(line, '[A-Za-z]{{2,}}')) >= 2) > 0""")
def comment_blocks(spark, sf):
    from gneiss.facts import lines

    c = document_lines(spark, sf).where(F.col("line").contains(",")).select(F.col("doc_id").alias("path"), F.col("line_no").cast("long").alias("line"), F.col("line").alias("text"))
    return lines.comment_blocks(c, 2).select(F.col("path").alias("doc_id"), "first", "last", "prose")


# ---------------------------------------------------------------- column functions


@query(r"""SELECT p_partkey, regexp_matches(p_name, '^[0-9a-f]{8,}$') OR p_partkey % 3 = 0 AS hash_like, len(list_distinct(string_split(p_name, ' '))) < 4 AS sparse, p_partkey % 5 = 0 AS blob, p_partkey % 4 + 1 AS anchor_at,
  concat_ws(' ', p_name, p_name, p_name, p_brand, p_type, 'ctx') AS document, ((p_size - 3)::DOUBLE * (p_size - 3) + (p_size * 2 - 1)::DOUBLE * (p_size * 2 - 1)) AS distance, CASE WHEN p_size % 2 = 0 THEN 'pkg,mod,attr' ELSE '' END AS named,
  CASE WHEN p_partkey % 2 = 0 THEN regexp_matches(concat('a/b', p_partkey), '^(a/b[0-9]*[02468])$') ELSE false END AS glob_hit FROM part""")
def text_tests(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    blob = F.when(n % 5 == 0, F.repeat(F.lit("QUJD"), 60)).otherwise("QUJD")
    lines = F.concat(F.repeat(F.lit("none\n"), (n % 4).cast("int")), F.lit("name = evil 1.2"))
    doc = C.naming_document(F.split("p_name", " "), F.array("p_brand"), F.array("p_type"), F.array(F.lit("ctx")))
    size = F.col("p_size").cast("double")
    even = [f"*/b*{d}" for d in (0, 2, 4, 6, 8)]
    return p.select(
        "p_partkey", C.looks_like_hash(F.when(n % 3 == 0, "0123456789abcdef").otherwise(F.col("p_name"))).alias("hash_like"), C.is_sparse(F.split("p_name", " ")).alias("sparse"), C.packed_blob(blob).alias("blob"),
        C.anchor_line(lines, F.lit("evil"), F.lit("1.2")).cast("long").alias("anchor_at"), F.array_join(doc, " ").alias("document"), C.squared_distance(F.array(size, size * 2), F.array(F.lit(3.0), F.lit(1.0))).alias("distance"),
        F.array_join(C.referenced_names(F.when(F.col("p_size") % 2 == 0, "pkg.mod:attr").otherwise("not a name")), ",").alias("named"), C.any_glob(F.concat(F.lit("a/b"), text("p_partkey")), even).alias("glob_hit"))


STEMS = [("economy", "economi"), ("economies", "economi"), ("large", "larg"), ("larges", "larg"), ("medium", "medium"), ("mediums", "medium"), ("promo", "promo"), ("promos", "promo"), ("small", "small"), ("smalls", "small"), ("standard", "standard"), ("standards", "standard")]


@query(f"""WITH w AS (SELECT p_partkey, lower(p_type) AS t FROM part), x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN t WHEN t LIKE '%y' THEN concat(left(t, -1), 'ies') ELSE concat(t, 's') END AS word FROM w)
SELECT p_partkey, x.word, stem FROM x JOIN ({values("word, stem", STEMS)}) s ON x.word = s.word""")
def stems(spark, sf):
    from gneiss.functions.stem import stemmed

    t = F.lower("p_type")
    many = F.when(t.endswith("y"), F.concat(F.expr("left(lower(p_type), length(p_type) - 1)"), F.lit("ies"))).otherwise(F.concat(t, F.lit("s")))
    words = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, t).otherwise(many).alias("word"))
    return words.withColumn("stem", stemmed(F.col("word")))


# ---------------------------------------------------------------- findings, reports, scanners

RANK = "CASE severity WHEN 'blocking' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"


@query(f"""WITH {F_SQL}, c AS (SELECT file, count(*) FILTER (severity = 'blocking') AS blocking, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'suggestion') AS suggestion FROM f GROUP BY file)
SELECT file, row_number() OVER (ORDER BY blocking DESC, high DESC, medium DESC, low DESC, suggestion DESC, file)::INT AS place FROM c""")
def files_in_order(spark, sf):
    return findings.ranked_files(event_findings(spark, sf)).select("file", "place")


@query(f"WITH {F_SQL} SELECT file AS path, list(rule_id || ':' || line ORDER BY line, rule_id).array_to_string(',') AS findings FROM f GROUP BY file")
def findings_by_file(spark, sf):
    from gneiss.sources.reports import grouped

    g = grouped(event_findings(spark, sf).withColumnRenamed("file", "path"))
    return g.select("path", F.array_join(F.transform("findings", lambda x: F.concat(x["rule_id"], F.lit(":"), x["line"].cast("string"))), ",").alias("findings"))


@query(f"""WITH {F_SQL} SELECT line, rule_id, CASE severity WHEN 'blocking' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, concat('  ', rule_id, ' ') AS message, file AS uri, greatest(line, 1) AS start_line,
sha256(concat(file, chr(0), rule_id, chr(0), trim(evidence))) AS fingerprint FROM f""")
def sarif_rows(spark, sf):
    from gneiss.sources.reports import sarif_results

    r = sarif_results(event_findings(spark, sf))
    at = lambda p: F.get_json_object("result", p)
    place = "$.locations[0].physicalLocation"
    return r.select("line", at("$.ruleId").alias("rule_id"), at("$.level").alias("level"), at("$.message.text").alias("message"), at(place + ".artifactLocation.uri").alias("uri"), at(place + ".region.startLine").cast("long").alias("start_line"), at("$.partialFingerprints.finding/v1").alias("fingerprint"))


@query(f"WITH {F_SQL} SELECT file AS path, rule_id, line FROM f WHERE file = (SELECT min(file) FROM f) AND rule_id = 'click'")
def finding_detail(spark, sf):
    f = event_findings(spark, sf).withColumnRenamed("file", "path")
    return findings.detail(f, f.agg(F.min("path")).first()[0], "click").select("path", "rule_id", "line")


@query(f"WITH {F_SQL} SELECT file, arg_min(rule_id, seq) AS rule_id, min(seq) AS seq FROM f GROUP BY file")
def first_finding(spark, sf):
    return findings.first_match(event_findings(spark, sf), ["file"], [F.col("seq")]).select("file", "rule_id", "seq")


@query("""SELECT concat('/', s_name) AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'AV-MAL-HEURISTIC' ELSE 'AV-MAL-MATCH' END AS rule_id, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'blocking' END AS severity,
CASE WHEN s_suppkey % 2 = 0 THEN 'candidate' ELSE 'auto' END AS verdict_kind, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'PUA.' ELSE 'Win.' END, s_nationkey) AS evidence FROM supplier""")
def antivirus_findings(spark, sf):
    from gneiss.sources import scanners

    name = F.when(F.col("s_suppkey") % 2 == 0, "PUA.").otherwise("Win.")
    out = table(spark, sf, "supplier").select(F.concat(F.lit("/"), "s_name", F.lit(": "), name, text("s_nationkey"), F.lit(" FOUND")).alias("value"))
    return scanners.antivirus_findings(scanners.antivirus(out)).select("path", "rule_id", "severity", "verdict_kind", "evidence")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT concat('lock', s_nationkey) AS path, k AS line, CASE WHEN s_suppkey % 4 = 0 THEN 'DEP-MAL-KNOWN' ELSE 'DEP-VULN-KNOWN' END AS rule_id,
concat(s_name, '@', s_suppkey, ' ', CASE WHEN s_suppkey % 4 = 0 THEN 'MAL-' ELSE 'CVE-' END, s_suppkey) AS evidence FROM s""")
def dependency_findings(spark, sf):
    from gneiss.sources import scanners

    s = table(spark, sf, "supplier")
    found = s.select(
        F.concat(F.lit("lock"), text("s_nationkey")).alias("lockfile"), F.col("s_name").alias("package"), text("s_suppkey").alias("version"),
        F.array(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "MAL-").otherwise("CVE-"), text("s_suppkey"))).alias("ids"), (F.col("s_suppkey") % 4 == 0).alias("malicious"))
    entry = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(x["s_name"], F.lit(" = "), x["s_suppkey"].cast("string")))
    texts = s.groupBy(F.concat(F.lit("lock"), text("s_nationkey")).alias("path")).agg(F.array_join(entry, "\n").alias("text"))
    return scanners.dependency_findings(found, texts, True).select("path", F.col("line").cast("long").alias("line"), "rule_id", "evidence")


# ---------------------------------------------------------------- ledgers


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN sha256(concat(o_orderstatus, chr(31), 'db 7')) ELSE o_orderstatus END AS fingerprint FROM orders")
def scanner_versions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, "AV").otherwise("R").alias("rule_id"), F.col("o_orderstatus").alias("fingerprint"))
    return ledger.with_versions(o, {"AV": "db 7"}).select("path", "fingerprint")


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def stale_facts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), text("o_totalprice").alias("sha"))
    made = o.where("path % 3 <> 0").select("path", F.when(F.col("path") % 5 == 0, "old").otherwise(F.col("sha")).alias("content_hash"))
    return ledger.stale_facts(o, made)


@query("SELECT l_orderkey AS path, l_linenumber AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def pruned_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n"))
    return ledger.pruned(li, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path")))


@query("SELECT c_custkey AS k, n_name AS repo FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_3'")
def without_repository(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ledger.without_repo(c.select(F.col("c_custkey").alias("k"), F.col("n_name").alias("repo")), "NATION_3")


# the second version: every seventh file is rewritten, every eleventh is gone
REFERS = "def _f{k}():\n    return 1\n\n\nprint(_f{size}())\n"


def refers(rows: DataFrame, size) -> DataFrame:
    """path, text: a file per row of part that defines a private function and calls the one of the row that its size names."""
    made = F.replace(F.replace(F.lit(REFERS), F.lit("{k}"), text("p_partkey")), F.lit("{size}"), size.cast("string"))
    return rows.select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), made.alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 11 <> 0)
SELECT concat('src/m', k, '.py') AS path, 'PY-DEAD-SYMBOL' AS rule_id FROM p WHERE k NOT IN (SELECT s FROM p)
UNION ALL SELECT concat('src/m', k, '.py'), 'PY-XFILE-PRIVATE-USED' FROM p WHERE k IN (SELECT q.s FROM p q WHERE q.k <> q.s)
UNION ALL SELECT concat('src/m', k, '.py'), 'PY-TYPING-MISSING-HINTS' FROM p""")
def incremental_audit(spark, sf):
    """Two versions of a tree drawn from part; only the second's changed files are given, and those that are gone pruned: its findings."""
    import uuid

    from gneiss.plans import audit
    from gneiss.sources.index import Index

    folder = spark.sparkContext.getCheckpointDir()
    index = Index(spark, f"{folder}/index-{uuid.uuid4().hex}")
    p, k = table(spark, sf, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    audit.incremental(spark, index, "r", refers(p, F.col("p_size")))
    now = refers(p.where(k % 11 != 0), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return audit.incremental(spark, index, "r", now).select("path", "rule_id").checkpoint()


@query("""WITH later AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderstatus = 'F' AS gone, 1 + o_orderkey % 5 AS seq FROM orders), last AS (SELECT k, max(seq) AS seq FROM later GROUP BY k)
SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM last) UNION ALL SELECT k, v FROM later JOIN last USING (k, seq) WHERE NOT gone""")
def merged_log(spark, sf):
    """The index's read: customers as the base, their orders as five later writes, finished ones as retractions."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("gone"), (1 + F.col("o_orderkey") % 5).alias("seq"))
    return ledger.merged(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), o, ["k"])


@query("""WITH ev AS (SELECT o_custkey AS k, o_orderkey AS version, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS sha, o_orderpriority AS r1 FROM orders),
t AS (SELECT ev.*, c_custkey IS NOT NULL AS known FROM ev LEFT JOIN customer ON c_custkey = k WHERE version = (SELECT max(e.version) FROM ev e WHERE e.k = ev.k)),
s AS (SELECT *, CASE WHEN known AND sha = 'O' THEN 'rule' ELSE 'content' END AS why FROM t WHERE sha IS NOT NULL)
SELECT concat('c', k) AS path, version, NULL AS rule_id, NULL AS fingerprint, 'gone' AS reason FROM t WHERE sha IS NULL AND known
UNION ALL SELECT concat('c', k), version, 'R1', r1, why FROM s WHERE why = 'content' OR r1 <> '1-URGENT'
UNION ALL SELECT concat('c', k), version, 'R2', 'x', why FROM s UNION ALL SELECT concat('c', k), version, 'R3', NULL, 'off' FROM s WHERE known""")
def keyed_ledger(spark, sf):
    """Orders as a stream of versions of their customer's file, over a ledger that holds all customers: what must run, what is off, which
    files are gone.  Every seventh order is a deletion."""
    from gneiss.streaming.ledger import own_folder, rules_due, run_to_table

    schema = table(spark, sf, "orders").schema
    o = spark.readStream.schema(schema).parquet(f"{sf}/orders.parque[t]")  # a pattern: the table may be one file
    path = lambda c: F.concat(F.lit("c"), text(c)).alias("path")
    sha = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    rules = F.create_map(F.lit("R1"), F.col("o_orderpriority"), F.lit("R2"), F.lit("x"))
    events = o.select(F.lit("r").alias("repo"), path("o_custkey"), F.col("o_orderkey").alias("version"), sha.alias("sha"), rules.alias("rules"))
    ran = F.create_map(F.lit("R1"), F.lit("1-URGENT"), F.lit("R3"), F.lit("y"))
    known = table(spark, sf, "customer").select(F.lit("r").alias("repo"), path("c_custkey"), F.lit(-1).cast("long").alias("version"), F.lit("O").alias("sha"), ran.alias("rules"))
    return run_to_table(spark, rules_due(events, known), own_folder(spark, "keyed-ledger")).select("path", "version", "rule_id", "fingerprint", "reason")


# ---------------------------------------------------------------- the graph


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT node_id FROM v WHERE ends_with(node_id, '::NATION_3')")
def symbol_resolution(spark, sf):
    return graph.resolve(star_graph(spark, sf)[0], "NATION_3").select("node_id")


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst, kind, 0 AS way FROM e UNION SELECT dst, src, kind, 1 FROM e), w(node_id, hops) AS (SELECT 'nat::NATION_3', 0 UNION SELECT b.dst, w.hops + 1 FROM b JOIN w ON b.src = w.node_id WHERE w.hops < 2),
h AS (SELECT node_id, min(hops) AS hops FROM w GROUP BY 1), m AS (SELECT h.node_id, h.hops, min(b.way::VARCHAR || b.kind) AS met FROM h JOIN b ON b.dst = h.node_id JOIN h p ON p.node_id = b.src AND p.hops = h.hops - 1 GROUP BY 1, 2)
SELECT h.node_id, h.hops::INT AS hops, met[2:] AS kind, CASE met[1] WHEN '0' THEN 'out' WHEN '1' THEN 'in' END AS direction FROM h LEFT JOIN m USING (node_id)""")
def neighbours(spark, sf):
    _, e = star_graph(spark, sf)
    return graph.neighbors(e, spark.createDataFrame([("nat::NATION_3",)], "node_id string"), 2)


@query(f"""WITH {EDGES_SQL}, n AS (SELECT 'reg::ASIA' AS id UNION SELECT dst FROM e WHERE src = 'reg::ASIA' UNION SELECT src FROM e WHERE dst = 'reg::ASIA') SELECT src, dst, kind FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def ego_graph(spark, sf):
    v, e = star_graph(spark, sf)
    return graph.ego(v, e, spark.createDataFrame([("reg::ASIA",)], "node_id string"), 1)[1].select("src", "dst", "kind")


CLUSTER_SQL = "c AS (SELECT *, CASE kind WHEN 'reg' THEN 0 WHEN 'nat' THEN 1 WHEN 'sup' THEN 2 ELSE 3 END AS cluster_id, length(node_id)::DOUBLE AS rank FROM v)"


def clustered(spark, sf) -> tuple[DataFrame, DataFrame]:
    v, e = star_graph(spark, sf)
    cluster = F.when(F.col("kind") == "reg", 0).when(F.col("kind") == "nat", 1).when(F.col("kind") == "sup", 2).otherwise(3)
    return v.withColumn("cluster_id", cluster).withColumn("rank", F.length("node_id").cast("double")), e


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, {CLUSTER_SQL} SELECT cluster_id, count(*) AS member_count, sum(rank) AS rank FROM c GROUP BY 1")
def cluster_sizes(spark, sf):
    return graph.clusters(clustered(spark, sf)[0])


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, {CLUSTER_SQL}, m AS (SELECT node_id FROM c WHERE cluster_id = 1) SELECT src, dst, kind FROM e WHERE src IN (SELECT node_id FROM m) AND dst IN (SELECT node_id FROM m) UNION ALL SELECT node_id, NULL, 'member' FROM m")
def cluster_members_and_edges(spark, sf):
    members, inner = graph.cluster_subgraph(*clustered(spark, sf), 1)
    return inner.select("src", "dst", "kind").union(members.select("node_id", F.lit(None).cast("string"), F.lit("member")))


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, s AS (SELECT node_id FROM v WHERE kind IN ('nat', 'reg') AND contains(lower(node_id), 'a')) SELECT src, dst FROM e WHERE src IN (SELECT node_id FROM s) AND dst IN (SELECT node_id FROM s)")
def visible_graph(spark, sf):
    return graph.visible(*star_graph(spark, sf), ("nat", "reg"), "A")[1].select("src", "dst")


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, {CLUSTER_SQL}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT cluster_id) FROM c) AS clusters,
(SELECT cluster_id FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS largest""")
def graph_overview(spark, sf):
    v, e = clustered(spark, sf)
    named = graph.clusters(v).withColumn("label", text("cluster_id"))
    o = graph.overview(v, e, named, v.limit(0).withColumn("why", F.lit("")))
    return spark.createDataFrame([(o["nodes"], o["edges"], o["clusters"], o["largest"][0]["cluster_id"])], "nodes long, edges long, clusters long, largest int")


@query(values("place, crumb", [(0, "overview"), (1, "nations"), (2, "nat::NATION_3")]))
def graph_breadcrumb(spark, sf):
    v, _ = clustered(spark, sf)
    named = spark.createDataFrame([(1, "nations")], "cluster_id int, label string")
    return spark.createDataFrame(list(enumerate(graph.breadcrumb(v, named, "nat::NATION_3"))), "place int, crumb string")


@query(f"""WITH {EDGES_SQL}, {F_SQL}, x AS (SELECT * FROM (SELECT DISTINCT dst AS node_id FROM e WHERE kind = 'contains') v JOIN (SELECT concat('nat::NATION_', line % 40) AS node_id, rule_id, line FROM f) USING (node_id))
SELECT node_id, count(*) AS n, min(line) AS first FROM x GROUP BY node_id""")
def findings_on_nodes(spark, sf):
    v = star_graph(spark, sf)[0].where("kind = 'nat'")
    f = event_findings(spark, sf).withColumnRenamed("file", "path").withColumn("evidence", F.concat(F.lit("nat::NATION_"), (F.col("line") % 40).cast("string")))
    out = graph.with_findings(v, f).where("findings is not null")
    return out.select("node_id", F.size("findings").cast("long").alias("n"), F.array_min(F.col("findings")["line"]).alias("first"))


@query("""WITH e AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_discount >= 0.045 THEN l_discount * 10 END WHEN l_linenumber = 2 THEN 0.5 END AS w FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT a, b, round(max(w), 6)::DOUBLE AS w FROM e WHERE w IS NOT NULL GROUP BY 1, 2""")
def merged_weights(spark, sf):
    kind = F.when(F.col("l_linenumber") == 1, "name_similar").when(F.col("l_linenumber") == 2, "calls").otherwise("contains")
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("kind"), (F.col("l_discount") * 10).alias("weight"))
    return communities.weighted(e).select("a", "b", F.round("w", 6).alias("w"))


@query("""WITH o AS (SELECT o_custkey AS node_id, o_orderkey AS line, unnest([o_orderstatus, o_orderpriority]) AS x, unnest([1, 2]) AS i, o_totalprice FROM orders), d AS (SELECT node_id, x, min((line, i)) AS seen FROM o GROUP BY 1, 2),
g AS (SELECT node_id, array_to_string(list(x ORDER BY seen), '|') AS lists FROM d GROUP BY 1) SELECT node_id, lists, min(line) AS line, bool_or(o_totalprice > 200000) AS any_large, bool_and(o_totalprice > 200000) AS all_large FROM o JOIN g USING (node_id) GROUP BY 1, 2""")
def united_facts(spark, sf):
    large = F.col("o_totalprice") > 200000
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("node_id"), F.array("o_orderstatus", "o_orderpriority").alias("lists"), F.col("o_orderkey").alias("line"), large.alias("any_large"), large.alias("all_large"))
    return resolve.united(o, ["lists"], ["any_large"], ["all_large"]).withColumn("lists", F.array_join("lists", "|"))


@query("""WITH d AS (SELECT concat(p_name, '/', p_size) AS name, concat('f', p_partkey % 50, '.py') AS path, CASE WHEN p_size % 3 = 0 THEN 'test' WHEN p_size % 3 = 1 THEN 'script' ELSE 'production' END AS role FROM part)
SELECT name, path FROM d WHERE role <> 'test' AND name NOT IN (SELECT concat(p_name, '/', p_size) FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49)""")
def dead_symbols(spark, sf):
    p = table(spark, sf, "part")
    role = F.when(F.col("p_size") % 3 == 0, "test").when(F.col("p_size") % 3 == 1, "script").otherwise("production")
    name = F.concat_ws("/", "p_name", text("p_size")).alias("name")
    d = p.select(name, F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("path"), role.alias("role"))
    used = p.join(table(spark, sf, "lineitem").where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey")).select(name)
    return crossfile.dead_symbols(d, used).select("name", "path")


@query("""WITH c AS (SELECT c_custkey, ['get', 'load', 'send'][c_custkey % 3 + 1] AS verb, concat('u', c_nationkey) AS a, concat('s', c_custkey % 4) AS b, c_mktsegment AS cluster, c_custkey % 3 = 2 AS w FROM customer),
p AS (SELECT x.c_custkey AS first, y.c_custkey AS second, (x.a = y.a)::INT + (x.b = y.b)::INT AS alike, x.verb AS v, y.verb AS z FROM c x JOIN c y ON x.cluster = y.cluster AND concat('k', x.c_custkey) < concat('k', y.c_custkey) AND x.verb <> y.verb)
SELECT concat('k', first) AS first, concat('k', second) AS second FROM p WHERE alike = 2 AND v <> 'send' AND z <> 'send'""")
def naming_inconsistencies(spark, sf):
    c = table(spark, sf, "customer")
    verb = F.element_at(F.array(F.lit("get"), F.lit("load"), F.lit("send")), (F.col("c_custkey") % 3 + 1).cast("int"))
    name = F.concat_ws("_", verb, F.concat(F.lit("u"), text("c_nationkey")), F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string")))
    shown = F.when(F.col("c_custkey") % 3 == 2, F.array(F.lit("writes"))).otherwise(F.array(F.lit("reads")))
    v = c.select(F.concat(F.lit("k"), text("c_custkey")).alias("node_id"), F.lit("function").alias("kind"), name.alias("name"), F.lit("m").alias("module"), F.lit("production").alias("role"), F.lit(1).alias("line"), F.col("c_mktsegment").alias("cluster_id"), shown.alias("profile"))
    return graph.naming_inconsistencies(v, ("reads", "writes")).select("first", "second")


@query("""WITH g AS (SELECT concat('p', p_partkey) AS node_id, p_brand, p_size FROM part), c AS (SELECT p_brand, p_size, count(*) AS n, min(node_id) AS least FROM g GROUP BY p_brand, p_size)
SELECT node_id, cluster_id FROM (SELECT p_brand, p_size, (row_number() OVER (ORDER BY n DESC, least) - 1)::INT AS cluster_id FROM c) JOIN g USING (p_brand, p_size)""")
def concept_clusters(spark, sf):
    """Parts of one brand and size call the first of them: each such star is a component, and merging it to its end gains, so it is a cluster."""
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), text("p_partkey")).alias("node_id"), "p_brand", "p_size")
    hub = p.groupBy("p_brand", "p_size").agg(F.min("node_id").alias("dst"))
    e = p.join(hub, ["p_brand", "p_size"]).where("node_id <> dst").select(F.col("node_id").alias("src"), "dst", F.lit("calls").alias("kind"), F.lit(1.0).alias("weight"))
    return communities.clusters(p.select("node_id"), e)


# ---------------------------------------------------------------- facts of sources

# a file per row of part; rows whose size is below their key build on the file that the size names
ALONE = "{async}def f{k}(a, b=1) -> int:\n    if a and b:\n        return 1\n    for i in a:\n        print(i)\n    return 0\n\n\nclass C{k}:\n    def go(self):\n        return {size}\n"
LINKED = "from src.m{size} import f{size}, C{size}\n\n\n{async}def f{k}(a, b=1) -> int:\n    if a and b:\n        return f{size}(a)\n    for i in a:\n        print(i)\n    return 0\n\n\nclass C{k}(C{size}):\n    def go(self):\n        return {size}\n"


def source_facts(spark, sf, *kinds: str) -> DataFrame:
    from gneiss.facts import dealt
    from gneiss.facts.python import facts

    made = F.when(F.col("p_size") < F.col("p_partkey"), LINKED).otherwise(ALONE)
    for mark, value in (("{k}", text("p_partkey")), ("{size}", text("p_size")), ("{async}", F.when(F.col("p_size") % 2 == 0, "async ").otherwise(""))):
        made = F.replace(made, F.lit(mark), value)
    files = dealt(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), made.alias("text"))
    return facts(files, kinds or None).checkpoint()


# a module per row of part: up to the tenth it defines a helper; the others re-export the helper of the module that their size names, by name
# and renamed, or with a star, and call it; all call it through the module's name too
HELPERS = "def help{k}(s, x):\n    s.refresh(x)\n"
PASSING = "from .m{size} import help{size} as help{k}\nfrom src import m{size}\n\n\ndef go{k}(s, x):\n    help{k}(s, x)\n    m{size}.help{size}(s, x)\n"
STARRED = "from src.m{size} import *\nimport src.m{size} as other\n\n\ndef go{k}(s, x):\n    other.help{size}(s, x)\n"


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS k, p_size AS t, CASE WHEN p_partkey <= 10 THEN 0 WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS how FROM part),
w(a, name, place, here, steps) AS (SELECT k, n, t, t, 1 FROM m, (VALUES ('help'), ('mod')) x(n) WHERE how > 0 AND (how = 1 OR n = 'mod')
  UNION SELECT w.a, w.name, m.t, CASE m.how WHEN 1 THEN m.t ELSE w.here END, w.steps + 1 FROM w JOIN m ON m.k = w.place WHERE w.steps < 4 AND (m.how = 2 OR (m.how = 1 AND w.here = m.k))),
f AS (SELECT w.a, w.name, w.here, min(w.steps) AS steps FROM w JOIN m ON m.k = w.place AND m.how = 0 AND w.here = m.k GROUP BY ALL)
SELECT concat('src/m', a, '.py') AS path, CASE WHEN name = 'help' THEN concat('help', a) WHEN m.how = 1 THEN concat('m', m.t, '.help', m.t) ELSE concat('other.help', m.t) END AS name, concat('src/m', here, '.py::help', here) AS dst, steps::INT AS steps
FROM f JOIN m ON m.k = f.a""")
def callee_resolution(spark, sf):
    """Calls of helpers through up to four modules that pass them on; chains that run in a circle or are longer give no row."""
    from gneiss.facts.python import facts

    k, body = F.col("p_partkey"), F.when(F.col("p_partkey") <= 10, HELPERS).when(F.col("p_partkey") % 3 == 0, STARRED).otherwise(PASSING)
    for mark, value in (("{k}", text("p_partkey")), ("{size}", text("p_size"))):
        body = F.replace(body, F.lit(mark), value)
    files = table(spark, sf, "part").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), body.alias("text"))
    # short rows become files to parse, so a split of the table is much work: dealt over all cores
    return resolve.callees(facts(files.repartition(4 * spark.sparkContext.defaultParallelism, "path")).checkpoint())


@query("""WITH p AS (SELECT concat('src/m', p_partkey, '.py') AS a, concat('src/m', p_size, '.py') AS b, p_partkey AS k, p_size AS t FROM part WHERE p_size < p_partkey)
SELECT a AS src, b AS dst, 'imports' AS kind FROM p UNION ALL SELECT concat(a, '::f', k), concat(b, '::f', t), 'calls' FROM p UNION ALL SELECT concat(a, '::C', k), concat(b, '::C', t), 'inherits' FROM p
UNION ALL SELECT concat(a, '::C', k, '.go'), concat(b, '::C', t, '.go'), 'overrides' FROM p""")
def structural_edges(spark, sf):
    f = source_facts(spark, sf, "module", "function", "class", "call", "import")
    return resolve.edges(f, resolve.nodes(f).checkpoint()).where("kind <> 'contains'").select("src", "dst", "kind")


@query("""SELECT concat('f', p_partkey) AS symbol, 'function' AS kind, 2 AS arg_count, 'int' AS return_type, p_size % 2 = 0 AS is_async, 4 AS complexity FROM part
UNION ALL SELECT concat('C', p_partkey, '.go'), 'method', 0, NULL, false, 1 FROM part""")
def definitions(spark, sf):
    from gneiss.facts import profile

    f = source_facts(spark, sf, "function", "class")
    m = profile.manifest(f).where("kind <> 'class'").select("path", "line", "symbol", "kind", "arg_count", "return_type", "is_async")
    c = f.where("kind = 'function'").select("path", "line", F.col("args")["complexity"].cast("int").alias("complexity"))
    return m.join(c, ["path", "line"]).drop("path", "line")


@query("""SELECT concat('src/m', p_partkey, '.py::f', p_partkey) AS node_id, CASE WHEN p_size % 2 = 0 THEN 'async,branches,calls_io' ELSE 'branches,calls_io' END AS profile FROM part
UNION ALL SELECT concat('src/m', p_partkey, '.py::C', p_partkey, '.go'), '' FROM part""")
def behaviour_profiles(spark, sf):
    from gneiss.facts import profile

    return profile.profiles(source_facts(spark, sf, "function", "raise", "except")).select("node_id", F.array_join(F.array_sort("profile"), ",").alias("profile"))


@query("SELECT count(*) AS n FROM part GROUP BY p_size % 5")
def clone_signatures(spark, sf):
    """Functions alike but for names and constants have one signature: there are as many as different methods called."""
    from gneiss.facts import dealt
    from gneiss.facts.python import facts

    made = F.lit("def f{k}(a{k}):\n    b{k} = a{k}.load{m}({k})\n    return b{k} + {size}\n")
    for mark, value in (("{k}", text("p_partkey")), ("{size}", text("p_size")), ("{m}", (F.col("p_size") % 5).cast("string"))):
        made = F.replace(made, F.lit(mark), value)
    files = dealt(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), made.alias("text"))
    return facts(files, ("function",)).where("kind = 'function'").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).select("n")


@query("""SELECT concat('module ', r_name) AS line FROM region UNION ALL SELECT concat('  nation ', r_name, '::', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('    calls: ', (SELECT r_name FROM region q WHERE q.r_regionkey = (n_nationkey % 5))) FROM nation""")
def graph_outline(spark, sf):
    """Regions contain nations, and a nation calls a region: an outline of those 30 nodes."""
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    n = table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("src"), F.concat("r_name", F.lit("::"), "n_name").alias("dst"))
    nodes = r.select(F.col("r_name").alias("node_id"), F.lit("module").alias("kind")).union(n.select("dst", F.lit("nation")))
    calls = n.join(r, F.col("n_nationkey") % 5 == F.col("r_regionkey")).select(F.col("dst").alias("src"), F.col("r_name").alias("dst"), F.lit("calls").alias("kind"))
    edges = n.select("src", "dst", F.lit("contains").alias("kind")).union(calls)
    lines = graph.outline([x.asDict() for x in nodes.collect()], [x.asDict() for x in edges.collect()]).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


# ---------------------------------------------------------------- many patterns at once


@query("""WITH i AS (SELECT concat('part::', p_partkey) AS id, concat(p_name, ' ', p_brand, ' ', p_type) AS t FROM part UNION ALL SELECT concat('doc::', doc_id), concat(source, '/', lang, '/', doc_id) FROM documents),
q AS (SELECT DISTINCT lower(x) AS term FROM (SELECT upper(substr(p_name, 3, 6)) AS x FROM part UNION ALL SELECT substr(p_brand, 6) FROM part UNION ALL SELECT concat('/', doc_id) FROM documents UNION ALL SELECT substr(p_type, 1, 1) FROM part))
SELECT term, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM q JOIN i ON contains(lower(t), term) GROUP BY term""")
def substring_search(spark, sf):
    part, docs = table(spark, sf, "part"), table(spark, sf, "documents")
    items = part.select(F.concat(F.lit("part::"), text("p_partkey")).alias("key"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    items = items.union(docs.select(F.concat(F.lit("doc::"), text("doc_id")), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), text("doc_id"))))
    terms = part.select(F.explode(F.array(F.upper(F.substring("p_name", 3, 6)), F.expr("substr(p_brand, 6)"), F.substring("p_type", 1, 1))).alias("term")).union(docs.select(F.concat(F.lit("/"), text("doc_id"))))
    hits = patterns.containing(items, terms)
    return hits.groupBy(F.col("pattern").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_id"), F.max("key").alias("last_id"))


@query(f"""WITH {PATH_SQL}, g AS (SELECT DISTINCT unnest([concat('*/f', p_partkey, '*'), concat('f', p_size, '?.[mp]*'), concat('[!s]*', p_partkey, '.md'), 'src/*', '*']) AS pattern FROM part)
SELECT pattern, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM g JOIN p ON path GLOB pattern OR regexp_extract(path, '[^/]*$') GLOB pattern GROUP BY pattern""")
def glob_matches(spark, sf):
    made = [F.format_string("*/f%d*", "p_partkey"), F.format_string("f%d?.[mp]*", "p_size"), F.format_string("[!s]*%d.md", "p_partkey"), F.lit("src/*"), F.lit("*")]
    rows = part_paths(spark, sf)
    hits = patterns.globbed(rows.select("path"), rows.select(F.explode(F.array(*made)).alias("pattern")))
    return hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
