"""The operators on the star-schema and text tables, each with the same query in SQL.

Findings are drawn from events: file is the user, rule the event type, severity follows from the type, line is the event id.
The graph is drawn from nations, suppliers, parts and customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import core as C
from gneiss.operators import crossfile, findings, graph, ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- findings from events

SEVERITY_OF = {"error": "blocking", "purchase": "high", "signup": "medium", "click": "low", "view": "suggestion"}
F_SQL = """f AS (SELECT concat('app/u', user_id % 7, '/', user_id, '.py') AS file, event_type AS rule_id,
  CASE event_type WHEN 'error' THEN 'blocking' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'suggestion' END AS severity,
  CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'candidate' END AS verdict_kind, event_id AS line, event_id AS seq, concat('  ', event_type, ' ') AS evidence, ts FROM events)"""
RANK_SQL = "CASE severity WHEN 'blocking' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 WHEN 'suggestion' THEN -1 ELSE -2 END"
COUNTS_SQL = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in C.SEVERITIES)


def event_findings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    severity = F.lit("suggestion")
    for t, s in SEVERITY_OF.items():
        severity = F.when(F.col("event_type") == t, s).otherwise(severity)
    path = F.concat(F.lit("app/u"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".py"))
    return e.select(
        path.alias("file"), F.col("event_type").alias("rule_id"), severity.alias("severity"), F.when(F.col("event_id") % 2 == 0, "auto").otherwise("candidate").alias("verdict_kind"),
        F.col("event_id").alias("line"), F.col("event_id").alias("seq"), F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("evidence"), "ts")


@query(f"WITH {F_SQL} SELECT file, {COUNTS_SQL} FROM f GROUP BY file")
def severity_pivot(spark, sf):
    return findings.counts_per_file(event_findings(spark, sf))


@query(f"WITH {F_SQL} SELECT severity, count(*) AS n FROM f GROUP BY severity")
def severity_totals(spark, sf):
    return findings.severity_totals(event_findings(spark, sf))


@query(f"WITH {F_SQL} SELECT rule_id, file, grouping(rule_id, file)::INT AS level, count(*) AS n FROM f GROUP BY GROUPING SETS ((rule_id), (file), ())")
def by_rule_and_file(spark, sf):
    return findings.by_rule_and_file(event_findings(spark, sf))


@query(f"WITH {F_SQL}, c AS (SELECT file, {COUNTS_SQL} FROM f GROUP BY file) SELECT * FROM c ORDER BY blocking DESC, high DESC, medium DESC, low DESC, suggestion DESC, file LIMIT 20")
def worst_files(spark, sf):
    return findings.worst_files(event_findings(spark, sf), 20)


@query(f"WITH {F_SQL} SELECT file, count(*) AS n FROM f GROUP BY file ORDER BY n DESC, file LIMIT 5")
def busiest_files(spark, sf):
    return findings.busiest_files(event_findings(spark, sf))


@query(f"WITH {F_SQL} SELECT file, rule_id, severity, line FROM f ORDER BY {RANK_SQL} DESC, file, seq LIMIT 50")
def most_severe_findings(spark, sf):
    return findings.most_severe(event_findings(spark, sf), 50).select("file", "rule_id", "severity", "line")


@query(f"WITH {F_SQL} SELECT coalesce(bool_or(verdict_kind = 'auto' AND {RANK_SQL} >= 2), false) AS failed, count(*) FILTER (verdict_kind = 'auto' AND {RANK_SQL} >= 2) AS n FROM f")
def gate(spark, sf):
    return findings.gate(event_findings(spark, sf), "high")


@query(f"WITH {F_SQL} SELECT rule_id, count(*) AS n, min(line) AS first_line FROM f WHERE {RANK_SQL} >= 1 GROUP BY rule_id")
def at_least_medium(spark, sf):
    return findings.at_least(event_findings(spark, sf), "medium").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


@query(f"WITH {F_SQL} SELECT file, line, severity FROM f WHERE severity IN ('blocking', 'low')")
def exact_severities(spark, sf):
    return findings.with_severities(event_findings(spark, sf), "blocking", "low").select("file", "line", "severity")


@query(f"WITH {F_SQL} SELECT file, line, CASE greatest({RANK_SQL}, 1) WHEN 3 THEN 'blocking' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' END AS raised FROM f")
def severity_floor(spark, sf):
    return event_findings(spark, sf).select("file", "line", C.raised(F.col("severity"), "medium").alias("raised"))


FP_SQL = "sha256(concat(file, chr(0), rule_id, chr(0), trim(evidence)))"


@query(f"WITH {F_SQL} SELECT line, {FP_SQL} AS fingerprint FROM f")
def finding_fingerprints(spark, sf):
    return findings.fingerprinted(event_findings(spark, sf)).select("line", "fingerprint")


@query(f"""WITH {F_SQL}, p AS (SELECT *, {FP_SQL} AS fp, row_number() OVER (PARTITION BY {FP_SQL} ORDER BY seq) AS rn FROM f),
b AS (SELECT {FP_SQL} AS fp, count(*) AS held FROM f WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT file, rule_id, line FROM p LEFT JOIN b USING (fp) WHERE rn > coalesce(held, 0)""")
def baseline_diff(spark, sf):
    f = findings.fingerprinted(event_findings(spark, sf))
    return findings.beyond_baseline(f, f.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))).select("file", "rule_id", "line")


@query(f"""WITH {F_SQL}, i(rule_id, file, line, h) AS (VALUES ('view', NULL, NULL, NULL), ('click', 'app/u3/10.py', NULL, NULL), ('error', 'app/u1/1.py', 0, sha256('error')), ('purchase', NULL, 7, NULL))
SELECT file, rule_id, line FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.rule_id = f.rule_id AND (i.file IS NULL OR i.file = f.file)
  AND (i.line IS NULL OR CASE WHEN i.h IS NOT NULL THEN i.h = sha256(trim(evidence)) ELSE i.line = f.line END))""")
def ignore_filter(spark, sf):
    rows = [("view", None, None, None), ("click", "app/u3/10.py", None, None), ("error", "app/u1/1.py", 0, "error"), ("purchase", None, 7, None)]
    i = spark.createDataFrame(rows, "rule_id string, file string, line long, text string").withColumn("evidence_hash", F.when(F.col("text").isNotNull(), F.sha2("text", 256)))
    return findings.not_ignored(event_findings(spark, sf), i).select("file", "rule_id", "line")


@query(f"""WITH {F_SQL}, p AS (SELECT unnest(['', 'app', split_part(file, '/', 1) || '/' || split_part(file, '/', 2), file]) AS prefix, severity FROM f)
SELECT prefix, {COUNTS_SQL} FROM p GROUP BY prefix""")
def directory_rollup(spark, sf):
    return findings.directory_rollup(event_findings(spark, sf))


@query(f"WITH {F_SQL}, d AS (SELECT DISTINCT file FROM f), s AS (SELECT rule_id, count(DISTINCT file) AS files FROM f GROUP BY rule_id) SELECT rule_id, files, (SELECT count(*) FROM d) AS all_files FROM s")
def files_per_rule(spark, sf):
    f = event_findings(spark, sf)
    return f.groupBy("rule_id").agg(F.countDistinct("file").alias("files")).join(F.broadcast(f.agg(F.countDistinct("file").alias("all_files"))))


@query(f"WITH {F_SQL}, c AS (SELECT file, rule_id, count(*) AS n FROM f GROUP BY file, rule_id), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, rule_id)::INT AS place FROM c) SELECT file, rule_id, n, place FROM r WHERE place <= 2")
def top_rules_per_file(spark, sf):
    c = event_findings(spark, sf).groupBy("file", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return findings.top_per_key(c, ["file"], [F.desc("n"), F.col("rule_id")], 2)


# ---------------------------------------------------------------- lines and literals of documents


def document_lines(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    return d.select("doc_id", F.posexplode(lines).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


L_SQL = r"""l AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS x FROM documents WHERE text IS NOT NULL))"""


@query(f"WITH {L_SQL} SELECT doc_id, count(*) AS lines, max(length(line)) AS longest, sum(length(line))::BIGINT AS chars FROM l GROUP BY doc_id")
def lines_per_document(spark, sf):
    return document_lines(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("line")).alias("longest"), F.sum(F.length("line")).alias("chars"))


@query(f"WITH {L_SQL} SELECT doc_id, count(*) AS lines FROM l GROUP BY doc_id HAVING count(*) > 40")
def file_size(spark, sf):
    return document_lines(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines")).where("lines > 40")


@query(f"WITH {L_SQL} SELECT doc_id, line_no, regexp_extract(line, 'token = \"([0-9a-fA-F]{{40}})\"', 1) AS value FROM l WHERE regexp_matches(line, 'token = \"[0-9a-fA-F]{{40}}\"')")
def secret_line_scan(spark, sf):
    p = 'token = "([0-9a-fA-F]{40})"'
    return document_lines(spark, sf).where(F.col("line").rlike(p)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_extract("line", p, 1).alias("value"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.content_hash(F.col("text")).alias("sha"))


@query(f"WITH {L_SQL}, s AS (SELECT doc_id, line_no FROM l WHERE length(line) < 60), g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM s) SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM g GROUP BY doc_id, g")
def short_line_runs(spark, sf):
    s = document_lines(spark, sf).where(F.length("line") < 60).select("doc_id", F.col("line_no").cast("long").alias("line_no"))
    return findings.runs(s, ["doc_id"], "line_no")


@query("WITH h AS (SELECT sha256(coalesce(text, '')) AS shape_hash, source AS path, doc_id FROM documents), o AS (SELECT shape_hash, count(DISTINCT path) AS n_paths FROM h GROUP BY shape_hash HAVING count(DISTINCT path) >= 2) SELECT doc_id, path, n_paths FROM h JOIN o USING (shape_hash)")
def dup_groups(spark, sf):
    h = table(spark, sf, "documents").select(C.content_hash(F.col("text")).alias("shape_hash"), F.col("source").alias("path"), "doc_id")
    return crossfile.duplicates(h).select("doc_id", "path", "n_paths")


SHAPE_SQL = r"md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[0-9]', '0', 'g'), '[ \t\n\r]+', ' ', 'g')))"


@query(f"""WITH h AS (SELECT {SHAPE_SQL} AS shape_hash, concat(source, '/', doc_id) AS path, coalesce(lang, 'production') AS role, doc_id AS line FROM documents),
o AS (SELECT shape_hash, role, count(DISTINCT path) AS n_paths FROM h GROUP BY 1, 2 HAVING count(DISTINCT path) >= 2) SELECT line, role, path, n_paths FROM h JOIN o USING (shape_hash, role)""")
def dup_within_role(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[0-9]", "0"), r"[ \t\n\r]+", " ")
    shapes = d.select(F.md5(F.trim(text)).alias("shape_hash"), "path", F.col("doc_id").alias("line"))
    return crossfile.duplicates_by_role(shapes, d.select("path", F.col("lang").alias("role"))).select("line", "role", "path", "n_paths")


@query(f"""WITH h AS (SELECT {SHAPE_SQL} AS shape_hash, source AS path, coalesce(lang, 'production') AS role, doc_id AS line FROM documents),
o AS (SELECT shape_hash, role, list_sort(list(DISTINCT path || ':' || line)) AS p FROM h GROUP BY 1, 2 HAVING count(DISTINCT path) >= 2),
e AS (SELECT line, list_filter(p, lambda x: x <> path || ':' || line) AS x FROM h JOIN o USING (shape_hash, role))
SELECT line, CASE WHEN len(x) > 5 THEN array_to_string(x[1:5], ', ') || ' (+' || (len(x) - 5) || ' more)' ELSE array_to_string(x, ', ') END AS elsewhere FROM e""")
def dup_elsewhere(spark, sf):
    d = table(spark, sf, "documents")
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[0-9]", "0"), r"[ \t\n\r]+", " ")
    shapes = d.select(F.md5(F.trim(text)).alias("shape_hash"), F.col("source").alias("path"), F.col("doc_id").alias("line"), F.coalesce("lang", F.lit("production")).alias("role"))
    often = shapes.groupBy("shape_hash", "role").agg(F.countDistinct("path").alias("n_paths")).where("n_paths >= 2")
    return crossfile.elsewhere(shapes.join(often, ["shape_hash", "role"])).select("line", "elsewhere")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_manifest(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.where("k is not null")


@query("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS anchors, len(regexp_extract_all(html, '<a [^>]*href=')) AS with_href, len(regexp_extract_all(html, '<script')) AS scripts FROM pages")
def html_anchors(spark, sf):
    n = lambda p: F.coalesce(F.regexp_count("html", F.lit(p)), F.lit(0)).cast("long")
    return table(spark, sf, "pages").select("page_id", n("<a ").alias("anchors"), n("<a [^>]*href=").alias("with_href"), n("<script").alias("scripts"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, string_split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/')[1] AS first_part FROM pages")
def url_parts(spark, sf):
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.element_at(F.split(path, "/"), 1).alias("first_part"))


WORDS_SQL = r"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM documents)"


@query(f"""WITH {WORDS_SQL}, tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM w), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT doc_id, token, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS w FROM tf JOIN df USING (token), n), s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1)
SELECT doc_id, max(round(w / norm, 6)) AS heaviest, count(*) AS terms FROM x JOIN s USING (doc_id) GROUP BY doc_id""")
def tfidf(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("token"))
    w = graph.tf_idf(t, "doc_id", "token")
    return w.groupBy("doc_id").agg(F.max(F.round("weight", 6)).alias("heaviest"), F.count(F.lit(1)).alias("terms"))


@query(f"""WITH m AS (SELECT l.quality * 2 + l.toxic AS cluster_id, d.doc_id AS node_id, unnest(list_distinct(regexp_extract_all(lower(d.text), '[a-z]{{4,}}'))) AS token FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT cluster_id, token, count(DISTINCT node_id) AS n FROM m GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), k AS (SELECT count(DISTINCT cluster_id) AS k FROM m),
s AS (SELECT cluster_id, token, round(n * ln((1.0 + k) / (1.0 + df)), 9) AS score FROM c JOIN df USING (token), k), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, token) AS p FROM s)
SELECT cluster_id, token AS label, round(score, 6) AS score FROM r WHERE p = 1""")
def cluster_labels(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("token")
    m = d.select((F.col("quality") * 2 + F.col("toxic")).alias("cluster_id"), F.col("doc_id").alias("node_id"), token)
    return graph.cluster_labels(m).select("cluster_id", "label", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- ledgers and set operations


@query("""WITH f AS (SELECT concat('o', o_orderkey) AS path, md5(concat(o_totalprice::DECIMAL(18,2), o_orderstatus)) AS sha, o_orderkey AS k FROM orders), r(rule_id, fingerprint) AS (VALUES ('r1', 'a'), ('r2', 'b')),
s AS (SELECT path, CASE WHEN k % 5 = 0 THEN 'old' ELSE sha END AS sha FROM f WHERE k % 11 <> 0), l AS (SELECT path, rule_id, CASE WHEN k % 7 = 0 AND rule_id = 'r2' THEN 'x' ELSE fingerprint END AS fp FROM f, r WHERE k % 11 <> 0)
SELECT f.path, r.rule_id, CASE WHEN f.sha IS DISTINCT FROM s.sha THEN 'content' ELSE 'rule' END AS reason FROM f CROSS JOIN r LEFT JOIN s ON s.path = f.path LEFT JOIN l ON l.path = f.path AND l.rule_id = r.rule_id
WHERE f.sha IS DISTINCT FROM s.sha OR r.fingerprint IS DISTINCT FROM l.fp""")
def ledger_missed(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    f = o.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("path"), F.md5(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "o_orderstatus")).alias("sha"), "k")
    rules = F.explode(F.array(*[F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("fingerprint")) for a, b in (("r1", "a"), ("r2", "b"))])).alias("r")
    plan = f.select("path", "k", rules).select("path", "k", "r.*")
    before = f.where("k % 11 <> 0").select("path", F.when(F.col("k") % 5 == 0, "old").otherwise(F.col("sha")).alias("sha"))
    done = plan.where("k % 11 <> 0").withColumn("fingerprint", F.when((F.col("k") % 7 == 0) & (F.col("rule_id") == "r2"), "x").otherwise(F.col("fingerprint")))
    return ledger.missed_rules(f, plan, before, done)


@query("SELECT p_partkey AS path, p_brand AS brand FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def stale_paths(spark, sf):
    name = lambda c: F.concat_ws("/", "p_brand", F.col(c).cast("string")).alias("path")
    part = table(spark, sf, "part")
    kept = table(spark, sf, "lineitem").where("l_quantity > 49").join(part, F.col("l_partkey") == F.col("p_partkey")).select(name("p_partkey"))
    stale = ledger.stale_paths(part.select(name("p_partkey"), F.col("p_brand").alias("brand")), kept, "Brand#1")
    return stale.select(F.element_at(F.split("path", "/"), 2).cast("long").alias("path"), "brand")


@query("""WITH new AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new""")
def upsert_latest(spark, sf):
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return ledger.upserted(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), new, ["k"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreferenced(spark, sf):
    return crossfile.unreferenced(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("""WITH d AS (SELECT concat(p_name, '/', p_size) AS name, min(p_brand) AS path FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1),
r AS (SELECT DISTINCT concat(p.p_name, '/', p.p_size) AS name, concat('user', s.s_nationkey) AS u FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey),
g AS (SELECT d.name, d.path, list_sort(list(DISTINCT u)) AS u FROM d JOIN r USING (name) WHERE u <> path GROUP BY 1, 2)
SELECT name, path, len(u)::INT AS n_files, CASE WHEN len(u) > 3 THEN array_to_string(u[1:3], ', ') || ' (+' || (len(u) - 3) || ' more)' ELSE array_to_string(u, ', ') END AS files FROM g""")
def leaked_private(spark, sf):
    part = table(spark, sf, "part").withColumn("p_name", F.concat_ws("/", "p_name", F.col("p_size").cast("string")))
    refs = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    refs = refs.select(F.col("p_name").alias("name"), F.concat(F.lit("user"), F.col("s_nationkey").cast("string")).alias("path"))
    return crossfile.leaked_private(part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("path")), refs)


@query("""WITH n AS (SELECT n_regionkey AS region, c_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY n DESC) AS r FROM n),
a AS (SELECT *, count(*) OVER (PARTITION BY region) AS c FROM r WHERE r = 1) SELECT region, nation AS home, n FROM a WHERE c = 1""")
def home_module(spark, sf):
    m = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return crossfile.home(m.select(F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation")), "region", "nation")


@query("""WITH RECURSIVE e AS (SELECT concat('n', n_nationkey) AS name, concat('r', n_regionkey) AS base FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey) FROM orders),
d(name, depth) AS (SELECT 'r1', 0 UNION ALL SELECT e.name, d.depth + 1 FROM e JOIN d ON e.base = d.name) SELECT name, min(depth)::INT AS depth FROM d GROUP BY name""")
def class_closure(spark, sf):
    e = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("base"))
    e = e.union(table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    e = e.union(table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")))
    return crossfile.descendants(e, spark.createDataFrame([("r1",)], "name string"))


# ---------------------------------------------------------------- the graph

EDGES_SQL = """e AS (SELECT concat('reg::', r_name) AS src, concat('nat::', n_name) AS dst, 'contains' AS kind, 1.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('nat::', n_name), concat('sup::', s_name), 'calls', 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT concat('sup::', s_name), concat('brand::', p_brand), 'references_type', 1.0 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
NODES_SQL = "v AS (SELECT DISTINCT node_id, string_split(node_id, '::')[1] AS kind, string_split(node_id, '::')[2] AS name FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e))"


def star_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    r, n, s, p, li = (table(spark, sf, x) for x in ("region", "nation", "supplier", "part", "lineitem"))
    one = F.lit(1.0).alias("weight")
    tag = lambda a, c: F.concat(F.lit(a + "::"), F.col(c))
    nation = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    e = nation.select(tag("reg", "r_name").alias("src"), tag("nat", "n_name").alias("dst"), F.lit("contains").alias("kind"), one)
    e = e.union(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(tag("nat", "n_name"), tag("sup", "s_name"), F.lit("calls"), one))
    li = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    e = e.union(li.select(tag("sup", "s_name"), tag("brand", "p_brand"), F.lit("references_type"), one).distinct())
    v = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    part = F.split("node_id", "::")
    return v.select("node_id", F.element_at(part, 1).alias("kind"), F.element_at(part, 2).alias("name")), e


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node_id, hops) AS (SELECT 'reg::ASIA', 0 UNION SELECT b.dst, w.hops + 1 FROM b JOIN w ON b.src = w.node_id WHERE w.hops < 3)
SELECT node_id, min(hops)::INT AS hops FROM w GROUP BY node_id""")
def bfs_depth(spark, sf):
    _, e = star_graph(spark, sf)
    return graph.neighbors(e, spark.createDataFrame([("reg::ASIA",)], "node_id string"), 3).select("node_id", "hops")


@query(f"""WITH {EDGES_SQL}, h AS (SELECT 'out' AS direction, kind, dst AS other FROM e WHERE src = 'nat::NATION_3' UNION SELECT 'in', kind, src FROM e WHERE dst = 'nat::NATION_3')
SELECT direction, kind, count(*) AS n, array_to_string(list_sort(list(other))[1:5], ',') AS sample FROM h GROUP BY 1, 2""")
def symbol_usages(spark, sf):
    v, e = star_graph(spark, sf)
    return graph.usages(v.withColumn("rank", F.lit(0.0)), e, "nat::NATION_3")


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT node_id, kind, 0.0::DOUBLE AS rank FROM v WHERE contains(lower(node_id), 'an') ORDER BY node_id LIMIT 20")
def symbol_search(spark, sf):
    v, _ = star_graph(spark, sf)
    return graph.search(v.withColumn("rank", F.lit(0.0)), "AN")


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, o AS (SELECT src AS node_id, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS node_id, count(*) AS i FROM e GROUP BY 1)
SELECT node_id, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree FROM v LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)""")
def degrees(spark, sf):
    v, e = star_graph(spark, sf)
    return graph.degrees(v, e).select("node_id", "out_degree", "in_degree")


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, o AS (SELECT src AS node_id, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS node_id, count(*) AS i FROM e GROUP BY 1),
d AS (SELECT node_id, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM v LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)),
t AS (SELECT CASE WHEN stddev_pop(ln(1 + o)) > 0 THEN avg(ln(1 + o)) + 1.5 * stddev_pop(ln(1 + o)) ELSE 'inf'::DOUBLE END AS fo, CASE WHEN stddev_pop(ln(1 + i)) > 0 THEN avg(ln(1 + i)) + 1.5 * stddev_pop(ln(1 + i)) ELSE 'inf'::DOUBLE END AS fi FROM d)
SELECT node_id, o::BIGINT AS out_degree, i::BIGINT AS in_degree, CASE WHEN ln(1 + o) >= fo THEN 'fan-out' ELSE 'fan-in' END AS why FROM d, t WHERE ln(1 + o) >= fo OR ln(1 + i) >= fi""")
def god_concepts(spark, sf):
    v, e = star_graph(spark, sf)
    v = v.withColumn("kind", F.lit("class")).withColumn("role", F.lit("production"))
    return graph.god_concepts(v, e, 1.5).select("node_id", "out_degree", "in_degree", "why")


ROUNDS = 50
PAGERANK_SQL = f"""WITH {EDGES_SQL}, {NODES_SQL}, k AS (SELECT src, dst, count(*) AS n FROM e WHERE kind IN ('calls', 'overrides', 'references_type') GROUP BY 1, 2),
s AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM k), c AS (SELECT count(*)::DOUBLE AS n FROM v), o AS MATERIALIZED (SELECT DISTINCT src FROM s),
r0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE / n AS rank FROM v, c), """ + ", ".join(
    f"""r{i} AS MATERIALIZED (SELECT p.node_id, 0.15 / c.n + 0.85 * coalesce(f.inflow, 0) + 0.85 * d.lost / c.n AS rank FROM r{i - 1} p CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE node_id NOT IN (SELECT src FROM o)) d
LEFT JOIN (SELECT s.dst, sum(q.rank * s.share) AS inflow FROM s JOIN r{i - 1} q ON q.node_id = s.src GROUP BY 1) f ON f.dst = p.node_id)"""
    for i in range(1, ROUNDS + 1)
) + f" SELECT node_id, round(rank / (SELECT sum(rank) FROM r{ROUNDS}), 8) AS rank FROM r{ROUNDS}"


@query(PAGERANK_SQL)
def pagerank(spark, sf):
    v, e = star_graph(spark, sf)
    return graph.pagerank(v, e, iterations=ROUNDS).select("node_id", F.round("rank", 8).alias("rank"))


@query("""WITH t AS (SELECT o_custkey AS node_id, list(DISTINCT p_brand) AS c, list(DISTINCT l_shipmode_like) AS t FROM (SELECT o_custkey, p_brand, concat(l_returnflag, l_linestatus) AS l_shipmode_like FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) GROUP BY 1),
p AS (SELECT a.node_id AS a, b.node_id AS b, a.c AS ca, b.c AS cb, a.t AS ta, b.t AS tb FROM t a JOIN t b ON a.node_id < b.node_id AND (list_has_any(a.c, b.c) OR list_has_any(a.t, b.t))),
s AS (SELECT a, b, round(0.6 * len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))) + 0.4 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS weight FROM p), x AS (SELECT a, b, weight FROM s WHERE weight >= 0.5 UNION ALL SELECT b, a, weight FROM s WHERE weight >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b DESC) AS place FROM x) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, weight FROM r WHERE place <= 8""")
def usage_similar(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = li.groupBy(F.col("o_custkey").alias("node_id")).agg(F.collect_set("p_brand").alias("callees"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("types"))
    return graph.usage_similar(items)


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS weight FROM u a JOIN u b ON a.vec_id < b.vec_id),
x AS (SELECT a, b, weight FROM s WHERE weight >= 0.3 UNION ALL SELECT b, a, weight FROM s WHERE weight >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b DESC) AS place FROM x)
SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, round(weight, 4) AS weight FROM r WHERE place <= 8""")
def cosine_neighbours(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"))
    return graph.cosine_neighbours(v, 0.3).select("src", "dst", F.round("weight", 4).alias("weight"))


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, c AS (SELECT node_id, CASE kind WHEN 'reg' THEN 0 WHEN 'nat' THEN 1 WHEN 'sup' THEN 2 ELSE 3 END AS c FROM v)
SELECT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, count(*) AS n FROM e JOIN c a ON a.node_id = src JOIN c b ON b.node_id = dst WHERE a.c <> b.c GROUP BY 1, 2""")
def cluster_overview(spark, sf):
    v, e = star_graph(spark, sf)
    cluster = F.when(F.col("kind") == "reg", 0).when(F.col("kind") == "nat", 1).when(F.col("kind") == "sup", 2).otherwise(3)
    return graph.cluster_overview(v.withColumn("cluster_id", cluster), e)


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, s AS (SELECT node_id FROM v WHERE kind IN ('nat', 'sup') AND contains(node_id, '0') OR kind = 'nat') SELECT src, dst, kind FROM e WHERE src IN (SELECT node_id FROM s) AND dst IN (SELECT node_id FROM s)")
def induced_edges(spark, sf):
    v, e = star_graph(spark, sf)
    shown = v.where(F.col("kind").isin("nat", "sup") & F.col("node_id").contains("0") | (F.col("kind") == "nat"))
    return graph.induced(e, shown).select("src", "dst", "kind")


# ---------------------------------------------------------------- joins of the data model


@query("""SELECT s_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def files_with_counts(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(*[F.count(F.when(F.col("l_returnflag") == x, 1)).alias(x.lower()) for x in "ANR"])
    return table(spark, sf, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").na.fill(0, ["a", "n", "r"])


@query("""WITH a AS (SELECT conv_id, turn, role FROM conversations), u AS (SELECT conv_id, turn FROM a WHERE role = 'user') SELECT a.conv_id, a.turn, max(u.turn) AS last_user FROM a JOIN u ON u.conv_id = a.conv_id AND u.turn < a.turn WHERE a.role = 'assistant' GROUP BY 1, 2""")
def asof_last_event(spark, sf):
    """The latest earlier event of a key, in one pass: a running maximum over the key's order, no range join."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before)
    return c.withColumn("last_user", last).where("role = 'assistant' and last_user is not null").select("conv_id", "turn", "last_user").distinct()


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def role_histogram(spark, sf):
    return findings.histogram(table(spark, sf, "conversations"), "role")


@query("""SELECT n_name AS verb, count(*) AS n, round(avg((c_mktsegment = 'BUILDING')::INT::DOUBLE), 6) AS building, round(avg((c_acctbal < 0)::INT::DOUBLE), 6) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 5""")
def behaviour_vectors(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "BUILDING", "building"), F.when(F.col("c_acctbal") < 0, "negative")))
    v = graph.verb_vectors(c.select(F.col("n_name").alias("verb"), shown.alias("profile")), ("building", "negative"), 5)
    return v.select("verb", "n", F.round(F.col("vector")[0], 6).alias("building"), F.round(F.col("vector")[1], 6).alias("negative"))


# ---------------------------------------------------------------- further operators


STOP_SQL = ", ".join(f"'{w}'" for w in sorted({*C.STOPWORDS, "brass", "tin"}))


@query(rf"""SELECT p_partkey, list_filter(list_transform(regexp_extract_all(p_name || '_' || p_type, '[a-zA-Z]+|[0-9]+'), lambda t: lower(t)), lambda t: len(t) > 1 AND t NOT IN ({STOP_SQL})).array_to_string(' ') AS tokens,
  lower(string_split(replace(p_name, ' ', '_'), '_')[1]) AS verb, lower(regexp_extract(p_brand, '^[ \t]*([A-Za-z0-9_.-]+)', 1)) AS dependency, array_to_string(string_split(replace(replace(p_name, ' ', '.'), ':', '.'), '.'), '/') AS entry,
  replace(regexp_replace(regexp_replace(concat('a/', replace(p_name, ' ', '/'), '.py'), '\.py$', ''), '/__init__$', ''), '/', '.') AS module, least(1.0, CASE WHEN p_size > 25 THEN 0.4 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0 END)::DOUBLE AS abstractness FROM part""")
def identifier_functions(spark, sf):
    p = table(spark, sf, "part")
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    none = F.lit(False)
    return p.select(
        "p_partkey", F.array_join(C.meaningful(C.identifier_tokens(F.concat_ws("_", "p_name", F.lower("p_type"))), (*C.STOPWORDS, "brass", "tin")), " ").alias("tokens"), C.verb(snake).alias("verb"), C.dependency_name(F.col("p_brand")).alias("dependency"),
        F.array_join(C.entry_point_names(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))), "/").alias("entry"), C.module_name(F.concat(F.lit("a/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit(".py"))).alias("module"),
        F.round(C.abstractness(F.col("p_size") > 25, F.col("p_size") % 2 == 0, none, none), 6).alias("abstractness"))


@query("""WITH v AS (SELECT concat('/', s_name, ': ', CASE WHEN s_suppkey % 3 = 0 THEN 'PUA.' WHEN s_suppkey % 3 = 1 THEN 'Heuristics.' ELSE 'Win.' END, s_nationkey, ' FOUND') AS line FROM supplier)
SELECT regexp_extract(line, '^(.*): (.+) FOUND$', 1) AS path, regexp_extract(line, '^(.*): (.+) FOUND$', 2) AS signature, regexp_matches(line, ': (PUA|Heuristics)[.]') AS heuristic FROM v""")
def antivirus_output(spark, sf):
    from gneiss.sources.scanners import antivirus

    name = F.when(F.col("s_suppkey") % 3 == 0, "PUA.").when(F.col("s_suppkey") % 3 == 1, "Heuristics.").otherwise("Win.")
    return antivirus(table(spark, sf, "supplier").select(F.concat(F.lit("/"), "s_name", F.lit(": "), name, F.col("s_nationkey").cast("string"), F.lit(" FOUND")).alias("value")))


@query("""SELECT concat('lock', s_nationkey) AS lockfile, s_name AS package, s_suppkey::VARCHAR AS version, concat(CASE WHEN s_suppkey % 4 = 0 THEN 'MAL-' ELSE 'CVE-' END, s_suppkey) AS ids, s_suppkey % 4 = 0 AS malicious FROM supplier""")
def dependency_report(spark, sf):
    from gneiss.sources.scanners import vulnerabilities

    s = table(spark, sf, "supplier")
    ids = F.array(F.struct(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "MAL-").otherwise("CVE-"), F.col("s_suppkey").cast("string")).alias("id")))
    package = F.struct(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("version")).alias("package"), ids.alias("vulnerabilities"))
    result = F.struct(F.struct(F.concat(F.lit("lock"), F.col("s_nationkey").cast("string")).alias("path")).alias("source"), F.collect_list(package).alias("packages"))
    doc = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.array(result).alias("results"))).alias("value"))
    return vulnerabilities(doc).withColumn("ids", F.array_join("ids", ","))


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'bind' WHEN role = 'system' THEN 'refresh' ELSE 'access' END AS what FROM conversations UNION ALL SELECT conv_id, turn, 'commit' FROM conversations WHERE turn % 5 = 1),
a AS (SELECT DISTINCT conv_id, turn, coalesce((SELECT max(b.turn) FROM e b WHERE b.conv_id = e.conv_id AND b.turn < e.turn AND b.what IN ('bind', 'refresh')), 0) AS since FROM e WHERE what = 'access')
SELECT DISTINCT concat('c', conv_id) AS fn, turn AS line FROM a WHERE EXISTS (SELECT 1 FROM e c WHERE c.what = 'commit' AND c.conv_id = a.conv_id AND c.turn > a.since AND c.turn < a.turn)""")
def read_after_commit(spark, sf):
    c = table(spark, sf, "conversations")
    what = F.when(F.col("turn") % 5 == 0, "bind").when(F.col("role") == "system", "refresh").otherwise("access")
    fn = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("fn")
    e = c.select(F.lit("p").alias("path"), fn, F.lit("x").alias("name"), F.col("turn").alias("line"), what.alias("what"))
    e = e.union(c.where("turn % 5 = 1").select(F.lit("p"), fn, F.lit(None).cast("string"), "turn", F.lit("commit")))
    return findings.read_after_commit(e).select("fn", "line").distinct()


@query("""WITH s AS (SELECT c_nationkey AS path, c_mktsegment AS h, round(c_acctbal / 1000) AS literals, c_custkey AS line FROM customer)
SELECT path, h AS skeleton_hash, count(*) AS n, count(DISTINCT literals) AS variants, min(line) AS line FROM s GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT literals) >= 2""")
def near_twins(spark, sf):
    c = table(spark, sf, "customer")
    return crossfile.near_twins(c.select(F.col("c_nationkey").alias("path"), F.col("c_mktsegment").alias("skeleton_hash"), F.round(F.col("c_acctbal") / 1000).alias("literals"), F.col("c_custkey").alias("line")), 3)


@query(f"WITH {L_SQL}, b AS (SELECT doc_id, md5(line) AS h, list_sort(list(DISTINCT line_no)) AS lines FROM l GROUP BY 1, 2 HAVING count(DISTINCT line_no) >= 2) SELECT doc_id AS path, h AS block_hash, array_to_string(lines, ',') AS lines FROM b")
def repeated_blocks(spark, sf):
    b = document_lines(spark, sf).select(F.col("doc_id").alias("path"), F.md5("line").alias("block_hash"), F.col("line_no").alias("line"))
    return crossfile.repeated_blocks(b).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("""WITH m AS (SELECT o_orderstatus AS status, c_nationkey AS nation, c_custkey AS k, o_totalprice AS rank, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS cluster_id, nation, rank, concat('o', o) AS id, k FROM m)
SELECT cluster_id, count(DISTINCT nation) AS n_modules, count(*) AS n_members, arg_max(id, (rank, id)) AS node_id FROM c GROUP BY cluster_id HAVING count(DISTINCT nation) >= 5 AND count(DISTINCT nation) / count(*) >= 0.0001""")
def scattered_concepts(spark, sf):
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cluster = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    v = m.select(cluster.alias("cluster_id"), F.col("c_nationkey").cast("string").alias("module"), F.col("o_totalprice").alias("rank"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("function").alias("kind"), F.lit("production").alias("role"), F.lit(1).alias("line"))
    return graph.scattered_concepts(v, 5, 0.0001).select("cluster_id", "n_modules", "n_members", "node_id")


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, d AS (SELECT node_id, (SELECT count(*) FROM e WHERE src = node_id) AS r FROM v), t AS (SELECT node_id FROM d ORDER BY r DESC, node_id LIMIT 120)
SELECT src, dst FROM e WHERE src IN (SELECT node_id FROM t) AND dst IN (SELECT node_id FROM t)""")
def top_nodes_induced(spark, sf):
    v, e = star_graph(spark, sf)
    top = graph.degrees(v, e).orderBy(F.desc("out_degree"), "node_id").limit(120)
    return graph.induced(e, top).select("src", "dst")


@query("""WITH e AS (SELECT o_custkey AS a, p_brand AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT b AS other, '?' AS kind, round(w, 4) AS weight, 0.0::DOUBLE AS rank FROM e WHERE a = 1 ORDER BY w DESC, b LIMIT 10""")
def related_symbols(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = li.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("p_brand").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("kind", F.lit("usage_similar"))
    none = spark.createDataFrame([], "node_id string, kind string, rank double")
    return graph.related(none, e, "c1")


@query("""WITH m AS (SELECT c_mktsegment AS label, count(*) AS member_count FROM customer GROUP BY 1) SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = (SELECT label FROM m WHERE contains(lower(label), 'build') ORDER BY member_count DESC, label LIMIT 1)""")
def concept_members(spark, sf):
    c = table(spark, sf, "customer")
    labels = c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("member_count")).withColumn("cluster_id", F.col("label"))
    return graph.concept(c.withColumn("cluster_id", F.col("c_mktsegment")).withColumn("name", F.col("c_name")), labels, "BUILD").select("c_custkey", "c_name")


@query("""WITH p AS (SELECT sum(o_totalprice) AS t, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) FILTER (o_orderpriority LIKE '1%') AS g, count(*) AS n FROM orders) SELECT n AS files, n AS n_findings, s AS suppressed, g AS ignored FROM p""")
def scan_totals(spark, sf):
    o = table(spark, sf, "orders").select(F.lit(1).alias("n_findings"), (F.col("o_orderstatus") == "F").cast("int").alias("suppressed"), F.col("o_orderpriority").startswith("1").cast("int").alias("ignored"))
    return findings.scan_totals(o)


@query(f"WITH {L_SQL}, w AS (SELECT doc_id, line_no FROM l WHERE contains(line, '.')), f AS (SELECT doc_id, min(line_no) AS starts FROM w GROUP BY 1) SELECT l.doc_id, count(*) AS preamble FROM l JOIN f USING (doc_id) WHERE line_no < starts GROUP BY 1")
def preamble_lines(spark, sf):
    lines = document_lines(spark, sf)
    first = Window.partitionBy("doc_id")
    starts = F.min(F.when(F.col("line").contains("."), F.col("line_no"))).over(first)
    return lines.withColumn("starts", starts).where("line_no < starts").groupBy("doc_id").agg(F.count(F.lit(1)).alias("preamble"))
