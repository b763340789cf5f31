import json

import pytest

from gneiss import cli


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "main.py").write_text("import hashlib\nfrom app.util import helper\n\n\ndef digest(data: bytes) -> str:\n    helper(data)\n    return hashlib.md5(data).hexdigest()\n")
    (tmp_path / "app" / "util.py").write_text("def helper(data: bytes) -> bytes:\n    return data\n")
    return str(tmp_path)


def run(spark, capsys, *args):
    code = cli.main(list(args), spark)
    return code, capsys.readouterr().out


def test_commands(spark, capsys, repo, tmp_path_factory):
    index = "file://" + str(tmp_path_factory.mktemp("index"))
    code, out = run(spark, capsys, "scan", repo, "--fail-on", "low", "--index", index, "--format", "json")
    assert code == 1 and "PY-SEC-WEAK-HASH" in json.loads(out)["rules"]
    assert "app/main.py" in run(spark, capsys, "aggregate", "--index", index)[1]
    assert json.loads(run(spark, capsys, "report", "--index", index, "--format", "summary")[1])["count"] > 0
    run(spark, capsys, "ignore", "add", "PY-SEC-WEAK-HASH", "--index", index)
    assert "PY-SEC-WEAK-HASH" not in run(spark, capsys, "scan", repo, "--index", index)[1]
    assert json.loads(run(spark, capsys, "ignore", "clear", "--index", index)[1]) == []
    with pytest.raises(SystemExit, match="did you mean PY-SEC-WEAK-HASH"):
        run(spark, capsys, "scan", repo, "--rule", "PY-SEC-WEAK-HASHES")
    assert json.loads(run(spark, capsys, "discover", repo)[1])["roles"] == {"production": 2}
    assert {r["symbol"] for r in json.loads(run(spark, capsys, "manifest", repo)[1])} == {"digest", "helper"}
    known = json.loads(run(spark, capsys, "registry", repo)[1])
    assert known["languages"] == ["python", "typescript"] and "sarif" in known["reporters"] and known["plugins"] == []
    assert len(json.loads(run(spark, capsys, "rules", "--standard", "bandit")[1])) > 10
    use = json.loads(run(spark, capsys, "graph", repo, "usages", "helper")[1])
    assert use["resolved"] == "app/util.py::helper" and any(u["kind"] == "calls" for u in use["usages"])
    assert json.loads(run(spark, capsys, "graph", repo, "overview")[1])["nodes"] == 4
    assert "digraph" in run(spark, capsys, "graph", repo, "export")[1]
    near = json.loads(run(spark, capsys, "graph", repo, "ego", "helper", "--format", "json")[1])
    assert "app/util.py::helper" in json.dumps(near["nodes"]) and "app/main.py::digest" in json.dumps(near["nodes"])


def test_a_second_scan_parses_only_what_has_changed(spark, capsys, repo, tmp_path_factory, monkeypatch):
    from pathlib import Path

    from gneiss.plans import audit

    index, parsed, facts_of = "file://" + str(tmp_path_factory.mktemp("index")), [], audit.facts_of
    monkeypatch.setattr(audit, "facts_of", lambda files: (parsed.append(sorted(r["path"] for r in files.select("path").collect())), facts_of(files))[1])
    run(spark, capsys, "scan", repo, "--index", index, "--format", "json")
    Path(repo, "app", "util.py").write_text("def helper(data):\n    return eval(data)\n")
    second = json.loads(run(spark, capsys, "scan", repo, "--index", index, "--format", "json")[1])
    whole = json.loads(run(spark, capsys, "scan", repo, "--format", "json")[1])
    assert parsed == [["app/main.py", "app/util.py"], ["app/util.py"], ["app/main.py", "app/util.py"]]
    key = lambda x: (x["file"], x["line"], x["rule"], x["evidence"])
    assert sorted(second["findings"], key=key) == sorted(whole["findings"], key=key) and second["count"] == second["shown"] > 0
