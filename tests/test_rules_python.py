import pytest
from pyspark.sql import functions as F

from gneiss.cases.python_cases import CASES, PLACED
from gneiss.facts.python import facts_of
from gneiss.rules import base


@pytest.fixture(scope="module")
def verdicts(spark):
    """Which files of the cases each rule reports: a case's file is named by its number and side."""
    from gneiss.facts.python import facts

    place = lambda rule, i, side: f"tests/test_{i}_{side}.py" if "-TEST-" in rule else f"src/m{i}_{side}.py"
    files = {place(r, i, side): text for i, (r, *both) in enumerate(CASES) for side, text in zip(("bad", "good"), both)}
    for _, bad, good in PLACED:
        files |= bad | good
    files["src/good_name.py"] = "x = 1\n"
    found = base.findings(facts(spark.createDataFrame(sorted(files.items()), "path string, text string")).checkpoint())
    return {(r["rule_id"], r["path"]) for r in found.select("rule_id", "path").distinct().collect()}, place


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(verdicts, i):
    hits, place = verdicts
    rule = CASES[i][0]
    assert (rule, place(rule, i, "bad")) in hits and (rule, place(rule, i, "good")) not in hits


@pytest.mark.parametrize("rule, bad, good", PLACED, ids=[c[0] for c in PLACED])
def test_rule_of_several_files(verdicts, rule, bad, good):
    hits, _ = verdicts
    assert any((rule, p) in hits for p in bad) and not any((rule, p) in hits for p in good)


def test_every_python_rule_has_a_case(spark):
    known = {r for r, x in base.load().items() if x.language == "python"}
    assert {c[0] for c in CASES} | {c[0] for c in PLACED} == known


def test_every_other_rule_has_a_case_or_an_operator(spark):
    from gneiss.plans import rule_tables

    known = {r for r, x in base.load().items() if x.language in ("shell", "config")}
    cases = rule_tables.all_cases()
    assert known <= {c[0] for c in cases["shell"] + cases["lines"]}


def test_unparsable_and_empty():
    assert [r[1] for r in facts_of("a.py", "def (")] == ["error"]
    assert [r[1] for r in facts_of("a.py", "")] == ["module"]
    assert [r[1] for r in facts_of("a.py", None)] == ["module"]


def test_evidence_is_whole(spark):
    from gneiss.facts.python import facts

    code = "eval(" + " + ".join(f"part_{i}" for i in range(200)) + ")\n"
    found = base.findings(facts(spark.createDataFrame([("a.py", code)], "path string, text string")), only=["PY-SEC-DANGEROUS-EVAL"])
    assert found.first()["evidence"] == code.strip()


def test_catalogue(spark):
    c = base.catalogue(spark)
    assert base.listed(c, category="security").count() >= 20
    assert base.listed(c, standard="bandit").where(F.col("rule_id") == "PY-SEC-WEAK-HASH").count() == 1
    assert base.listed(c, framework="pytest").count() >= 8
