import ast

import pytest

from gneiss.cases import python_cases
from gneiss.facts import dealt, python, typescript

SF = "/root/testdata/sf0.001"
SOURCES = [t for c in python_cases.CASES for t in c[1:]] + ["x = f'{a!r}' + u'b' * -1 ** 2\n\n\ndef f(*a, k: int = 1.5, **b):\n    'doc'\n    return (yield a), g(*a, **b)(1).c, (i for i in a)\n"]


def test_small_tables_are_dealt_over_all_cores(spark):
    from gneiss.plans.more_tables import source_facts

    least = 4 * spark.sparkContext.defaultParallelism
    assert source_facts(spark, SF).rdd.getNumPartitions() >= least  # one split of part before
    assert dealt(spark.range(5000 * (least + 1), numPartitions=1), "id").rdd.getNumPartitions() == least + 1


def test_code_is_that_of_unparse():
    for source in SOURCES:
        for node in python.walk(ast.parse(source)):
            if isinstance(node, ast.expr | ast.stmt):
                assert python.text(node) == ast.unparse(node)


def test_facts_of_some_kinds_are_those_of_all():
    for source in SOURCES:
        whole = python.facts_of("a.py", source)
        for kinds in ({"module"}, {"function"}, {"call", "class"}, {"symbol_def", "comment", "block"}, {"if", "assign", "literal"}, {"if", "assign", "import", "except", "raise", "return"}):
            assert python.facts_of("a.py", source, frozenset(kinds)) == [r for r in whole if r[1] in kinds or r[1] == "error" and "error" in kinds]
    source = "const a = go(`x${b}`)\n// c\nexport function M() {\n  return <p>{a}</p>\n}\n"
    for kinds in ({"module"}, {"component", "call"}):
        assert sorted(map(str, typescript.facts_of("a.tsx", source, frozenset(kinds)))) == sorted(str(r) for r in typescript.facts_of("a.tsx", source) if r[1] in kinds)


def test_copies_of_a_file_are_parsed_once(monkeypatch):
    parsed, parse = [], ast.parse
    monkeypatch.setattr(python.ast, "parse", lambda source: (parsed.append(source), parse(source))[1])
    rows = [python.facts_of(f"{i}.py", "copied_only_here = 1\n") for i in range(3)]
    assert len(parsed) == 1 and [r[0][0] for r in rows] == ["0.py", "1.py", "2.py"] and rows[0][0][1:] == rows[2][0][1:]


@pytest.mark.parametrize("most", [1, 7])
def test_rows_are_handed_on_some_at_a_time(spark, most):
    files = spark.createDataFrame([(f"{i}.py", "" if i % 3 else None) for i in range(20)], "path string, text string").coalesce(1)
    got = python.rows_of(files, python.facts_of, most)
    assert sorted(r["path"] for r in got.collect()) == sorted(f"{i}.py" for i in range(20))


def test_rules_read_no_other_kinds_than_they_say(spark):
    """What a rule finds over the kinds of facts that it names is what it finds over all."""
    from pyspark.sql import functions as F

    from gneiss.rules import base

    files = [(f"src/m{i}.py" if i % 3 else f"tests/test_{i}.py", t) for i, t in enumerate(SOURCES)]
    whole = python.facts(spark.createDataFrame(files, "path string, text string")).checkpoint()
    by_kinds = {}
    for r in base.load().values():
        if r.language == "python" and r.reads:
            by_kinds.setdefault(r.reads, []).append(r.rule_id)
    assert base.kinds_read([base.RULES["PY-STYLE-FILE-SIZE"], base.RULES["PY-STYLE-INLINE-IMPORT"]]) == ("import", "module")
    assert base.kinds_read([base.RULES["PY-STYLE-FILE-SIZE"], base.RULES["PY-STYLE-LONG-COMMENT"]]) is None
    for kinds, rules in by_kinds.items():
        rows = lambda facts: sorted(map(str, base.findings(facts, "python", rules).collect()))  # noqa: B023, E731
        assert rows(whole) == rows(whole.where(F.col("kind").isin(*kinds))), kinds
