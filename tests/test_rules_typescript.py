import pytest

from gneiss.cases.typescript_cases import CASES, DESIGN, DESIGNED, PLACED
from gneiss.facts.typescript import facts_of
from gneiss.rules import base


def test_every_rule_has_a_case(spark):
    known = {r for r, x in base.load().items() if x.language == "typescript"}
    assert {c[0] for c in CASES + DESIGNED + PLACED} == known


def found(spark, files, rules=None):
    from gneiss.facts.typescript import facts

    hits = base.findings(facts(spark.createDataFrame(sorted(files.items()), "path string, text string")).checkpoint(), "typescript", rules)
    return {(r["rule_id"], r["path"]) for r in hits.select("rule_id", "path").distinct().collect()}


@pytest.fixture(scope="module")
def verdicts(spark):
    files = {f"m{i}/{side}.tsx": text for i, (_, *both) in enumerate(CASES) for side, text in zip(("bad", "good"), both)}
    for _, bad, good in PLACED:
        files |= bad | good
    return found(spark, files)


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(verdicts, i):
    assert (CASES[i][0], f"m{i}/bad.tsx") in verdicts and (CASES[i][0], f"m{i}/good.tsx") not in verdicts


@pytest.mark.parametrize("rule, bad, good", PLACED, ids=[c[0] for c in PLACED])
def test_rule_of_several_files(verdicts, rule, bad, good):
    assert any((rule, p) in verdicts for p in bad) and not any((rule, p) in verdicts for p in good)


def test_design_system_rules_are_silent_until_configured(spark, monkeypatch):
    from gneiss.rules import typescript

    files = {f"m{i}/{side}.tsx": text for i, (_, *both) in enumerate(DESIGNED) for side, text in zip(("bad", "good"), both)}
    rules = [r for r, _, _ in DESIGNED]
    assert not found(spark, files, rules)
    for key, value in DESIGN.items():
        monkeypatch.setitem(typescript.DESIGN, key, value)
    assert found(spark, files, rules) == {(r, f"m{i}/bad.tsx") for i, r in enumerate(rules)}


@pytest.mark.parametrize("source", ["", None, "<", "const a = b < c && d > e", "const f = <T,>(x: T) => x", "`${`${a}`}`", "'open", "/* open", "const A = () => <p>{/* c */}{'<b>'}</p>", "a = <div", "if (a<b) { c(d) }", "}}}))"])
def test_scanner_ends_on_odd_sources(source):
    assert any(r[1] == "module" for r in facts_of("a.tsx", source))


def test_types_are_not_markup():
    assert not [r for r in facts_of("a.ts", "const m = new Map<string, number>()\nconst f = <T extends B>(x: T): Array<T> => [x]\n") if r[1] == "element"]


def test_inventory(spark):
    from gneiss.facts import profile
    from gneiss.facts.typescript import facts

    source = "export function Card({ a, b }) {\n  return <p>{a}</p>\n}\nfunction add(x, y) {\n  const z = x\n  return z + y\n}\n"
    rows = profile.manifest(facts(spark.createDataFrame([("a.tsx", source)], "path string, text string"))).collect()
    assert {(r["symbol"], r["kind"], r["arg_count"]) for r in rows} >= {("Card", "component", 2), ("add", "function", 2)}
