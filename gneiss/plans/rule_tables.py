"""The rules over source trees drawn from `part`: a file per row, a query per language and category, and in SQL which rows have a finding.

A row of `part` is a source file: its key chooses the rule's template (``gneiss.cases``: a source with the finding and one without), its
size whether the file has the finding, and its key and brand go into the file's name and text.  Where a rule has a limit, the row's size
is what is measured against it; where a rule looks across files, the rows' sizes and brands say which files belong together.  A result
row is a row of `part`, the rule, and whether its file has the finding.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.cases import python_cases, shell_cases, typescript_cases
from gneiss.facts import dealt
from gneiss.plans.tables import QUERIES, SQL

Case = tuple[str, str, str, str, str]  # rule, path with the finding, its text, path without, its text

WITH = "p_size > 25"
LABELS = {"python": "\n\nLABEL_{k} = '{brand}'\n", "typescript": "\nexport const label{k} = '{brand}'\n", "shell": "\necho '{brand}'\n"}


def listed(n, one, sep: str):
    """one(i) for i from 1 to n, joined; n is a column, none for 0."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), sep)).otherwise("")


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def size():
    return F.col("p_size")


def key():
    return F.col("p_partkey")


# rule: source by size, and in SQL which sizes have the finding
SIZED = {
    "PY-OOP-LONG-PARAM-LIST": (lambda: text("def f(", listed(size(), lambda i: text("a", i), ", "), "):\n    return 1\n"), "p_size >= 7"),
    "PY-OOP-HIGH-COMPLEXITY": (lambda: text("def f(x, y):\n", listed(size(), lambda i: text("    if x > ", i, ":\n        y += 1\n"), ""), "    return y\n"), "p_size + 1 > 10"),
    "PY-OOP-CONSTRUCTOR-WALL": (lambda: text("x = Thing(", listed(size(), lambda i: text("a", i, "=", i), ", "), ")\n"), "p_size >= 12"),
    "PY-STYLE-FILE-SIZE": (lambda: F.repeat(F.lit("x = 1\n"), size() * 20), "p_size * 20 > 800"),
    "TS-STYLE-FILE-SIZE": (lambda: F.repeat(F.lit("x()\n"), size() * 20), "p_size * 20 > 800"),
}
REFERRED = "p_partkey IN (SELECT p_size FROM part)"
ALIKE = "p_size IN (SELECT p_size FROM part GROUP BY p_size HAVING count(*) > 1)"
# rules across files: path and text of a row's file, and in SQL which rows have the finding
ACROSS = {
    "PY-DEAD-SYMBOL": ("src/m{k}.py", "def _f{k}():\n    return 1\n\n\nprint(_f{size}())\n", f"NOT {REFERRED}"),
    "PY-TEST-UNUSED-FIXTURE": ("tests/test_{k}.py", "@pytest.fixture\ndef fx{k}():\n    return 1\n\n\ndef test_{k}(fx{size}):\n    assert fx{size}\n", f"NOT {REFERRED}"),
    "PY-XFILE-PRIVATE-USED": ("src/m{k}.py", "from src.m{size} import _f{size}\n\n\ndef _f{k}():\n    return 1\n\n\n_f{size}()\n", "p_partkey IN (SELECT q.p_size FROM part q WHERE q.p_size <> q.p_partkey)"),
    "PY-XFILE-DUP-MODEL": ("src/m{k}.py", "class M{k}(BaseModel):\n    x{size}: int\n    y{size}: str\n", ALIKE),
    "PY-XFILE-DUP-FUNCTION": ("src/m{k}.py", "def go{k}(a):\n    x = a.one{size}(1)\n    y = x.two(2)\n    return y.three()\n", ALIKE),
    "TS-XFILE-DUP-COMPONENT": ("src/M{k}.tsx", "export function M{k}({{ a }}) {{\n  const b = useThing{size}(a)\n  return <section><h4>{{b}}</h4></section>\n}}\n", ALIKE),
    "TS-XFILE-DUP-FUNCTION": ("src/m{k}.ts", "function f{k}(a) {{\n  const b = go{size}(a)\n  const c = run(b)\n  return c.end()\n}}\n", ALIKE),
    "TS-XFILE-DUP-JSX-BLOCK": ("src/B{k}.tsx", "export const B{k} = () => <form><x{size}><b>x</b></x{size}><p><i>y</i></p></form>\n", ALIKE),
}


def placed(cases, bad_path: str, good_path: str) -> list[Case]:
    return [(rule, bad_path, bad, good_path, good) for rule, bad, good in cases if rule not in SIZED and rule not in ACROSS]


def all_cases() -> dict[str, list[Case]]:
    tests = [c for c in python_cases.CASES if "-TEST-" in c[0]]
    supply = [(rule, "p{k}/" + next(iter(bad)).split("/")[-1], *bad.values(), "p{k}/" + next(iter(good)).split("/")[-1], *good.values()) for rule, bad, good in python_cases.PLACED if "-SUPPLY-" in rule]
    return {
        "python": placed([c for c in python_cases.CASES if c not in tests], "src/m{k}.py", "src/m{k}.py") + placed(tests, "tests/test_{k}.py", "tests/test_{k}.py") + supply,
        "typescript": placed(typescript_cases.CASES + typescript_cases.DESIGNED, "src/M{k}.tsx", "src/M{k}.tsx"),
        "shell": placed(shell_cases.CASES, "bin/s{k}.sh", "bin/s{k}.sh"),
        # findings that are no rule over facts: lines of scripts, settings and manifests
        "lines": [
            ("CFG-ENV-FILE-COMMITTED", "c{k}/.env", "NAME=1\n", "c{k}/name.env.md", "NAME=1\n"),
            ("CFG-SECRET-DETECTED", "c{k}/a.yaml", "key: AKIA" + "ABCDEFGH" * 2 + "\n", "c{k}/a.yaml", "key: AKIA\n"),
            ("MF-SUPPLY-INSTALL-HOOK", "c{k}/package.json", '{{"scripts": {{"postinstall": "node x.js"}}}}\n', "c{k}/package.json", '{{"scripts": {{"start": "node x.js"}}}}\n'),
            ("SH-STYLE-LONG-COMMENT", "c{k}/a.sh", "ls\n" + "# these are words\n" * 5, "c{k}/a.sh", "# these are words\n" * 5 + "ls\n"),
        ],
    }


def filled(template, braces: bool):
    """A template column with the row's key, size and brand; doubled braces stand for one where braces is set."""
    out = template
    for mark, value in (("{k}", key()), ("{size}", size()), ("{brand}", F.col("p_brand"))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")) if braces else out


def part_of(spark, sf: str) -> DataFrame:
    """The rows, dealt before texts are made of them: the table is one split or a few, and a row is a file to parse."""
    return dealt(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_brand"), "p_partkey")


def files_of(spark, sf: str, language: str, cases: list[Case]) -> DataFrame:
    """p_partkey, rule_id, path, text: a file for each row of part, by the template that its key chooses."""
    label = LABELS.get(language, "")
    rows = [(k, rule, bad_path, bad + label, good_path, good + label) for k, (rule, bad_path, bad, good_path, good) in enumerate(cases)]
    templates = spark.createDataFrame(rows, "k int, rule_id string, bad_path string, bad string, good_path string, good string")
    files = part_of(spark, sf).withColumn("k", (key() % len(rows)).cast("int")).join(F.broadcast(templates), "k")  # a catalogue of fixed size
    side = lambda a, b: F.when(F.expr(WITH), F.col(a)).otherwise(F.col(b))
    return files.select("p_partkey", "rule_id", filled(side("bad_path", "good_path"), False).alias("path"), filled(side("bad", "good"), language == "lines").alias("text"))


def found_in(files: DataFrame, found: DataFrame) -> DataFrame:
    """p_partkey, rule_id, found: whether the file of the row has the finding of its rule."""
    hits = found.select("path", "rule_id").distinct().withColumn("hit", F.lit(True))
    return files.select("p_partkey", "rule_id", "path").join(hits, ["path", "rule_id"], "left").select("p_partkey", "rule_id", F.coalesce("hit", F.lit(False)).alias("found"))


def findings_in(files: DataFrame, language: str, rules: list[str]) -> DataFrame:
    from gneiss.facts import lines, python, typescript
    from gneiss.plans import audit
    from gneiss.rules import base

    if language == "lines":
        return audit.of_lines(files)
    kinds = base.kinds_read([base.load()[r] for r in rules])
    facts = lines.code_lines(files) if language == "shell" else {"python": python.facts, "typescript": typescript.facts}[language](files, kinds)
    return base.findings(facts.checkpoint(), language, rules)


def run(language: str, cases: list[Case], spark, sf: str) -> DataFrame:
    files = files_of(spark, sf, language, cases)
    known = spark.createDataFrame([("src/good_name.py", "x = 1\n")], "path string, text string")  # comments of the templates name it
    return found_in(files, findings_in(files.select("path", "text").unionByName(known), language, sorted({c[0] for c in cases})))


def run_one(language: str, rule: str, path: str, source, spark, sf: str) -> DataFrame:
    """The same for one rule whose text is made from the row: `source` gives the column."""
    files = part_of(spark, sf).select("p_partkey", F.lit(rule).alias("rule_id"), filled(F.lit(path), False).alias("path"), source().alias("text"))
    return found_in(files, findings_in(files.select("path", "text"), language, [rule]))


def run_all(plans, spark, sf: str) -> DataFrame:
    out = None
    for plan in plans:
        df = plan(spark, sf)
        out = df if out is None else out.unionByName(df)
    return out


def scattered(spark, sf: str) -> DataFrame:
    """Settings classes, a file per brand: those outside the brand that has most."""
    rows = part_of(spark, sf)
    files = rows.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(text("class S", key(), "(BaseSettings):\n    pass\n"))), "\n\n").alias("text"))
    found = findings_in(dealt(files.select(text("src/", F.regexp_replace("p_brand", r"\W", "_"), ".py").alias("path"), "text"), "path"), "python", ["PY-CONFIG-SCATTERED-SETTINGS"])
    hits = found.select(F.regexp_extract("evidence", r"^S(\d+)$", 1).cast("long").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return rows.join(hits, "p_partkey", "left").select("p_partkey", F.lit("PY-CONFIG-SCATTERED-SETTINGS").alias("rule_id"), F.coalesce("hit", F.lit(False)).alias("found"))


SCATTERED_SQL = """WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), best AS (SELECT max(n) AS n FROM n), home AS (SELECT any_value(p_brand) AS p_brand FROM n JOIN best USING (n) HAVING count(*) = 1)
SELECT p_partkey, 'PY-CONFIG-SCATTERED-SETTINGS' AS rule_id, coalesce(p_brand <> (SELECT p_brand FROM home), false) AS found FROM part"""


def chosen_sql(cases: list[Case]) -> str:
    rules = ", ".join(f"({k}, '{c[0]}')" for k, c in enumerate(cases))
    return f"SELECT p_partkey, rule_id, {WITH} AS found FROM part JOIN (VALUES {rules}) t(k, rule_id) ON p_partkey % {len(cases)} = k"


def one_sql(rule: str, condition: str) -> str:
    return f"SELECT p_partkey, '{rule}' AS rule_id, {condition} AS found FROM part"


def category(rule: str) -> str:
    first, second = rule.split("-")[:2]
    return {"SA": "sqlalchemy", "TS": second.lower()}.get(first, second.lower()) if rule[:5] != "TS-DS" else "design_system"


def register() -> None:
    plans: dict[str, list] = {}
    for language, cases in all_cases().items():
        groups: dict[str, list[Case]] = {}
        for c in cases:
            groups.setdefault(f"rules_{language}_{category(c[0])}" if language in ("python", "typescript") else f"rules_{language}", []).append(c)
        for name, some in groups.items():
            plans.setdefault(name, []).append((partial(run, language, some), chosen_sql(some)))
    for rule, (source, condition) in SIZED.items():
        language = "typescript" if rule.startswith("TS") else "python"
        path = "src/M{k}.tsx" if language == "typescript" else "src/m{k}.py"
        plans.setdefault(f"rules_{language}_{category(rule)}", []).append((partial(run_one, language, rule, path, source), one_sql(rule, condition)))
    for rule, (path, source, condition) in ACROSS.items():
        language = "typescript" if rule.startswith("TS") else "python"
        made = lambda s=source, b=language == "typescript": filled(F.lit(s), b)
        plans.setdefault(f"rules_{language}_{category(rule)}", []).append((partial(run_one, language, rule, path, made), one_sql(rule, condition)))
    plans.setdefault("rules_python_config", []).append((scattered, SCATTERED_SQL))
    for name, some in plans.items():
        QUERIES[name], SQL[name] = partial(run_all, [p for p, _ in some]), " UNION ALL ".join(f"SELECT * FROM ({sql})" for _, sql in some)


def with_design(plan, spark, sf: str) -> DataFrame:
    """A query with the design system's settings in force while it is built."""
    from gneiss.rules import base

    base.load()
    from gneiss.rules import typescript

    before = dict(typescript.DESIGN)
    typescript.DESIGN.update(typescript_cases.DESIGN)
    try:
        return plan(spark, sf)
    finally:
        typescript.DESIGN.clear()
        typescript.DESIGN.update(before)


register()
QUERIES["rules_typescript_design_system"] = partial(with_design, QUERIES["rules_typescript_design_system"])
