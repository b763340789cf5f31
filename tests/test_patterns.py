import random
from fnmatch import fnmatchcase

from gneiss.operators import patterns
from gneiss.sources import config


def draw(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def test_containing_against_plain_code(spark):
    rng = random.Random(1)
    texts = [draw(rng, "abAB.é\n🙂", 9) for _ in range(300)] + ["", "x" * 200_000 + "needle"]
    terms = sorted({draw(rng, "abAB.é\n🙂", 5) for _ in range(120)} | {"", "a", "NEEDLE", "nowhere", "🙂a"})
    items = spark.createDataFrame([*enumerate(texts), (9999, None)], "key long, text string")
    asked = spark.createDataFrame([(t,) for t in [*terms, *terms, None]], "term string")
    got = sorted(tuple(r) for r in patterns.containing(items, asked).collect())
    assert got == sorted({(t.lower(), k) for t in terms for k, x in enumerate(texts) if t.lower() in x.lower()})


def test_globs_against_plain_code(spark):
    rng = random.Random(2)
    paths = sorted({draw(rng, "ab/.]-[!^&\\", 9) for _ in range(400)} | {"src/main.py", "a\nb", "x/é.py", "x/🙂.py"})
    globs = sorted({draw(rng, "ab/.*?", 6) for _ in range(200)} | {"*", "?", "*.py", "src/*", "[ab]*", "[!ab]*", "[]]", "[!]]*", "a[", "[a-]*", "[^a]*", "*[[]*", "*[&]*", "*[\\]*", "?.py", "", "*a*b*", "[", "[]", "[!", "a[!", "\\*"})
    rows = lambda xs, n: spark.createDataFrame([(x,) for x in [*xs, xs[0], None]], f"{n} string")
    got = sorted(tuple(r) for r in patterns.globbed(rows(paths, "path"), rows(globs, "pattern")).collect())
    assert got == sorted((g, p) for g in globs for p in paths if fnmatchcase(p, g) or fnmatchcase(p.split("/")[-1], g))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key long, text string")
    assert not patterns.containing(none, spark.createDataFrame([("a",)], "term string")).count()
    assert not patterns.containing(spark.createDataFrame([(1, "a")], "key long, text string"), spark.createDataFrame([], "term string")).count()


def test_only_texts_with_the_rarest_gram_are_compared(spark):
    items = spark.createDataFrame([(i, f"module_{i}.run") for i in range(1000)], "key long, text string")
    asked = patterns.lookups(spark.createDataFrame([("_77.run",)], "pattern string"), patterns.F.array("pattern"))
    assert patterns.candidates(items, asked).count() <= 40  # holds "_77.ru" or "77.run"


def test_plan_with_many_overrides(spark):
    """Above FEW_GLOBS the overrides are looked up; both ways give the same plan."""
    globs = [f"src/m{i % 7}*" if i % 3 else f"*{i}.py" for i in range(60)]
    files = spark.createDataFrame([(f"src/m{i}.py", "production") for i in range(80)] + [("b/x.sh", "test")], "path string, role string")
    rows = [("R", role, i, g, True, i % 5, "auto", f"f{i}") for role in ("production", "test") for i, g in enumerate([None, *globs])]
    matrix = spark.createDataFrame(rows, "rule_id string, role string, layer int, glob string, enabled boolean, rank int, verdict string, fingerprint string")
    few = sorted(map(tuple, config.plan(files, matrix, globs, few=1000).collect()))
    assert few == sorted(map(tuple, config.plan(files, matrix, globs, few=0).collect())) and len(few) == 81


def clustered_vectors(spark, n=3000, dim=24, centres=12, spread=0.05):
    import numpy as np

    rng = np.random.default_rng(3)
    middle = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:centres]
    share = np.where(rng.random(n) < 0.34, 0, rng.integers(0, centres, n))  # one centre holds a third of all rows
    v = middle[share] + rng.normal(size=(n, dim)) * spread
    v[7], v[8] = v[9], 0.0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return v, spark.createDataFrame([*rows, (n, None), (n + 1, [None] * dim)], "node_id long, v array<double>")


def test_cosine_neighbours_against_plain_code(spark):
    import numpy as np

    from gneiss.operators import graph

    v, table = clustered_vectors(spark)
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(np.nan_to_num(u) @ np.nan_to_num(u).T, 6)
    want = set()
    for i in range(len(v)):
        best = sorted((j for j in range(len(v)) if j != i and s[i, j] >= 0.9), key=lambda j: (-s[i, j], -j))[:8]
        want |= {(min(i, j), max(i, j)) for j in best}
    got = {(r["src"], r["dst"]) for r in graph.cosine_neighbours(table, 0.9, 8, block=100).collect()}
    # pairs whose sixth digit depends on the order of addition can stand on either side of a tie
    assert len(got ^ want) <= len(want) // 500, len(got ^ want)


def test_cosine_visits_only_blocks_in_reach(spark):
    from gneiss.operators import graph

    v, table = clustered_vectors(spark)
    unit = table.where("node_id < 3000 and node_id <> 8")
    norm = graph.F.sqrt(graph.dot(graph.F.col("v"), graph.F.col("v")))
    unit = unit.select("node_id", graph.F.transform("v", lambda x: x / norm).alias("v"))
    near, all_of = graph.near_blocks(unit, 0.8, 100).count(), graph.near_blocks(unit, -1.0, 100).count()
    assert all_of >= 30 * 2999 and near < all_of / 2, (near, all_of)
    assert not graph.cosine_neighbours(table.limit(0)).count()
