import itertools
import random

from pyspark.sql import functions as F

from gneiss.facts.python import facts
from gneiss.operators import communities, graph, resolve
from gneiss.plans import codegraph, plugins
from gneiss.rules import base

FILES = {
    "app/base.py": "class Store:\n    def load_item(self, key: str) -> str:\n        return key\n    def save_item(self, key: str) -> None:\n        self.load_item(key)\n",
    "app/__init__.py": "from app.base import Store\n",
    "app/disk.py": "from app import Store\nfrom app.util import helper\n\n\nclass DiskStore(Store):\n    def load_item(self, key: str) -> str:\n        return helper(key)\n    def flush(self) -> None:\n        self.save_item('x')\n\n\ndef open_store(path: str) -> Store:\n    return DiskStore()\n",
    "app/util.py": "def helper(key: str) -> str:\n    return local(key)\n\n\ndef local(key: str) -> str:\n    return key\n",
    "app/use.py": "import app.util\n\n\ndef run(key: str) -> str:\n    return app.util.helper(key)\n",
}


def test_structural_edges(spark):
    f = facts(spark.createDataFrame(list(FILES.items()), "path string, text string")).checkpoint()
    v = resolve.nodes(f).checkpoint()
    e = {(r["src"], r["dst"], r["kind"]) for r in resolve.edges(f, v).collect()}
    assert {
        ("app/disk.py", "app/disk.py::DiskStore", "contains"), ("app/disk.py::DiskStore", "app/disk.py::DiskStore.flush", "contains"), ("app/disk.py", "app/util.py", "imports") if False else ("app/use.py", "app/util.py", "imports"),
        ("app/disk.py::DiskStore.load_item", "app/util.py::helper", "calls"), ("app/util.py::helper", "app/util.py::local", "calls"), ("app/use.py::run", "app/util.py::helper", "calls"),
        ("app/disk.py::DiskStore", "app/base.py::Store", "inherits"), ("app/disk.py::DiskStore.load_item", "app/base.py::Store.load_item", "overrides"),
        ("app/disk.py::DiskStore.flush", "app/base.py::Store.save_item", "calls"), ("app/base.py::Store.save_item", "app/base.py::Store.load_item", "calls"), ("app/disk.py::open_store", "app/base.py::Store", "references_type"),
    } <= e
    assert not any(a == b for a, b, _ in e)
    nodes, edges, named = codegraph.build(f)
    assert abs(nodes.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert named.count() >= 1 and set(codegraph.findings(nodes, edges, f, 1.0).columns) == {"path", "line", "evidence", "rule_id", "category", "severity", "verdict_kind"}
    assert graph.search(nodes, "LOAD_item").count() == 2
    assert {r["node_id"] for r in graph.resolve(nodes, "helper").collect()} == {"app/util.py::helper"}
    assert graph.usages(nodes, edges, "app/util.py::helper").where("direction = 'in' and kind = 'calls'").first()["n"] == 2
    sub, inner = graph.ego(nodes, edges, spark.createDataFrame([("app/util.py::helper",)], "node_id string"), 1)
    assert sub.count() >= 4 and inner.count() >= 3


def modularity(nodes, links, label):
    total = sum(w for _, _, w in links)
    deg = dict.fromkeys(nodes, 0.0)
    for a, b, w in links:
        deg[a] += w
        deg[b] += w
    inside = sum(w for a, b, w in links if label[a] == label[b]) / total
    return inside - sum(sum(deg[n] for n in nodes if label[n] == c) ** 2 for c in set(label.values())) / (4 * total * total)


def test_greedy_modularity_finds_cliques(spark):
    links = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    label = communities.greedy_modularity(nodes, links)
    assert len({label[n] for n in nodes if n[0] == "a"}) == 1 and len(set(label.values())) == 3
    r = random.Random(4)
    other = {n: r.randrange(3) for n in nodes}
    assert modularity(nodes, links, label) > modularity(nodes, links, other)
    v = spark.createDataFrame([(n,) for n in nodes], "node_id string")
    e = spark.createDataFrame([(a, b, "calls", 1.0) for a, b, _ in links], "src string, dst string, kind string, weight double")
    got = {r["node_id"]: r["cluster_id"] for r in communities.clusters(v, e).collect()}
    assert got == label
    # the plan for giant components, on all of them
    far = {r["node_id"]: r["cluster_id"] for r in communities.clusters(v, e, giant=1).collect()}
    assert far == label
    alone = v.union(spark.createDataFrame([("zz",)], "node_id string"))
    assert {r["node_id"]: r["cluster_id"] for r in communities.clusters(alone, e).collect()} == {**label, "zz": 3}


def test_components_are_merged_as_the_whole_graph_is(spark):
    r = random.Random(9)
    pairs = {(min(a, b), max(a, b)) for c in range(12) for _ in range(c * 2) for a, b in [(f"c{c}n{r.randrange(6)}", f"c{c}n{r.randrange(6)}")] if a != b}
    links = [(a, b, r.choice([0.5, 0.6, 0.9])) for a, b in sorted(pairs)]
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    v = spark.createDataFrame([(n,) for n in nodes], "node_id string")
    e = spark.createDataFrame([(a, b, "name_similar", w) for a, b, w in links], "src string, dst string, kind string, weight double")
    assert {x["node_id"]: x["cluster_id"] for x in communities.clusters(v, e).collect()} == communities.greedy_modularity(nodes, links)
    from gneiss.operators.components import components

    least = {}
    for a, b, _ in links:  # components by hand
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in nodes:
        for a, b, _ in links:
            least[a] = least[b] = min(least[a], least[b])
    chain = [(f"k{i:03}", f"k{i + 1:03}") for i in range(60)]
    frame = spark.createDataFrame([(a, b) for a, b, _ in links] + chain, "a string, b string")
    assert {x["node"]: x["component"] for x in components(frame).collect()} == least | {n: "k000" for p in chain for n in p}


def test_a_round_of_ranks_leaves_edges_in_place(spark):
    """No exchange stands between the checkpointed edges and their join with the ranks."""
    v = spark.range(200).selectExpr("cast(id as string) node_id")
    e = spark.range(800).selectExpr("cast(id % 200 as string) src", "cast((id * 7) % 200 as string) dst", "'calls' kind")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    seen, old = [], type(v).checkpoint
    try:
        type(v).checkpoint = lambda self, *a, **k: (seen.append(self._jdf.queryExecution().executedPlan().toString()), old(self, *a, **k))[1]
        graph.pagerank(v, e, iterations=2).count()
    finally:
        type(v).checkpoint = old
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(x for x in reversed(seen) if "inflow" in x and "SortMergeJoin [src" in x)
    lines = join.split("\n")
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin [src" in x)
    side = lines[at + 1 : at + 4]
    assert any("Scan ExistingRDD" in x for x in side) and not any("Exchange" in x for x in side), side


def test_latent_vectors_both_ways(spark):
    r = random.Random(1)
    rows = [(f"d{i}", f"{'xyz'[i % 3]}{r.randrange(6)}") for i in range(24) for _ in range(8)]
    w = graph.tf_idf(spark.createDataFrame(rows, "node_id string, token string")).checkpoint()
    one = {r["node_id"]: r["v"] for r in communities.latent_vectors(w, 5).collect()}
    communities.LOCAL_CELLS, old = 0, communities.LOCAL_CELLS
    try:
        two = {r["node_id"]: r["v"] for r in communities.latent_vectors(w, 5).collect()}
    finally:
        communities.LOCAL_CELLS = old
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert all(abs(dot(one[a], one[b]) - dot(two[a], two[b])) < 1e-6 for a in one for b in one)


def test_naming_inconsistency(spark):
    rows = [(f"m::{v}_user_{i}", "function", f"{v}_user_record", "m.py", "production", i, 0.1, 1, ["reads"]) for i, v in enumerate(["fetch"] * 5 + ["obtain"] * 5)]
    v = spark.createDataFrame(rows, "node_id string, kind string, name string, module string, role string, line int, rank double, cluster_id int, profile array<string>")
    assert graph.naming_inconsistencies(v, ["reads", "writes"]).count() == 25
    assert graph.naming_inconsistencies(v.withColumn("profile", F.when(F.col("name").startswith("fetch"), F.array(F.lit("writes"))).otherwise(F.col("profile"))), ["reads", "writes"]).count() == 0


def test_plugins(spark, tmp_path):
    (tmp_path / "good.py").write_text("from gneiss.rules.base import rule\nrule('X-HOUSE', 'style', 'low', 'auto', 'shell')(lambda lines: lines.where(\"text like '%house%'\").selectExpr('path', 'line', 'text as evidence'))\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')\n")
    assert plugins.load({"plugins": {"path": str(tmp_path)}}) == []
    import warnings

    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert plugins.load({"plugins": {"path": str(tmp_path), "trust_local": True}}) == ["good.py"]
    assert any("bad.py" in str(x.message) for x in w)
    assert base.RULES.pop("X-HOUSE").category == "style"


IMPORTS = {
    "pkg/__init__.py": "from .core import thing as renamed\nfrom .star import *\n",
    "pkg/core.py": "def thing():\n    return 1\n\n\nclass Base:\n    def go(self):\n        return thing()\n",
    "pkg/star.py": "from pkg.deep import *\n",
    "pkg/deep.py": "def far():\n    return 2\n",
    "use.py": "from pkg import renamed, far\n\n\ndef a():\n    return renamed()\n\n\ndef b():\n    return far()\n",
    "wide.py": "from pkg import *\n\n\ndef c():\n    return far()\n",
    "chain.py": "from pkg.core import Base\nclass A(Base):\n    x = 1\nclass B(A):\n    x = 1\nclass C(B):\n    x = 1\nclass D(C):\n    x = 1\nclass E(D):\n    x = 1\nclass F(E):\n    def run(self):\n        return self.go()\n",
    "typed.py": "from pkg.core import Base\n\n\ndef on(item: Base | None):\n    return item.go()\n\n\ndef made():\n    one = Base()\n    return one.go()\n",
    "back.py": "from pkg.core import thing\n\n\ndef give(run):\n    return run(thing)\n",
    "app/main.py": "app = make()\n",
    "app/routes.py": "from app.main import app\n\n\n@app.get('/')\ndef home():\n    return 1\n",
    "same_a.py": "def twice():\n    return 1\n",
    "same_b.py": "def twice():\n    return 2\n",
    "both.py": "import same_a\nimport same_b\n\n\ndef z():\n    return twice()\n",
    "circle.py": "class X(Y):\n    x = 1\nclass Y(X):\n    def m(self):\n        return self.nothing()\n",
}


def test_imports_stars_chains_receivers_callbacks_and_registries(spark):
    f = facts(spark.createDataFrame(list(IMPORTS.items()), "path string, text string")).checkpoint()
    e = {(r["src"], r["dst"], r["kind"]) for r in resolve.edges(f, resolve.nodes(f).checkpoint()).collect()}
    assert {
        ("use.py::a", "pkg/core.py::thing", "calls"), ("use.py::b", "pkg/deep.py::far", "calls"), ("wide.py::c", "pkg/deep.py::far", "calls"),
        ("chain.py::F.run", "pkg/core.py::Base.go", "calls"), ("typed.py::on", "pkg/core.py::Base.go", "calls"), ("typed.py::made", "pkg/core.py::Base.go", "calls"),
        ("typed.py::made", "pkg/core.py::Base", "references_type"), ("back.py::give", "pkg/core.py::thing", "callback_arg"), ("app/routes.py::home", "app/main.py", "registered_in"),
        ("pkg/star.py", "pkg/deep.py", "imports"), ("pkg/__init__.py", "pkg/core.py", "imports"),
    } <= e
    assert not any(a == "both.py::z" for a, _, _ in e)  # two modules in reach have the name


def test_united_definitions(spark):
    rows = [("n", 3, ["b", "a"], True, True), ("n", 1, ["a", "c"], False, False), ("m", 2, [], False, True)]
    got = {r["node_id"]: tuple(r)[1:] for r in resolve.united(spark.createDataFrame(rows, "node_id string, line int, callees array<string>, hof boolean, stub boolean"), ["callees"], ["hof"], ["stub"]).collect()}
    assert got == {"n": (1, ["a", "c", "b"], True, False), "m": (2, [], False, True)}


def test_words_are_stemmed(spark):
    from gneiss.functions.stem import stem

    words = {"consigned": "consign", "consistency": "consist", "knackeries": "knackeri", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "happy": "happi", "relational": "relat", "controlling": "control"}
    assert {w: stem(w) for w in words} == words
    f = facts(spark.createDataFrame([("a.py", "def load_items(path):\n    return path\n\n\ndef loading_item(paths):\n    return paths\n")], "path string, text string"))
    by = {}
    for r in resolve.documents(f).collect():
        by.setdefault(r["node_id"], set()).add(r["token"])
    assert by["a.py::load_items"] == by["a.py::loading_item"] == {"load", "item", "path"}


def test_the_graph_is_stored_and_follows_the_files(spark, tmp_path):
    from gneiss.sources import reports
    from gneiss.sources.index import Index

    index = Index(spark, f"file://{tmp_path}/index")
    now = {"a.py": "def f():\n    return g()\n\n\ndef g():\n    return 1\n", "b.py": "def h():\n    return 2\n"}
    frame = lambda: spark.createDataFrame(sorted(now.items()), "path string, text string")
    nodes, edges, _ = codegraph.current(spark, index, "r", frame())
    assert nodes.count() == 5 and ("a.py::f", "a.py::g", "calls") in {(r["src"], r["dst"], r["kind"]) for r in edges.collect()}
    before = {r["node_id"]: r["rank"] for r in nodes.collect()}
    assert {r["node_id"]: r["rank"] for r in codegraph.current(spark, index, "r", frame())[0].collect()} == before
    now["b.py"] = "from a import g\n\n\ndef h():\n    return g()\n"
    assert ("b.py::h", "a.py::g", "calls") in {(r["src"], r["dst"], r["kind"]) for r in codegraph.current(spark, index, "r", frame())[1].collect()}
    hit = spark.createDataFrame([("a.py", 1, "a.py::f", "GRAPH-GOD-CONCEPT", "suggestion")], "path string, line int, evidence string, rule_id string, severity string")
    nodes, edges, _ = codegraph.load(index, "r")
    payload = reports.graph_payload(nodes, edges, 3, hit)
    assert len(payload["nodes"]) == 3 and "a.py::g" in reports.graph_page(payload) and "digraph" in reports.dot(payload)
    assert [n["findings"][0]["rule_id"] for n in reports.graph_payload(nodes, edges, None, hit)["nodes"] if n["findings"]] == ["GRAPH-GOD-CONCEPT"]


def test_callees_through_re_exports(spark):
    tree = {
        "app/use.py": "from pkg import go as run, _hidden, listed, both, ring, deep, cls\nimport pkg.core as c\nfrom pkg import core\nfrom . import near\n\n\ndef f():\n    run(); _hidden(); listed(); both(); ring(); deep(); cls()\n    c.go(); core.go(); near.here(); f(); x.go()\n",
        "app/near.py": "def here():\n    pass\n",
        "app/__init__.py": "",
        "pkg/__init__.py": "from .core import *\nfrom .named import listed\nfrom .one import both\nfrom .two import both\nfrom .ring import ring\nfrom .d1 import deep\nfrom .core import K as cls\n",
        "pkg/core.py": "def go():\n    pass\n\n\ndef _hidden():\n    pass\n\n\nclass K:\n    def go(self):\n        pass\n",
        "pkg/named.py": "from .more import *\n",
        "pkg/more.py": "__all__ = ['listed']\n\n\ndef listed():\n    pass\n\n\ndef other():\n    pass\n",
        "pkg/one.py": "def both():\n    pass\n",
        "pkg/two.py": "def both():\n    pass\n",
        "pkg/ring.py": "from .gnir import ring\n",
        "pkg/gnir.py": "from .ring import ring\n",
        **{f"pkg/d{i}.py": f"from .d{i + 1} import deep\n" for i in range(1, 4)},
        "pkg/d4.py": "def deep():\n    pass\n",
    }
    f = facts(spark.createDataFrame(sorted(tree.items()), "path string, text string")).checkpoint()
    got = lambda depth: {(r["name"], r["dst"], r["steps"]) for r in resolve.callees(f, depth).where("path = 'app/use.py'").collect()}
    near = {("run", "pkg/core.py::go", 2), ("both", "pkg/one.py::both", 2), ("both", "pkg/two.py::both", 2), ("c.go", "pkg/core.py::go", 1), ("core.go", "pkg/core.py::go", 1), ("near.here", "app/near.py::here", 1)}
    assert got(4) == near | {("listed", "pkg/more.py::listed", 3)}
    assert got(5) == got(4) | {("deep", "pkg/d4.py::deep", 5)} and got(2) == near
    assert resolve.callees(f.limit(0)).isEmpty()


def test_usage_similar_with_copies_against_plain_code(spark):
    """Copies stand behind one of them; each node's k best are still those of all pairs."""
    draw = random.Random(5)
    kinds = [(draw.sample("abcdefg", draw.randint(0, 5)), draw.sample("xyz", draw.randint(0, 2))) for _ in range(25)]
    rows = [(i, *draw.choice(kinds)) for i in range(160)]
    items = spark.createDataFrame(rows, "node_id long, callees array<string>, types array<string>")
    different = {(frozenset(c), frozenset(t)) for _, c, t in rows}
    assert graph.one_of_each(items)[0].count() == len(different) < 30
    part = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    for threshold, k in ((0.5, 3), (0.3, 2), (0.5, 30)):
        want = set()
        for i, c, t in rows:
            near = [(round(0.6 * part(set(c), set(d)) + 0.4 * part(set(t), set(u)), 6), j) for j, d, u in rows if i != j]
            want |= {(min(i, j), max(i, j), w) for w, j in sorted((x for x in near if x[0] >= threshold), reverse=True)[:k]}
        assert {(r["src"], r["dst"], round(r["weight"], 6)) for r in graph.usage_similar(items, threshold, k).collect()} == want


def test_naming_inconsistencies_of_many_alike(spark):
    """Nodes alike in cluster, verb and objects are compared once; all their pairs come out, the smaller id first."""
    rows = [(f"n{i:03}", ("get", "load", "send")[i % 3] + ("_user_name", "_name_user", "_order")[i // 3 % 3], "m", i, i // 9 % 2) for i in range(90)]
    v = spark.createDataFrame(rows, "node_id string, name string, module string, line int, cluster_id int")
    v = v.withColumn("kind", F.lit("function")).withColumn("role", F.lit("production")).withColumn("profile", F.when(F.col("name").startswith("send"), F.array(F.lit("writes"))).otherwise(F.array(F.lit("reads"))))
    words = lambda r: frozenset(r[1].split("_")[1:])
    want = sorted((a[4], a[0], b[0], a[3]) for a in rows for b in rows if a[0] < b[0] and a[4] == b[4] and words(a) == words(b) and {a[1].split("_")[0], b[1].split("_")[0]} == {"get", "load"})
    got = graph.naming_inconsistencies(v, ("reads", "writes"))
    assert sorted((r["cluster_id"], r["first"], r["second"], r["line"]) for r in got.collect()) == want
