"""The code graph as two tables: nodes(node_id, kind, name, module, role, line, rank, cluster_id) and edges(src, dst, kind, weight).

Reads are joins and aggregations; ranks and traversals are loops of joins whose state is checkpointed, so a lost executor costs
at most the current step.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.core import dot, jaccard, object_tokens, smooth_idf, squared_distance, verb

# fixed values: edge kinds by use
STRUCTURAL = ("calls", "overrides", "inherits", "references_type", "callback_arg", "registered_in", "contains", "imports")
SEMANTIC = ("name_similar", "usage_similar")
RANKED = ("calls", "overrides", "references_type")
DEGREE = ("calls", "references_type", "overrides", "contains", "registered_in")
FUNCTIONS = ("function", "method")
TEST_ROLES = ("test", "test_support")


def incident(edges: DataFrame, node: str, kinds=STRUCTURAL) -> DataFrame:
    """other, kind, direction, weight: edges at a node; two equi-filters rather than an OR, so each can use pushdown."""
    e = edges.where(F.col("kind").isin(*kinds))
    out = e.where(F.col("src") == node).select(F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"), "weight")
    return out.unionByName(e.where(F.col("dst") == node).select(F.col("src").alias("other"), "kind", F.lit("in").alias("direction"), "weight"))


def resolve(nodes: DataFrame, symbol: str) -> DataFrame:
    """Nodes a symbol can mean: the id itself, else ids that end in ::symbol or .symbol."""
    exact = nodes.where(F.col("node_id") == symbol)
    near = nodes.where(F.col("node_id").endswith(f"::{symbol}") | F.col("node_id").endswith(f".{symbol}"))
    return exact if not exact.isEmpty() else near.orderBy("node_id")


def related(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 10) -> DataFrame:
    hits = incident(edges, node, SEMANTIC).join(nodes.select(F.col("node_id").alias("other"), F.col("kind").alias("node_kind"), "rank"), "other", "left")
    hits = hits.select("other", F.coalesce("node_kind", F.lit("?")).alias("kind"), F.round("weight", 4).alias("weight"), F.round(F.coalesce("rank", F.lit(0.0)), 6).alias("rank"))
    return hits.orderBy(F.desc("weight"), F.desc("rank"), "other").limit(limit)


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int, kinds=STRUCTURAL) -> DataFrame:
    """node_id, hops, kind, direction: everything within `depth` of seeds(node_id), both directions, breadth first.

    kind and direction are those of the edge by which a node was first met: out edges before in edges, then by kind; null for seeds.
    """
    e = edges.where(F.col("kind").isin(*kinds)).select("src", "dst", "kind")
    both = e.withColumn("way", F.lit(0)).union(e.select(F.col("dst"), F.col("src"), "kind", F.lit(1))).distinct()
    seen = seeds.select("node_id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("direction"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = both.join(frontier.select(F.col("node_id").alias("src")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min(F.struct("way", "kind")).alias("by"))
        step = step.join(seen, "node_id", "left_anti")
        frontier = step.select("node_id", F.lit(hop).alias("hops"), F.col("by.kind").alias("kind"), F.when(F.col("by.way") == 0, "out").otherwise("in").alias("direction")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def ego(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth and the edges among them."""
    near = neighbors(edges, seeds, depth)
    return nodes.join(near.select("node_id", "hops"), "node_id"), induced(edges, near)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node_id")
    return edges.join(n.withColumnRenamed("node_id", "src"), "src", "left_semi").join(n.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def cluster_subgraph(nodes: DataFrame, edges: DataFrame, cluster_id: int) -> tuple[DataFrame, DataFrame]:
    members = nodes.where(F.col("cluster_id") == cluster_id)
    return members, induced(edges, members)


def cluster_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, n: edges between each unordered pair of clusters."""
    c = nodes.where("cluster_id is not null").select("node_id", "cluster_id")
    e = edges.join(c.toDF("src", "ca"), "src").join(c.toDF("dst", "cb"), "dst").where("ca <> cb")
    return e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def visible(nodes: DataFrame, edges: DataFrame, kinds=None, query: str = "") -> tuple[DataFrame, DataFrame]:
    shown = nodes.where(F.lower("node_id").contains(query.lower()))
    if kinds:
        shown = shown.where(F.col("kind").isin(*kinds))
    return shown, induced(edges, shown)


def with_findings(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """nodes with the list of findings whose evidence is the node."""
    item = F.struct("rule_id", "severity", "path", "line")
    return nodes.join(findings.groupBy(F.col("evidence").alias("node_id")).agg(F.array_sort(F.collect_list(item)).alias("findings")), "node_id", "left")


def search(nodes: DataFrame, term: str, limit: int = 20) -> DataFrame:
    hits = nodes.where(F.lower("node_id").contains(term.lower()))
    rank = F.coalesce("rank", F.lit(0.0))
    return hits.orderBy(rank.desc(), "node_id").limit(limit).select("node_id", "kind", F.round(rank, 6).alias("rank"))


def usages(nodes: DataFrame, edges: DataFrame, node: str, sample: int = 5) -> DataFrame:
    """direction, kind, n, sample: distinct neighbours per direction and kind, the best ranked of them listed."""
    hits = incident(edges, node).select("direction", "kind", "other").distinct()
    hits = hits.join(nodes.select(F.col("node_id").alias("other"), "rank"), "other", "left")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("rank", F.lit(0.0))).alias("r"), "other"))), 1, sample)
    return hits.groupBy("direction", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(top["other"], ",").alias("sample"))


def clusters(nodes: DataFrame) -> DataFrame:
    return nodes.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("member_count"), F.sum("rank").alias("rank"))


def concept(nodes: DataFrame, labels: DataFrame, term: str) -> DataFrame:
    """Members of the cluster that fits a term: by label in either direction, the largest first; else by member names."""
    t = F.lit(term.lower())
    by_label = labels.where(F.lower("label").contains(t) | t.contains(F.lower("label")))
    best = by_label.orderBy(F.desc("member_count"), "cluster_id").limit(1).select("cluster_id")
    if best.isEmpty():
        named = nodes.where("cluster_id is not null").where(F.lower("name").contains(t))
        best = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(1).select("cluster_id")
    return nodes.join(F.broadcast(best), "cluster_id")  # one row


def degrees(nodes: DataFrame, edges: DataFrame, kinds=DEGREE) -> DataFrame:
    e = edges.where(F.col("kind").isin(*kinds))
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(out, "node_id", "left").join(into, "node_id", "left").na.fill(0, ["out_degree", "in_degree"])


def log_floor(column: str, sigma: float):
    """Mean plus sigma population deviations of log1p; nothing passes where there is no spread."""
    x = F.log1p(F.col(column))
    return F.when(F.stddev_pop(x) > 0, F.avg(x) + sigma * F.stddev_pop(x)).otherwise(F.lit(float("inf")))


def god_concepts(nodes: DataFrame, edges: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Production functions and classes whose fan-out, else fan-in, stands out in log space."""
    prod = nodes.where(F.col("kind").isin(*FUNCTIONS, "class") & ~F.coalesce("role", F.lit("production")).isin(*TEST_ROLES))
    d = degrees(prod, edges)
    floors = d.agg(log_floor("out_degree", sigma).alias("out_floor"), log_floor("in_degree", sigma).alias("in_floor"))
    hub, sink = F.log1p("out_degree") >= F.col("out_floor"), F.log1p("in_degree") >= F.col("in_floor")
    return d.join(F.broadcast(floors)).where(hub | sink).select(*prod.columns, "out_degree", "in_degree", F.when(hub, "fan-out").otherwise("fan-in").alias("why"))


def scattered_concepts(nodes: DataFrame, least_modules: int = 5, least_ratio: float = 0.5) -> DataFrame:
    m = nodes.where(F.col("kind").isin(*FUNCTIONS) & F.col("cluster_id").isNotNull() & ~F.coalesce("role", F.lit("production")).isin(*TEST_ROLES))
    anchor = F.max(F.struct("rank", "node_id", "module", "line")).alias("anchor")
    g = m.groupBy("cluster_id").agg(F.countDistinct("module").alias("n_modules"), F.count(F.lit(1)).alias("n_members"), anchor)
    g = g.where((F.col("n_modules") >= least_modules) & (F.col("n_modules") / F.col("n_members") >= least_ratio))
    return g.select("cluster_id", "n_modules", "n_members", "anchor.node_id", "anchor.module", "anchor.line")


def verb_vectors(functions: DataFrame, attributes, least: int = 5) -> DataFrame:
    """verb, n, vector from functions(verb, profile): the share of a verb's functions that show each attribute; rare verbs are left out."""
    share = F.array(*[F.avg(F.array_contains("profile", a).cast("double")) for a in attributes])
    return functions.groupBy("verb").agg(F.count(F.lit(1)).alias("n"), share.alias("vector")).where(F.col("n") >= least)


def naming_inconsistencies(nodes: DataFrame, attributes, least: int = 5, overlap: float = 0.6, distance: float = 0.15) -> DataFrame:
    """Pairs of one cluster with different verbs that behave alike on much the same object.

    nodes also have profile array<string>.  What makes a pair is the cluster, the verb and the objects, so kinds of nodes are compared, one
    for all nodes that are alike in these; they are blocked by cluster and shared object token.  Only pairs of the result are made of nodes.
    """
    prod = nodes.where(F.col("kind").isin(*FUNCTIONS) & ~F.coalesce("role", F.lit("production")).isin(*TEST_ROLES)).withColumn("verb", verb(F.col("name")))
    verbs = verb_vectors(prod, attributes, least).select("verb", "vector")
    m = prod.where("cluster_id is not null").join(verbs, "verb").withColumn("objects", F.array_sort(F.array_distinct(object_tokens(F.col("name"))))).where(F.size("objects") > 0)
    alike = ["cluster_id", "verb", "objects"]
    kinds = m.groupBy(*alike).agg(F.min("node_id").alias("node_id"), F.first("vector").alias("vector")).checkpoint()
    keyed = rare_first(kinds.select("node_id", F.transform("objects", lambda o: F.concat_ws("\x1f", F.col("cluster_id").cast("string"), o)).alias("tokens")), overlap)
    side = lambda p: keyed.select("token", "before", "node_id").join(kinds.select("node_id", F.struct("node_id", "verb", "vector", "objects").alias(p)), "node_id").select("token", F.col("before").alias(f"{p}_before"), p)
    # a pair is handled at its rarest common word
    pairs = side("a").join(side("b"), "token").where("a.node_id < b.node_id and a.verb <> b.verb").where(~F.arrays_overlap("a_before", "b_before"))
    ok = (jaccard(F.col("a.objects"), F.col("b.objects")) >= overlap) & (squared_distance(F.col("a.vector"), F.col("b.vector")) <= distance)
    pairs = pairs.where(ok).select(F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"))
    each = m.join(kinds.select(*alike, F.col("node_id").alias("of")), alike).select("of", "cluster_id", "node_id", "module", "line").checkpoint()
    # the pairs of two kinds are made in many tasks: a few rows on each side become many
    parts = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    left = pairs.join(each.withColumnRenamed("of", "a"), "a").select("b", "cluster_id", F.struct("node_id", "module", "line").alias("x"))
    right = each.select(F.col("of").alias("b"), F.struct("node_id", "module", "line").alias("y"))
    both = dealt_join(left, right, parts)
    first, second = F.least("x", "y"), F.greatest("x", "y")
    return both.select("cluster_id", first["node_id"].alias("first"), second["node_id"].alias("second"), first["module"].alias("module"), first["line"].alias("line"))


def dealt_join(left: DataFrame, right: DataFrame, parts: int, slots: int = 16) -> DataFrame:
    """left(b, ...) joined with right(b, y): the rows of one b on the left are dealt over some slots, to each of which goes a copy of the right's."""
    dealt = left.withColumn("slot", F.pmod(F.xxhash64("x"), F.lit(slots)).cast("int")).repartition(parts, "b", "slot")
    return dealt.join(right.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))), ["b", "slot"])


def rare_first(sets: DataFrame, least: float) -> DataFrame:
    """node_id, token, before from sets(node_id, tokens): the tokens of each set by which it can be found by a set with Jaccard >= least.

    Tokens are ordered by the number of sets that have them, then by name; two sets that are alike enough share one of the first
    size - ceil(least * size) + 1.  `before` holds the rarer tokens of the same set.
    """
    each = sets.select("node_id", F.explode(F.array_distinct("tokens")).alias("token"))
    n = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(n, "token").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    size = F.size("t")
    kept = F.least(size, size - F.ceil(F.lit(least) * size - 1e-9) + 1).cast("int")
    found = ordered.select("node_id", F.col("t.token").alias("t"), F.posexplode(F.slice("t.token", F.lit(1), kept)).alias("at", "token"))
    return found.select("node_id", "token", F.slice("t", F.lit(1), F.col("at")).alias("before"))


def pagerank(nodes: DataFrame, edges: DataFrame, kinds=RANKED, damping: float = 0.85, iterations: int = 50, personal: DataFrame | None = None) -> DataFrame:
    """node_id, rank.  Parallel edges count; dangling mass goes back to the restart distribution."""
    ids = nodes.select("node_id").distinct()
    e = edges.where(F.col("kind").isin(*kinds)).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    e = e.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("src"))).select("src", "dst", "share").checkpoint()
    base = ids.withColumn("p", F.lit(1.0))
    if personal is not None:
        chosen = personal.select("node_id", F.lit(1.0).alias("own")).distinct()
        base = ids.join(chosen, "node_id", "left").select("node_id", F.coalesce("own", F.lit(0.0)).alias("p"))
        if base.where("p > 0").isEmpty():
            base = ids.withColumn("p", F.lit(1.0))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = base.agg(F.sum("p").alias("t"))
    has_out = e.select(F.col("src").alias("node_id"), F.lit(True).alias("has_out")).distinct()
    state = base.join(F.broadcast(total)).select("node_id", (F.col("p") / F.col("t")).alias("p")).join(has_out, "node_id", "left").withColumn("rank", F.col("p"))  # one row
    # edges lie by their source and nodes by their id, in as many parts: a round shuffles only what flows over edges, summed up before
    with dealt_once(ids.sparkSession):
        e, state = e.repartition(parts, "src").checkpoint(), state.repartition(parts, "node_id").checkpoint()
        for _ in range(iterations):
            now = state.select(F.col("node_id").alias("src"), "rank")
            flow = e.join(now, "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
            # what nodes without out edges hold goes back to the start; it is one number a round
            lost = state.where("has_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            new = F.lit(1 - damping) * F.col("p") + damping * F.coalesce("inflow", F.lit(0.0)) + damping * F.col("lost") * F.col("p")
            # the state is read three times a round, so its plan is cut each round
            state = state.join(flow, "node_id", "left").join(F.broadcast(lost)).select("node_id", "p", "has_out", new.alias("rank")).checkpoint()
    whole = state.agg(F.sum("rank").alias("whole"))
    return state.join(F.broadcast(whole)).select("node_id", (F.col("rank") / F.col("whole")).alias("rank"))


@contextmanager
def dealt_once(spark: SparkSession):
    """Within it, a checkpoint keeps how its rows are dealt: a plan that is changed while it runs tells nothing of that."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


UNIT_ITEMS = 2048
UNIT = "node {0}, other {0}, weight double"


def usage_similar(items: DataFrame, threshold: float = 0.5, k: int = 8) -> DataFrame:
    """src, dst, weight from items(node_id, callees, types): the k best partners of each node by weight.

    The weight is 0.6 * Jaccard of callees + 0.4 * Jaccard of types, so the Jaccard of callees is at least (threshold - 0.4) / 0.6
    and pairs meet at the rarer tokens of their callees (types, of which there are few, bring pairs together only at thresholds up
    to 0.4).  The items of a token are cut into blocks, and each pair of blocks is one unit of work: it scores each pair whose
    rarest common token it is and hands on the k best of each node only.

    Nodes with the same sets are copies: only the largest id of each such group is scored.  What ranks above a group, by weight and largest
    id, ranks above its members, so a node's k best are among its own group and the k best groups, and of each the k largest ids that are
    not its own.
    """
    least = (threshold - 5e-7 - 0.4) / 0.6
    words = items.select(F.explode(F.concat("callees", "types")).alias("w")).agg(F.countDistinct("w").alias("w"), F.countDistinct(F.xxhash64("w")).alias("h")).first()
    if words["w"] != words["h"]:  # one of 10**7 in a million runs
        raise RuntimeError("two tokens have one hash")
    sets, of = one_of_each(items)
    tokens = F.col("c") if least > 0 else F.concat("c", F.transform("t", lambda x: F.xxhash64(x, F.lit("type"))))
    keyed = rare_first(sets.select("node_id", tokens.alias("tokens")), max(least, 0.0) or 1e-9).join(sets.select("node_id", "c", "t"), "node_id")
    m = keyed.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(UNIT_ITEMS)).cast("int").alias("m"))
    rows = keyed.join(m, "token").withColumn("blk", F.pmod(F.xxhash64("node_id"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("token", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "node_id", "before", "c", "t")
    kind = dict(items.dtypes)["node_id"]

    def score(key, table):
        import numpy as np
        import pyarrow as pa

        x, y = key[1].as_py(), key[2].as_py()
        blk = table.column("blk").to_numpy()
        order = np.argsort(blk, kind="stable")
        split = len(blk) if x == y else int((blk == x).sum())
        table = table.take(pa.array(order)).combine_chunks()
        n = len(blk)
        ids = table.column("node_id").to_pylist()
        rank = np.empty(n, np.int64)
        rank[sorted(range(n), key=ids.__getitem__)] = np.arange(n)

        def incidence(name):
            lists = table.column(name).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            off = lists.offsets.to_numpy()
            size = np.diff(off)
            values, code, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            row, shared = np.repeat(np.arange(n), size), often[code] > 1  # a token of one item adds to its size only
            _, code = np.unique(code[shared], return_inverse=True)
            out = np.zeros((n, int(code.max(initial=-1)) + 1), np.float32)
            out[row[shared], code] = 1
            return out, size.astype(np.float32)

        (c, nc), (t, nt), (b, _) = incidence("c"), incidence("t"), incidence("before")
        right = np.arange(n) if x == y else np.arange(split, n)
        cr, tr, br = c[right].T.copy(), t[right].T.copy(), b[right].T.copy()
        def top(places, others):
            """The k largest places of each row and whose they are; -1 is none."""
            at = np.argpartition(-places, min(k, places.shape[1]) - 1, axis=1)[:, :k]
            return np.take_along_axis(places, at, 1), np.take_along_axis(others, at, 1)

        mine, theirs, places = [], [], []

        def hand_on(rows, best, others):
            i, j = np.nonzero(best >= 0)
            mine.append(rows[i])
            theirs.append(others[i, j])
            places.append(best[i, j])

        far, far_of = np.full((len(right), 0), -1), np.zeros((len(right), 0), np.int64)
        for i in range(0, split, 256):
            left = np.arange(i, min(i + 256, split))
            # each pair is scored in one unit only, so all units together score no more than all pairs
            i_, j_ = np.nonzero((b[left] @ br == 0) & (left[:, None] != right[None, :]))
            if not len(i_):
                continue
            both, kinds = (c[left] @ cr)[i_, j_].astype(np.float64), (t[left] @ tr)[i_, j_].astype(np.float64)
            every, types = nc[left][i_] + nc[right][j_] - both, nt[left][i_] + nt[right][j_] - kinds
            w = np.divide(both, every, out=np.zeros(len(i_)), where=every > 0) * 0.6 + np.divide(kinds, types, out=np.zeros(len(i_)), where=types > 0) * 0.4
            w = np.floor(w * 1e6 + 0.5)
            ok = w / 1e6 >= threshold
            if not ok.any():
                continue
            i_, j_, w = i_[ok], j_[ok], w[ok].astype(np.int64) * n
            # a pair's place: by weight, then by the partner's id
            places_here = np.full((len(left), len(right)), -1)
            places_here[i_, j_] = w + rank[right][j_]
            some = np.unique(i_)
            hand_on(left[some], *top(places_here[some], np.broadcast_to(right, (len(some), len(right)))))
            if x != y:  # the same for the right side, kept over the strips
                places_here[i_, j_] = w + rank[left][i_]
                far = np.concatenate([far, places_here.T], axis=1)
                far, far_of = top(far, np.concatenate([far_of, np.broadcast_to(left, (len(right), len(left)))], axis=1))
        hand_on(right, far, far_of)
        node, other, place = (np.concatenate(v) for v in (mine, theirs, places))
        column = table.column("node_id")
        return pa.table([column.take(pa.array(node)), column.take(pa.array(other)), pa.array(place // n / 1e6)], names=["node", "other", "weight"])

    found = best_of(rows.groupBy("token", "x", "y").applyInArrow(score, UNIT.format(kind)), k)
    members = of.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("node_id")))).where(F.col("place") <= k + 1).select(F.col("group").alias("other"), "node_id")
    own = F.floor((F.when(F.size("c") > 0, 0.6).otherwise(0.0) + F.when(F.size("t") > 0, 0.4).otherwise(0.0)) * 1e6 + 0.5) / 1e6
    alike = sets.where(F.size("c") + F.size("t") > 0).select(F.col("node_id").alias("node"), F.col("node_id").alias("other"), own.alias("weight")).where(F.col("weight") >= threshold)
    near = best_of(found.select("node", "other", "weight").unionByName(alike).join(members, "other").select("node", F.col("node_id").alias("other"), "weight"), k + 1)
    each = of.join(near.select(F.col("node").alias("group"), "other", "weight"), "group").where("node_id <> other").select(F.col("node_id").alias("node"), "other", "weight")
    return best_neighbours(each, k)


def one_of_each(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, c, t): of the items(node_id, callees, types) with the same sets the one with the largest id, the sets as hashes; and
    (node_id, group): which that is for each item."""
    hashed = lambda c: F.array_sort(F.transform(F.array_distinct(c), lambda x: F.xxhash64(x)))
    each = items.select("node_id", hashed("callees").alias("c"), hashed("types").alias("t")).checkpoint()
    sets = each.groupBy("c", "t").agg(F.max("node_id").alias("node_id")).select("node_id", "c", "t").checkpoint()
    return sets, each.join(sets.withColumnRenamed("node_id", "group"), ["c", "t"]).select("node_id", "group").checkpoint()


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each node in found(node, other, weight); ties prefer the larger id."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("other")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def best_neighbours(found: DataFrame, k: int) -> DataFrame:
    """src, dst, weight from found(node, other, weight): undirected pairs that are among the k best of either end; ties prefer the larger id."""
    return best_of(found, k).select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst"), "weight").distinct()


def tf_idf(tokens: DataFrame, document: str = "node_id", token: str = "token") -> DataFrame:
    """document, token, weight: smooth idf, unit vectors.  tokens has a row per occurrence."""
    tf = tokens.groupBy(document, token).agg(F.count(F.lit(1)).alias("tf"))
    n = tokens.agg(F.countDistinct(document).alias("n"))
    df = tf.groupBy(token).agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, token).join(F.broadcast(n)).withColumn("w", F.col("tf") * smooth_idf(F.col("n"), F.col("df")))
    norm = w.groupBy(document).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, document).select(document, token, (F.col("w") / F.col("norm")).alias("weight"))


MOST_PIVOTS = 256


def angles(vectors, others):
    """The angle between each of the unit vectors and each of the others."""
    import numpy as np

    return np.arccos(np.clip(vectors @ others.T, -1.0, 1.0))


def near_blocks(unit: DataFrame, threshold: float, block: int) -> DataFrame:
    """x, y, blk, node_id, v: unit vectors unit(node_id, v) dealt to the pairs of blocks in which a cosine of at least threshold can be.

    A cell is what is nearest to one of at most MOST_PIVOTS vectors, and is cut into blocks of about `block` rows.  Of each cell the
    smallest and largest angle to each pivot are known; angles keep the triangle inequality, so a vector whose angle to some pivot is
    further than the threshold's angle outside a cell's range has no partner in that cell and is not sent there.
    """
    import numpy as np

    rows = unit.count()
    order = F.xxhash64("node_id")
    chosen = unit.orderBy(order, "node_id").limit(min(MOST_PIVOTS, max(1, -(-rows // block)))).select("v").collect()  # at most MOST_PIVOTS
    if not chosen:
        return unit.select(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("blk"), "node_id", "v")
    pivots = np.array([r["v"] for r in chosen])
    kind = dict(unit.dtypes)["node_id"]

    def place(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                a = angles(np.stack(pdf.v.to_list()), pivots)
                yield pd.DataFrame({"node_id": pdf.node_id, "v": pdf.v, "cell": a.argmin(1), "away": list(a)})

    placed = unit.mapInPandas(place, f"node_id {kind}, v array<double>, cell int, away array<double>").checkpoint()
    ranges = [F.min(F.col("away")[i]).alias(f"lo{i}") for i in range(len(pivots))] + [F.max(F.col("away")[i]).alias(f"hi{i}") for i in range(len(pivots))]
    found = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ranges).collect())  # a row a pivot
    cells = np.array([r["cell"] for r in found])
    low = np.array([[r[f"lo{i}"] for i in range(len(pivots))] for r in found])
    high = np.array([[r[f"hi{i}"] for i in range(len(pivots))] for r in found])
    cuts = np.array([-(-r["n"] // block) for r in found])
    first = np.concatenate([[0], np.cumsum(cuts)[:-1]])
    widest = np.arccos(np.clip(threshold - 1e-6, -1.0, 1.0)) + 1e-6  # weights are rounded to six digits

    def deal(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            away = np.stack(pdf.away.to_list())
            own = np.searchsorted(cells, pdf.cell.to_numpy())
            mine = first[own] + pdf.cut.to_numpy() % cuts[own]
            for c in range(len(cells)):
                gap = np.maximum(low[c] - away, away - high[c]).max(1)
                at = np.nonzero(gap <= widest)[0]
                for o in range(first[c], first[c] + cuts[c]):
                    if len(at):
                        yield pd.DataFrame({"x": np.minimum(mine[at], o), "y": np.maximum(mine[at], o), "blk": mine[at], "node_id": pdf.node_id.iloc[at], "v": pdf.v.iloc[at]})

    cut = placed.withColumn("cut", F.pmod(order, F.lit(1 << 30)).cast("int"))
    return cut.mapInPandas(deal, f"x int, y int, blk int, node_id {kind}, v array<double>")


def cosine_neighbours(vectors: DataFrame, threshold: float = 0.45, k: int = 8, block: int = 2048) -> DataFrame:
    """src, dst, weight from vectors(node_id, v): exact, block against block, without the pairs of blocks that the threshold rules
    out; a task holds two blocks and hands on the k best of each row.  A vector that is null, holds null or is all zeros has no neighbours."""
    unit = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select("node_id", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm")).where("norm > 0")
    unit = unit.select("node_id", F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("v"))
    rows = near_blocks(unit, threshold, block)

    def compare(key, pdf):
        import numpy as np
        import pandas as pd

        x, y = key
        a, b = pdf[pdf.blk == x], pdf[pdf.blk == y]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": pdf.node_id[:0], "other": pdf.node_id[:0], "weight": pd.Series(dtype="float64")})
        s = np.round(np.stack(a.v.to_list()) @ np.stack(b.v.to_list()).T, 6)
        ia, ib = a.node_id.to_numpy(), b.node_id.to_numpy()
        if x == y:
            np.fill_diagonal(s, -2)
        sides = [(s, ia, ib)] if x == y else [(s, ia, ib), (s.T, ib, ia)]
        out = []
        for w, mine, others in sides:  # the k best of each row: largest weight, then largest id
            by_id = np.argsort(others)[::-1]
            best = by_id[np.argsort(-w[:, by_id], axis=1, kind="stable")[:, :k]]
            top = np.take_along_axis(w, best, 1)
            i, j = np.nonzero(top >= threshold)
            out.append(pd.DataFrame({"node": mine[i], "other": others[best[i, j]], "weight": top[i, j]}))
        return pd.concat(out)

    kind = dict(vectors.dtypes)["node_id"]
    return best_neighbours(rows.groupBy("x", "y").applyInPandas(compare, UNIT.format(kind)), k)


def cluster_labels(members: DataFrame) -> DataFrame:
    """cluster_id, label from members(cluster_id, node_id, token): the token with the largest count * ln((1 + K) / (1 + df)), ties by token."""
    counts = members.select("cluster_id", "node_id", "token").distinct().groupBy("cluster_id", "token").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    k = members.agg(F.countDistinct("cluster_id").alias("k"))
    score = F.round(F.col("n") * F.log((F.lit(1.0) + F.col("k")) / (F.lit(1.0) + F.col("df"))), 9)
    scored = counts.join(df, "token").join(F.broadcast(k)).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "token"))
    return scored.withColumn("place", place).where("place = 1").select("cluster_id", F.col("token").alias("label"), "score")


def overview(nodes: DataFrame, edges: DataFrame, named: DataFrame, hubs: DataFrame, top: int = 8, first: int = 5) -> dict:
    """Counts, the largest clusters, and the first hubs by direction: a few rows."""
    big = named.orderBy(F.desc("member_count"), "cluster_id").limit(top).collect()
    h = hubs.orderBy("node_id")
    return {
        "nodes": nodes.count(), "edges": edges.count(), "clusters": named.count(), "largest": [r.asDict() for r in big],
        "god_concepts": [r["node_id"] for r in h.where("why = 'fan-out'").limit(first).collect()], "bottlenecks": [r["node_id"] for r in h.where("why = 'fan-in'").limit(first).collect()],
    }


def outline(nodes: list[dict], edges: list[dict]) -> str:
    """The contains-tree in pre-order with each node's other relations; for subgraphs that were collected under a bound."""
    children: dict[str, list[str]] = {}
    inner, names = set(), {n["node_id"]: n for n in nodes}
    for e in edges:
        if e["kind"] == "contains" and e["src"] in names and e["dst"] in names:
            children.setdefault(e["src"], []).append(e["dst"])
            inner.add(e["dst"])
    out: list[str] = []

    relations: dict[str, dict[str, list[str]]] = {}
    for e in edges:
        if e["kind"] != "contains":
            relations.setdefault(e["src"], {}).setdefault(e["kind"], []).append(e["dst"])

    def walk(i: str, depth: int) -> None:
        out.append("  " * depth + f"{names[i].get('kind', '?')} {i}")
        out.extend("  " * (depth + 1) + f"{k}: {', '.join(sorted(v))}" for k, v in sorted(relations.get(i, {}).items()))
        for c in sorted(children.get(i, [])):
            walk(c, depth + 1)

    for i in sorted(set(names) - inner):
        walk(i, 0)
    return "\n".join(out)


def breadcrumb(nodes: DataFrame, named: DataFrame, node: str) -> list[str]:
    """overview, the node's cluster, the node."""
    r = nodes.where(F.col("node_id") == node).join(named.select("cluster_id", "label"), "cluster_id", "left").first()
    return ["overview"] if r is None else ["overview", *([r["label"]] if r["label"] else []), node]
