"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification, classes of linked documents.

1. Each text becomes its set of five-word shingles (64-bit hashes) and HASHES MinHash values.  Documents with the same
   shingle set are copies: one of them (the smallest doc_id) stands for all, so copies are never paired.
2. BANDS bands of ROWS values key the candidates.  At similarity 0.8 a pair misses all bands with probability
   (1 - 0.8**5) ** 25 = 5e-5; the bound is the method's, not a cap.
3. Documents that share a band value are compared block against block: a band value with n documents is cut into
   ceil(n / BLOCK) hashed blocks and each pair of blocks is one unit of work, so no task holds a whole group.  A pair is
   handled only in the first band where it agrees.  MinHash values are compared CHUNK at a time; with m of n equal and
   a uniform prior the similarity is Beta(m + 1, n - m + 1), and a pair is dropped when its probability of reaching the
   threshold falls below TOLERANCE.
4. What survives is verified exactly on shingle sets built from the texts, again by unit of work.  A unit yields counts
   per document and the edges of a spanning forest, not its pairs, so rows stay linear in documents.
5. Classes are the connected components of the links (min-label propagation with pointer jumping; tables are written
   each round).  ``n_links`` counts other documents with similarity >= 0.8, copies included.

Defined cases: a null, empty or blank text has no shingles, links to nothing and is a class of its own; a text of fewer
than five words is one shingle; rows that repeat a doc_id count as one document (the row with the smallest set key);
rows with null doc_id take no part; an empty table gives an empty result; other columns are not read.
Work within one group of *different* texts that all resemble each other is quadratic in their number, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean, slices, utf8
from gneiss.llm.shingles import lower, mix64, shingle_hashes, shingle_sets, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
HASHES = BANDS * ROWS
CHUNK = 25
TOLERANCE = 1e-6
BLOCK = 256
_factors = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhash(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, HASHES) uint32; rows without shingles are all ones."""
    n = np.diff(offsets)
    out = np.full((len(n), HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        starts = offsets[:-1][full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((shingles * _factors[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n values a pair needs at least m equal ones, else P(similarity >= threshold) < tolerance."""
    grid = np.linspace(0, 1, 20_001)[1:-1]
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        for m in range(n + 1):
            logp = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logp - logp.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def survivors(sig: np.ndarray, bands: np.ndarray, own_band: int, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) whose first common band is own_band and whose signatures pass the Bayesian test.

    split: rows before it are one block and the rest another, only pairs across count; None: all pairs of one block.
    """
    n = len(sig)
    left = np.arange(n if split is None else split)
    out_i, out_j = [], []
    for i in left:
        j = np.arange(i + 1 if split is None else split, n)
        j = j[(bands[j] == bands[i]).argmax(1) == own_band]  # the pairs that this unit handles
        for c, m in enumerate(LEAST):
            k = c * CHUNK
            if c == 0:
                equal = (sig[j, :CHUNK] == sig[i, :CHUNK]).sum(1)
            else:
                equal = equal + (sig[j, k : k + CHUNK] == sig[i, k : k + CHUNK]).sum(1)
            keep = equal >= m[1]
            j, equal = j[keep], equal[keep]
            if not len(j):
                break
        if len(j):
            out_i.append(np.full(len(j), i))
            out_j.append(j)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


LEAST = least_matches()
SIG = "doc_id long, set_key binary, n_shingles int, sig binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key of the shingle set, number of shingles, MinHash values, band keys."""

    def sign(batches):
        for b in batches:
            data, off = utf8(lower(b.column(1)))
            ids = b.column(0)
            for i, j in slices(off, 1 << 20):
                s, so = shingle_hashes(*word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i]), WORDS)
                sig = minhash(s, so)
                n = np.diff(so)
                # two 64-bit sums over the set, and its size, name the set
                total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([s, mix64(s + np.uint64(7))], 1), axis=0, dtype=np.uint64)]) if len(s) else np.zeros((1, 2), np.uint64)
                key = np.concatenate([total[so[1:]] - total[so[:-1]], n[:, None].astype(np.uint64)], 1)
                band = sig.reshape(len(n), BANDS, ROWS).astype(np.uint64)
                h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    h = mix64(h ^ band[:, :, r]) + np.uint64(r)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), pa.array(h.view(np.int64).ravel()))
                fixed = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                yield pa.RecordBatch.from_arrays([ids[i:j], fixed(key), pa.array(n, pa.int32()), fixed(sig), lists], names=["doc_id", "set_key", "n_shingles", "sig", "bands"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(sign), SIG)


def groups(batches, keys: list[str]):
    """Record batches of whole groups from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cuts = [0, *np.flatnonzero(change), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def compare(batches):
    """Units of work -> members with surviving pairs, and the unit's pairs as one row of positions."""
    fields = [("unit", pa.int64()), ("doc_id", pa.int64()), ("pairs", pa.binary())]
    out = []
    for g in groups(batches, ["bk", "x", "y"]):
        if g.num_rows < 2:
            continue
        x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
        block = g.column("block").to_numpy()
        ids = g.column("doc_id").to_numpy()
        order = np.lexsort((ids, block))
        ids, block = ids[order], block[order]
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)[order]
        bands = sig.reshape(-1, BANDS, ROWS)
        own = g.column("band")[0].as_py()
        split = None if x == y else int((block == x).sum())
        i, j = survivors_by_rows(sig, bands, own, split)
        if len(i):
            used = np.unique(np.concatenate([i, j]))
            unit = int(mix64(np.array([g.column("bk")[0].as_py() & (2**64 - 1)], np.uint64) + np.uint64(x * 1_000_003 + y))[0].view(np.int64))
            out += [(unit, int(d), None) for d in ids[used]]
            out.append((unit, None, np.stack([ids[i], ids[j]], 1).astype(np.int64).tobytes()))
        if len(out) > 2000:
            yield batch(out, fields)
            out = []
    yield batch(out, fields)


def survivors_by_rows(sig, bands, own, split):
    # whole bands agree where all their rows do
    n = len(sig)
    if n == 2:
        for m, least in LEAST:
            if int((sig[0, :m] == sig[1, :m]).sum()) < least:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
        agree = (bands[0] == bands[1]).all(1)
        hit = agree.argmax() == own
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys ^ bands[:, :, r].astype(np.uint64)) + np.uint64(r)
    return survivors(sig, keys, own, split)


def verify(batches):
    """Exact Jaccard of a unit's surviving pairs -> linked copies per document and a spanning forest's edges."""
    fields = [("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]
    out = []
    for g in groups(batches, ["unit"]):
        ids, pairs, copies = g.column("doc_id").to_pylist(), g.column("pairs").to_pylist(), g.column("copies").to_pylist()
        at = {d: k for k, d in enumerate(ids) if d is not None}
        column, sets = g.column("text"), []
        for i in range(0, g.num_rows, 32):  # the texts of a unit are turned into sets a few at a time
            s, off = shingle_sets(column.slice(i, 32), WORDS)
            sets += [s[x:y].copy() for x, y in zip(off[:-1], off[1:], strict=True)]
        todo = [np.frombuffer(p, np.int64).reshape(-1, 2) for p in pairs if p is not None]
        links: dict[int, int] = {}
        root = {d: d for d in at}

        def find(d, root=root):
            while root[d] != d:
                root[d] = root[root[d]]
                d = root[d]
            return d

        todo = np.concatenate(todo) if todo else np.zeros((0, 2), np.int64)
        todo = todo[np.argsort(todo[:, 0], kind="stable")]
        previous, mine = None, None
        for a, b in todo.tolist():
            i, j = at[a], at[b]
            if previous != a:
                previous, mine = a, sets[i]
            other = sets[j]
            n, m = len(mine), len(other)
            if min(n, m) < THRESHOLD * max(n, m) - 1e-9:
                continue
            pos = np.searchsorted(mine, other)
            both = int((mine[np.minimum(pos, n - 1)] == other).sum())
            if both >= THRESHOLD * (n + m - both) - 1e-9:
                links[a] = links.get(a, 0) + copies[j]
                links[b] = links.get(b, 0) + copies[i]
                if (ra := find(a)) != (rb := find(b)):
                    root[max(ra, rb)] = min(ra, rb)
        out += [(d, find(d), n) for d, n in links.items()]
        if len(out) > 2000:
            yield batch(out, fields)
            out = []
    yield batch(out, fields)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges(a, b): the smallest node of its component.

    Each round every node takes the smallest label of its neighbours and then its label's label; labels are written and
    read again.  Aggregations combine before they shuffle, so a hub costs no more than its edges.
    """
    both = scratch.save(edges.union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct().toDF("node", "other"), "edges", 2)
    label = scratch.save(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "label0", 2)
    k = 0
    while True:
        k += 1
        near = both.join(label.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        step = scratch.save(step, f"step{k}", 2)
        # pointer jumping: the label of the label
        up = step.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = step.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("root"), F.col("root").alias("old"))
        new = scratch.save(new, f"label{k}", 2)
        changed = new.where("root <> old").limit(1).count()
        scratch.remove(f"step{k}")
        scratch.remove(f"label{k - 1}")
        label = new.select("node", "root")
        if not changed:
            return label


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links for every document; class_id is the smallest doc_id of its class."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.save(signatures(docs), "signatures")
    one = signed.select("doc_id", "set_key", "n_shingles").groupBy("doc_id").agg(F.min(F.struct("set_key", "n_shingles")).alias("s"))
    one = scratch.save(one.select("doc_id", "s.set_key", (F.col("s.n_shingles") > 0).alias("full")), "sets", 2)
    reps = scratch.save(one.where("full").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps", 2)
    sig = signed.join(reps.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id"])
    sig = scratch.save(sig.select("doc_id", "sig", "bands"), "rep_signatures")
    scratch.remove("signatures")

    banded = sig.select("doc_id", F.posexplode("bands").alias("band", "bk"))
    n_of = scratch.save(banded.groupBy("bk").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_bands", 2)
    m = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), m).cast("int")
    members = banded.join(n_of, "bk").select("bk", "band", "doc_id", m.alias("m"), block.alias("block"))
    members = members.join(sig.select("doc_id", "sig"), "doc_id")
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    units = members.select("bk", "band", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "doc_id", "sig")
    found = units.repartition("bk", "x", "y").sortWithinPartitions("bk", "x", "y").mapInArrow(lean(compare), "unit long, doc_id long, pairs binary")
    found = scratch.save(found, "survivors")

    needed = found.where("doc_id is not null").select("unit", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    wanted = scratch.save(needed.select("doc_id").distinct().join(reps.select(F.col("rep").alias("doc_id"), "copies"), "doc_id"), "wanted", 2)
    texts = scratch.save(texts.join(wanted, "doc_id").dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "copies"), "texts")
    rows = needed.join(texts, "doc_id").select("unit", "doc_id", "text", "copies", F.lit(None).cast("binary").alias("pairs"))
    blobs = found.where("doc_id is null").select("unit", "doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"), "pairs")
    linked = rows.unionByName(blobs).repartition("unit").sortWithinPartitions("unit", "doc_id").mapInArrow(lean(verify), "a long, b long, links long")
    linked = scratch.save(linked, "links")
    scratch.remove("survivors")
    scratch.remove("texts")

    root = components(linked.select("a", "b"), scratch)
    degree = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of_rep = scratch.save(degree.join(root, "node", "full").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "of_rep", 2)
    by_set = reps.join(of_rep, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_set = scratch.save(by_set, "by_set", 2)
    out = one.join(by_set, "set_key", "left")
    own = F.col("full") & F.col("class_id").isNotNull()
    return out.select("doc_id", F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs of which no linked row with a smaller doc_id exists in its class; null doc_ids stay."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    gone = scratch.save(classes(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone")), "gone", 2)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM s),
r AS MATERIALIZED (SELECT k, min(doc_id) AS rep, count(DISTINCT doc_id) AS copies, any_value(s) AS s, len(any_value(s)) AS n FROM k GROUP BY k),
x AS MATERIALIZED (SELECT rep, n, copies, unnest(s) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.copies) AS ca, any_value(b.copies) AS cb FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
  GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(node, root) AS (SELECT rep, rep FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
l AS (SELECT rep, min(root) AS class_id FROM (SELECT node AS rep, root FROM c) GROUP BY rep),
d AS (SELECT rep, sum(n) AS n FROM (SELECT a AS rep, cb AS n FROM p UNION ALL SELECT b, ca FROM p) GROUP BY rep)
SELECT w.doc_id, coalesce(l.class_id, w.doc_id) AS class_id, coalesce(coalesce(d.n, 0) + r.copies - 1, 0)::BIGINT AS n_links
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN r ON r.k = k.k LEFT JOIN l ON l.rep = r.rep LEFT JOIN d ON d.rep = r.rep
"""
