"""Removal of every byte covered by a LENGTH-byte string that starts more than once in the corpus.

Suffixes are compared at anchors.  Of each LENGTH-byte window the GRAM-byte strings with the smallest hash are anchors
(ties all count), so two equal windows have their anchors at the same places: whatever repeats meets at an anchor, and
about one suffix in 150 needs sorting.

1. ``anchors``: (text key, position, hash).  Only hashes that occur at two places go on.  Equal texts have one key; a text
   that occurs twice is covered whole, and one row of it stands for the others.
2. ``contexts``: each repeated anchor carries the bytes a window around it can have.
3. ``cover``: the contexts of one hash are an enhanced suffix array: sorted by what follows the anchor, with the common
   prefix of neighbours.  A stack scan gives the common-prefix intervals; in each, members are ordered by what precedes
   the anchor, and the longest left extension that a member shares with any other of the interval, all of them and not
   just neighbours, is found.  If left and right extension reach LENGTH, the member's bytes are covered.
4. Anchors with more than GROUP places never meet in one task.  Their windows are hashed (128 bits), repeats inside a task
   are settled there and leave one entry, and the rest are dealt by window hash: exact, and linear in the rows.  Some texts
   together send one row to each bucket of hashes, and each bucket is a task of its own.

Defined cases: null text is empty; a text shorter than LENGTH loses nothing; repeated rows are occurrences of their own, so
both lose all bytes if long enough; overlapping occurrences in one text count; an empty table gives an empty result;
other columns are not read.  Bytes are judged on the input, never on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean, slices, utf8
from gneiss.llm.jaccard import batch, groups
from gneiss.llm.shingles import _inverse, _table, mix64, powers

LENGTH = 400
GRAM = 100
GROUP = 1000
REST = LENGTH - GRAM
BUCKET_ENTRIES = 1_000_000
HELD_ENTRIES = 300_000
_powers_down = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _powers_down
    if len(_powers_down) < n:
        steps = np.full(max(n, 2 * len(_powers_down)), _inverse, np.uint64)
        steps[0] = 1
        _powers_down = np.multiply.accumulate(steps)
    return _powers_down


def rolling(data: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of the `size` bytes from each position on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values = _table[data] if not salt else mix64(_table + np.uint64(salt))[data]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(len(data))[: len(data)], dtype=np.uint64)])
    return mix64((total[size:] - total[:-size]) * inverse_powers(n)[:n])


def sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over x[i : i + w] for each i with a whole window."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(padded, axis=1).ravel()
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchor_positions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of the anchors of the rows in data."""
    h = rolling(data, GRAM)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, h[:0]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[: len(data) - LENGTH + 1] == row[LENGTH - 1 :]  # windows inside one row
    low = np.where(whole, sliding(h, REST + 1, np.minimum, np.uint64(2**64 - 1)), np.uint64(0))
    edge = np.zeros(REST, np.uint64)
    best = sliding(np.concatenate([edge, low, edge]), REST + 1, np.maximum, np.uint64(0))
    at = np.flatnonzero((best == h) & (best > 0))
    return row[at], at - offsets[row[at]], h[at]


def text_key(text) -> "F.Column":
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def anchors(docs: DataFrame) -> DataFrame:
    """key, id, pos, h of docs(key, id, text)."""
    fields = [("key", pa.binary()), ("id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())]

    def find(batches):
        for b in batches:
            data, off = utf8(b.column(2))
            for i, j in slices(off, 1 << 20):
                row, pos, h = anchor_positions(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if len(row):
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], names=[n for n, _ in fields])

    return docs.select("key", "id", "text").mapInArrow(lean(find), "key binary, id long, pos int, h long")


CONTEXT = "kind int, h long, key binary, pos int, lead int, body binary"
FIELDS = [("kind", pa.int32()), ("h", pa.int64()), ("key", pa.binary()), ("pos", pa.int32()), ("lead", pa.int32()), ("body", pa.binary())]
CONTEXT_KIND, WINDOW_KIND, START_KIND = 0, 1, 2
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("start", "<i4"), ("owner", "<i4")])  # owner: which of the row's keys
KEY = 16


def parts(x: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    """x cut where by changes."""
    return np.split(x, np.flatnonzero(by[1:] != by[:-1]) + 1) if len(x) else []


def contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """rows(key, text, at: array<struct<pos, h, hot>>) -> contexts of anchors, window entries of hot ones (h: their bucket)."""

    def settle(hot: list[tuple[bytes, np.ndarray]]) -> list[tuple]:
        """Window entries of some texts, a row per bucket: repeats among them are known starts, and leave one entry for the others."""
        keys = [k for k, _ in hot]
        e = np.concatenate([e for _, e in hot])
        e["owner"] = np.repeat(np.arange(len(hot)), [len(e) for _, e in hot])
        e = e[np.lexsort((e["h2"], e["h1"]))]
        first = np.ones(len(e), bool)
        first[1:] = (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])
        once = first & np.append(first[1:], True)
        known, rest = e[~once], e[first]
        out = []
        known = known[np.lexsort((known["start"], known["owner"]))]
        for x in parts(known, known["owner"]):
            out.append((START_KIND, 0, keys[x["owner"][0]], 0, 0, x["start"].tobytes()))
        to = (rest["h1"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for x, bucket in zip(parts(rest[order], to[order]), np.unique(to).tolist(), strict=True):
            owners, x["owner"] = np.unique(x["owner"], return_inverse=True)
            out.append((WINDOW_KIND, bucket, b"".join(keys[i] for i in owners), 0, 0, x.tobytes()))
        return out

    def cut(batches):
        out, hot, held = [], [], 0
        for b in batches:
            for k in range(b.num_rows):
                raw, key = b.column(1)[k].as_py().encode(), b.column(0)[k].as_py()
                starts = []
                for p in b.column(2)[k].as_py():
                    pos = p["pos"]
                    lo, hi = max(0, pos - REST), min(len(raw), pos + LENGTH)
                    if p["hot"]:
                        starts.append(np.arange(lo, min(pos, len(raw) - LENGTH) + 1))
                    else:
                        out.append((CONTEXT_KIND, p["h"], key, pos, pos - lo, raw[lo:hi]))
                if starts:
                    s = np.unique(np.concatenate(starts))
                    a, z = int(s[0]), int(s[-1]) + LENGTH
                    data = np.frombuffer(raw, np.uint8)[a:z]
                    e = np.zeros(len(s), ENTRY)
                    e["h1"], e["h2"], e["start"] = rolling(data, LENGTH)[s - a], rolling(data, LENGTH, 77)[s - a], s
                    hot.append((key, e))
                    held += len(e)
                if held >= HELD_ENTRIES:
                    yield batch(settle(hot), FIELDS)
                    hot, held = [], 0
                if len(out) >= 4000:
                    yield batch(out, FIELDS)
                    out = []
        if hot:
            yield batch(settle(hot), FIELDS)
        yield batch(out, FIELDS)

    return rows.select("key", "text", "at").mapInArrow(lean(cut), CONTEXT)


def common(rows: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each row and the next, never past either's end."""
    n, width = len(rows), max(map(len, rows))
    m = np.zeros((n, width + 1), np.int16)
    for i, r in enumerate(rows):
        m[i, : len(r)] = np.frombuffer(r, np.uint8)
        m[i, len(r) :] = -1 - (i % 2)
    return (m[1:] != m[:-1]).argmax(1)


def prefix_intervals(lcp: list[int]):
    """(length, first, last) of the common-prefix intervals of a sorted list, by a scan with a stack."""
    stack = [(0, 0)]
    for i, x in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            yield length, first, i
        if x > 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def extents(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> dict[int, tuple[int, int]]:
    """For each member that repeats over `length` bytes around the anchor: how far to the left and to the right.

    lefts are reversed: they run away from the anchor.
    """
    n = len(lefts)
    by_right = sorted(range(n), key=rights.__getitem__)
    lcp = common([rights[i] for i in by_right]).tolist()
    by_left = sorted(range(n), key=lefts.__getitem__)
    shared = np.append(common([lefts[i] for i in by_left]), 0)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    found: dict[int, tuple[int, int]] = {}
    for right, first, last in prefix_intervals(lcp):
        members = np.array(by_right[first : last + 1])
        members = members[np.argsort(rank[members])]
        between = np.minimum.reduceat(shared, rank[members])[:-1]  # common left extension of those next in order
        left = np.maximum(np.append(between, 0), np.insert(between, 0, 0))
        for i, x in zip(members[left + right >= length].tolist(), left[left + right >= length].tolist(), strict=True):
            a, b = found.get(i, (0, 0))
            found[i] = (max(a, x), max(b, right))
    return found


COVER = "key binary, starts binary, ends binary"
COVER_FIELDS = [("key", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())]
i4 = lambda *x: np.array(x, "<i4").tobytes()


def cover(batches):
    """Contexts sorted by anchor hash -> covered runs."""
    out = []
    for g in groups(batches, ["h"]):
        if g.num_rows < 2:
            continue
        keys, pos, lead, body = (g.column(c).to_pylist() for c in ("key", "pos", "lead", "body"))
        if g.num_rows == 2:
            (a, b), (x, y) = body, lead
            right = common([a[x:], b[y:]])[0]
            left = common([a[:x][::-1], b[:y][::-1]])[0]
            found = {0: (left, right), 1: (left, right)} if left + right >= LENGTH else {}
        else:
            found = extents([a[:x][::-1] for a, x in zip(body, lead, strict=True)], [a[x:] for a, x in zip(body, lead, strict=True)])
        for i, (left, right) in found.items():
            out.append((keys[i], i4(pos[i] - left), i4(pos[i] + right)))
        if len(out) > 4000:
            yield batch(out, COVER_FIELDS)
            out = []
    yield batch(out, COVER_FIELDS)


def cover_hot(batches):
    """Window entries of a bucket -> covered windows."""
    for g in groups(batches, ["h"]):
        keys, found = [], []
        for k, x in zip(g.column("key").to_pylist(), g.column("body").to_pylist(), strict=True):
            found.append(np.frombuffer(x, ENTRY).copy())
            found[-1]["owner"] += len(keys)
            keys += [k[i : i + KEY] for i in range(0, len(k), KEY)]
        e = np.concatenate(found)
        del found
        e = e[np.lexsort((e["h2"], e["h1"]))]
        first = np.ones(len(e), bool)
        first[1:] = (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])
        e = e[~(first & np.append(first[1:], True))]
        e = e[np.lexsort((e["start"], e["owner"]))]
        out = [(keys[x["owner"][0]], x["start"].tobytes(), (x["start"] + LENGTH).tobytes()) for x in parts(e, e["owner"])]
        yield batch(out, COVER_FIELDS)


def dealt(ctx: DataFrame, buckets: int) -> DataFrame:
    """Window entries, each bucket in a task of its own: a few buckets dealt by hash would share tasks and leave others empty."""
    return ctx.where(F.col("kind") == WINDOW_KIND).select("h", "key", "body").repartitionById(buckets, F.col("h").cast("int")).sortWithinPartitions("h")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(new[1:], True)]


REMOVED = "key binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def strip(batches):
    """(key, text, starts, ends) -> what is removed and the digest of what stays."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            raw = r["text"].encode()
            s, e = merged(np.frombuffer(b"".join(r["starts"]), "<i4").astype(np.int64), np.frombuffer(b"".join(r["ends"]), "<i4").astype(np.int64))
            kept, at = hashlib.sha256(), 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            rows.append((r["key"], int((e - s).sum()), len(s), kept.hexdigest(), [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield batch(rows, [("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", spans)])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), text.alias("text"))
    listed = scratch.save(base.select("doc_id", "key", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "listed")
    of_key = scratch.save(listed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "of_key")

    found = scratch.save(anchors(base), "anchors")
    place = F.struct("key", "pos")
    repeated = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z")
    repeated = scratch.save(repeated.select("h", (F.col("n") > GROUP).alias("hot"), "n"), "repeated")
    hot_places = repeated.where("hot").agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(16, -(-hot_places * REST // BUCKET_ENTRIES))
    used = found.join(repeated.select("h", "hot"), "h").join(of_key.select("key", "id"), ["key", "id"], "left_semi")
    # repeated rows give the same places twice
    used = used.groupBy("key", "id").agg(F.collect_set(F.struct("pos", "h", "hot")).alias("at"))
    texts = scratch.save(base.select("key", "id", "text").join(used, ["key", "id"]).dropDuplicates(["key"]).select("key", "text", "at"), "texts")
    scratch.remove("anchors")

    ctx = scratch.save(contexts(texts, buckets), "contexts")
    plain = ctx.where(F.col("kind") == CONTEXT_KIND).select("h", "key", "pos", "lead", "body").repartition("h").sortWithinPartitions("h").mapInArrow(lean(cover), COVER)
    spread = dealt(ctx, buckets).mapInArrow(lean(cover_hot), COVER)

    def known(batches):
        for b in batches:
            rows = [(r["key"], r["body"], (np.frombuffer(r["body"], "<i4") + LENGTH).astype("<i4").tobytes()) for r in b.to_pylist()]
            yield batch(rows, COVER_FIELDS)

    settled = ctx.where(F.col("kind") == START_KIND).select("key", "body").mapInArrow(lean(known), COVER)
    covers = plain.unionByName(spread).unionByName(settled)
    runs = covers.groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    removed = scratch.save(texts.select("key", "text").join(runs, "key").mapInArrow(lean(strip), REMOVED), "removed")
    for name in ("contexts", "texts"):
        scratch.remove(name)

    per_key = scratch.save(of_key.select("key", "n").join(removed, "key", "left"), "per_key")
    out = listed.join(per_key, "key", "left")
    # a text that occurs twice and is long enough goes whole
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    some = F.col("n_removed").isNotNull()
    empty_sha = F.lit(hashlib.sha256(b"").hexdigest())
    full_span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(some, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).when(some, F.col("n_spans")).otherwise(F.lit(0).cast("long")).alias("n_spans"),
        F.when(whole, empty_sha).when(some, F.col("kept_sha256")).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.when(whole, full_span).when(some, F.col("spans")).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", spans.alias("spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n, row_number() OVER () AS r FROM documents),
p AS (SELECT r, b, unnest(generate_series(0, n - 400)) AS i FROM d WHERE n >= 400),
w AS (SELECT r, i, md5(b[i + 1:i + 400]) AS h FROM p),
q AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, i > coalesce(lag(i) OVER o, -1000) + 400 AS fresh FROM w WHERE h IN (SELECT h FROM q) WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s),
t AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM g GROUP BY r, g),
k AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f FROM t),
a AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(s || '-' || e, ',' ORDER BY s) AS spans, string_agg(hex(d.b[f + 1:s]), '' ORDER BY s) || hex(any_value(d.b)[max(e) + 1:]) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN a.r IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""
