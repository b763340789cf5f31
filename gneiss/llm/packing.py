"""Best-fit-decreasing packing of tokenised documents into windows of fixed capacity.

1. ``pieces``: each document is tokenised in its own partition; its ids are cut into full windows and one remainder.  The
   pieces of each length are numbered within the partition, so no shuffle is needed to rank them.  The rows are written.
2. ``plan_windows``: best-fit decreasing depends on lengths only, and there are at most `capacity` of them.  The driver
   gets one count per length (a fixed bound), keeps open windows as counted runs in a segment tree indexed by
   remaining capacity, and places whole runs of equal pieces into the tightest windows.  That is global best-fit
   decreasing, at a cost that does not grow with the corpus.
3. ``pack``: a piece finds its run by binary search over the plan, from its length and its rank in that length.

Defined cases: null and empty text still give the closing id, so one piece of length 1; repeated rows are packed once
each; an empty table gives an empty result; very long texts are cut, so no piece exceeds the capacity.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean

CAPACITY = 2048
CLOSING_ID = 1
CACHE_WORDS = 250_000
VOCABULARY = "word_bpe_49k.json"
LETTERS_THEN_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-;=?-@\[-`{-~]+)")  # no apostrophe or angle bracket

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local_rank long"
_encoders: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Ids of a blank-delimited chunk as little-endian bytes.  The vocabulary never joins across white space, so a
    text's ids are its chunks' ids in turn; a full cache is dropped, never a chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode, self.bpe = self.tokenizer.encode, self.tokenizer.model.tokenize
        # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.alphabet = {b: chr(shifted.get(b, b)) for b in range(256)}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower() and max(chunk) < "\u0100":  # one normalised pre-token
            word = chunk if chunk.isascii() else "".join(map(self.alphabet.__getitem__, chunk.encode()))
            ids = array("I", [t.id for t in self.bpe(word)]).tobytes()
        elif m := LETTERS_THEN_MARKS.fullmatch(chunk):  # letters and marks after them are never one pre-token
            ids = self[m[1]] + self[m[2]]
        else:
            ids = array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        try:  # the vocabulary is lower case; within Latin-1 lower() and normalisation are plain
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of every row of docs(doc_id, text), numbered within their length and part.

    A part is one partition of docs, as `cut` sees it.  A task can run several of them where the result is coalesced, so
    its id is taken from the rows and not from the task.
    """
    closing = array("I", [closing_id]).tobytes()

    def cut(batches):
        words = encoder(vocabulary or vocabulary_path())
        seen = [0] * (capacity + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            ids_of, cols = [], [array("q") for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + closing
                view, n = memoryview(ids), len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(view[start * 4 : (start + length) * 4])
                    for c, v in zip(cols, (start, length, crc, n, part, seen[length]), strict=True):
                        c.append(v)
                    ids_of.append(doc_id)
                    seen[length] += 1
            arrays = [pa.array(ids_of, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(lean(cut), PIECES)


class TightestFit:
    """Segment tree over remaining capacities 0..capacity: which are open, and the tightest at or above a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, r: int, on: bool) -> None:
        i = r + self.size
        self.open[i] = int(on)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def at_least(self, r: int) -> int:
        """The smallest open capacity >= r, or -1."""
        i = r + self.size
        if self.open[i]:
            return r
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.size
            i //= 2
        return -1


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs (length, first rank, first window, offset in the window), sorted by length and rank.

    Windows with equal remaining capacity are kept as runs of consecutive ids, so a step places a whole run.
    """
    tree, runs = TightestFit(capacity), [[] for _ in range(capacity + 1)]
    out, opened = [], 0

    def add(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            if not runs[r]:
                tree.set(r, True)
            runs[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.at_least(length)
            if r < 0:  # open as many windows as the rest needs, full of pieces of this length
                per = capacity // length
                if left >= per:
                    n = left // per
                    for k in range(per):
                        out.append((length, rank + k * n, opened, k * length))
                    rank, left = rank + n * per, left - n * per
                    add(capacity - per * length, opened, n)
                    opened += n
                else:
                    for k in range(left):
                        out.append((length, rank + k, opened, k * length))
                    add(capacity - left * length, opened, 1)
                    opened, left = opened + 1, 0
                continue
            first, n = runs[r].pop()
            if not runs[r]:
                tree.set(r, False)
            m = min(left, n)
            out.append((length, rank, first, capacity - r))
            add(r - length, first, m)
            add(r, first + m, n - m)
            rank, left = rank + m, left - m
    cols = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "window": cols[:, 2], "offset": cols[:, 3]}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of docs with sequence_id and offset; offsets in a sequence are gapless from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, capacity, vocabulary, closing_id), "pieces")
    # one row per part and length: a part's pieces of one length are numbered 0..n-1
    tally = scratch.save(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = plan_windows(counts, capacity)
    key = plan["length"] * (1 << 48) + plan["rank"]
    plan_b = spark.sparkContext.broadcast((key, plan["rank"], plan["window"], plan["offset"]))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = scratch.save(base, "base")
    ranked = cut.join(base, ["part", "length"])

    def place(batches):
        keys, ranks, windows, offsets = plan_b.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("local_rank").to_numpy() + b.column("base").to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            new = [pa.array(windows[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + new, names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(lean(place), schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
