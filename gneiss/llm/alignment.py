"""Alignment of the tokens of two tokenizers over the same texts.

Two token sequences of one text are a bipartite graph: a token of A and a token of B are joined where their bytes overlap.  Its
connected components, found by union-find, are exactly the smallest groups between places where both sequences end a token.  Every
A token of a group is linked with every B token of it, and the links' id pairs are counted by the documents that hold them.

1. ``tokens``: a text is cut where one blank stands between marks that are no white space.  No token of either vocabulary crosses
   such a place (A's pattern starts a pre-token there, B has no piece with a blank after another mark; checked when a model is
   loaded), so its tokens, groups and links are those of its chunks in turn.  Chunks that were not met before are encoded
   and their overlap graph is handed to union-find, all at once; short ones that were met lately are kept.  The documents of about BLOCK_BYTES of text
   are a block: it hands on each different pair once, with the number of its documents, and for each document which of these it holds
   how often.  So what is shuffled to count pairs has been combined over a block's documents.  The rows are written.
2. ``counts``: documents per pair over all blocks, and whether a pair is its A id's most frequent one.
3. ``align``: a block's pairs get their counts by a join and go back to the block's documents.  A pair has at most one row a block, and
   a block's share is bounded by its text, so no key is hot.

Defined cases: a null, empty or not reproducible text (its tokens' bytes are not blank + text) has no tokens: zeros and an empty digest;
repeated rows are documents of their own; an empty table gives an empty result; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean, slices, utf8

VOCABULARY_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
STEP_BYTES = 1024 << 10
KEPT_CHUNKS = 300_000
KEPT_LENGTH = 32
WIDE_GROUP = 64
JOINED_BYTES = 50_000
CHUNKS = re.compile(r" (?<!  )(?=\S)")
PLAIN = re.compile("[\0-ɏ‐-‧€]*")
#: of byte-level vocabularies: contractions, letters, digits, other marks, each with a blank before it; white space
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ROWS = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, places binary, times binary, place int, a int, b int, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_pairs_of: dict[tuple[str, str], "Pairs"] = {}


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by union-find over all edges at once: roots are hung below smaller roots they share an
    edge with, then all paths are halved until they are flat."""
    parent = np.arange(n)
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            return parent
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A token and which B token cover each stretch between successive ends; both cover the same bytes."""
    ends = np.unique(np.concatenate([ends_a, ends_b]))
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Pairs:
    """Both tokenizers, and what is known of chunks: n_a, n_b, n_groups, links' pair keys, groups as text; None: not reproducible."""

    def __init__(self, vocabulary: str, model: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        shown = {v: k for k, v in byte_alphabet().items()}
        words = self.slow.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * self.slow.get_vocab_size()
        for word, i in words.items():
            self.bytes_a[i] = bytes(shown[c] for c in word) if all(c in shown for c in word) else word.encode()
        self.bytes_b = [self.piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(rb"[^ ] ", x) for x in self.bytes_b):
            raise ValueError("a piece has a blank after another mark, so texts can't be cut at blanks")
        digits = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.array(digits).view(np.uint8).reshape(len(digits), -1)
        self.len_digits = np.array([len(x) for x in digits], np.int64)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shift = max(len(self.bytes_b) - 1, 1).bit_length()
        with open(vocabulary, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.fast = None
        if all(words.get(m) == 256 + i for i, m in enumerate(joined)):  # ids in order of merging: ranks give the same merges
            import tiktoken

            ranks = {self.bytes_a[i]: i for i in range(256 + len(joined))}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple | None] = {}  # chunks without their first blank
        self.before: dict[str, tuple | None] = {}  # what was known until `known` was begun anew

    def piece(self, i: int) -> bytes:
        text = self.sp.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.sp.is_byte(i) else text.replace("▁", " ").encode()

    def ids_a(self, text: str) -> list[int]:
        # both read the same pattern; letters that one library's tables may not have yet are left to the tokenizer itself
        if self.fast is not None and len(text) < 100_000 and (text.isascii() or PLAIN.fullmatch(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def tokens_a(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks in another order, their A ids, and how many each has.  Where CHUNKS would cut chunks apart again, many are encoded as
        one text, whose tokens are theirs in turn."""
        fast = self.fast is not None
        apart = [fast and c[-1] != " " and not c[1:2].isspace() and len(c) < JOINED_BYTES and (c.isascii() or PLAIN.fullmatch(c) is not None) for c in chunks]
        joined, alone = (chunks, []) if all(apart) else (list(compress(chunks, apart)), [c for c, x in zip(chunks, apart, strict=True) if not x])
        ids, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        each = [self.ids_a(c) for c in alone]
        off = np.concatenate([[0], np.cumsum([len(c.encode()) for c in joined])]).astype(np.int64)
        for i, j in slices(off, JOINED_BYTES):
            x = self.fast.encode_to_numpy("".join(joined[i:j]), disallowed_special=()).astype(np.int64)
            ends = np.cumsum(self.len_a[x])
            last = np.searchsorted(ends, off[i + 1 : j + 1] - off[i])
            if last[-1] != len(x) - 1 or not np.array_equal(ends[last], off[i + 1 : j + 1] - off[i]):
                raise ValueError("a token crosses a place where texts are cut")
            ids.append(x)
            many.append(np.diff(last, prepend=-1))
        ids.append(np.fromiter(chain.from_iterable(each), np.int64))
        many.append(np.array([len(x) for x in each], np.int64))
        return joined + alone, np.concatenate(ids), np.concatenate(many)

    def learn(self, chunks: list[str]) -> dict[str, tuple | None]:
        """What is to be known of each chunk (each starts with a blank)."""
        if not chunks:
            return {}
        chunks, ids_a, many_a = self.tokens_a(chunks)
        each_b = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        ids_b, many_b = np.fromiter(chain.from_iterable(each_b), np.int64), np.array([len(x) for x in each_b], np.int64)
        raw = [c.encode() for c in chunks]
        same = reproduced(raw, ids_a, many_a, self.bytes_a, self.len_a) & reproduced(raw, ids_b, many_b, self.bytes_b, self.len_b)
        out: dict[str, tuple | None] = dict.fromkeys(compress(chunks, ~same))
        if out:
            ids_a, ids_b = ids_a[np.repeat(same, many_a)], ids_b[np.repeat(same, many_b)]
            chunks, many_a, many_b = list(compress(chunks, same)), many_a[same], many_b[same]
        if not chunks:
            return out
        off_a, off_b = (np.concatenate([[0], np.cumsum(m)]) for m in (many_a, many_b))
        n = len(ids_a)
        u, v = overlaps(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))
        root = components(n + len(ids_b), u, v + n)
        # a component's smallest node is its first A token, and its tokens of either side are consecutive
        first = np.flatnonzero(root[:n] == np.arange(n))
        group_a, group_b = np.searchsorted(first, root[:n]), np.searchsorted(first, root[n:])
        wide_a, wide_b = np.bincount(group_a), np.bincount(group_b)
        start_b = np.cumsum(wide_b) - wide_b
        groups = np.searchsorted(first, off_a)
        wide = (wide_a * wide_b) > WIDE_GROUP * WIDE_GROUP
        each = np.where(wide, 0, wide_b)[group_a]  # links of each A token
        at = np.cumsum(each) - each
        mine = np.repeat(np.arange(n), each)
        other = np.repeat(start_b[group_a], each) + np.arange(len(mine)) - np.repeat(at, each)
        keys = (ids_a[mine] << self.shift) | ids_b[other]
        cut = np.append(at, len(keys))[off_a]
        # the groups as text, in order: A ids, B ids; what follows an id depends on whether it is its side's last
        where_a = np.arange(n) + start_b[group_a]
        where_b = np.arange(len(ids_b)) + np.cumsum(wide_a)[group_b]
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        ids, written = np.empty(n + len(ids_b), np.int64), np.empty((n + len(ids_b), self.digits.shape[1] + 1), np.uint8)
        ids[where_a], ids[where_b] = ids_a, ids_b
        written[:, :-1] = self.digits[ids]
        written[where_a, -1], written[where_b, -1] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        names = written[written != 0].tobytes()
        name_cut = np.concatenate([[0], np.cumsum(self.len_digits[ids] + 1)])[off_a + off_b].tolist()
        raw, cut, key_cut = keys.tobytes(), cut.tolist(), (8 * cut).tolist()
        rows = zip(chunks, many_a.tolist(), many_b.tolist(), np.diff(groups).tolist(), cut, cut[1:], key_cut, key_cut[1:], name_cut, name_cut[1:], strict=False)
        for c, n_a, n_b, n_groups, c0, c1, k0, k1, s0, s1 in rows:
            out[c] = (n_a, n_b, n_groups, c1 - c0, raw[k0:k1], names[s0 : s1 - 1], ())
        for g in np.flatnonzero(wide):  # links of a wide group: by its different ids and how often they occur
            c = chunks[int(np.searchsorted(off_a, first[g], side="right")) - 1]
            x, nx = np.unique(ids_a[group_a == g], return_counts=True)
            y, ny = np.unique(ids_b[group_b == g], return_counts=True)
            found = ((x[:, None] << self.shift) | y[None, :]).ravel(), (nx[:, None] * ny[None, :]).ravel()
            old = out[c]
            out[c] = (*old[:3], old[3] + int(found[1].sum()), *old[4:6], (*old[6], found))
        return out

    def lookup(self, chunks: set[str]) -> list[str]:
        """Sees to it that the chunks (without their first blank) are in `known`; gives those too long to stay there.  Of about KEPT_CHUNKS
        the half that was not met lately goes."""
        if len(self.known) >= KEPT_CHUNKS // 2:
            self.before, self.known = self.known, {}
        missing = chunks.difference(self.known)
        new = missing.difference(self.before)
        self.known.update((c, self.before[c]) for c in missing - new)
        self.known.update((c[1:], x) for c, x in self.learn([" " + c for c in new]).items())
        return [c for c in new if len(c) >= KEPT_LENGTH]


def reproduced(raw: list[bytes], ids: np.ndarray, many: np.ndarray, table: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Whether each of the texts is its tokens' bytes, joined."""
    parts = list(map(table.__getitem__, ids.tolist()))
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum(many)]
    if np.array_equal(ends, np.cumsum([len(r) for r in raw])) and b"".join(parts) == b"".join(raw):
        return np.ones(len(raw), bool)
    cut = np.cumsum(many).tolist()
    return np.array([b"".join(parts[a:z]) == r for r, a, z in zip(raw, [0, *cut], cut, strict=False)], bool)


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def pairs_of(vocabulary: str | None, model: str | None) -> Pairs:
    import public_tokenizers

    key = vocabulary or public_tokenizers.path(VOCABULARY_A), model or public_tokenizers.path(MODEL_B)
    if key not in _pairs_of:
        _pairs_of[key] = Pairs(*key)
    return _pairs_of[key]


def short(values: np.ndarray) -> bytes:
    """A byte each; values from 255 on follow as four bytes."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u4").tobytes()


def long(raw: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(raw, np.uint8, n)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(raw, "<u4", offset=n)
    return out


class Block:
    """Documents gathered until their texts reach BLOCK_BYTES; `close` gives their rows and those of their pairs."""

    def __init__(self, shift: int):
        self.shift, self.docs, self.keys, self.times, self.size = shift, [], [], [], 0

    def add(self, doc_id, found: list[tuple | None], size: int) -> None:
        self.size += size
        none = np.zeros(0, np.int64)
        if not found or None in found:
            self.docs.append((doc_id, 0, 0, 0, 0, ""))
            self.keys.append(none)
            self.times.append(none)
            return
        n_a, n_b, n_groups, n_links, keys, names, wide = zip(*found, strict=True)
        unique, times = np.unique(np.frombuffer(b"".join(keys), np.int64), return_counts=True)
        if any(wide):
            more = [w for x in wide for w in x]
            all_keys, all_times = (np.concatenate(x) for x in ((unique, *(k for k, _ in more)), (times, *(t for _, t in more))))
            unique, at = np.unique(all_keys, return_inverse=True)
            times = np.zeros(len(unique), np.int64)
            np.add.at(times, at, all_times)
        self.docs.append((doc_id, sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(b";".join(names)).hexdigest()))
        self.keys.append(unique)
        self.times.append(times)

    def close(self, block: int):
        lengths = [len(k) for k in self.keys]
        pairs, at, n = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent pairs come first, so most places and steps between them are small
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place, ends = place[at], np.cumsum(lengths)
        places, times = [], []
        for length, end, t in zip(lengths, ends.tolist(), self.times, strict=True):
            mine = place[end - length : end]
            by_place = np.argsort(mine)
            places.append(short(np.diff(mine[by_place], prepend=0)))
            times.append(short(t[by_place]))
        docs, m = list(zip(*self.docs, strict=True)), len(self.docs)
        cols = {"doc_id": docs[0], "block": [block] * m, "n_a": docs[1], "n_b": docs[2], "n_groups": docs[3], "n_links": docs[4], "groups_sha256": docs[5], "n_pairs": lengths, "places": places, "times": times}
        pairs = pairs[order]
        own = {"block": np.full(len(pairs), block), "place": np.arange(len(pairs)), "a": pairs >> self.shift, "b": pairs & ((1 << self.shift) - 1), "n": n[order]}
        for part, rows in ((cols, m), (own, len(pairs))):
            arrays = [pa.array(part[f.name], f.type) if f.name in part else pa.nulls(rows, f.type) for f in SCHEMA]
            yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in ROWS.split(", ")])


def tokens(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Rows of documents, and of the pairs of each block of them (those have an `a`)."""

    def read(batches):
        known, block, part, closed = pairs_of(vocabulary, model), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.diff(utf8(texts)[1]).tolist()
            i = 0
            while i < len(ids):
                j, room = i, STEP_BYTES
                while j < len(ids) and (room > 0 or j == i):
                    room, j = room - sizes[j], j + 1
                split = [CHUNKS.split(" " + t) if t else [] for t in texts[i:j].to_pylist()]
                for s in split:  # each chunk is without its first blank
                    if s and s[0]:
                        s[0] = s[0][1:]
                    elif s:  # the text starts with a mark: the cut was before it
                        del s[0]
                long_ones = known.lookup(set().union(*split))
                get = known.known.get
                for k, s in enumerate(split):
                    block = block or Block(known.shift)
                    block.add(ids[i + k], list(map(get, s)), sizes[i + k])
                    if block.size >= BLOCK_BYTES:
                        yield from block.close((part << 32) + closed)
                        block, closed = None, closed + 1
                for c in long_ones:
                    del known.known[c]
                i = j
        if block:
            yield from block.close((part << 32) + closed)

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part")).mapInArrow(lean(read), ROWS)


def counts(rows: DataFrame) -> DataFrame:
    """a, b, count, best from the rows of ``tokens``: documents that hold a pair linked, and whether no pair of its A id has more."""
    total = rows.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("count"))
    return total.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))  # an A id has at most a vocabulary of partners


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.save(tokens(docs, vocabulary, model), "tokens")
    pairs = rows.where("a is not null").select("block", "place", "a", "b").join(counts(rows), ["a", "b"]).select("block", "place", "count", "best")
    again = docs.sparkSession.read.schema(rows.schema).parquet(scratch.path("tokens"))  # read anew: both sides of the join below have its columns
    texts = again.where("a is null").select("doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "places", "times")

    def score(own, others):
        if not own.num_rows:
            return pa.table([pa.array([], f.type) for f in OUT], schema=OUT)
        count, best = np.zeros(others.num_rows, np.int64), np.zeros(others.num_rows, np.int64)
        at = others.column("place").to_numpy()
        count[at], best[at] = others.column("count").to_numpy(), others.column("best").to_numpy().astype(np.int64)
        sums, bests = [], []
        for n, p, t in zip(own.column("n_pairs").to_pylist(), own.column("places"), own.column("times"), strict=True):
            place, times = np.cumsum(long(p.as_py(), n)), long(t.as_py(), n)
            sums.append(int(count[place] @ times))
            bests.append(int(best[place] @ times))
        new = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table([new[f.name] if f.name in new else own.column(f.name) for f in OUT], schema=OUT)

    return texts.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(score, RESULT)


OUT = pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in RESULT.split(", ")])


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
