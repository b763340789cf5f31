"""Media columns: content-addressed payloads in tar shards, with metadata read from headers by byte range.

``store``: each task appends its payloads to tar shards under `root`, where they stay: the column's digest, shard, offset and
length resolve as long as that folder exists.  A payload is kept as an 8-bit greyscale PNG, 64 samples wide (lossless), under
a name that is the digest of the stored bytes; a task writes equal payloads once.  Rows carry digest, shard, offset and length and are written as a table; only shards that this table names count, so
a lost or repeated task leaves at most an unnamed file.
``fill_metadata``: reads just the first 33 bytes of each payload (signature and IHDR) by range.
``read_back``: reads payload ranges, checks digests, decodes and computes features.  Rows are dealt by shard and offset, in
tasks of about READ_BYTES of payload, so a task reads few shards in order however small the index is.

Defined cases: null text is the empty payload, 64 zero bytes; equal texts give equal values wherever stored; repeated
rows give a row each; an empty table writes nothing and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean, shared_dir

WIDTH = 64
SHARD_BYTES = 1 << 30
READ_BYTES = 16 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return len(raw), raw.ljust(size, b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits, colour, *_ = struct.unpack(">IIBBBBB", head[16:29])
    return {"width": width, "height": height, "bit_depth": bits, "colour_type": colour}


def from_png(png: bytes) -> bytes:
    meta, at, data = png_header(png), 8, b""
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are stored")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    bands = ",".join(str(int(c)) for c in counts.reshape(8, 32).sum(1))
    return f"mean={x.mean():.4f};std={x.std():.4f};min={x.min()};max={x.max()};entropy={entropy:.4f};bands={bands}"


def open_fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:///"):
        return fs.LocalFileSystem(), uri[7:]
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends members to tar files, each of about `limit` bytes."""

    def __init__(self, root: str, limit: int = SHARD_BYTES):
        self.fs, self.dir = open_fs(root)
        self.root, self.limit, self.out = root, limit, None
        self.known: dict[str, tuple[str, int, int]] = {}

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if digest in self.known:
            return self.known[digest]
        if self.out is None or self.at > self.limit:
            self.close()
            self.fs.create_dir(self.dir, recursive=True)
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.dir}/{self.name}"), 0
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        where = (f"{self.root}/{self.name}", self.at + len(head), len(data))
        self.at += len(head) + len(data) + (-len(data) % 512)
        self.known[digest] = where
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.known = None, {}


class RangeReader:
    """Byte ranges of shards; few files stay open."""

    def __init__(self, most: int = 8):
        self.open: OrderedDict = OrderedDict()
        self.most = most

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            fs, path = open_fs(shard)
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[shard] = fs.open_input_file(path)
        return self.open[shard].read_at(length, offset)


def store(docs: DataFrame, scratch: Scratch, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards under root and returns the written index table (INDEX)."""

    def write(batches):
        w = ShardWriter(root, shard_bytes)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                png = to_png(payload)
                digest = hashlib.sha256(png).hexdigest()
                rows.append((doc_id, n, digest, *w.add(digest, png)))
            names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        w.close()

    return scratch.save(docs.select("doc_id", "text").mapInArrow(lean(write), INDEX), "index")


def fill_metadata(index: DataFrame) -> DataFrame:
    """index plus width, height, bit_depth, colour_type, from HEADER_BYTES of each payload."""

    def heads(batches):
        reader = RangeReader()
        for b in batches:
            metas = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            extra = [pa.array([m[k] for m in metas], pa.int32()) for k in ("width", "height", "bit_depth", "colour_type")]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "width", "height", "bit_depth", "colour_type"])

    return index.mapInArrow(lean(heads), INDEX + ", width int, height int, bit_depth int, colour_type int")


def read_back(index: DataFrame) -> DataFrame:
    """The contract's columns, all computed from bytes read back from the shards."""
    schema = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
              "width int, height int, bit_depth int, shard string, offset long, length long")  # fmt: skip

    def decode(batches):
        reader, cache = RangeReader(), OrderedDict()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if (got := cache.get(r["digest"])) is None:
                    png = reader.read(r["shard"], r["offset"], r["length"])
                    digest = hashlib.sha256(png).hexdigest()
                    if digest != r["digest"]:
                        raise OSError(f"{r['shard']} at {r['offset']}: the digest differs")
                    samples = from_png(png)
                    if (r["width"], r["height"], r["bit_depth"]) != (WIDTH, len(samples) // WIDTH, 8):
                        raise OSError(f"{r['shard']} at {r['offset']}: the metadata differ")
                    got = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(png), digest, features(samples))
                    cache[r["digest"]] = got
                    if len(cache) > 1000:
                        cache.popitem(last=False)
                rows.append((r["doc_id"], r["n_bytes"], *got, *(r[k] for k in ("width", "height", "bit_depth", "shard", "offset", "length"))))
            cols = list(zip(*rows, strict=True)) or [()] * 14
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            fields = [f.split() for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return index.mapInArrow(lean(decode), schema)


def media_columns(docs: DataFrame, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The media columns of docs(doc_id, text); the payloads stay in the shards under root."""
    index = store(docs, Scratch(docs.sparkSession, "media"), root, shard_bytes)
    n = -(-(index.agg(F.sum("length").alias("n")).first()["n"] or 0) // READ_BYTES)
    return read_back(fill_metadata(index.repartitionByRange(max(1, n), "shard", "offset")))


def op4_media(spark, sf_dir: str) -> DataFrame:
    """The shards stay in the shared folder, below gneiss/media."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs, f"{shared_dir(spark)}/gneiss/media/{uuid.uuid4().hex}").withColumn("stored_as", F.lit("png-grey8-w64"))
