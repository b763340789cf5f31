"""Shared plumbing: scratch tables in the cluster's shared folder, and zero-copy views of Arrow text columns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir.  Where it is unset, a local one on a local master (tests); an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gneiss-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


PART_BYTES = 16 << 20
SIZE_UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int | None:
    """What the optimizer knows of the size of the tables that df reads; None where it knows of no table."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [n for n in sizes if n < SIZE_UNKNOWN]
    return sum(known) if known else None


def few_files(df: DataFrame, per_core: int = 4) -> DataFrame:
    """One partition per PART_BYTES of input, or a few a core if those are more: small tables leave no swarm of tiny files,
    and a task's share does not grow with the input.  Partitions are joined without moving data, and never where no size is known."""
    size = input_bytes(df)
    return df if size is None else df.coalesce(max(per_core * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written once and read again: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gneiss/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, per_core: int = 4) -> DataFrame:
        few_files(df, per_core).write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def remove(self, name: str = "") -> None:
        """Delete one table that no pending plan reads, or the whole scratch folder."""
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as e:  # the session may be gone at exit
            if name:
                raise RuntimeError(f"scratch table {name} can't be removed") from e


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, budget: int, most: int = 1 << 30):
    """Cut rows into runs of at most `most` rows and about `budget` bytes; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + budget, side="right")) - 1
        j = min(max(j, i + 1), n, i + most)
        yield i, j
        i = j


BATCH_ROWS = 512


def small_batches(batches):
    """The same rows in slices of at most BATCH_ROWS, without copying: Python objects are made for a slice at a time."""
    for b in batches:
        for i in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(i, BATCH_ROWS)


def give_back() -> None:
    """Returns freed memory to the system: workers stay alive, and idle ones should not hold what a task has used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def lean(f):
    """A mapInArrow function that gets small batches and gives memory back when its task ends."""

    def run(batches):
        try:
            yield from f(small_batches(batches))
        finally:
            give_back()

    return run
