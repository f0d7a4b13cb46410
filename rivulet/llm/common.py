"""Shared helpers: tables in the cluster's shared folder, components of a link graph, hashing of words in numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is set on a single machine; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rivulet-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    The files outlive a lost executor, carry exact sizes for the planner and let later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rivulet_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_rivulet_path", None)
        if not path:
            continue
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that occurs in edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars.  Each step is a minimum per node (combined
    on the map side) and an equi-join that adaptive execution may split, so a node with very many links stays
    distributed; each round is written to the shared folder, so plans do not grow.
    """

    def star(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        met = both.join(least, "u")
        if larger:
            return met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, name)
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        after_df = written(star(down, False).where("a <> b").distinct(), name)
        after = state(after_df)
        discard(now)
        now = after_df
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ---------------------------------------------------------------------------------------------------------------
# Words of many texts at once, on the bytes of an Arrow column.


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts; lower: A-Z count as a-z."""

    def __init__(self, lower: bool = False, seed: int = 20250101):
        table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            table[65:91] = table[97:123]
        table[list(SEPARATORS)] = 0
        self.table = table
        self.gap = np.zeros(256, bool)
        self.gap[list(SEPARATORS)] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 20)
            for attr, base in (("powers", _BASE), ("inverse", _UNBASE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, attr, np.cumprod(p))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes; bounds: where each text begins, and the end. Returns the words' hashes and each text's bounds in them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        self._grow(n)
        gap = self.gap[data]
        start = ~gap
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = gap[:-1]
        before[bounds[:-1][bounds[:-1] < n]] = True
        start &= before
        at = np.flatnonzero(start)
        within = np.searchsorted(at, bounds)
        if not len(at):
            return np.zeros(0, np.uint64), within
        sums = np.add.reduceat(self.table[data] * self.powers[:n], at)
        return mix(sums * self.inverse[at]), within


def text_chunks(column, size: int = 1 << 20):
    """Yields (first row, past the last row, bytes, bounds) of an Arrow string column in pieces of about size bytes; null: empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def release_memory() -> None:
    """Gives back what Arrow and the C library keep of freed memory; a worker that waits for its next task needs none of it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(batches, size: int = 8 << 20):
    """Splits Arrow record batches so that none holds much more than size bytes (one row at least)."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(size, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
        del b
        release_memory()
