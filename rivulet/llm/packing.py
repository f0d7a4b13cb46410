"""Packing of documents along a space-filling curve.

A document is tokenised; the hashed vector of its tokens is projected to DIMS dimensions by fixed random directions,
and the point's place on a Hilbert curve is its key.  A range sort by (key, doc_id) puts alike documents next to each
other, and every partition of it fills sequences of max_tokens with neighbouring documents, cut where a sequence ends.
The ranges hold equal numbers of tokens, not of documents; a cell of the curve with more than that is dealt over several.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import discard, small_batches, written
from rivulet.llm.tokens import default_vocabulary, encoding

DIMS, BITS = 3, 16
HASHED = 1 << 16


def directions(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(HASHED, DIMS)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims) with coordinates below 2**bits.

    Gray-code form: undo the excess rotations from the highest bit down, then interleave.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - one
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_cells(points: np.ndarray) -> np.ndarray:
    """Real points to the curve's grid: each coordinate is squashed to (0, 1), so no value falls outside."""
    top = (1 << BITS) - 1
    return np.clip((0.5 + np.arctan(points * 4) / np.pi) * top, 0, top).astype(np.uint64)


def tokenised(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, key, n (tokens with the closing id 0), ids (unsigned 16-bit, little-endian), draw (uniform in [0, 1)). Null text: as empty."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches):
        from pyspark import TaskContext

        enc, rays = encoding(path, pattern), directions()
        rng = np.random.default_rng(TaskContext.get().partitionId() if TaskContext.get() else 0)
        for b in small_batches(batches, 4 << 20):
            ids, sizes, points = [], [], np.zeros((b.num_rows, DIMS), np.float32)
            for k, text in enumerate(b.column(1).to_pylist()):
                t = np.array(enc.encode(text or "", allowed_special="all") + [0], np.uint16)
                points[k] = rays[t].mean(axis=0)
                ids.append(t.tobytes())
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hilbert_key(curve_cells(points)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(rng.random(b.num_rows))],
                names=["doc_id", "key", "n", "ids", "draw"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, n long, ids binary, draw double")


def token_ranges(tokens: DataFrame, partition_tokens: int, total: int) -> Column:
    """The partition of a row of tokens (key, n, draw): ranges of the curve with about partition_tokens tokens each.

    Tokens are counted per cell (the upper 32 of 48 bits of the key), and running totals taken within each of the 65,536
    upper cells, whose own totals go through the driver. Of the cells, only those in which a range ends reach it, so one
    or two per partition; a row of such a cell goes by its draw to one of the ranges that the cell lies in.
    """
    cells = written(tokens.groupBy(F.shiftright("key", 16).alias("cell")).agg(F.sum("n").alias("w")), "cells")
    upper = F.shiftright("cell", 16)
    before, offsets = 0, []
    for r in cells.groupBy(upper.alias("top")).agg(F.sum("w").alias("w")).orderBy("top").collect():
        offsets.append((r["top"], before))
        before += r["w"]
    tops = tokens.sparkSession.createDataFrame(offsets or [(0, 0)], "top long, offset long")
    running = F.sum("w").over(Window.partitionBy("top").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cells.withColumn("top", upper).withColumn("to", running).join(F.broadcast(tops), "top").select("cell", "w", (F.col("to") + F.col("offset") - F.col("w")).alias("at"))
    part = lambda c: F.floor(c / partition_tokens)
    ends = placed.where(part(F.col("at")) != part(F.col("at") + F.col("w"))).orderBy("cell").collect()
    discard(cells)
    cell, at, width = (np.array([r[c] for r in ends], np.int64) for c in ("cell", "at", "w"))
    last = max(0, -(-total // partition_tokens) - 1)

    @F.arrow_udf("int")
    def of(keys: pa.Array, draws: pa.Array) -> pa.Array:
        c = keys.to_numpy() >> 16
        if not len(cell):
            return pa.array(np.zeros(len(c), np.int32))
        i = np.searchsorted(cell, c, "right") - 1  # the last cell not after c in which a range ends
        inside = cell[np.maximum(i, 0)] == c
        to = at[np.maximum(i, 0)] + width[np.maximum(i, 0)] * np.where(inside, draws.to_numpy(), 1.0)
        return pa.array(np.where(i < 0, 0, np.minimum(to // partition_tokens, last)).astype(np.int32))

    return of("key", "draw")


def pack(docs: DataFrame, max_tokens: int = 1024, vocabulary: tuple[str, str] | None = None, partition_tokens: int = 6_000_000, with_ids: bool = True) -> DataFrame:
    """Pieces of documents laid into sequences of at most max_tokens along the curve.

    One row per piece: doc_id, start (the document's tokens before it), length, doc_tokens, sequence_id, offset (where
    it begins in the sequence; gapless from 0), ids_crc32 and, if with_ids, ids (array of int).

    Every token lies in exactly one piece. Only the last sequence of a partition (about partition_tokens) is short of
    max_tokens, and that is padded. Null text is empty: one closing id. Repeated rows and null ids are packed like
    others; an empty table gives no rows; other columns are ignored. Ties on the curve are ordered by doc_id, or dealt
    over several partitions where they fill more than one. A document is in one partition, however long.

    The tokens are written once (lengths and keys are read back alone to cut the ranges) and shuffled once.
    """
    tokens = written(tokenised(docs, vocabulary), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // partition_tokens))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        at = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        sequence, filled = at, 0
        for b in batches:
            rows: list[list] = [[] for _ in range(8 if with_ids else 7)]
            held = 0
            for doc, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.frombuffer(raw.as_buffer(), np.uint16).astype("<u4")
                start = 0
                while start < n:
                    if filled == max_tokens:
                        sequence, filled = sequence + 1, 0
                    take = min(n - start, max_tokens - filled)
                    piece = ids[start : start + take]
                    for column, value in zip(rows, (doc, start, take, zlib.crc32(piece.tobytes()), n, sequence, filled, piece.astype(np.int32)), strict=False):
                        column.append(value)
                    start, filled, held = start + take, filled + take, held + take
                if held > 1 << 20:
                    yield batch(rows)
                    rows, held = [[] for _ in rows], 0
            if rows[0]:
                yield batch(rows)

    def batch(rows):
        types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names=names[: len(rows)])

    ranged = tokens.withColumn("part", token_ranges(tokens, partition_tokens, total)) if parts > 1 else tokens.withColumn("part", F.lit(0))
    ordered = ranged.repartitionById(parts, "part").sortWithinPartitions("key", "doc_id").select("doc_id", "n", "ids")
    return ordered.mapInArrow(run, schema)


def op1_query(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
