"""Exact repeated passages by fixed-block anchors.

Every document's non-overlapping blocks of block words (half a window) are the index; every rolling block-sized window
of every document probes it.  As a window of window >= 2 * block - 1 words holds a whole aligned block wherever it
starts, every repeat of a window meets the index.  Hits are extended word by word: the windows around them are
compared whole, the smallest document of each is found, and runs of repeated windows are the maximal exact repeats.

Work is done per group of documents (a few MB of text, dealt by a hash), whose hashes travel sorted, without
repetitions and packed, in buckets by value.  So a passage that very many documents hold costs one entry per group.
A bucket takes the values of a fixed amount of text, whatever a group's size; a group sends a row to each bucket that it
has values for, so never more rows than words.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import WordHasher, mix, small_batches, text_chunks, written

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(maxsize=1)
def hasher() -> WordHasher:
    return WordHasher()


def group_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and each text's bounds in them."""
    hashes, ends = [], [np.zeros(1, np.int64)]
    for _, _, data, bounds in text_chunks(texts, 1 << 19):
        w, at = hasher()(data, bounds)
        hashes.append(w)
        ends.append(at[1:] + ends[-1][-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(ends)


class Rolled:
    """Hashes of the rolling windows of a group's documents."""

    def __init__(self, ids: np.ndarray, texts, block: int, window: int):
        words, ends = group_words(texts)
        n = len(words)
        self.ends, self.ids, self.block, self.window = ends, ids, block, window
        self.sizes = np.diff(ends)
        doc = np.repeat(np.arange(len(ids)), self.sizes)
        self.place = np.arange(n) - ends[:-1][doc]
        left = self.sizes[doc] - self.place
        self.probing = np.flatnonzero(left >= block)
        self.doc = doc
        h = hasher()
        h._grow(n + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * h.powers[:n])])
        at = self.probing
        self.short = np.zeros(n, np.uint64)
        self.short[at] = mix((prefix[at + block] - prefix[at]) * h.inverse[at])
        self.windows = np.flatnonzero(left >= window)
        at = self.windows  # two overlapping blocks span the window
        self.long = np.zeros(n, np.uint64)
        self.long[at] = mix(mix((prefix[at + block] - prefix[at]) * h.inverse[at]) * np.uint64(0x9E3779B97F4A7C15) + mix((prefix[at + window] - prefix[at + window - block]) * h.inverse[at + window - block]) + (np.uint64(0) if window <= 2 * block else mix((prefix[at + window] - prefix[at]) * h.inverse[at])))

    def probes(self):
        """Distinct upper 48 bits of the probes: values, whether any is an aligned block, whether of several documents, order and owner."""
        h = self.short[self.probing] >> np.uint64(16)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return s, new, new, order, first
        aligned = (self.place[self.probing] % self.block == 0)[order]
        ids = self.ids[self.doc[self.probing]][order]
        return s[first], np.logical_or.reduceat(aligned, first), np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), order, np.cumsum(new) - 1


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the last byte below 128: the bytes, and where each value ends."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        more = np.flatnonzero(sizes > k)
        byte = (values[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[more] - sizes[more] + k] = byte.astype(np.uint8) | ((sizes[more] > k + 1) * 128).astype(np.uint8)
    return out, ends


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([last[:0], [0], last[:-1] + 1])[: len(last)]
    sizes = last - first + 1
    values = np.zeros(len(last), np.uint64)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        more = np.flatnonzero(sizes > k)
        values[more] |= (data[first[more] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return values, last + 1


def rows_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bytes cut into binary values at the places ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and each row's bounds in them."""
    sizes, data = [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)]
    for c in column.chunks:
        if len(c):
            o = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            sizes.append(np.diff(o))
            data.append(np.frombuffer(c.buffers()[2], np.uint8)[o[0] : o[-1]] if o[-1] > o[0] else data[0])
    return np.concatenate(data), np.cumsum(np.concatenate(sizes))


def at_ends(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends])[at]


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Sorted values in rows cut at ``at``: the first of a row and the differences of the others."""
    d = np.diff(values, prepend=np.uint64(0))
    d[at[:-1]] = values[at[:-1]]
    data, ends = varints(d)
    return rows_of(data, at_ends(ends, at))


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and each row's bounds in them."""
    data, cut = bytes_of(column)
    d, ends = from_varints(data)
    at = np.searchsorted(ends, cut, "right")
    total = np.cumsum(d)
    before = np.concatenate([total[:0], [np.uint64(0)], total])[at[:-1]]
    return total - np.repeat(before, np.diff(at)), at


def packed_ids(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    data, ends = varints(((ids << 1) ^ (ids >> 63)).view(np.uint64))
    return rows_of(data, at_ends(ends, at))


def unpacked_ids(column: pa.ChunkedArray) -> np.ndarray:
    z = from_varints(bytes_of(column)[0])[0]
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)


def packed_bits(flags: np.ndarray, at: np.ndarray) -> pa.Array:
    """Flags in rows cut at ``at``, each row in whole bytes."""
    sizes = np.diff(at)
    ends = np.concatenate([[0], np.cumsum((sizes + 7) // 8)])
    wide = np.zeros(int(ends[-1]) * 8, bool)
    wide[np.arange(len(flags)) + np.repeat(ends[:-1] * 8 - at[:-1], sizes)] = flags
    return rows_of(np.packbits(wide), ends)


def cuts(values: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (equal ranges of values of width bits) that the sorted values fall into, and where each begins, with the end."""
    bucket = ((values >> np.uint64(width - 32)) * np.uint64(buckets)) >> np.uint64(32)
    new = np.ones(len(values), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    first = np.flatnonzero(new)
    return bucket[first].astype(np.int64), np.append(first, len(values))


def equal_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of the values, where each run of equal ones begins in it, and its length."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(s)))


def table_of(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def span_rows(words: list[bytes], mask: np.ndarray) -> tuple[int, str, list[dict]]:
    """Removed words, digest of the kept ones, and their spans."""
    n = int(mask.sum())
    if not n:
        return 0, hashlib.sha256(b" ".join(words)).hexdigest(), [{"begin": 0, "end": len(words)}] if words else []
    edge = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]])))
    spans = [{"begin": int(i), "end": int(j)} for i, j in edge.reshape(-1, 2)]
    return n, hashlib.sha256(b" ".join([x for s in spans for x in words[s["begin"] : s["end"]]])).hexdigest(), spans


PROBE_SCHEMA = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("data", pa.binary())])
FOUND_SCHEMA = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("data", pa.binary()), ("docs", pa.binary())])
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("copies", pa.int64())])
PROBE_TYPE, FOUND_TYPE = "bucket long, g long, data binary", "bucket long, g long, data binary, docs binary"
OUT_TYPE = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept array<struct<begin:int,end:int>>, copies long"
COPIES = 1_000_000  # of a repeated row, written by one task


def untouched(docs: DataFrame) -> DataFrame:
    """Rows of which nothing is removed."""

    def run(batches):
        for b in small_batches(batches):
            rows = [((t or "").encode().split(), d) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            done = [span_rows(w, np.zeros(0, bool)) for w, _ in rows]
            yield from table_of(OUT_SCHEMA, [d for _, d in rows], [len(w) for w, _ in rows], [x[0] for x in done], [x[1] for x in done], [x[2] for x in done], [1] * len(rows)).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, OUT_TYPE)


def grouped(texts: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """The result for texts (doc_id, text, copies, g), by groups g; a row's copies pass through."""

    def rolled(table: pa.Table) -> Rolled:
        ids = table.column("doc_id").combine_chunks().to_numpy()
        return Rolled(ids, table.column("text"), block, window)

    def group_of(table: pa.Table) -> int:
        return table.column("g")[0].as_py()

    def probe(table: pa.Table) -> pa.Table:
        values, aligned, several, _, _ = rolled(table).probes()
        names, at = cuts(values, buckets, 48)
        flagged = (values << np.uint64(2)) | (aligned.astype(np.uint64) << np.uint64(1)) | several.astype(np.uint64)
        return table_of(PROBE_SCHEMA, names, np.full(len(names), group_of(table)), packed(flagged, at))

    def meet(table: pa.Table) -> pa.Table:
        """For each group, which of its values are an aligned block somewhere and occur in more than one group or document."""
        flagged, at = unpacked(table.column("data"))
        order, first, count = equal_runs(flagged >> np.uint64(2))
        if not len(first):
            return FOUND_SCHEMA.empty_table()
        aligned, several = (flagged[order] & np.uint64(2)) > 0, (flagged[order] & np.uint64(1)) > 0
        live = np.empty(len(order), bool)
        live[order] = np.repeat(np.logical_or.reduceat(aligned, first) & ((count > 1) | np.logical_or.reduceat(several, first)), count)
        some = np.flatnonzero(np.add.reduceat(live, at[:-1]))  # rows are never empty
        data = packed_bits(live, at).take(pa.array(some))
        return table_of(FOUND_SCHEMA, table.column("bucket").to_numpy()[some], table.column("g").to_numpy()[some], data, [b""] * len(some))

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        """The windows around hits: distinct hashes and the smallest document of each."""
        if not table.num_rows or not found.num_rows:
            return FOUND_SCHEMA.empty_table()
        r = rolled(table)
        values, _, _, order, owner = r.probes()
        names, at = cuts(values, buckets, 48)
        live = np.zeros(len(values), bool)
        data, cut = bytes_of(found.column("data"))
        for k, i, j in zip(np.searchsorted(names, found.column("bucket").to_numpy()).tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            live[at[k] : at[k + 1]] = np.unpackbits(data[i:j], count=int(at[k + 1] - at[k]))
        hit = np.zeros(len(r.doc) + 1, np.int64)
        hit[r.probing[order[live[owner]]] + 1] = 1
        hits = np.cumsum(hit)
        w = r.windows[hits[r.windows + window - block + 1] > hits[r.windows]]
        h, ids = r.long[w], r.ids[r.doc[w]]
        order, first, _ = equal_runs(h)
        if not len(first):
            return FOUND_SCHEMA.empty_table()
        least = np.minimum.reduceat(ids[order], first)
        values = h[order[first]]
        names, at = cuts(values, buckets, 64)
        return table_of(FOUND_SCHEMA, names, np.full(len(names), group_of(table)), packed(values, at), packed_ids(least, at))

    def smallest(table: pa.Table) -> pa.Table:
        """For each group, the windows that a smaller document of another group holds."""
        values, at = unpacked(table.column("data"))
        ids = unpacked_ids(table.column("docs"))
        order, first, count = equal_runs(values)
        if not len(first):
            return FOUND_SCHEMA.empty_table()
        later = np.empty(len(values), bool)
        later[order] = np.repeat(np.minimum.reduceat(ids[order], first), count) < ids[order]
        mine = np.add.reduceat(later.astype(np.int64), at[:-1])
        some = np.flatnonzero(mine)
        data = packed(values[later], np.concatenate([[0], np.cumsum(mine[some])]))
        return table_of(FOUND_SCHEMA, table.column("bucket").to_numpy()[some], table.column("g").to_numpy()[some], data, [b""] * len(some))

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT_SCHEMA.empty_table()
        r = rolled(table)
        w = r.windows
        h, ids = r.long[w], r.ids[r.doc[w]]
        order, first, count = equal_runs(h)
        gone = np.zeros(len(r.doc) + window + 1, np.int32)
        if len(first):
            flagged = np.zeros(len(first), bool)
            flagged[np.searchsorted(h[order[first]], unpacked(found.column("data"))[0])] = True
            least = np.repeat(np.minimum.reduceat(ids[order], first), count)
            covered = w[order[np.repeat(flagged, count) | (least < ids[order])]]
            gone[covered] += 1
            np.subtract.at(gone, covered + window, 1)
        removed = np.cumsum(gone)[: len(r.doc)] > 0
        done = [span_rows((t or "").encode().split(), removed[i:j]) for t, i, j in zip(table.column("text").to_pylist(), r.ends[:-1].tolist(), r.ends[1:].tolist(), strict=True)]
        return table_of(OUT_SCHEMA, r.ids, r.sizes, [x[0] for x in done], [x[1] for x in done], [x[2] for x in done], table.column("copies").combine_chunks())

    probes = texts.groupBy("g").applyInArrow(probe, PROBE_TYPE)
    hits = probes.groupBy("bucket").applyInArrow(meet, FOUND_TYPE)
    windows = texts.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(extend, FOUND_TYPE)
    earlier = windows.groupBy("bucket").applyInArrow(smallest, FOUND_TYPE)
    return texts.groupBy("g").cogroup(earlier.groupBy("g")).applyInArrow(finish, OUT_TYPE)


def remove_repeats(docs: DataFrame, window: int = 50, block: int | None = None, group_bytes: int = 6 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (spans of kept words: array of begin, end) for every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of window words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. Null text: no words. A null doc_id is neither smaller nor
    larger than another: its row keeps all words. Rows that share a doc_id do not remove each other's words; where text
    and doc_id are the same, however often, the text is worked on once. An empty table gives no rows; other columns are
    ignored.

    block: words of an indexed block; at most half the window rounded up, which is the default. bucket_bytes: text whose
    values one bucket takes. Repeats are told by 64-bit hashes (probes by 48 bits; a false hit only costs a comparison).
    """
    block = block or (window + 1) // 2
    if not 0 < 2 * block - 1 <= window:
        raise ValueError("a window must hold an aligned block wherever it starts")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length")
    keyed = base.select("doc_id", "text", length, F.xxhash64("text", F.col("text").isNull()).alias("hash"))
    per = keyed.groupBy("doc_id", "length", "hash").count()
    none = F.col("doc_id").isNull()
    size, most, nulls = per.agg(F.sum(F.when(~none, F.col("length"))), F.max(F.when(~none, F.col("count"))), F.count(F.when(none, 1))).first()
    texts = base.where(~none).select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    again = (most or 0) > 1
    if again:  # rows that occur several times count once here and are multiplied at the end
        repeated = written(per.where(~none & (F.col("count") > 1)), "repeated")
        on = ["doc_id", "length", "hash"]
        once = keyed.where(~none).join(repeated, on, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
        first = keyed.where(~none).join(repeated, on).groupBy(*on).agg(F.first("text").alias("text"), F.first("count").alias("copies"))
        texts = written(once.unionByName(first.select("doc_id", "text", "copies")), "texts")
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    groups = max(1, -(-(size or 0) // group_bytes))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // bucket_bytes))
    out = grouped(texts.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))), window, block, buckets)
    if again:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
        parts = out.where("copies > 1").withColumn("part", part).repartition(max(1, buckets))
        some = F.least(F.col("copies") - F.col("part") * COPIES, F.lit(COPIES))
        many = parts.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), some)))
        out = out.where("copies = 1").unionByName(many.drop("part", "one"))
    if nulls:
        out = out.unionByName(untouched(base.where(none)))
    return out.drop("copies")


def op8_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT s.doc_id, s.i, md5(array_to_string(w[s.i:s.i + 49], ' ')) AS k FROM s JOIN d USING (doc_id)),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
c AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS p FROM h JOIN m USING (k) WHERE m.least < h.doc_id),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t ANTI JOIN c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY t.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
