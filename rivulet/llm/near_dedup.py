"""Near-duplicate documents by an inverted join over MinHash coordinates.

A document is its set of distinct word shingles.  Equal sets are folded into one representative.  Every representative
is posted under each (coordinate, value) of its MinHash signature; values that only one document has match nothing and
are dropped.  Two documents that agree in at least min_matches coordinates must meet under one of their rarest
``postings - min_matches + 1`` values, so only that prefix is joined (common values are skipped) and agreements are
counted on the whole lists.  Pairs that reach min_matches, and whose LOWEST smallest hashes (the whole set, if it is no larger) do not
put them five standard deviations under the threshold, are confirmed on the full sets.

Links are only needed up to reachability, so pairs inside one component are never made: first every document is
confirmed against the leader it meets most often (of each value, the document with the commonest values: the text that
the others vary), then against its likeliest partner elsewhere, and at last every candidate pair from different
components is.  A group of n near copies costs about n pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import WordHasher, connected_components, discard, mix, small_batches, text_chunks, written

COORDINATES = 40
MIN_MATCHES = 20
LOWEST = 384
BLOCK = 512
BROADCAST_IDS = 2_000_000  # 16 MB
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def hasher() -> WordHasher:
    return WordHasher(lower=True)


def shingle_sets(texts, words: int):
    """Yields (first row, past the last, distinct shingle hashes of all rows, each row's bounds in them) per piece of a column.

    Fewer than ``words`` words are one shingle; no words, none.
    """
    for i, j, data, bounds in text_chunks(texts, 1 << 19):
        w, at = hasher()(data, bounds)
        joined = w.copy()
        for k in range(1, words):
            joined[: len(w) - k] = mix(joined[: len(w) - k] * _STEP + w[k:])
        found, ends = [], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                one = np.unique(joined[a : b - words + 1])
            elif b > a:
                h = np.uint64(b - a)
                one = mix(np.array([functools.reduce(lambda x, y: int(x) * 31 + int(y) & 0xFFFFFFFFFFFFFFFF, w[a:b], int(h))], np.uint64))
            else:
                one = w[:0]
            found.append(one)
            ends.append(ends[-1] + len(one))
        yield i, j, np.concatenate(found) if found else w[:0], np.array(ends)


def crossings(blocks: DataFrame, percent: int, coordinates: int, min_matches: int, signatures_only: bool = False, best_only: bool = False) -> DataFrame:
    """Candidate pairs (a, b), a > b, with estimated similarity, from pairs of blocks of documents that share a value.

    Documents of different components count the coordinates in which they agree, and the hashes that their lists of
    smallest ones share; between whole sets that is exact, otherwise an estimate from the hashes below both ends.
    signatures_only: the sketches are signatures alone, cut to a byte a coordinate, and the result the documents (doc) that agree enough with any.
    best_only: of a pair of blocks, only the likeliest partner of each left document.
    """

    def unpacked(column):
        s = column.flatten()
        docs, parts, sizes = (s.field(c).to_numpy(zero_copy_only=False) for c in ("doc", "component", "n"))
        raw = s.field("sketch")
        if signatures_only:  # a byte of each coordinate, otherwise all bytes and more
            ends, data = raw.offsets.to_numpy(), raw.values.to_numpy()
        else:
            raw = raw.cast(pa.large_binary())
            ends, data = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 4, np.frombuffer(raw.buffers()[2], np.uint32)
        prefix = s.field("prefix")
        prefixes = prefix.offsets.to_numpy(), prefix.values.to_numpy()
        return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), docs, parts, sizes, ends, data, prefixes

    class Side:
        def __init__(self, column, k):
            at, docs, parts, sizes, ends, data, (self.prefix_ends, self.prefixes) = column
            i, j = int(at[k]), int(at[k + 1])
            self.begin = i
            self.docs, self.parts, self.sizes = docs[i:j], parts[i:j], sizes[i:j]
            place = ends[i:j, None] + np.arange(coordinates)
            self.signature = data[place]
            self.held = np.diff(ends[i : j + 1]) - coordinates
            owner = np.repeat(np.arange(j - i), self.held)
            first = np.cumsum(self.held) - self.held
            low = data[(ends[i:j] + coordinates - first)[owner] + np.arange(len(owner))].astype(np.uint32)
            self.keys = (owner.astype(np.uint64) << np.uint64(32)) | low
            self.first, self.owner, self.low = first, owner, low
            self.whole = self.held == self.sizes
            last = low[np.maximum(first + self.held - 1, 0)].astype(np.int64) if len(low) else np.zeros(j - i, np.int64)
            self.last = np.where(self.whole, 1 << 32, last)

        def prefix(self, r):
            return set(self.prefixes[self.prefix_ends[self.begin + r] : self.prefix_ends[self.begin + r + 1]].tolist())

        def matrix(self, values):
            m = np.zeros((len(self.docs), len(values)), np.float32)
            at = np.minimum(np.searchsorted(values, self.low), len(values) - 1)
            ok = values[at] == self.low
            m[self.owner[ok], at[ok]] = 1
            return m

        def below(self, rows, limit):
            return np.searchsorted(self.keys, (rows.astype(np.uint64) << np.uint64(32)) | np.minimum(limit, (1 << 32) - 1).astype(np.uint64), "right") - self.first[rows]

    def run(batches):
        p = percent / 100
        flagged: set[int] = set()
        for batch in small_batches(batches, 4 << 20):
            found = [np.zeros(0 if signatures_only else (0, 2), np.int64)]
            scores = [np.zeros(0)]
            lefts, rights = unpacked(batch.column(0)), unpacked(batch.column(1))
            keys = batch.column(3).to_pylist()
            for k, main in enumerate(batch.column(2).to_pylist()):
                a, b = Side(lefts, k), Side(rights, k)
                go = (a.parts[:, None] != b.parts[None]) & ((b.parts[None] == main) | (a.docs[:, None] < b.docs[None]))
                go &= np.minimum(a.sizes[:, None], b.sizes[None]) * 100 >= np.maximum(a.sizes[:, None], b.sizes[None]) * percent
                if not go.any():
                    continue
                if signatures_only:
                    agree = np.zeros(go.shape, np.int16)
                    for c in range(coordinates):
                        agree += a.signature[:, None, c] == b.signature[None, :, c]
                    go &= agree >= min_matches
                    found.append(np.concatenate([a.docs[go.any(axis=1)], b.docs[go.any(axis=0)]]))
                    continue
                common = np.intersect1d(a.low, b.low)
                same = np.zeros(go.shape, np.float32)
                for c in range(0, len(common), 4096):
                    same += a.matrix(common[c : c + 4096]) @ b.matrix(common[c : c + 4096]).T
                x, y = np.nonzero(go & (same >= (p - 0.3) * np.minimum(a.held[:, None], b.held[None])))
                full = (a.signature[x] == b.signature[y]).sum(axis=1) >= min_matches
                x, y = x[full], y[full]
                limit = np.minimum(a.last[x], b.last[y])
                shared = same[x, y].astype(np.int64)
                either = a.below(x, limit) + b.below(y, limit) - shared
                slack = np.where(a.whole[x] & b.whole[y], 0, 5 * np.sqrt(p * (1 - p) / np.maximum(either, 1)))
                ok = shared >= (p - slack) * either - 1e-9
                x, y, score = x[ok], y[ok], shared[ok] / either[ok]
                if best_only:
                    order = np.lexsort((score, x))
                    order = order[np.append(x[order][1:] != x[order][:-1], True)] if len(order) else order
                    x, y, score = x[order], y[order], score[order]
                # a pair that meets under several values counts under the smallest
                once = np.array([min(a.prefix(i) & b.prefix(j)) == keys[k] for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
                x, y, score = x[once], y[once], score[once]
                scores.append(score)
                x, y = a.docs[x], b.docs[y]
                found.append(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1))
            if signatures_only:
                flagged.update(np.concatenate(found).astype(np.int64).tolist())
                if len(flagged) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(flagged), pa.int64())], names=["doc"])
                    flagged.clear()
                continue
            out, first = np.unique(np.concatenate(found), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(np.concatenate(scores).astype(np.float64)[first])], names=["a", "b", "score"])
        if flagged:
            yield pa.RecordBatch.from_arrays([pa.array(list(flagged), pa.int64())], names=["doc"])

    if signatures_only:
        return blocks.mapInArrow(run, "doc long").distinct()
    return blocks.mapInArrow(run, "a long, b long, score double").groupBy("a", "b").agg(F.max("score").alias("score"))


def signatures(sets: np.ndarray, ends: np.ndarray, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures of the rows whose set is not empty, and which rows those are."""
    rng = np.random.default_rng(5)
    mults = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    some = np.diff(ends) > 0
    out = np.zeros((int(some.sum()), coordinates), np.uint32)
    for k in range(coordinates if len(out) else 0):
        out[:, k] = np.minimum.reduceat(((sets * mults[k] + adds[k]) >> np.uint64(32)).astype(np.uint32), ends[:-1][some])
    return out, some


def sketches(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its signature (no coordinates for an empty set)."""

    def run(batches):
        for b in small_batches(batches):
            for i, j, sets, ends in shingle_sets(b.column(1), words):
                sizes = np.diff(ends)
                signature, some = signatures(sets, ends, coordinates)
                total = np.zeros((2, j - i), np.uint64)
                for k in range(2 if some.any() else 0):
                    total[k, some] = np.add.reduceat(mix(sets + np.uint64((k + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)), ends[:-1][some])
                at = np.zeros(j - i + 1, np.int32)
                at[1:] = np.cumsum(sizes > 0) * coordinates
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(signature.ravel().view(np.int32)))
                columns = [b.column(0).slice(i, j - i), *(pa.array(x) for x in (sizes.astype(np.int64), total[0].view(np.int64), total[1].view(np.int64))), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature array<int>")


def candidates(docs: DataFrame, ids: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc, text, and signature and smallest hashes (upper halves) as bytes, of the documents in ids (doc); written.

    The ids are counted: up to BROADCAST_IDS of them go to the texts, beyond that both sides are shuffled.
    """
    ids = written(ids.select("doc").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    met = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "doc")

    def run(batches):
        for b in small_batches(batches):
            for i, j, sets, ends in shingle_sets(b.column(1), words):
                upper = (sets >> np.uint64(32)).astype(np.uint32)  # each row's are sorted
                signature, some = signatures(sets, ends, coordinates)
                place = np.cumsum(np.diff(ends) > 0) - 1
                both = [signature[place[r]].tobytes() + upper[ends[r] : min(ends[r + 1], ends[r] + LOWEST)].tobytes() if some[r] else b"" for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(both, pa.binary())], names=["doc", "text", "sketch"])

    return written(met.mapInArrow(run, "doc long, text string, sketch binary"), "candidates")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full shingle sets; docs from candidates()."""
    met = pairs.join(docs.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(docs.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        last: tuple[str | None, np.ndarray | None] = (None, None)

        def one(text: str) -> np.ndarray:
            return next(shingle_sets(pa.array([text]), words))[2]

        for b in small_batches(batches):
            keep = []
            for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != tb:
                    last = (tb, one(tb or ""))
                x, y = one(ta or ""), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def linked(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after adding links (a, b) to the components so far."""
    links = written(links, "links")
    if joined is not None:
        if not links.limit(1).count():
            return joined
        links = links.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return written(connected_components(links), "components")


def prefix_keys(min_matches: int) -> Column:
    """The rarest values of a list: two lists with min_matches in common share one of them."""
    return F.slice(F.col("posts.key"), F.lit(1), F.size("posts") - min_matches + 1)


def meetings(lists: DataFrame, joined: DataFrame, min_matches: int) -> DataFrame:
    """(key, main, parts, block, doc, component, n) for every value that documents of several components share in their prefix.

    main is the component of its smallest document; a block has about BLOCK documents, however many share the value.
    """
    members = lists.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    prefix = members.select("doc", "n", "component", F.explode(prefix_keys(min_matches)).alias("key"))
    mixed = prefix.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min(F.struct("doc", "component")).alias("lead"), F.count("*").alias("g")).where("c0 <> c1")
    # written, so that the join has no aggregate in its stage and adaptive execution may split a hot value
    mixed = written(mixed.select("key", F.col("lead.component").alias("main"), F.ceil(F.col("g") / BLOCK).alias("parts")), "values")
    return written(prefix.join(mixed, "key"), "meetings").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts")))


def block_pairs(meeting: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs of blocks (left, right, main): right blocks hold all documents of a value, left ones those outside its main component."""
    rows = F.collect_list(F.struct("doc", "component", "n", "sketch", "prefix"))
    left = meeting.where("component <> main").join(sketch, "doc").groupBy("key", "block").agg(rows.alias("left"), F.first("parts").alias("parts"))
    # each left block goes to every right block by the block's number, so a hot value is dealt over many tasks
    left = left.select("key", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    right = meeting.join(sketch, "doc").groupBy("key", "block").agg(rows.alias("right"), F.first("main").alias("main"))
    return left.join(right, ["key", "block"]).select("left", "right", "main", "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, min_matches: int = MIN_MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Links join documents with 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    A pair exactly at 80 % agrees in fewer than 20 of 40 coordinates with a probability of about 5e-6, and if it is
    longer than LOWEST its smallest hashes lie five standard deviations too low with one of about 1e-6; more similar
    pairs, less. Null and wordless texts: empty set, linked with nothing, kept. Rows that share a doc_id count as one
    document; a null doc_id is not linked and has a null component, and its row is kept. An empty table gives no rows;
    other columns are ignored.
    """
    sketch = written(sketches(docs, words, coordinates), "sketches")
    classes = written(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("signature").alias("signature")), "classes")
    # a set too small to link with any but an equal one posts nothing
    linkable = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posts = linkable.select(F.col("rep").alias("doc"), "n", F.posexplode("signature").alias("pos", "value")).select("doc", "n", place.alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    lists = posts.join(shared, "key").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("posts")).where(F.size("posts") >= min_matches)
    lists = lists.join(classes.select(F.col("rep").alias("doc"), "signature"), "doc")
    lists = written(lists, "postings")

    weight = F.aggregate("posts", F.lit(0).cast("long"), lambda s, p: s + p["f"])
    weighed = lists.select("doc", weight.alias("w"), F.explode("posts.key").alias("key"))
    heads = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("doc")).alias("d"))).alias("m")).select("key", (-F.col("m.d")).alias("lead"))
    leaders = weighed.join(heads, "key").where("doc <> lead").groupBy("doc", "lead").count()
    first = leaders.where(F.col("count") * 2 >= min_matches).groupBy("doc").agg(F.max(F.struct("count", (-F.col("lead")).alias("lead"))).alias("m")).select(F.col("doc").alias("a"), (-F.col("m.lead")).alias("b"))
    first = written(first, "leaders")
    texts = candidates(docs, first.select(F.col("a").alias("doc")).union(first.select(F.col("b").alias("doc"))), words, coordinates)
    joined = linked(None, confirmed(first, texts, words, percent))
    discard(texts, first)
    meeting = meetings(lists, joined, min_matches)
    bytewise = F.transform("signature", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    apart = crossings(block_pairs(meeting, lists.select("doc", bytewise.alias("sketch"), F.array().cast("array<bigint>").alias("prefix"))), percent, coordinates, min_matches, signatures_only=True)
    texts = candidates(docs, apart, words, coordinates)
    some = written(lists.join(texts.select("doc"), "doc"), "postings")
    discard(lists)
    for last in (False, True):
        met = crossings(block_pairs(meetings(some, joined, min_matches), texts.select("doc", "sketch").join(some.select("doc", prefix_keys(min_matches).alias("prefix")), "doc")), percent, coordinates, min_matches, best_only=not last)
        if not last:  # each document with its likeliest partner: merges what one link can merge
            ends = met.select(F.col("a").alias("x"), "a", "b", "score").union(met.select(F.col("b").alias("x"), "a", "b", "score"))
            met = ends.groupBy("x").agg(F.max(F.struct("score", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        joined = linked(joined, confirmed(met.select("a", "b"), texts, words, percent))
    discard(texts, some)
    where = classes.select("h1", "h2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "h1", "h2").join(where, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps; of rows that share a doc_id, one.

    Rows without doc_id are kept.
    """
    found = near_duplicates(docs, words, percent)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.limit(1).count():
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
    return kept


def op4_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=2, percent=80)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
