"""Near-duplicate vectors by Euclidean p-stable hashing.

A normalised vector is projected on Gaussian directions, shifted, and quantised with a fixed width; ``projections``
quantised values form its bucket in each of ``tables`` hash tables, and it is posted under each bucket by its id alone.
Members of a bucket are compared by the angle between their vectors rounded to a byte a component, with each vector's own
rounding error allowed for, so that no pair at the threshold is lost and chance meetings are.  What is left joins
vectors to groups, and inside a group every pair is checked once by exact cosine in double precision.

Buckets and groups are cut into blocks, and pairs of blocks are compared; only counts of links per vector and edges of
spanning stars leave a comparison, so a cluster of n near vectors gives rows in proportion to n.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import connected_components, discard, mix, small_batches, written

WIDTH = 2.0
MISSED = 0.002  # of pairs exactly at the threshold
BLOCK = 512
SMALL = 24  # members up to which a bucket's pairs are listed in numpy, many buckets at a time


def usable(embedding: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    x = F.coalesce(embedding, F.array().cast("array<float>"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def collision(cosine: float, width: float = WIDTH) -> float:
    """The probability that one quantised projection of two unit vectors is the same."""
    d = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = width / d
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_shape(largest: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(tables, projections) for labels of at most ``largest`` vectors.

    A vector meets about one unrelated one in a table, however many there are, and a pair exactly at the threshold
    shares no bucket with a probability of ``missed``.
    """
    projections = max(8, math.ceil(math.log(max(largest, 1)) / -math.log(collision(0.0))))
    return math.ceil(math.log(missed) / math.log(1 - collision(threshold) ** projections)), projections


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def hashed(vectors: DataFrame, tables: int, projections: int, width: float = WIDTH) -> DataFrame:
    """(id, label, embedding) to (id, buckets, coarse, slack).

    One 64-bit bucket per table; vectors of other labels or lengths meet in none. coarse is the vector rounded to a byte
    a component, slack the angle between the two.
    """

    def run(batches):
        drawn: dict[int, tuple] = {}
        for b in small_batches(batches, 4 << 20):
            ids, labels, lists = b.column(0), b.column(1), b.column(2)
            out = np.zeros((b.num_rows, tables), np.uint64)
            coarse, slack = [b""] * b.num_rows, np.zeros(b.num_rows)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            names = np.array([hash_text(x) for x in labels.to_pylist()], np.uint64)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                if dim not in drawn:
                    rng = np.random.default_rng(1000 + dim)
                    drawn[dim] = rng.normal(size=(dim, tables * projections)), rng.uniform(0, width, tables * projections)
                rays, shift = drawn[dim]
                x = scaled(flat[starts[rows][:, None] + np.arange(dim)])
                q = np.rint(x * 127)
                norm = np.linalg.norm(x, axis=1)
                slack[rows] = angle(np.einsum("ij,ij->i", x, q) / (norm * np.linalg.norm(q, axis=1)))
                for r, raw in zip(rows.tolist(), q.astype(np.int8), strict=True):
                    coarse[r] = raw.tobytes()
                x /= norm[:, None]
                cells = np.floor((x @ rays + shift) / width).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
                h = mix(np.arange(1, tables + 1, dtype=np.uint64)[None, :] + names[rows][:, None])
                for k in range(projections):
                    h = mix(h * np.uint64(31) + cells[:, :, k] + np.uint64(dim))
                out[rows] = h
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(out.ravel().view(np.int64))), pa.array(coarse, pa.binary()), pa.array(slack)], names=["id", "buckets", "coarse", "slack"])

    return vectors.mapInArrow(run, "id long, buckets array<long>, coarse binary, slack double")


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars with the components of the edges a-b: every node but the smallest of its component, and that one."""
    ids = np.unique(np.concatenate([a, b]))
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, x, least)
        np.minimum.at(now, y, least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    off = root != np.arange(len(ids))
    return ids[off], ids[root[off]]


def blocks(members: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Pairs of blocks (left, right, same) of the members of each key that has several; a key's blocks hold about BLOCK.

    A key of one block is paired with itself in place; the blocks of others meet by their numbers in a join, so a hot key
    is dealt over many tasks.
    """
    count = members.groupBy(*keys).count().where("count > 1").select(*keys, F.ceil(F.col("count") / BLOCK).alias("parts"))
    count = written(count, "groups")
    cut = members.join(count, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    whole = cut.groupBy(*keys, "block").agg(F.collect_list(F.struct("id", *columns)).alias("left"), F.first("parts").alias("parts"))
    whole = written(whole, "blocks")
    alone = whole.where("parts = 1").select("left", F.lit(None).cast(whole.schema["left"].dataType).alias("right"))
    several = whole.where("parts > 1")
    other = several.select(*keys, F.col("block").alias("other"), F.col("left").alias("right"))
    many = several.withColumn("other", F.explode(F.sequence("block", F.col("parts") - 1))).join(other, [*keys, "other"])
    return alone.unionByName(many.select("left", F.when(F.col("block") < F.col("other"), F.col("right")).alias("right")))


def members_of(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Where each row's members begin, with the end, and the members of all rows."""
    sizes = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def near_groups(pairs: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of stars over the members of blocks whose rounded vectors may lie within the threshold."""
    limit = math.acos(threshold) + 1e-6

    class Side:
        def __init__(self, column):
            self.at, members = members_of(column)
            self.ids = members.field("id").to_numpy(zero_copy_only=False)
            self.slack = members.field("slack").to_numpy(zero_copy_only=False)
            raw = members.field("coarse").cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            self.sizes = np.diff(ends)
            width = int(self.sizes.max()) if len(raw) else 0
            q = np.zeros((len(raw), width), np.float32)
            q[np.arange(width) < self.sizes[:, None]] = np.frombuffer(raw.buffers()[2], np.int8)[ends[0] : ends[-1]]
            self.q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

    def run(batches):
        for batch in small_batches(batches, 4 << 20):
            left, right = Side(batch.column(0)), Side(batch.column(1))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            sizes, paired = np.diff(left.at), np.asarray(batch.column(1).is_valid())
            for n in np.unique(sizes[~paired & (sizes <= SMALL)]).tolist():  # all buckets of n members at once
                rows = left.at[:-1][~paired & (sizes == n)]
                i, j = np.triu_indices(n, 1)
                for part in np.array_split(rows, len(rows) * len(i) // 50_000 + 1):
                    x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    ok = angle(np.einsum("ij,ij->i", left.q[x], left.q[y])) <= limit + left.slack[x] + left.slack[y]
                    found.append((left.ids[x[ok]], left.ids[y[ok]]))
            for k in np.flatnonzero(paired | (sizes > SMALL)).tolist():
                one = slice(left.at[k], left.at[k + 1])
                side, two = (right, slice(right.at[k], right.at[k + 1])) if paired[k] else (left, one)
                near = angle(left.q[one] @ side.q[two].T) <= limit + left.slack[one][:, None] + side.slack[two]
                x, y = np.nonzero(near if paired[k] else np.triu(near, 1))
                found.append(stars(left.ids[one][x], side.ids[two][y]))
            a, b = stars(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def links_of(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per pair of blocks: (id, n, root): the copies of other vectors linked to id, and an end of its star (null: none)."""

    def run(batches):
        for batch in small_batches(batches, 4 << 20):
            (at, left), (to, right) = members_of(batch.column(0)), members_of(batch.column(1))
            paired = np.asarray(batch.column(1).is_valid())

            def vectors(members, i, j):
                part = members.slice(i, j - i)
                x = scaled(part.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1))
                return part.field("id").to_numpy(zero_copy_only=False), part.field("copies").to_numpy(zero_copy_only=False), x, np.sqrt(np.einsum("ij,ij->i", x, x))

            ids, counts, roots = [], [], []
            for k in range(batch.num_rows):
                a, ca, x, nx = vectors(left, int(at[k]), int(at[k + 1]))
                b, cb, y, ny = vectors(right, int(to[k]), int(to[k + 1])) if paired[k] else (a, ca, x, nx)
                near = (x @ y.T) / (nx[:, None] * ny) >= threshold
                if not paired[k]:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                node, root = stars(a[i], b[j])
                n = [near @ cb] + ([near.T @ ca] if paired[k] else [])
                every = np.concatenate([a, b]) if paired[k] else a
                total = np.concatenate(n)
                of = dict(zip(node.tolist(), root.tolist(), strict=True))
                for v, c in zip(every[total > 0].tolist(), total[total > 0].tolist(), strict=True):
                    ids.append(v)
                    counts.append(c)
                    roots.append(of.get(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(roots, pa.int64())], names=["id", "n", "root"])

    return pairs.mapInArrow(run, "id long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    A pair of one label with cosine >= threshold is linked if it shares a bucket, or if buckets join it through others;
    no pair below is linked. Tables and projections follow the size of the largest label (table_shape): a pair exactly at
    the threshold is found with a probability of 0.998, closer pairs more surely. Equal vectors of a label are folded
    before hashing, so n copies cost n rows, and all of them are linked. Components of any scale are told alike.

    Null, zero and non-finite vectors and null labels: no links, kept. Rows repeated with the same vec_id, label and
    vector count as one vector. A null vec_id links with nothing, has a null component and is kept. An empty table
    gives no rows; other columns are ignored.
    """
    base = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies")), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sketch = written(hashed(classes.select("id", "label", "embedding"), *table_shape(largest, threshold)), "sketches")

    posts = sketch.select("id", F.explode("buckets").alias("bucket"))
    shared = written(posts.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "buckets")
    met = posts.join(shared, "bucket").join(sketch.select("id", "coarse", "slack", F.octet_length("coarse").alias("dim")), "id")
    groups = connected_components(near_groups(blocks(met, ["bucket", "dim"], "coarse", "slack"), threshold))

    grouped = classes.join(groups.withColumnRenamed("node", "id").withColumnRenamed("component", "near"), "id").withColumn("dim", F.size("embedding"))
    links = written(links_of(blocks(grouped, ["near", "label", "dim"], "embedding", "copies"), threshold), "links")
    discard(shared, sketch)
    components = connected_components(links.where("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("id").agg(F.sum("n").alias("n"))

    found = classes.join(degree, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    found = found.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    ok = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    keyed = base.select("vec_id", F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("embedding")).alias("embedding"))
    out = keyed.join(found, ["label", "embedding"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.component_id = c.node AS kept FROM c LEFT JOIN n ON n.a = c.node
"""
