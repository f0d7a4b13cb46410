"""permutations, permutations_with_replacement and combinations.

The items get dense positions, and the tuples come from joins of the items with themselves under position conditions.
Each tuple's place in lexicographic order follows from its positions by a formula, so no sort or numbering of the
output is needed.  Only the input, which is small where its tuples are enumerable, is broadcast, and its size is checked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.stream import SEQ, VALUE, Stream, kept

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20
SPREAD_ROWS = 5_000_000  # tuples per task, about, once pairs are spread


def total(op: str, n: int, k: int) -> int:
    if op == "permutations":
        return math.perm(n, k)
    if op == "combinations":
        return math.comb(n, k)
    return n**k if k else 0


def positioned(s: Stream, carried: dict[str, Column] | None = None) -> DataFrame:
    """_p (dense position), _v (item) and carried columns.

    A stream whose count is known and whose places are longs is numbered without gaps already; others are numbered
    here, in one partition.
    """
    extra = [c.alias(n) for n, c in (carried or {}).items()]
    base = s.frame.select(SEQ, F.col(VALUE).alias("_v"), *extra)
    if s.count is not None and isinstance(s.frame.schema[SEQ].dataType, T.LongType):
        return base.withColumnRenamed(SEQ, "_p")
    return base.select((F.row_number().over(Window.orderBy(SEQ)) - 1).cast("long").alias("_p"), "_v", *(carried or {}))


def broadcastable(base: DataFrame, n: int) -> bool:
    """Whether n rows of base stay within the limits; types of no fixed width are measured, in one aggregate."""
    if n > BROADCAST_ROWS:
        return False
    loose = [f.name for f in base.schema if any(w in f.dataType.simpleString() for w in ("string", "binary", "array", "map"))]
    if not loose:
        return True  # at most a million rows of a few fixed fields
    return (base.agg(F.sum(F.length(F.to_json(F.struct(*loose))))).first()[0] or 0) <= BROADCAST_BYTES


def falling(x: Column, k: int) -> Column:
    """C(x, k) as a Column: products of long values, divided as they grow, so every step is whole."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.call_function("div", out * (x - i), F.lit(i + 1).cast("long"))
    return F.when(x >= k, out).otherwise(F.lit(0).cast("long"))


def place(op: str, n: int, k: int, positions: list[Column]) -> Column:
    """The lexicographic rank of a tuple."""
    if op == "permutations_with_replacement":
        out = F.lit(0).cast("long")
        for p in positions:
            out = out * n + p
        return out
    if op == "combinations":
        rank = F.lit(math.comb(n, k) - 1).cast("long")
        for i, p in enumerate(positions):
            rank = rank - falling(F.lit(n - 1).cast("long") - p, k - i)
        return rank
    out = F.lit(0).cast("long")
    for i, p in enumerate(positions):
        used = F.lit(0).cast("long")
        for q in positions[:i]:
            used = used + (q < p).cast("long")
        out = out + (p - used) * math.perm(n - 1 - i, k - 1 - i)
    return out


def expand(s: Stream, op: str, k: int, carried: dict[str, Column] | None = None, max_rows: int | None = None, pieces: bool = False) -> Stream:
    """Tuples of k items as arrays, in lexicographic order of position.

    k = 0: one empty tuple, but for permutations_with_replacement none. k above the number of items: none, but for
    permutations_with_replacement. carried: columns computed once per item, before the tuples are formed, and passed on
    as ``name_i`` for the i-th item. max_rows: ValueError beforehand if there would be more. pieces: items and positions
    stay in columns ``_v0``, ``_p0``, ``_v1``, ... in place of SEQ and VALUE, for the caller to put together later.
    """
    spark, kind = s.spark, s.frame.schema[VALUE].dataType
    out_type = T.ArrayType(kind, False)

    def none() -> Stream:
        parts = [F.lit(None).cast(t).alias(f"{c}{i}") for i in range(k) for c, t in (("_v", kind), ("_p", "long"))]
        empty = spark.range(0).select(*(parts if pieces else [F.col("id").alias(SEQ), F.lit(None).cast(out_type).alias(VALUE)]))
        for name, c in (carried or {}).items():
            what = s.frame.select(c.alias("x")).schema["x"].dataType
            empty = empty.withColumns({f"{name}_{i}": F.lit(None).cast(what) for i in range(k)})
        return Stream(empty, 0)

    if k == 0:
        if op == "permutations_with_replacement":
            return none()
        return Stream(spark.range(1).select(F.col("id").alias(SEQ), F.array().cast(out_type).alias(VALUE)), 1)
    if k == 1 and not (pieces or carried or max_rows is not None):
        return Stream(s.frame.select(SEQ, F.array(VALUE).alias(VALUE)), s.count)
    base = positioned(s, carried)
    n = s.count
    if n is None:
        base = kept(base)
        n = base.count()
    rows = total(op, n, k)
    if max_rows is not None and rows > max_rows:
        raise ValueError(f"{op}({k}) of {n} items gives {rows} rows; the limit is {max_rows}")
    if not rows:
        return none()
    side = lambda i: base.select(F.col("_p").alias(f"_p{i}"), F.col("_v").alias(f"_v{i}"), *(F.col(c).alias(f"{c}_{i}") for c in carried or {}))
    small = broadcastable(base, n)
    # spread what multiplies: the first items, or the first pairs where there are tuples enough
    width = spark.sparkContext.defaultParallelism * 4
    joined = side(0).repartition(max(1, min(width, n)), "_p0") if rows > 10_000 else side(0)
    for i in range(1, k):
        right = F.broadcast(side(i)) if small else side(i)
        if op == "combinations":
            joined = joined.join(right, F.col(f"_p{i - 1}") < F.col(f"_p{i}"))
        elif op == "permutations":
            differ = F.lit(True)
            for j in range(i):
                differ = differ & (F.col(f"_p{j}") != F.col(f"_p{i}"))
            joined = joined.join(right, differ)
        else:
            joined = joined.crossJoin(right)
        if i == 1 and k > 2 and rows > SPREAD_ROWS:
            joined = joined.repartition(max(width, rows // SPREAD_ROWS) if rows // SPREAD_ROWS < n * n else n * n, "_p0", "_p1")
    positions = [F.col(f"_p{i}") for i in range(k)]
    names = [f"{c}_{i}" for c in carried or {} for i in range(k)]
    parts = [F.col(f"_v{i}") for i in range(k)]
    if pieces:
        return Stream(joined.select(*parts, *positions, *names), rows)
    seq = place(op, n, k, positions) if max(rows, math.comb(n, k) * (k + 1)) < 1 << 62 else F.array(*positions)
    return Stream(joined.select(seq.alias(SEQ), F.array(*parts).alias(VALUE), *names), rows)
