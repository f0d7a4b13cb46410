"""keep_first_n: the n largest items, largest first; of equal items the earlier ones, in stream order."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.stream import SEQ, VALUE, Stream

CHUNK = 4096  # items that one array_sort takes


def keep_first_n(s: Stream, n: int, key: Callable[[Column], Column] | list | None = None, ascending: bool = False, compare: Callable | None = None) -> Stream:
    """With a key, or a list of (key, ascending): a sort with limit, which Spark runs as a top n per partition and a merge.

    With a Python comparator: a top n per partition in Python, then one of the partitions' results. n = 0: empty.
    """
    if n == 0:
        return Stream(s.frame.limit(0), 0)
    count = min(n, s.count) if s.count is not None else None
    if key is not None:
        keys = key if isinstance(key, list) else [(key, ascending)]
        names = [f"_key{i}" for i in range(len(keys))]
        frame = s.frame.withColumns({name: k(F.col(VALUE)) for name, (k, _) in zip(names, keys, strict=True)})
        ways = [up for _, up in keys]
        best = frame.orderBy(*sorted_by(names, ways), F.col(SEQ).asc()).limit(n)
        return ranked(best.select(*names, SEQ, VALUE), names, ways, count)
    if compare is None:
        raise ValueError("keep_first_n needs a key or a comparator")
    return by_comparator(s, n, compare, count)


def sorted_by(names: list[str], ascending: list[bool]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in zip(names, ascending, strict=True)]


def ranked(best: DataFrame, names: list[str], ascending: list[bool], count: int | None) -> Stream:
    """At most n rows, numbered in their order of keys and place."""
    order = Window.orderBy(*sorted_by(names, ascending), F.col(SEQ).asc())
    return Stream(best.select((F.row_number().over(order) - 1).cast("long").alias("_rank"), VALUE).withColumnRenamed("_rank", SEQ), count)


def by_order(s: Stream, n: int, order: Callable[[Column, Column], Column]) -> Stream:
    """A comparator given as a Column of two items, negative, zero or positive.

    Chunks of items are sorted as arrays and cut to n, then what is left of a partition's share, then of all; no group
    holds more than a chunk, or n items of each chunk or partition.
    """
    if n == 0:
        return Stream(s.frame.limit(0), 0)
    compare = lambda a, b: F.when(order(a[VALUE], b[VALUE]) != 0, -order(a[VALUE], b[VALUE])).when(a[SEQ] < b[SEQ], -1).when(a[SEQ] > b[SEQ], 1).otherwise(0)

    def best(frame: DataFrame, group: Column) -> DataFrame:
        items = frame.groupBy(group.alias("_group")).agg(F.collect_list("_item").alias("_items"))
        return items.select("_group", F.explode(F.slice(F.array_sort("_items", compare), 1, n)).alias("_item"))

    size = max(CHUNK, 1 << (4 * n - 1).bit_length())
    width = int(s.spark.conf.get("spark.sql.shuffle.partitions"))
    frame = s.frame.select(F.floor(F.monotonically_increasing_id() / size).alias("_group"), F.struct(SEQ, VALUE).alias("_item"))
    frame = best(best(frame, F.col("_group")), F.pmod(F.xxhash64("_group"), F.lit(width)))
    last = frame.agg(F.slice(F.array_sort(F.collect_list("_item"), compare), 1, n).alias("_items"))
    out = last.select(F.posexplode("_items").alias("_place", "_item")).select(F.col("_place").cast("long").alias(SEQ), F.col(f"_item.{VALUE}").alias(VALUE))
    return Stream(out, min(n, s.count) if s.count is not None else None)


def by_comparator(s: Stream, n: int, compare: Callable, count: int | None) -> Stream:
    """Items go through Python in Arrow batches, as they are; no built-in operator sorts by a Python function."""
    schema = s.frame.select(SEQ, VALUE).schema
    numbered = T.StructType([T.StructField(SEQ, T.LongType()), schema[VALUE]])
    compare = pickled(compare)

    def kept(last: bool):
        def run(batches):
            from pyspark.sql.conversion import ArrowTableToRowsConversion, LocalDataToArrowConversion

            f = compare()
            order = functools.cmp_to_key(lambda a, b: -f(a[1], b[1]) or (a[0] > b[0]) - (a[0] < b[0]))
            best: list = []
            for b in batches:
                best += [(r[0], r[1]) for r in ArrowTableToRowsConversion.convert(pa_table(b), schema)]
                if len(best) >= 4 * n + CHUNK:
                    best = sorted(best, key=order)[:n]
            best = sorted(best, key=order)[:n]
            if best:
                rows = [(i, x[1]) for i, x in enumerate(best)] if last else best
                yield from LocalDataToArrowConversion.convert(rows, numbered if last else schema, False).to_batches()

        return run

    local = s.frame.select(SEQ, VALUE).mapInArrow(kept(False), schema)
    return Stream(local.repartition(1).mapInArrow(kept(True), numbered), count)


def pa_table(batch):
    import pyarrow as pa

    return pa.Table.from_batches([batch])


def pickled(f: Callable) -> Callable:
    """f as bytes that load where they are called, so that it may come from a module that executors do not have."""
    from pyspark import cloudpickle

    raw = cloudpickle.dumps(f)
    return lambda: pickle.loads(raw)
