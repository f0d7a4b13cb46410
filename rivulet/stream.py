"""The fluent API: a finite, ordered stream of items as a DataFrame.

Columns: SEQ (the item's place: a long, or an array of longs that orders alike), VALUE (the item) and, for items that
may have failed to be read, ERROR.  Methods give new streams and plan only; Spark runs them when df or a sink asks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ, VALUE, ERROR = "_seq", "value", "_error"


class Stream:
    """count: rows if known; least and most bound nothing and may be None."""

    def __init__(self, frame: DataFrame, count: int | None = None):
        self.frame, self.count = frame, count

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def fallible(self) -> bool:
        return ERROR in self.frame.columns

    # ---------------------------------------------------------------- sources

    @staticmethod
    def range(spark: SparkSession, start: int, end: int, inclusive: bool = False, dtype: str = "int") -> Stream:
        from rivulet.sources.ranges import integer_range

        return integer_range(spark, start, end, inclusive, dtype)

    @staticmethod
    def enum(spark: SparkSession, names: list[str]) -> Stream:
        from rivulet.sources.ranges import enum_range

        return enum_range(spark, names)

    @staticmethod
    def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> Stream:
        from rivulet.sources.csv import read_csv

        return read_csv(spark, path, schema, **options)

    @staticmethod
    def from_table(df: DataFrame, order_by: list[str] | str) -> Stream:
        """Rows of a table as items (a struct of its columns, or the column if there is one), ordered by order_by.

        Integer columns order by themselves; other keys cost a range-partitioned sort.
        """
        from rivulet.sources.ranges import from_table

        return from_table(df, [order_by] if isinstance(order_by, str) else order_by)

    @staticmethod
    def select_all(*streams: Stream) -> Stream:
        from rivulet.operators.union import select_all

        return select_all(list(streams))

    # ---------------------------------------------------------------- operators

    def map(self, f: Callable[[Column], Column]) -> Stream:
        from rivulet.operators.elements import map_items

        return map_items(self, f)

    def filter(self, f: Callable[[Column], Column]) -> Stream:
        from rivulet.operators.elements import filter_items

        return filter_items(self, f)

    def filter_map(self, f: Callable[[Column], Column], optional: bool = False) -> Stream:
        from rivulet.operators.elements import filter_map_items

        return filter_map_items(self, f, optional)

    def ok(self) -> Stream:
        from rivulet.operators.elements import ok

        return ok(self)

    def ok_or_panic(self) -> Stream:
        from rivulet.operators.elements import ok_or_panic

        return ok_or_panic(self)

    def permutations(self, k: int, **options) -> Stream:
        from rivulet.operators.combinatorics import expand

        return expand(self, "permutations", k, **options)

    def permutations_with_replacement(self, k: int, **options) -> Stream:
        from rivulet.operators.combinatorics import expand

        return expand(self, "permutations_with_replacement", k, **options)

    def combinations(self, k: int, **options) -> Stream:
        from rivulet.operators.combinatorics import expand

        return expand(self, "combinations", k, **options)

    def keep_first_n(self, n: int, key: Callable[[Column], Column] | list | None = None, ascending: bool = False, compare: Callable | None = None) -> Stream:
        """The n largest items by key (or, ascending, the smallest), largest first; ties keep stream order.

        key may be a list of (key, ascending), compared one after the other.

        compare(a, b): a Python comparator on items, negative, zero or positive; slower.
        """
        from rivulet.operators.topn import keep_first_n

        return keep_first_n(self, n, key, ascending, compare)

    def fold(self, init: Column | object, f: Callable[[Column, Column], Column]) -> Stream:
        """One item: f over the items in order, from init."""
        from rivulet.operators.fold import fold

        return fold(self, init, f)

    def fold_sum(self, f: Callable[[Column], Column] = lambda v: v, init: object = 0) -> Stream:
        from rivulet.operators.fold import fold_algebraic

        return fold_algebraic(self, {"value": ("+", f, init)})

    def fold_fields(self, **fields) -> Stream:
        """One struct item; each field: (operator, function of an item, initial value), operator one of + min max *."""
        from rivulet.operators.fold import fold_algebraic

        return fold_algebraic(self, fields, struct=True)

    def collect_and_apply(self, f: Callable[[Column], Column]) -> Stream:
        """One item: f of the array of all items in order."""
        from rivulet.operators.fold import collect_and_apply

        return collect_and_apply(self, f)

    # ---------------------------------------------------------------- results

    @property
    def df(self) -> DataFrame:
        """The items, unordered: VALUE, or the fields of struct items as columns; ERROR where present."""
        return self._flat(self.frame)

    @property
    def ordered(self) -> DataFrame:
        return self._flat(self.frame.orderBy(SEQ))

    def _flat(self, df: DataFrame) -> DataFrame:
        kind = df.schema[VALUE].dataType
        columns = [f"{VALUE}.`{f.name}`" for f in kind.fields] if isinstance(kind, T.StructType) else [VALUE]
        return df.select(*columns, *([ERROR] if self.fallible else []))

    def split(self, *names: str) -> DataFrame:
        """Array items as columns of these names."""
        return self.frame.select(*(F.col(VALUE)[i].alias(n) for i, n in enumerate(names)))

    def items(self) -> list:
        """All items, in order, on the driver."""
        return [r[VALUE] for r in self.frame.orderBy(SEQ).select(VALUE).collect()]

    def persist(self) -> Stream:
        """Keeps the items for several consumers, until release()."""
        return Stream(kept(self.frame), self.count)

    def write_file(self, path: str, compression: str | None = None) -> None:
        from rivulet.sources.sink import write_csv

        write_csv(self, path, compression)


KEPT: list[DataFrame] = []


def kept(frame: DataFrame) -> DataFrame:
    """frame, persisted until release()."""
    KEPT.append(frame.persist())
    return KEPT[-1]


def release() -> None:
    """Frees what streams and programs keep for several readers; streams made before still work, and compute it again."""
    while KEPT:
        KEPT.pop().unpersist()


def sequence_array(df: DataFrame) -> Column:
    """SEQ as an array, whatever its type."""
    return F.col(SEQ) if isinstance(df.schema[SEQ].dataType, T.ArrayType) else F.array(F.col(SEQ).cast("long"))
