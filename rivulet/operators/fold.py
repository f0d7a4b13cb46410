"""fold and collect_and_apply: exactly one item, whatever the input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.stream import SEQ, VALUE, Stream


def one(frame: DataFrame) -> Stream:
    return Stream(frame.select(F.lit(0).cast("long").alias(SEQ), VALUE), 1)


def gathered(s: Stream) -> DataFrame:
    """One row with the array _items of all items in order."""
    kind = s.frame.schema[VALUE].dataType
    pairs = F.array_sort(F.collect_list(F.struct(SEQ, VALUE)))
    return s.frame.agg(F.transform(pairs, lambda x: x[VALUE]).cast(T.ArrayType(kind)).alias("_items"))


def fold(s: Stream, init, f: Callable[[Column, Column], Column]) -> Stream:
    """A sequential left fold. The items of one fold meet in one row, in order; use an algebraic fold where one exists."""
    start = init if isinstance(init, Column) else F.lit(init)
    return one(gathered(s).select(F.aggregate("_items", start, f).alias(VALUE)))


def fold_algebraic(s: Stream, fields: dict[str, tuple], struct: bool = False) -> Stream:
    """Folds that do not depend on order, as partial and final aggregates: field to (operator, f(item), initial value)."""
    aggregates = []
    for name, (op, f, init) in fields.items():
        x, start = f(F.col(VALUE)), init if isinstance(init, Column) else F.lit(init)
        if op == "+":
            out = F.coalesce(F.sum(x), F.lit(0)) + start
        elif op == "*":
            out = F.coalesce(F.product(x), F.lit(1)) * start
        else:
            out = (F.least if op == "min" else F.greatest)(F.coalesce(F.min(x) if op == "min" else F.max(x), start), start)
        aggregates.append(out.alias(name))
    frame = s.frame.agg(*aggregates)
    return one(frame.select(F.struct(*fields).alias(VALUE)) if struct else frame.select(F.col(next(iter(fields))).alias(VALUE)))


def collect_and_apply(s: Stream, f: Callable[[Column], Column]) -> Stream:
    return one(gathered(s).select(f(F.col("_items")).alias(VALUE)))
