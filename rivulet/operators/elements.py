"""map, filter, filter_map, ok and ok_or_panic: row by row, order kept, inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.stream import ERROR, SEQ, VALUE, Stream


def others(s: Stream) -> list[str]:
    return [SEQ, *([ERROR] if s.fallible else [])]


def map_items(s: Stream, f: Callable[[Column], Column]) -> Stream:
    return Stream(s.frame.select(*others(s), f(F.col(VALUE)).alias(VALUE)), s.count)


def filter_items(s: Stream, f: Callable[[Column], Column]) -> Stream:
    return Stream(s.frame.where(f(F.col(VALUE))))


def filter_map_items(s: Stream, f: Callable[[Column], Column], optional: bool = False) -> Stream:
    """Keeps where f is not null. optional: f gives a struct, null for none, whose field v is the item and may be null."""
    kept = s.frame.select(*others(s), f(F.col(VALUE)).alias(VALUE)).where(F.col(VALUE).isNotNull())
    return Stream(kept.withColumn(VALUE, F.col(VALUE)["v"]) if optional else kept)


def ok(s: Stream) -> Stream:
    """Drops items that could not be read."""
    return Stream(s.frame.where(F.col(ERROR).isNull()).drop(ERROR)) if s.fallible else s


def ok_or_panic(s: Stream) -> Stream:
    """Fails with the first item that could not be read."""
    if not s.fallible:
        return s
    failed = F.raise_error(F.concat(F.lit("item could not be read: "), F.col(ERROR)))
    return Stream(s.frame.select(SEQ, F.when(F.col(ERROR).isNotNull(), failed.cast(s.frame.schema[VALUE].dataType)).otherwise(F.col(VALUE)).alias(VALUE)), s.count)
