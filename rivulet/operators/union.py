"""select_all: streams one after the other; a union, whose branches run in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rivulet.stream import ERROR, SEQ, VALUE, Stream, sequence_array


def select_all(streams: list[Stream]) -> Stream:
    """Ordered by argument, then within each; duplicates stay. Items must have one type."""
    if not streams:
        raise ValueError("select_all needs a stream")
    kinds = {s.frame.schema[VALUE].dataType.simpleString() for s in streams}
    if len(kinds) > 1 and not kinds <= {"tinyint", "smallint", "int", "bigint"}:
        raise ValueError(f"select_all over different item types: {', '.join(sorted(kinds))}")
    fallible = any(s.fallible for s in streams)
    frames = []
    for i, s in enumerate(streams):
        error = [F.col(ERROR) if s.fallible else F.lit(None).cast("string").alias(ERROR)] if fallible else []
        frames.append(s.frame.select(F.concat(F.array(F.lit(i).cast("long")), sequence_array(s.frame)).alias(SEQ), VALUE, *error))
    counts = [s.count for s in streams]
    return Stream(reduce(lambda a, b: a.union(b), frames), None if None in counts else sum(counts))
