"""Chains of map, filter, filter_map, ok and ok_or_panic over a Structured Streaming source.

These operators look at one item at a time, so they mean the same on an unbounded stream; the others need the end of
their input and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.engine import Engine, ProgramError, Typed
from rivulet.plans.parser import parse
from rivulet.plans.syntax import Return, StreamStatement, Variable
from rivulet.stream import SEQ, VALUE, Stream

ELEMENTWISE = ("map", "filter", "filter_map", "ok", "ok_or_panic")


def stream_items(df: DataFrame) -> Stream:
    """The rows of a (streaming) DataFrame as items; their place is not known, so SEQ is null."""
    value = F.col(df.columns[0]) if len(df.columns) == 1 else F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return Stream(df.select(F.lit(None).cast("long").alias(SEQ), value.alias(VALUE)))


def run_streaming(text: str, source: DataFrame, variable: str = "input", **options) -> DataFrame:
    """The program's one returning chain over source, which it names as a variable; a streaming DataFrame if source is one."""
    program = parse(text)
    chains = [s for s in program.of(StreamStatement) if isinstance(s.output, Return)]
    if len(chains) != 1 or not isinstance(chains[0].chain.source, Variable) or chains[0].chain.source.name != variable:
        raise ProgramError(f"a streaming program returns one chain that starts from {variable!r}")
    for s in chains[0].chain.steps:
        if s.op not in ELEMENTWISE:
            raise ProgramError(f"{s.op} needs the end of its input and cannot run on an unbounded stream")
    engine = Engine(source.sparkSession, tables={variable: stream_items(source)}, **options)
    engine.prepare(program)
    now = Typed(stream_items(source))
    for s in chains[0].chain.steps:
        now = engine.step(now, s)
    return now.stream.df
