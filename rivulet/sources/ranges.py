"""Integer ranges, enum ranges and tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.stream import SEQ, VALUE, Stream


def integer_range(spark: SparkSession, start: int, end: int, inclusive: bool = False, dtype: str = "int") -> Stream:
    """start..end, ascending; a bound beyond dtype int makes it long. ValueError if the end lies before the start."""
    n = end - start + inclusive
    if n < 0:
        raise ValueError("Range count is negative")
    if dtype == "int" and max(abs(start), abs(end)) >= 1 << 31:
        dtype = "bigint"
    frame = spark.range(start, start + n).select((F.col("id") - start).alias(SEQ), F.col("id").cast(dtype).alias(VALUE))
    return Stream(frame, n)


def enum_range(spark: SparkSession, names: list[str]) -> Stream:
    """The names in order; a literal array, so nothing is sent to executors."""
    items = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    return Stream(spark.range(1).select(F.posexplode(items).alias(SEQ, VALUE)).select(F.col(SEQ).cast("long"), VALUE), len(names))


def from_table(df: DataFrame, order_by: list[str]) -> Stream:
    columns = df.columns
    value = F.col(columns[0]) if len(columns) == 1 else F.struct(*(F.col(f"`{c}`") for c in columns))
    kinds = [df.schema[c].dataType for c in order_by]
    if all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in kinds):
        keys = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-(1 << 63))) for c in order_by]
        seq = keys[0] if len(keys) == 1 else F.array(*keys)
        return Stream(df.select(seq.alias(SEQ), value.alias(VALUE)))
    # places by a range-partitioned sort: they rise with the keys and have gaps, so no task sees the whole table
    ordered = df.orderBy(*(F.col(f"`{c}`") for c in order_by))
    return Stream(ordered.select(F.monotonically_increasing_id().alias(SEQ), value.alias(VALUE)))
