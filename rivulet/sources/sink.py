"""One CSV file in stream order."""

from __future__ import annotations

import csv
import sys
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.stream import ERROR, SEQ, VALUE, Stream


def flattened(kind: T.DataType, c, name: str, length_of) -> list:
    """Columns for an item: structs by field, arrays by element, scalars as they are."""
    if isinstance(kind, T.ArrayType):
        return [x for i in range(length_of(c)) for x in flattened(kind.elementType, F.get(c, F.lit(i)), f"{name}_{i}", length_of)]
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in flattened(f.dataType, c[f.name], f.name, length_of)]
    return [c.cast("string").alias(name)]


def rows(s: Stream) -> tuple[DataFrame, bool]:
    """The ordered rows to write, and whether they have a header: struct items have, scalars and arrays have not."""
    if s.fallible:
        raise ValueError("a stream of items that may have failed cannot be written; use ok() or ok_or_panic()")
    kind = s.frame.schema[VALUE].dataType
    first = s.frame.limit(1).select(VALUE) if "array" in kind.simpleString() else None

    def length_of(c) -> int:
        found = first.select(F.size(c)).first()
        return found[0] if found else 0

    columns = flattened(kind, F.col(VALUE), "value", length_of)
    return s.frame.orderBy(SEQ).select(*columns) if columns else s.frame.select(F.lit("").alias("value")).limit(0), isinstance(kind, T.StructType)


def write_csv(s: Stream, path: str, compression: str | None = None) -> None:
    """Exactly one file at path, replaced if it is there; its folders are made. gz: by compression, or by the name.

    A stream of structs without items gives an empty file. /dev/stdout prints.
    """
    df, header = rows(s)
    if path == "/dev/stdout":
        out = csv.writer(sys.stdout, lineterminator="\n")
        for i, r in enumerate(df.toLocalIterator()):
            if header and not i:
                out.writerow(df.columns)
            out.writerow(["" if x is None else x for x in r])
        sys.stdout.flush()
        return
    gz = compression == "gz" or compression is None and path.endswith(".gz")
    spark = s.spark
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    part_dir = hadoop.Path(target.getParent() or hadoop.Path("."), f".{target.getName()}-{uuid.uuid4().hex}")
    # the sort runs in parallel; only its result goes through one writer, which is what a single file asks for
    writer = df.coalesce(1).write.option("header", header).option("emptyValue", "").option("nullValue", "")
    writer.option("compression", "gzip" if gz else "none").csv(part_dir.toString())
    try:
        parts = [f.getPath() for f in system.listStatus(part_dir) if f.getPath().getName().startswith("part-")]
        system.delete(target, False)
        if parts and not (header and df.limit(1).count() == 0):
            if not system.rename(parts[0], target):
                raise OSError(f"cannot move the result to {path}")
        else:
            system.create(target, True).close()
    finally:
        system.delete(part_dir, True)
