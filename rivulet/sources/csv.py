"""CSV files with a header as streams of structs, a bad record being an item with an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.types import INTEGERS, Catalog, EnumDef, Type, integer_range, smallest_integer
from rivulet.stream import ERROR, SEQ, VALUE, Stream

CORRUPT = "_corrupt_record"


@dataclass
class Decoded:
    """A field's value, and when that is not what the text says."""

    value: Column
    bad: Column
    optional: bool = False


def header_of(line: str, spark: SparkSession) -> list[str]:
    import csv

    return next(csv.reader([line])) if line else []


def raw_rows(spark: SparkSession, path: str, infer_compression: bool) -> tuple[DataFrame, list[str]]:
    """All columns as text under their header names (renamed _c0, _c1, ...), SEQ and CORRUPT."""
    if path.endswith(".gz") and not infer_compression:
        # plain text under a .gz name: Spark's text readers would unzip it, so the file is one value
        size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        if size >= 1 << 31:
            raise ValueError(f"{path}: plain text under a .gz name is read whole and must be smaller than 2 GB; rename it")
        lines = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.decode("content", "utf-8"), r"\r?\n")).alias("n", "line")).where("line <> ''")
        first = lines.where("n = 0").select("line").first()
        names = header_of(first[0] if first else "", spark)
        schema = ", ".join([*(f"_c{i} string" for i in range(len(names))), f"{CORRUPT} string"])
        rows = lines.where("n > 0").select(F.array(F.col("n").cast("long")).alias(SEQ), F.from_csv("line", F.lit(schema), {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("r"))
        return rows.select(SEQ, "r.*"), names
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    schema = T.StructType([*(T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))), T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").csv(path)
    # splits of one file are read in any order of tasks, but their offsets order them
    seq = F.array(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select(seq.alias(SEQ), *rows.columns), names


def decode(raw: Column, t: Type, catalog: Catalog, owner: tuple[str, str], enforce_bounds: bool) -> Decoded:
    if t.kind == "option":
        inner = decode(raw, t.inner[0], catalog, owner, enforce_bounds)
        return Decoded(F.when(raw.isNotNull(), inner.value), raw.isNotNull() & inner.bad, True)
    text = F.coalesce(raw, F.lit(""))
    if t.kind == "bounded" or t.kind in INTEGERS:
        low, high = catalog.bounds[owner] if t.kind == "bounded" else integer_range(t.kind)
        storage = Type(smallest_integer(low, high)) if t.kind == "bounded" else t
        if not (t.kind == "bounded" and enforce_bounds):
            low, high = integer_range(storage.kind)
        wide = raw.try_cast("decimal(38,0)")
        value = raw.try_cast(catalog.spark(storage))
        whole = raw.rlike(r"^[+-]?[0-9]+$")
        if high >= 10**38:
            return Decoded(value, value.isNull() | ~F.coalesce(whole, F.lit(False)))
        fits = F.coalesce(whole & (wide >= F.lit(str(low)).cast("decimal(38,0)")) & (wide <= F.lit(str(high)).cast("decimal(38,0)")), F.lit(False))
        return Decoded(value, value.isNull() | ~fits)
    if t.kind in ("f32", "f64"):
        value = raw.try_cast("float" if t.kind == "f32" else "double")
        return Decoded(value, value.isNull())
    if t.kind == "bool":
        return Decoded(F.when(raw == "true", True).when(raw == "false", False), ~F.coalesce(raw.isin("true", "false"), F.lit(False)))
    if t.kind == "char":
        return Decoded(raw, F.coalesce(F.char_length(raw), F.lit(0)) != 1)
    if t.kind == "string":
        return Decoded(text, F.octet_length(text) > t.size)
    if t.name in catalog.enums:
        return decode_enum(text, catalog.enums[t.name])
    if t.name == "String":
        return Decoded(text, F.lit(False))
    raise ValueError(f"a CSV field cannot be {t}")


def decode_enum(text: Column, e: EnumDef) -> Decoded:
    """Variant names by their texts; anything else is the default, if there is one."""
    known = None
    for v in (*e.variants, *([e.default] if e.default and e.payload is None else [])):
        hit = text == (v.name if v.text is None else v.text)
        known = F.when(hit, v.name) if known is None else known.when(hit, v.name)
    known = known if known is not None else F.lit(None).cast("string")
    if e.payload is not None:
        own = known.isNotNull()
        value = F.struct(F.coalesce(known, F.lit(e.default.name)).alias("variant"), F.when(~own, text).alias("payload"))
        return Decoded(value, ~own & (F.octet_length(text) > e.payload))
    if e.default:
        return Decoded(F.coalesce(known, F.lit(e.default.name)), F.lit(False))
    return Decoded(known, known.isNull())


def spark_fields(schema: T.StructType) -> list[tuple[str, Type | None, T.StructField]]:
    return [(f.name, None, f) for f in schema.fields]


def read_struct(spark: SparkSession, path: str, name: str, catalog: Catalog, infer_compression: bool = True, enforce_bounds: bool = False) -> Stream:
    """Items of a declared struct. Columns are bound by header name; a missing one is an error unless optional.

    An item whose record has the wrong number of columns, or a field that its type cannot take, has ERROR set and a
    null value. A field of an optional type is null where empty. enforce_bounds: bounded integers outside their
    bounds are errors (otherwise only the storage type limits them).
    """
    rows, names = raw_rows(spark, path, infer_compression)
    columns, faults = [], [F.when(F.col(CORRUPT).isNotNull(), F.lit("wrong number of columns"))]
    if name in catalog.external:
        fields = [(f.name, f) for f in catalog.external[name].fields]
    else:
        fields = list(catalog.structs[name].fields)
    for field, t in fields:
        raw = F.col(f"_c{names.index(field)}") if field in names else None
        if isinstance(t, T.StructField):
            kind, optional = t.dataType, t.nullable
            if raw is None:
                d = Decoded(F.lit(None).cast(kind), F.lit(not optional))
            elif isinstance(kind, T.StringType):
                d = Decoded(F.coalesce(raw, F.lit("")) if not optional else raw, F.lit(False))
            else:
                d = Decoded(raw.try_cast(kind), raw.try_cast(kind).isNull() & (raw.isNotNull() | F.lit(not optional)))
        elif raw is None:
            d = Decoded(F.lit(None).cast(catalog.spark(t, (name, field))), F.lit(t.kind != "option"))
        else:
            d = decode(raw, t, catalog, (name, field), enforce_bounds)
        columns.append(d.value.alias(field))
        shown = F.lit("missing column") if raw is None else F.concat(F.lit("bad value "), F.coalesce(raw, F.lit("(empty)")))
        faults.append(F.when(d.bad, F.concat(F.lit(f"{field}: "), shown)))
    error = F.coalesce(*faults)
    # Spark reads a pruned file without its fault column unless that is materialised with the others
    out = rows.select(SEQ, error.cast("string").alias(ERROR), F.struct(*columns).alias(VALUE))
    return Stream(out.select(SEQ, F.when(F.col(ERROR).isNull(), F.col(VALUE)).alias(VALUE), ERROR))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, infer_compression: bool = True) -> Stream:
    """Items of a Spark struct type; nullable fields are optional."""
    return read_struct(spark, path, "_", Catalog(external={"_": schema}), infer_compression)
