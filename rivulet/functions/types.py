"""The type model of pipelines and its mapping to Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# width in bits and signedness of the integer types
INTEGERS = {"i8": (8, True), "i16": (16, True), "i32": (32, True), "i64": (64, True), "isize": (64, True), "i128": (128, True), "u8": (8, False), "u16": (16, False), "u32": (32, False), "u64": (64, False), "usize": (64, False), "u128": (128, False)}
PRIMITIVES = (*INTEGERS, "f32", "f64", "bool", "char")


def integer_range(name: str) -> tuple[int, int]:
    bits, signed = INTEGERS[name]
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)


def spark_integer(name: str) -> T.DataType:
    """The Spark type that holds a whole integer type; 128-bit types are cut to 38 digits."""
    bits, signed = INTEGERS[name]
    if bits == 128:
        return T.DecimalType(38, 0)
    if bits == 64:
        return T.LongType() if signed or name == "usize" else T.DecimalType(20, 0)
    return {(8, True): T.ByteType(), (16, True): T.ShortType(), (32, True): T.IntegerType(), (8, False): T.ShortType(), (16, False): T.IntegerType(), (32, False): T.LongType()}[bits, signed]


def smallest_integer(low: int, high: int) -> str:
    """The narrowest type for a range: unsigned if it has no negative value."""
    for name in ("u8", "u16", "u32", "u64", "u128") if low >= 0 else ("i8", "i16", "i32", "i64", "i128"):
        a, b = integer_range(name)
        if a <= low and high <= b:
            return name
    raise ValueError(f"no integer type holds {low}..{high}")


@dataclass(frozen=True)
class Type:
    """kind: a primitive's name, string (size: bytes), option, array, bounded, named or ordering."""

    kind: str
    name: str = ""
    size: int = 0
    inner: tuple[Type, ...] = ()
    bounds: tuple = ()

    def __str__(self) -> str:
        if self.kind == "option":
            return f"Option<{self.inner[0]}>"
        if self.kind == "array":
            return f"[{self.inner[0]}; {self.size}]"
        if self.kind == "string":
            return f"string_{self.size}"
        return self.name or self.kind


@dataclass(frozen=True)
class StructDef:
    name: str
    fields: tuple[tuple[str, Type], ...]


@dataclass(frozen=True)
class Variant:
    name: str
    text: str | None = None


@dataclass(frozen=True)
class EnumDef:
    """Unit variants in order; default: the variant that takes any other text, payload: bytes of text that it keeps."""

    name: str
    variants: tuple[Variant, ...]
    default: Variant | None = None
    payload: int | None = None

    @property
    def unit_names(self) -> list[str]:
        own = [v.name for v in self.variants]
        return own + [self.default.name] if self.default and self.payload is None else own

    def __len__(self) -> int:
        return len(self.variants) + (self.default is not None)


@dataclass
class Catalog:
    """Declared structs and enums, resolved bounds, and structs given from outside."""

    structs: dict[str, StructDef] = field(default_factory=dict)
    enums: dict[str, EnumDef] = field(default_factory=dict)
    bounds: dict[tuple[str, str], tuple[int, int]] = field(default_factory=dict)
    external: dict[str, T.StructType] = field(default_factory=dict)

    def spark(self, t: Type, owner: tuple[str, str] | None = None) -> T.DataType:
        if t.kind in INTEGERS:
            return spark_integer(t.kind)
        if t.kind == "bounded":
            return spark_integer(smallest_integer(*self.bounds[owner]))
        if t.kind in ("f32", "f64"):
            return T.FloatType() if t.kind == "f32" else T.DoubleType()
        if t.kind == "bool":
            return T.BooleanType()
        if t.kind in ("char", "string"):
            return T.StringType()
        if t.kind == "option":
            return self.spark(t.inner[0], owner)
        if t.kind == "array":
            return T.ArrayType(self.spark(t.inner[0]), False)
        if t.name in self.enums:
            return T.StringType() if self.enums[t.name].payload is None else T.StructType([T.StructField("variant", T.StringType()), T.StructField("payload", T.StringType())])
        if t.name in self.structs:
            return self.struct(t.name)
        if t.name in self.external:
            return self.external[t.name]
        if t.name == "Vec" and t.inner:
            return T.ArrayType(self.spark(t.inner[0]))
        if t.name == "HashMap" and len(t.inner) == 2:
            return T.MapType(self.spark(t.inner[0]), self.spark(t.inner[1]))
        if t.name == "String":
            return T.StringType()
        raise ValueError(f"unknown type {t}")

    def struct(self, name: str) -> T.StructType:
        if name in self.external:
            return self.external[name]
        return T.StructType([T.StructField(f, self.spark(t, (name, f)), t.kind == "option") for f, t in self.structs[name].fields])

    def constants(self, name: str) -> dict[str, int]:
        """FIELD_MIN, FIELD_MAX and FIELD_CARDINALITY of a struct's bounded fields."""
        out = {}
        for f, t in self.structs[name].fields:
            if (name, f) in self.bounds:
                low, high = self.bounds[name, f]
                out |= {f"{f.upper()}_MIN": low, f"{f.upper()}_MAX": high, f"{f.upper()}_CARDINALITY": high - low + 1}
        return out
