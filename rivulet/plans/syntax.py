"""Syntax tree of the text language."""

from __future__ import annotations

from dataclasses import dataclass

from rivulet.functions.types import EnumDef, StructDef, Type


@dataclass(frozen=True)
class Range:
    """Integers from start to end; ends are literals or names of constants."""

    start: int | str
    end: int | str
    inclusive: bool = False


@dataclass(frozen=True)
class EnumRange:
    enum: str


@dataclass(frozen=True)
class ReadFile:
    path: str
    struct: str
    infer_compression: bool = True


@dataclass(frozen=True)
class SelectAll:
    branches: tuple[Chain, ...]


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Step:
    """A stream operator: number is its count or initial value, function the name that it applies."""

    op: str
    number: int | str | None = None
    function: str | None = None


@dataclass(frozen=True)
class Chain:
    source: Range | EnumRange | ReadFile | SelectAll | Variable
    steps: tuple[Step, ...] = ()


@dataclass(frozen=True)
class Return:
    pass


@dataclass(frozen=True)
class WriteFile:
    path: str
    format: str
    compression: str | None = None


@dataclass(frozen=True)
class StreamStatement:
    chain: Chain
    output: Return | WriteFile


@dataclass(frozen=True)
class VariableStatement:
    name: str
    chain: Chain


@dataclass(frozen=True)
class Param:
    name: str
    type: Type
    by_reference: bool = False


@dataclass(frozen=True)
class FunctionStatement:
    name: str
    params: tuple[Param, ...]
    returns: Type
    body: str


Statement = StreamStatement | VariableStatement | FunctionStatement | StructDef | EnumDef


@dataclass(frozen=True)
class Program:
    statements: tuple[Statement, ...]

    def of(self, kind) -> list:
        return [s for s in self.statements if isinstance(s, kind)]
