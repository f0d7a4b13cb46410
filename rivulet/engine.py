"""Runs programs of the text language on Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.exprs import Compiler, Emitter, Node, Unsupported, comparator_keys, inputs_of, substituted, with_nodes, wrapped
from rivulet.functions.types import INTEGERS, Catalog, EnumDef, StructDef, Type
from rivulet.operators.combinatorics import expand
from rivulet.operators.fold import fold, fold_algebraic
from rivulet.operators.topn import by_order, keep_first_n, ranked, sorted_by
from rivulet.operators.union import select_all
from rivulet.plans.bounds import resolve
from rivulet.plans.parser import parse
from rivulet.plans.syntax import Chain, EnumRange, FunctionStatement, Program, Range, ReadFile, Return, SelectAll, Step, StreamStatement, Variable, VariableStatement
from rivulet.sources.csv import read_struct
from rivulet.sources.ranges import enum_range, integer_range
from rivulet.stream import SEQ, VALUE, Stream

COMBINATORIC = ("permutations", "permutations_with_replacement", "combinations")


class ProgramError(ValueError):
    """The program cannot run: an unknown name, a wrong type, or a body outside the compiled subset."""


@dataclass
class SortKey:
    """An outside comparator for keep_first_n as a key: key(item Column); ascending keeps the smallest."""

    key: Callable[[Column], Column]
    ascending: bool = False


@dataclass
class Typed:
    """A stream and the language's type of its items, where known."""

    stream: Stream
    type: Type | None = None


class Engine:
    """functions: outside functions by name, from Columns to Column (for keep_first_n a SortKey or a comparator on
    items). schemas: outside structs. constants: names usable as range ends. tables: streams usable as variables.
    wrap_overflow: + - * and negation of integers wrap around in their type instead of raising."""

    def __init__(self, spark: SparkSession, functions: dict | None = None, schemas: dict[str, T.StructType] | None = None, constants: dict[str, int] | None = None, tables: dict[str, Stream] | None = None, enforce_bounds: bool = False, wrap_overflow: bool = False):
        self.spark, self.functions, self.constants = spark, functions or {}, constants or {}
        self.schemas, self.tables, self.enforce_bounds = schemas or {}, tables or {}, enforce_bounds
        self.wraps = wrap_overflow

    def prepare(self, program: Program) -> None:
        self.catalog = Catalog({s.name: s for s in program.of(StructDef)}, {e.name: e for e in program.of(EnumDef)}, external=self.schemas)
        resolve(self.catalog)
        self.declared = {f.name: f for f in program.of(FunctionStatement)}
        self.compiler = Compiler(self.declared, self.catalog, self.functions, self.wraps)
        self.variables: dict[str, Typed] = {n: Typed(s) for n, s in self.tables.items()}
        uses: dict[str, int] = {}
        for s in (*program.of(StreamStatement), *program.of(VariableStatement)):
            if isinstance(s.chain.source, Variable):
                uses[s.chain.source.name] = uses.get(s.chain.source.name, 0) + 1
        for v in program.of(VariableStatement):
            made = self.chain(v.chain)
            # one computation for several consumers
            self.variables[v.name] = Typed(made.stream.persist(), made.type) if uses.get(v.name, 0) > 1 else made

    def run(self, program: Program | str) -> Stream | None:
        """Writes the program's files, then gives the stream of all that it returns (None if it returns nothing)."""
        if isinstance(program, str):
            program = parse(program)
        self.prepare(program)
        returned = []
        for s in program.of(StreamStatement):
            made = self.chain(s.chain)
            if isinstance(s.output, Return):
                returned.append(made.stream)
            else:
                self.encoded(made).write_file(s.output.path, s.output.compression)
        if not returned:
            return None
        return returned[0] if len(returned) == 1 else select_all(returned)

    # -------------------------------------------------------------- sources

    def chain(self, c: Chain) -> Typed:
        now = self.source(c)
        steps = list(c.steps)
        while steps:
            s = steps.pop(0)
            fused = self.top_of_tuples(now, s, steps[0]) if steps and s.op in COMBINATORIC and steps[0].op == "keep_first_n" else None
            if fused is not None:
                steps.pop(0)
                now = fused
            else:
                now = self.step(now, s)
        return now

    def source(self, c: Chain) -> Typed:
        s = c.source
        if isinstance(s, Variable):
            if s.name not in self.variables:
                raise ProgramError(f"stream variable {s.name!r} is not defined before it is used")
            return self.variables[s.name]
        if isinstance(s, Range):
            kind = self.first_parameter(c)
            return Typed(integer_range(self.spark, self.constant(s.start), self.constant(s.end), s.inclusive, self.catalog.spark(kind).simpleString() if kind else "int"), kind or Type("i32"))
        if isinstance(s, EnumRange):
            if s.enum not in self.catalog.enums:
                raise ProgramError(f"range({s.enum}): '{s.enum}' is not a declared enum in this program")
            return Typed(enum_range(self.spark, self.catalog.enums[s.enum].unit_names), Type("named", s.enum))
        if isinstance(s, ReadFile):
            if s.struct not in self.catalog.structs and s.struct not in self.schemas:
                raise ProgramError(f"read_file: struct {s.struct!r} is neither declared nor given in schemas")
            return Typed(read_struct(self.spark, s.path, s.struct, self.catalog, s.infer_compression, self.enforce_bounds), Type("named", s.struct))
        branches = [self.chain(b) for b in s.branches]
        return Typed(select_all([b.stream for b in branches]), branches[0].type)

    def constant(self, x: int | str) -> int:
        if isinstance(x, int):
            return x
        if x in self.constants:
            return self.constants[x]
        raise ProgramError(f"range end {x!r}: give constants={{'{x}': ...}}")

    def first_parameter(self, c: Chain) -> Type | None:
        """The integer type that the first in-language function of a chain takes."""
        for s in c.steps:
            if s.op in ("map", "filter", "filter_map") and s.function in self.declared:
                kind = self.declared[s.function].params[0].type if self.declared[s.function].params else None
                return kind if kind and kind.kind in INTEGERS else None
            if s.op == "fold" and s.function in self.declared and len(self.declared[s.function].params) == 2:
                kind = self.declared[s.function].params[1].type
                return kind if kind.kind in INTEGERS else None
            if s.op in COMBINATORIC:
                return None
        return None

    # -------------------------------------------------------------- steps

    def compiled(self, name: str, *inputs: str) -> Node | None:
        """The graph of an in-language function over inputs; None if an outside one replaces it."""
        if name not in self.declared:
            if name in self.functions:
                return None
            raise ProgramError(f"unknown function {name!r}: declare it or give functions={{'{name}': ...}}")
        try:
            return self.compiler.call(name, [self.compiler.graph.make("input", x) for x in inputs])
        except Unsupported as e:
            if name in self.functions:
                return None
            raise ProgramError(str(e)) from None

    def emitter(self, **inputs: Column) -> Emitter:
        return Emitter(inputs, self.functions, self.wraps)

    def step(self, now: Typed, s: Step) -> Typed:
        stream = now.stream
        if s.op == "ok":
            return Typed(stream.ok(), now.type)
        if s.op == "ok_or_panic":
            return Typed(stream.ok_or_panic(), now.type)
        if s.op in COMBINATORIC:
            return Typed(expand(stream, s.op, s.number), Type("array", size=s.number, inner=(now.type,)) if now.type else None)
        if s.op == "keep_first_n":
            return Typed(self.top(stream, s), now.type)
        if s.op == "fold":
            return self.folded(stream, s)
        node = self.compiled(s.function, "v")
        declared = self.declared.get(s.function)
        keep = [SEQ, *(["_error"] if stream.fallible else [])]
        if node is None:
            f = self.functions[s.function]
            out = {"map": stream.map, "filter": stream.filter, "filter_map": stream.filter_map}[s.op](f)
            return Typed(out, now.type if s.op == "filter" else None)
        made = with_nodes(stream.frame, self.emitter(v=F.col(VALUE)), {"_made": node})
        if s.op == "filter":
            return Typed(Stream(made.where("_made").drop("_made")), now.type)
        kind = declared.returns.inner[0] if s.op == "filter_map" and declared.returns.kind == "option" else declared.returns
        value = F.col("_made")
        if kind.kind in INTEGERS or kind.kind in ("f32", "f64"):
            value = value.cast(self.catalog.spark(kind))
        if s.op == "map":
            return Typed(Stream(made.select(*keep, value.alias(VALUE)), stream.count), kind)
        return Typed(Stream(made.where("_made IS NOT NULL").select(*keep, value.alias(VALUE))), kind)

    def comparator(self, name: str) -> tuple[Node, list[tuple[Node, bool]] | None] | None:
        """The order that an in-language comparator gives of items a and b, and its keys, if it compares keys one by one."""
        node = self.compiled(name, "a", "b")
        return None if node is None else (node, comparator_keys(self.compiler.graph, node))

    def top(self, stream: Stream, s: Step) -> Stream:
        found = self.comparator(s.function)
        if found is None:
            f = self.functions[s.function]
            if isinstance(f, SortKey):
                return keep_first_n(stream, s.number, f.key, f.ascending)
            return keep_first_n(stream, s.number, compare=f)
        order, keys = found
        if keys is None:
            return by_order(stream, s.number, lambda a, b: self.emitter(a=a, b=b).column(order))
        names = [f"_by{i}" for i in range(len(keys))]
        frame = with_nodes(stream.frame, self.emitter(a=F.col(VALUE)), dict(zip(names, (k for k, _ in keys), strict=True)))
        by = [(lambda _, c=c: F.col(c), not up) for c, (_, up) in zip(names, keys, strict=True)]
        return keep_first_n(Stream(frame, stream.count), s.number, by)

    def top_of_tuples(self, now: Typed, tuples: Step, top: Step) -> Typed | None:
        """Tuples and their top n in one: what a key takes from single items is computed before the items multiply,
        and only the chosen tuples are put together. None where the key does not allow it."""
        k, n = tuples.number, top.number
        if not k or not n or top.function not in self.declared:
            return None
        found = self.comparator(top.function)
        if found is None or not found[1]:
            return None
        keys = [key for key, _ in found[1]]
        g = self.compiler.graph
        parts: dict[int, Node] = {}

        def elements(x: Node, seen: set) -> None:
            if id(x) in seen:
                return
            seen.add(id(x))
            if x.op == "at" and x.args[0].op == "input" and x.args[1].op == "const":
                parts[id(x)] = g.make("input", f"e{x.args[1].args[0]}", integer=x.integer)
                return
            for a in x.args:
                if isinstance(a, Node):
                    elements(a, seen)

        for key in keys:
            elements(key, set())
        keys = [substituted(g, key, parts) for key in keys]
        if any("a" in inputs_of(key) for key in keys):
            return None
        carried: dict[int, tuple[str, Node]] = {}
        done: dict[int, Node] = {}

        def hoisted(x: Node) -> Node:
            if id(x) in done:
                return done[id(x)]
            ins = inputs_of(x)
            if len(ins) == 1:
                name = next(iter(ins))
                i = int(name[1:])
                one = {}

                def mark(y: Node) -> None:
                    if y.op == "input":
                        one[id(y)] = g.make("input", "e", integer=y.integer)
                    for a in y.args:
                        if isinstance(a, Node):
                            mark(a)

                mark(x)
                alone = substituted(g, x, one)
                column = carried.setdefault(id(alone), (f"c{len(carried)}", alone))[0]
                out = g.make("input", f"{column}_{i}", integer=x.integer)
            else:
                out = g.make(x.op, *(hoisted(a) if isinstance(a, Node) and inputs_of(a) else a for a in x.args), integer=x.integer) if ins else x
            done[id(x)] = out
            return out

        keys = [hoisted(key) for key in keys]
        if any(int(x.rpartition("_")[2]) >= k for key in keys for x in inputs_of(key)):
            return None
        frame = with_nodes(now.stream.frame, self.emitter(e=F.col(VALUE)), {c: x for c, x in carried.values()})
        names = [c for c, _ in carried.values()]
        out = expand(Stream(frame, now.stream.count), tuples.op, k, {c: F.col(c) for c in names}, pieces=True)
        frame = with_nodes(out.frame, self.emitter(**{f"{c}_{i}": F.col(f"{c}_{i}") for c in names for i in range(k)}), {f"_key{i}": key for i, key in enumerate(keys)})
        pieces, places = [f"_v{i}" for i in range(k)], [f"_p{i}" for i in range(k)]
        by, ways = [f"_key{i}" for i in range(len(keys))], [not up for _, up in found[1]]
        best = frame.select(*by, *places, *pieces).orderBy(*sorted_by(by, ways), *places).limit(n)
        count = None if out.count is None else min(n, out.count)
        made = ranked(best.select(*by, F.array(*places).alias(SEQ), F.array(*pieces).alias(VALUE)), by, ways, count)
        return Typed(made, Type("array", size=k, inner=(now.type,)) if now.type else None)

    def folded(self, stream: Stream, s: Step) -> Typed:
        declared = self.declared.get(s.function)
        init: Column
        if isinstance(s.number, int):
            kind = declared.returns if declared and declared.returns.kind != "named" else None
            init = F.lit(s.number).cast(self.catalog.spark(kind)) if kind else F.lit(s.number)
            start = self.compiler.graph.const(s.number, kind.kind if kind and kind.kind in INTEGERS else None)
        elif s.number in self.declared:
            start = self.compiled(s.number)
            init = self.emitter().column(start)
            kind = self.declared[s.number].returns
            if kind.name in self.catalog.structs:
                init = init.cast(self.catalog.struct(kind.name))
        elif s.number in self.functions:
            start, kind, init = None, None, self.functions[s.number]()
        else:
            raise ProgramError(f"fold: {s.number!r} is no function")
        node = self.compiled(s.function, "acc", "x")
        kind = declared.returns if node is not None else kind
        if node is None:
            return Typed(fold(stream, init, self.functions[s.function]), kind)
        algebraic = self.algebraic(node, start) if start is not None else None
        if algebraic is not None:
            fields, sums = {}, {}
            for name, (op, what, begin) in algebraic.items():
                if self.wraps and op == "+" and (integer := begin.integer or what.integer or (kind.kind if kind else None)) in INTEGERS:
                    sums[name] = integer  # summed without overflow, cut to the type once
                wide = lambda c, n=name: c.cast("decimal(38,0)") if n in sums else c
                fields[name] = (op, lambda v, w=what, wide=wide: wide(self.emitter(x=v).column(w)), wide(self.emitter().column(begin)))
            out = fold_algebraic(stream, fields, struct=node.op == "struct")
            if sums:
                cell = (lambda n: F.col(VALUE)[n]) if node.op == "struct" else (lambda n: F.col(VALUE))
                cut = [(wrapped(cell(n), sums[n]) if n in sums else cell(n)).alias(n) for n in fields]
                out = out.map(lambda v: F.struct(*cut) if node.op == "struct" else cut[0])
            what = self.catalog.struct(kind.name) if node.op == "struct" else self.catalog.spark(kind)
            return Typed(Stream(out.frame.select(SEQ, F.col(VALUE).cast(what).alias(VALUE)), 1), kind)
        what = self.catalog.spark(kind)
        return Typed(fold(stream, init.cast(what), lambda acc, x: self.emitter(acc=acc, x=x).column(node).cast(what)), kind)

    def algebraic(self, node: Node, start: Node) -> dict | None:
        """Field to (operator, part without the accumulator, initial value), if every field folds on its own."""
        g = self.compiler.graph
        if node.op == "struct":
            if start.op != "struct" or start.args[1] != node.args[1]:
                return None
            pairs = [(n, v, lambda a, n=n: a.op == "field" and a.args[0].op == "input" and a.args[0].args[0] == "acc" and a.args[1] == n, b) for n, v, b in zip(node.args[1], node.args[2:], start.args[2:], strict=True)]
        else:
            pairs = [("value", node, lambda a: a.op == "input" and a.args[0] == "acc", start)]
        out = {}
        for name, v, is_acc, begin in pairs:
            op = {"+": "+", "-": "-", "least": "min", "greatest": "max"}.get(v.op)
            if op is None:
                return None
            a, b = v.args
            if op != "-" and is_acc(b):
                a, b = b, a
            if not is_acc(a) or "acc" in inputs_of(b):
                return None
            out[name] = ("+", g.make("neg", b, integer=b.integer), begin) if op == "-" else (op, b, begin)
        return out

    # -------------------------------------------------------------- output

    def encoded(self, made: Typed) -> Stream:
        """Enum items and fields as the texts that files hold."""

        def text(c: Column, e: EnumDef) -> Column:
            name = c["variant"] if e.payload is not None else c
            out = None
            for v in (*e.variants, *([e.default] if e.default else [])):
                t = F.lit(v.name if v.text is None else v.text)
                if e.payload is not None and v is e.default:
                    t = c["payload"]
                out = F.when(name == v.name, t) if out is None else out.when(name == v.name, t)
            return out

        t = made.type
        s = made.stream
        if t is None or t.kind != "named" or s.fallible:
            return s
        if t.name in self.catalog.enums:
            return s.map(lambda v: text(v, self.catalog.enums[t.name]))
        if t.name not in self.catalog.structs:
            return s
        fields = []
        for f, ft in self.catalog.structs[t.name].fields:
            inner = ft.inner[0] if ft.kind == "option" else ft
            fields.append((f, self.catalog.enums.get(inner.name) if inner.kind == "named" else None))
        if not any(e for _, e in fields):
            return s
        return s.map(lambda v: F.struct(*((text(v[f], e) if e else v[f]).alias(f) for f, e in fields)))


def run(text: str, spark: SparkSession, **options) -> Stream | None:
    """Runs a program's text; options as for Engine."""
    return Engine(spark, **options).run(text)
