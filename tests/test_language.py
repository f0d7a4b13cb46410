import gzip

import pytest

from rivulet.engine import ProgramError, SortKey, run
from rivulet.plans.bounds import BoundsError
from rivulet.plans.parser import ParseError, parse

REJECTED = """range(0, 100)|.return|.map(x)|range(0, 10).map(double)|struct { x: i32 }|enum { A, B }|struct Foo|enum Bar|fn (x: i32) -> i32 { x }|fn foo(x: i32) -> i32|range(0, 10).map().return
range(0, 10).filter().return|range(0, 10)..return|range(0, 10).|range(0, 100.return|range(0 100).return|range(0, 100)...return|range(0, 100)).return|@range(0, 100).return|range(0, 100).#map(f).return
range(10).return|range().return|range(0, 10).return(123)|range(0, 10); .return|fn 12f(x: i32) -> i32 { x }|struct 12P { x: i32 }|enum 45C { Red }|range(0, 10).map(12t).return|read_file(csv, struct=D).return
read_file("d.csv", csv).return|read_file(d.csv, csv, struct=D).return|read_file("d.csv", json, struct=D).return|read_file("d.csv", csv, struct=).return|read_file("d.csv", csv, struct=D, infer_compression=maybe).return
read_file("d.csv", csv, struct=D.return|select_all().return|select_all(range(0, 10), .map(d)).return|select_all(range(0, 10),).return|select_all(range(0, 10),, range(1, 2)).return|select_all(range(0, 10).return
select_all(other(0, 10)).return|range(=0, 5).return|range(0, 5).unknown(1).return|range(0, 5).write_file("x", parquet)|enum E { defaultish }|enum E { A, default B(i32) }"""


@pytest.mark.parametrize("text", [x for line in REJECTED.splitlines() for x in line.split("|")])
def test_rejected(text):
    with pytest.raises(ParseError):
        parse(text)


def test_accepted_forms():
    text = """
        enum E { A, B = "b", default C = "c", }
        struct S { a: Option<int[-1, 1_000]>, b: string_8, c: HashMap<String, Vec<i32>>, d: boolean, }
        fn f(x: &i32, y: [[i32; 3]; 3]) -> std::cmp::Ordering { /* } */ let s = "}"; '}' }
        v = range(0, =5)
        w = v.map(f)
        w.ok().ok_or_panic().fold(init, f).write_file("/tmp/x.gz", csv, compression=gz)
        select_all(range(0,1).map(f), select_all(range(E))).return
    """
    assert len(parse(text).statements) == 7
    assert dict(parse(text).statements[1].fields)["d"].kind == "named"


def items(spark, text, **options):
    def plain(x):
        return [plain(y) for y in x] if isinstance(x, list) else x.asDict() if hasattr(x, "asDict") else x

    out = run(text, spark, **options)
    return None if out is None else plain(out.items())


PROGRAMS = [
    ("fn double(x: i32) -> i32 { x * 2 } range(0,3).map(double).return", [0, 2, 4]),
    ("fn is_odd(i: &i32) -> bool { i.wrapping_rem(2) == 1 } range(0,10).filter(is_odd).return", [1, 3, 5, 7, 9]),
    ("range(0,2).permutations(2).combinations(2).return", [[[0, 1], [1, 0]]]),
    ("fn c(a: &[i32; 2], b: &[i32; 2]) -> Ordering { a[0].cmp(&b[0]) } range(0,2).permutations(2).keep_first_n(1, c).return", [[1, 0]]),
    ("enum Words { Hello, World } range(Words).return", ["Hello", "World"]),
    ("enum E { A, default Z } range(E).return", ["A", "Z"]),
    ("enum E { A, default Z(string_4) } range(E).return", ["A"]),
    ("select_all(range(0,3), range(10,13)).return", [0, 1, 2, 10, 11, 12]),
    ("fn add(a: i32, x: i32) -> i32 { a + x } range(0,100).fold(0, add).return", [4950]),
    ("fn f(a: i32, x: i32) -> i32 { a * 2 + x } range(0,5).fold(0, f).return", [26]),
    ("struct M { v: u32 } fn make() -> M { M { v: 10 } } fn acc(m: M, x: u32) -> M { M { v: m.v + x } } fn un(m: M) -> u32 { m.v } range(0,5).fold(make, acc).map(un).return", [20]),
    ("fn half(x: i32) -> Option<i32> { if x % 2 == 0 { Some(x / 2) } else { None } } range(0,6).filter_map(half).return", [0, 1, 2]),
    ("fn f(x: i32) -> i8 { (x * 3) as i8 } range(40,45).map(f).return", [120, 123, 126, -127, -124]),
    ("fn f(x: i32) -> u8 { (x - 2) as u8 } range(0,4).map(f).return", [254, 255, 0, 1]),
    ("fn f(x: i32) -> i64 { (x as i64) * 4000000000 } range(0,3).map(f).return", [0, 4000000000, 8000000000]),
    ("fn f(x: i32) -> i32 { (x - 7) / 2 } range(0,3).map(f).return", [-3, -3, -2]),
    ("fn f(x: i32) -> i32 { x.wrapping_mul(2000000000) } range(0,3).map(f).return", [0, 2000000000, -294967296]),
    ("fn f(x: i32) -> f64 { x as f64 / 2.0 } range(0,3).map(f).return", [0.0, 0.5, 1.0]),
    ("fn f(x: i32) -> i32 { let mut n = 0; let mut i = 0; while i < 4 { n = n + x * i; i += 1; } n } range(0,3).map(f).return", [0, 6, 12]),
    ("fn f(x: i32) -> i32 { match x { 0 => 5, 1 | 2 => 7, n => n * 10 } } range(0,5).map(f).return", [5, 7, 7, 30, 40]),
    ("fn c(a: &i32, b: &i32) -> Ordering { b.cmp(a) } range(3,9).keep_first_n(3, c).return", [3, 4, 5]),
    ("fn c(a: &i32, b: &i32) -> Ordering { if a < b { Ordering::Greater } else if a > b { Ordering::Less } else { Ordering::Equal } } range(3,9).keep_first_n(2, c).return", [3, 4]),
    ("fn k(a: &i32) -> i32 { a % 3 } fn c(a: &i32, b: &i32) -> Ordering { k(a).cmp(&k(b)).reverse() } range(0,7).keep_first_n(3, c).return", [0, 3, 6]),
    ("struct P { a: i32, b: i32 } fn p(x: i32) -> P { P { a: x % 3, b: x } } fn b(v: P) -> i32 { v.b } fn c(x: &P, y: &P) -> Ordering { x.a.cmp(&y.a).then_with(|| y.b.cmp(&x.b)) } range(0,8).map(p).keep_first_n(5, c).map(b).return", [2, 5, 1, 4, 7]),
    ("struct P { a: i32, b: i32 } fn p(x: i32) -> P { P { a: x % 3, b: x } } fn b(v: P) -> i32 { v.b } fn c(x: &P, y: &P) -> Ordering { match y.a.cmp(&x.a) { Ordering::Equal => x.b.cmp(&y.b), other => other } } range(0,8).map(p).keep_first_n(4, c).map(b).return", [6, 3, 0, 7]),
    ("struct P { a: i32, b: i32 } fn p(x: i32) -> P { P { a: x % 3, b: x } } fn b(v: P) -> i32 { v.b } fn c(x: &P, y: &P) -> Ordering { if x.a != y.a { return x.a.cmp(&y.a); } y.b.cmp(&x.b) } range(0,8).map(p).keep_first_n(5, c).map(b).return", [2, 5, 1, 4, 7]),
    ("fn h(x: &i32) -> i32 { x % 2 } fn c(x: &i32, y: &i32) -> Ordering { h(x).cmp(&h(y)).then(x.cmp(y).reverse()) } range(0,7).keep_first_n(4, c).return", [1, 3, 5, 0]),
    # no key of one item: quotients compared by cross products
    ("fn c(x: &i32, y: &i32) -> Ordering { (x * (y % 3 + 1)).cmp(&(y * (x % 3 + 1))) } range(1,10).keep_first_n(4, c).return", [9, 6, 7, 3]),
    ("fn c(p: &[i32; 2], q: &[i32; 2]) -> Ordering { (p[1] - p[0]).cmp(&(q[1] - q[0])).then(q[0].cmp(&p[0])) } range(0,5).combinations(2).keep_first_n(3, c).return", [[0, 4], [0, 3], [1, 4]]),
    ("fn f(x: i32) -> i32 { if x < 2 { return 10; } if x == 2 { return 20; } else { let y = x * 2; if y > 6 { return y; } } x } range(0,5).map(f).return", [10, 10, 20, 3, 8]),
    ("fn g(x: i32) -> Option<i32> { if x % 2 == 0 { Some(x * 5) } else { None } } fn f(x: i32) -> Option<i32> { let y = g(x)?; if y > 15 { return None; } Some(y + 1) } range(0,6).filter_map(f).return", [1, 11]),
    ("out = inn.map(f) inn = range(0, 2) fn f(x: i32) -> i32 { x }", "undefined"),
]


@pytest.mark.parametrize(("text", "expected"), PROGRAMS)
def test_programs(spark, text, expected):
    if expected == "undefined":
        with pytest.raises(ProgramError, match="not defined before"):
            run(text, spark)
    else:
        assert items(spark, text) == expected


WRAPPING = [
    ("fn f(x: i32) -> i32 { x * 2000000000 } range(0,3).map(f).return", [0, 2000000000, -294967296]),
    ("fn f(x: i32) -> u8 { let a = x as u8; a + 254 } range(0,4).map(f).return", [254, 255, 0, 1]),
    ("fn f(x: i32) -> u8 { let a = x as u8; a - 2 } range(0,4).map(f).return", [254, 255, 0, 1]),
    ("fn f(x: i32) -> u32 { let a = (x - 1) as u32; a * a } range(0,3).map(f).return", [1, 0, 1]),
    ("fn f(x: i32) -> i64 { let a = x as i64 + 9223372036854775806; a * 3 } range(0,3).map(f).return", [9223372036854775802, 9223372036854775805, -9223372036854775808]),
    ("fn f(x: i32) -> i8 { let a = (x + 127) as i8; -a } range(0,2).map(f).return", [-127, -128]),
    ("fn f(x: i32) -> i32 { let mut h: i32 = 17; let mut i = 0; while i < 8 { h = h * 31 + x; i += 1; } h } range(0,2).map(f).return", "hash"),
    ("fn add(n: i32, x: i32) -> i32 { n + x * 1000000000 } range(0,10).fold(0, add).return", [45 * 10**9 % 2**32]),
]


@pytest.mark.parametrize(("text", "expected"), WRAPPING)
def test_overflow_wraps_on_request(spark, text, expected):
    def cut(v):
        return (v + 2**31) % 2**32 - 2**31

    if expected == "hash":
        expected = []
        for x in range(2):
            h = 17
            for _ in range(8):
                h = cut(h * 31 + x)
            expected.append(h)
    assert run(text, spark, wrap_overflow=True).items() == expected


def test_declarations_may_follow_their_use(spark):
    assert items(spark, "range(0, 2).map(f).return fn f(x: i32) -> i32 { g(x) + 1 } fn g(x: i32) -> i32 { x * 5 }") == [1, 6]


def test_outside_functions(spark):
    assert items(spark, "range(0, 4).map(f).keep_first_n(2, c).return", functions={"f": lambda v: v * v, "c": SortKey(lambda v: v)}) == [9, 4]
    assert items(spark, "range(0, 4).keep_first_n(2, c).return", functions={"c": lambda a, b: b - a}) == [0, 1]
    with pytest.raises(ProgramError, match="unknown function"):
        run("range(0, 4).map(f).return", spark)
    with pytest.raises(ProgramError, match="functions="):
        run("fn f(x: i32) -> i32 { x.count_ones() } range(0, 4).map(f).return", spark)
    assert items(spark, "range(a, b).return", constants={"a": 3, "b": 5}) == [3, 4]
    with pytest.raises(ProgramError, match="not a declared enum"):
        run("range(Nope).return", spark)


def test_fused_top_of_tuples_matches_the_plain_operators(spark):
    functions = "fn w(v: i32) -> i32 { (v * 7) % 11 } fn d(a: i32, b: i32) -> i32 { if a < b { b - a } else { a - b } } fn k(p: &[i32; 2]) -> i32 { d(w(p[0]), w(p[1])) } fn c(a: &[i32; 2], b: &[i32; 2]) -> Ordering { k(a).cmp(&k(b)) }"
    w = [(v * 7) % 11 for v in range(9)]
    pairs = [[a, b] for a in range(9) for b in range(a + 1, 9)]
    expected = sorted(pairs, key=lambda p: -abs(w[p[0]] - w[p[1]]))[:6]
    assert items(spark, functions + "range(0, 9).combinations(2).keep_first_n(6, c).return") == expected
    made = run(functions + "range(0, 9).combinations(2).keep_first_n(6, c).return", spark)
    assert "BatchEvalPython" not in made.frame._jdf.queryExecution().toString()


BOUNDS = [
    ("struct Sensor { reading: int[100, 0] }", "Bounds violation for field 'Sensor.reading': min (100) is greater than max (0)"),
    ("struct Temp { reading: uint[-10, -1] }", "Bounds violation for field 'Temp.reading': uint[] cannot have negative min value (-10)"),
    ("struct Sensor { reading: int[0, NonExistent.len()] }", "Undefined type: 'NonExistent'"),
    ("struct S { a: int[0, 1 / 0] }", "Division by zero in bound expression"),
    ("struct S { a: int[0, b.max()], b: int[0, a.max()] }", "Circular dependency detected"),
    ("struct S { a: int[0, E.max()] } enum E { }", "no variants"),
]


@pytest.mark.parametrize(("text", "message"), BOUNDS)
def test_bounds_faults(spark, text, message):
    with pytest.raises(BoundsError) as e:
        run(text, spark)
    assert str(e.value).startswith("Bounded type validation failed:\n  - ") and message in str(e.value)


def test_bounds_may_use_several_methods_of_one_type(spark):
    from rivulet.engine import Engine

    engine = Engine(spark)
    engine.prepare(parse("enum Color { R, G, B } struct P { i: uint[0, Color.len() - Color.min() - 1], j: int[-(i.max() + 1) * 2, i.cardinality()] }"))
    assert engine.catalog.bounds == {("P", "i"): (0, 2), ("P", "j"): (-6, 3)}
    assert engine.catalog.constants("P")["J_CARDINALITY"] == 10


SHIPS = "class,hull\nDeadalus,spherical\nOberth,split\nOlympic,spherical\n"
HULL = 'enum Hull { Spherical = "spherical", Split = "split" } struct V { class: string_8, hull: Hull } '


@pytest.fixture
def ships(tmp_path):
    (tmp_path / "ships.csv").write_text(SHIPS)
    (tmp_path / "gaps.csv").write_text("hull,class\nspherical,Deadalus\n,Oberth\nsplit,\n")
    (tmp_path / "odd.csv").write_text("class,hull\nDeadalus,spherical\nTooLongName,split\nOberth,flat\nx,split,extra\n")
    with gzip.open(tmp_path / "ships.csv.gz", "wt") as f:
        f.write(SHIPS)
    (tmp_path / "plain.csv.gz").write_text(SHIPS)
    return tmp_path


def test_csv_reads_and_writes(spark, ships):
    sph = "fn sph(v: V) -> bool { matches!(v.hull, Hull::Spherical) } "
    for name, extra in (("ships.csv", ""), ("ships.csv.gz", ""), ("plain.csv.gz", ", infer_compression=false")):
        text = f'{HULL}{sph} read_file("{ships}/{name}", csv, struct=V{extra}).ok_or_panic().filter(sph).return'
        assert [x["class"] for x in items(spark, text)] == ["Deadalus", "Olympic"]
    run(f'{HULL} read_file("{ships}/ships.csv", csv, struct=V).ok().write_file("{ships}/deep/out.csv", csv) read_file("{ships}/ships.csv", csv, struct=V).ok().write_file("{ships}/out.csv.gz", csv) range(0, 3).write_file("{ships}/n.csv", csv, compression=none)', spark)
    assert (ships / "deep/out.csv").read_text() == SHIPS
    assert gzip.open(ships / "out.csv.gz", "rt").read() == SHIPS
    assert (ships / "n.csv").read_text() == "0\n1\n2\n"


def test_csv_empty_struct_stream_gives_an_empty_file(spark, ships):
    run(f'{HULL} fn no(v: V) -> bool {{ false }} read_file("{ships}/ships.csv", csv, struct=V).ok().filter(no).write_file("{ships}/e.csv", csv)', spark)
    assert (ships / "e.csv").read_text() == ""


def test_csv_bad_records(spark, ships):
    read = f'read_file("{ships}/odd.csv", csv, struct=V)'
    assert [x["class"] for x in items(spark, f"{HULL} {read}.ok().return")] == ["Deadalus"]
    with pytest.raises(Exception, match="could not be read"):
        items(spark, f"{HULL} {read}.ok_or_panic().return")


def test_csv_by_name_with_defaults_and_options(spark, ships):
    text = f'enum Hull {{ Spherical = "spherical", default Other }} struct V {{ class: Option<string_8>, hull: Hull }} read_file("{ships}/gaps.csv", csv, struct=V).ok().return'
    assert items(spark, text) == [{"class": "Deadalus", "hull": "Spherical"}, {"class": "Oberth", "hull": "Other"}, {"class": None, "hull": "Other"}]
    text = f'enum Hull {{ Spherical = "spherical", default Other(string_5) }} struct V {{ class: String, hull: Hull }} fn h(v: V) -> string_5 {{ match v.hull {{ Hull::Other(x) => x, _ => "none" }} }} read_file("{ships}/odd.csv", csv, struct=V).ok().map(h).return'
    assert items(spark, text) == ["none", "split", "flat"]


def test_integer_fields_are_checked(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\n1,2\n300,2\n1.5,2\n-1,2\n7,99\n")
    text = f'struct S {{ a: u8, b: int[0, 10] }} read_file("{tmp_path}/n.csv", csv, struct=S).ok().return'
    assert [x["a"] for x in items(spark, text)] == [1, 7]
    assert [x["a"] for x in items(spark, text, enforce_bounds=True)] == [1]


def test_streaming_chain(spark, tmp_path):
    from rivulet.streaming.elements import run_streaming

    spark.range(10).selectExpr("cast(id as int) as v").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
    out = run_streaming("fn odd(x: i32) -> bool { x % 2 == 1 } fn up(x: i32) -> i32 { x * 10 } input.filter(odd).map(up).return", source)
    query = out.writeStream.format("memory").queryName("chain").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r[0] for r in spark.table("chain").collect()) == [10, 30, 50, 70, 90]
    with pytest.raises(ProgramError, match="end of its input"):
        run_streaming("input.combinations(2).return", source)


def test_command_line_runs_programs(spark, tmp_path, capsys, monkeypatch):
    import io

    from rivulet.cli import main

    (tmp_path / "p").write_text("struct P { a: i32, b: i32 } fn f(x: i32) -> P { P { a: x, b: x * 2 } } range(1, 3).map(f).return")
    assert main(["run", str(tmp_path / "p")]) == 0
    assert capsys.readouterr().out == "a,b\n1,2\n2,4\n"
    monkeypatch.setattr("sys.stdin", io.StringIO('range(0, 3).combinations(2).write_file("/dev/stdout", csv)'))
    assert main([]) == 0
    assert capsys.readouterr().out == "0,1\n0,2\n1,2\n"
    (tmp_path / "bad").write_text("range(0, 3).map(nothing).return")
    assert main(["run", str(tmp_path / "bad")]) == 1


def test_command_line(tmp_path, capsys):
    from rivulet.cli import main

    (tmp_path / "p").write_text("range(0, 5).return")
    assert main(["analyze", str(tmp_path / "p")]) == 0
    assert '"cardinality": "5"' in capsys.readouterr().out
    (tmp_path / "bad").write_text("range(0, 5)")
    assert main(["analyze", str(tmp_path / "bad")]) == 1
