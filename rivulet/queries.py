"""One query per operator over the standard tables, and the same results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.engine import Engine, ProgramError, SortKey
from rivulet.plans.analysis import analyze
from rivulet.stream import ERROR, VALUE, Stream

INT, LONG, TEXT = "int", "bigint", "string"


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def items(spark: SparkSession, d: str, name: str, columns: list[str], order_by: str | list[str]) -> Stream:
    return Stream.from_table(table(spark, d, name, *columns), order_by)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share: below spark.checkpoint.dir, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rivulet-")
    return f"{base}/{uuid.uuid4().hex}/{name}"


PALETTE = """
fn weight(v: i32) -> i64 { (v * v + 7) as i64 }
fn light(c: &[i32; 3]) -> i64 { 3 * weight(c[0]) + 6 * weight(c[1]) + weight(c[2]) }
fn tint(c: &[i32; 3]) -> i64 { 5 * weight(c[0]) - 4 * weight(c[2]) }
fn gap(a: i64, b: i64) -> i64 { if a < b { b - a } else { a - b } }
fn contrast(p: &[[i32; 3]; 3]) -> i64 {
    let mut least: i64 = i64::MAX;
    let mut i: usize = 0;
    while i < 3 {
        let mut j: usize = i + 1;
        while j < 3 {
            let g = gap(light(&p[i]), light(&p[j])) + gap(tint(&p[i]), tint(&p[j]));
            if g < least { least = g; }
            j = j + 1;
        }
        i = i + 1;
    }
    least
}
fn by_contrast(a: &[[i32; 3]; 3], b: &[[i32; 3]; 3]) -> Ordering {
    let x = contrast(a);
    let y = contrast(b);
    if x < y { Ordering::Less } else if x > y { Ordering::Greater } else { Ordering::Equal }
}
fn step(v: i32) -> bool { v % 10 == 0 }
"""


def flagship(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """The best contrasting triples of triples of part sizes: filter, power, combinations, top n."""
    sizes = table(spark, d, "part", "p_size").where("p_size IS NOT NULL").distinct()
    made = Engine(spark, tables={"sizes": Stream.from_table(sizes, "p_size")}).run(PALETTE + f"sizes.filter(step).permutations_with_replacement(3).combinations(3).keep_first_n({n}, by_contrast).return")
    cells = [F.col(VALUE)[i][j].alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    return made.frame.select(*cells)


def enum_decode(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "status.csv")
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    orders.write.option("header", True).csv(path)
    program = """
        enum Status { Final = "F", Open = "O", default Other }
        struct Order { o_orderkey: i64, o_orderstatus: Status }
        read_file("%s", csv, struct=Order).ok_or_panic().return
    """
    return Engine(spark).run(program % path).df.select("o_orderkey", F.col("o_orderstatus").alias("status"))


def ok_rows(spark: SparkSession, d: str, drop: bool = True) -> DataFrame:
    path = scratch(spark, "nation.csv")
    nation = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    bad = F.when(F.col("n_nationkey") % 5 == 0, F.lit("zz")).otherwise(F.col("n_regionkey").cast("string"))
    nation.select("n_nationkey", "n_name", bad.alias("n_regionkey")).write.option("header", True).csv(path)
    program = 'struct Nation { n_nationkey: i32, n_name: string_30, n_regionkey: u8 } read_file("%s", csv, struct=Nation)%s.return'
    made = Engine(spark).run(program % (path, ".ok()" if drop else ""))
    if drop:
        return made.df.select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
    return made.frame.groupBy(F.col(ERROR).isNotNull().alias("failed")).agg(F.count("*").alias("n"))


def csv_roundtrip(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    path = scratch(spark, f"nation.csv{suffix}")
    items(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey").write_file(path)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType(), False), T.StructField("n_name", T.StringType(), False), T.StructField("n_regionkey", T.IntegerType(), False)])
    return Stream.read_csv(spark, path, schema).ok_or_panic().df


def bounded(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    from rivulet.plans.parser import parse

    engine.prepare(parse("enum Mode { A, B, C } struct Part { p_size: uint[1, 50], slot: int[-Mode.len(), p_size.max() * 2] }"))
    made = engine.catalog.constants("Part")
    return spark.range(1).select(*(F.lit(v).cast(LONG).alias(k.lower()) for k, v in made.items()))


def analysis(spark: SparkSession, d: str) -> DataFrame:
    report = analyze("digits = range(0, 10) digits.filter(f).permutations(2).return range(0, 512).combinations(3).keep_first_n(20, c).return")
    return spark.createDataFrame([(s.description, str(s.cardinality), str(s.time_class), str(s.space_class), s.collects_input) for s in report.streams], "description string, cardinality string, time_class string, space_class string, collects_input boolean")


def program(text: str, *tables: tuple[str, str, list[str], str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query from a program's text; tables: (variable, table, columns, order)."""
    return lambda spark, d: Engine(spark, tables={v: items(spark, d, t, c, o) for v, t, c, o in tables}).run(text).df


ORDERS = ("orders", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey")
ORDER = "struct Order { o_orderkey: i64, o_custkey: i64, o_orderstatus: string_1 } "
CUSTOMERS = ("customers", "customer", ["c_custkey", "c_nationkey", "c_mktsegment"], "c_custkey")
CUSTOMER = "struct Customer { c_custkey: i64, c_nationkey: i32, c_mktsegment: string_20 } "


def raised(act: Callable[[], object], says: str, kind: type = Exception) -> bool:
    """Whether act fails with an error of that kind and wording."""
    try:
        act()
    except kind as e:
        return says in str(e)
    return False


def one_row(spark: SparkSession, **values: bool) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one text file, numbered from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line", "text"))


def csv_lines(spark: SparkSession, name: str, lines: list[str]) -> str:
    """A small CSV file with these lines, in order."""
    path = scratch(spark, name)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


def written_in_order(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "top.csv")
    items(spark, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderkey").keep_first_n(30, key=lambda x: x["o_totalprice"]).map(lambda x: F.struct(x["o_orderkey"].alias("o_orderkey"))).write_file(path)
    return file_lines(spark, path).where("line > 0").select("line", F.col("text").cast(LONG).alias("o_orderkey"))


def written_scalars_in_order(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "pairs.csv")
    Engine(spark).run(f'range(0, 40).combinations(2).write_file("{path}", csv)')
    return file_lines(spark, path)


def written_empty(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "none.csv")
    items(spark, d, "nation", ["n_nationkey", "n_name"], "n_nationkey").filter(lambda x: F.lit(False)).write_file(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).getLen()
    return spark.createDataFrame([(1, length)], "files long, size long")


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """Columns bound by name, an empty optional field, a ragged row, a bad number and one out of its type."""
    path = csv_lines(spark, "odd.csv", ["size,name,key", "5,a,1", ",b,2", "7,c,3,extra", "x,d,4", "300,e,5", "9,,6", "8,f"])
    made = Engine(spark).run(f'struct R {{ key: i64, name: Option<string_5>, size: Option<u8> }} read_file("{path}", csv, struct=R).ok().return')
    return made.df.select("key", "name", F.col("size").cast(INT).alias("size"))


def csv_missing_column(spark: SparkSession, d: str) -> DataFrame:
    """A column that the file lacks: null for an optional field, an error for another; and a file that is not there."""
    path = csv_lines(spark, "short.csv", ["key", "1", "2"])
    optional = Engine(spark).run(f'struct R {{ key: i64, name: Option<string_5> }} read_file("{path}", csv, struct=R).ok().return').df.where("name IS NULL").count()
    needed = Engine(spark).run(f'struct R {{ key: i64, name: string_5 }} read_file("{path}", csv, struct=R).ok().return').df.count()
    strict = Engine(spark).run(f'struct R {{ key: i64, name: string_5 }} read_file("{path}", csv, struct=R).ok_or_panic().return')
    absent = raised(lambda: Engine(spark).run(f'struct R {{ key: i64 }} read_file("{path}-none", csv, struct=R).ok().return').df.count(), "")
    return one_row(spark, optional_is_null=optional == 2, needed_is_error=needed == 0, strict_raises=raised(strict.df.collect, "missing column"), absent_raises=absent)


def csv_plain_under_gz(spark: SparkSession, d: str) -> DataFrame:
    path = csv_lines(spark, "plain.csv.gz", ["key,name", "1,a", "2,b"])
    files = spark.read.format("binaryFile").load(path).first()["path"]
    fs = spark._jvm.org.apache.hadoop.fs.Path(files)
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-one/plain.csv.gz")
    system = fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(to.getParent())
    system.rename(fs, to)
    return Engine(spark).run(f'struct R {{ key: i64, name: string_5 }} read_file("{to.toString()}", csv, struct=R, infer_compression=false).ok_or_panic().return').df


def payload_match(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "status.csv")
    table(spark, d, "orders", "o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    text = """
        enum Status { Final = "F", default Other(string_1) }
        struct Order { o_orderkey: i64, o_orderstatus: Status }
        struct Seen { key: i64, status: string_10 }
        fn seen(o: Order) -> Option<Seen> {
            match o.o_orderstatus {
                Status::Final => None,
                Status::Other(x) => Some(Seen { key: o.o_orderkey, status: x }),
            }
        }
        read_file("%s", csv, struct=Order).ok_or_panic().filter_map(seen).return
    """
    return Engine(spark).run(text % path).df


def outside(spark: SparkSession, d: str) -> DataFrame:
    """A function of Columns in place of an in-language one, and a key for keep_first_n."""
    digits = lambda v: F.aggregate(F.split(v.cast("string"), ""), F.lit(0).cast(LONG), lambda n, c: n + F.coalesce(c.try_cast(LONG), F.lit(0)))
    tables = {"keys": items(spark, d, "orders", ["o_orderkey"], "o_orderkey")}
    return Engine(spark, functions={"digits": digits, "most": SortKey(lambda v: v)}, tables=tables).run("keys.map(digits).keep_first_n(25, most).return").df


def refused(spark: SparkSession, d: str) -> DataFrame:
    """Programs that cannot run name what stands in the way; integers that overflow raise."""
    run_ = lambda text: Engine(spark).run(text).df.collect()
    return one_row(
        spark,
        body_names_function=raised(lambda: run_("fn odd_one(x: i32) -> i32 { x.count_ones() } range(0, 4).map(odd_one).return"), "odd_one", ProgramError),
        unknown_function=raised(lambda: run_("range(0, 4).map(nothing).return"), "nothing", ProgramError),
        reversed_range=raised(lambda: run_("range(7, 3).return"), "Range count is negative"),
        overflow=raised(lambda: run_("fn f(x: i32) -> i32 { x * 2000000000 } range(0, 4).map(f).return"), "OVERFLOW"),
    )


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """An element-wise chain on a Structured Streaming source, run until the files there are read."""
    from rivulet.streaming.elements import run_streaming

    source = spark.readStream.schema(spark.read.parquet(f"{d}/orders.parquet").schema).parquet(f"{d}/orders.parque[t]").select("o_orderkey", "o_custkey", "o_orderstatus")
    text = ORDER + "fn open(o: Order) -> bool { o.o_orderkey % 3 == 0 } fn half(o: Order) -> Option<i64> { if o.o_custkey % 2 == 0 { Some(o.o_orderkey * 2) } else { None } } input.filter(open).filter_map(half).return"
    path = scratch(spark, "streamed")
    run_streaming(text, source).writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    v = lambda: F.col(VALUE)
    cents = lambda c: F.round(c * 100).cast(LONG)
    return {
        "range_exclusive": lambda s, d: Stream.range(s, 0, 100).df,
        "range_inclusive": lambda s, d: Stream.range(s, 0, 100, inclusive=True).df,
        "enum_range": lambda s, d: Engine(s).run("enum Color { Red, Green, Blue } range(Color).return").df,
        "map": lambda s, d: items(s, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], ["l_orderkey", "l_linenumber"]).map(lambda x: F.struct(x["l_orderkey"].alias("l_orderkey"), x["l_linenumber"].alias("l_linenumber"), (x["l_quantity"].cast(LONG) * 2 + 10).alias("doubled"))).df,
        "filter": lambda s, d: items(s, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], ["l_orderkey", "l_linenumber"]).filter(lambda x: x["l_quantity"] > 45).df,
        "filter_map": lambda s, d: items(s, d, "events", ["event_id", "props"], "event_id").filter_map(lambda x: F.when(F.get_json_object(x["props"], "$.k").cast("int") % 2 == 0, F.struct(x["event_id"].alias("event_id"), F.get_json_object(x["props"], "$.k").cast("int").alias("k")))).df,
        "permutations": lambda s, d: items(s, d, "region", ["r_name"], "r_name").permutations(2).split("v0", "v1"),
        "permutations_with_replacement": lambda s, d: items(s, d, "region", ["r_name"], "r_name").permutations_with_replacement(3).split("v0", "v1", "v2"),
        "combinations": lambda s, d: items(s, d, "nation", ["n_nationkey"], "n_nationkey").combinations(3).split("v0", "v1", "v2"),
        "comb_after_perm": lambda s, d: items(s, d, "region", ["r_regionkey"], "r_regionkey").permutations(2).combinations(2).frame.select(*(v()[i][j].alias(f"v{i}{j}") for i in range(2) for j in range(2))),
        "tuple_ranks": lambda s, d: items(s, d, "nation", ["n_nationkey"], "n_nationkey").combinations(4).frame.select(F.col("_seq").alias("place"), *(v()[i].alias(f"v{i}") for i in range(4))),
        "keep_first_n": lambda s, d: items(s, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderkey").keep_first_n(20, key=lambda x: x["o_totalprice"]).df,
        "keep_first_n_smallest": lambda s, d: items(s, d, "part", ["p_partkey", "p_size"], "p_partkey").keep_first_n(15, key=lambda x: x["p_size"], ascending=True).df,
        "keep_first_n_comparator": lambda s, d: items(s, d, "customer", ["c_custkey", "c_nationkey"], "c_custkey").keep_first_n(10, compare=lambda a, b: (a["c_nationkey"] % 7 > b["c_nationkey"] % 7) - (a["c_nationkey"] % 7 < b["c_nationkey"] % 7)).df,
        "fold_sum": lambda s, d: items(s, d, "lineitem", ["l_quantity"], "l_quantity").fold_sum(lambda x: x.cast(LONG), 10).df,
        "fold_empty": lambda s, d: items(s, d, "lineitem", ["l_quantity"], "l_quantity").filter(lambda x: F.lit(False)).fold_sum(lambda x: x.cast(LONG), 7).df,
        "fold_struct": lambda s, d: items(s, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderkey").fold_fields(n=("+", lambda x: F.lit(1).cast(LONG), 0), cents=("+", lambda x: cents(x["o_totalprice"]), 0), least=("min", lambda x: x["o_orderkey"], 1 << 40), most=("max", lambda x: x["o_orderkey"], -1)).df,
        "fold_ordered": lambda s, d: items(s, d, "region", ["r_name"], "r_name").fold("", lambda acc, x: F.concat(acc, F.lit("/"), x)).df,
        "select_all": lambda s, d: Stream.select_all(items(s, d, "customer", ["c_name"], "c_name"), items(s, d, "supplier", ["s_name"], "s_name")).df,
        "multi_consumer": multi_consumer,
        "multi_return": lambda s, d: Engine(s).run("fn even(i: i32) -> bool { i % 2 == 0 } fn odd(i: i32) -> bool { i % 2 == 1 } fn up(i: i32) -> i32 { (i * 2) + 10 } digits = range(0, 10) digits.filter(even).return odd_digits = digits.filter(odd) odd_digits.map(up).return").df,
        "ok": ok_rows,
        "ok_errors": lambda s, d: ok_rows(s, d, drop=False),
        "enum_decode_default": enum_decode,
        "bounded_field": bounded,
        "csv_roundtrip": lambda s, d: csv_roundtrip(s, d, ""),
        "csv_roundtrip_gz": lambda s, d: csv_roundtrip(s, d, ".gz"),
        "collect_and_apply": lambda s, d: items(s, d, "region", ["r_regionkey"], "r_regionkey").collect_and_apply(lambda a: F.struct(F.size(a).cast(LONG).alias("n"), F.aggregate(a, F.lit(0), lambda x, y: x + y).cast(LONG).alias("total"))).df,
        "palette_flagship": flagship,
        "analyze": analysis,
        "range_empty": program("select_all(range(5, 5), range(2, =2), range(9, =8)).return"),
        "filter_map_option": program(ORDER + "fn f(o: Order) -> Option<i64> { if o.o_orderkey.wrapping_rem(3) == 0 { Some(o.o_orderkey * 10 + o.o_custkey % 7) } else { None } } orders.filter_map(f).return", ORDERS),
        "struct_literal": program(ORDER + "struct Pair { key: i64, twice: i64, small: bool } fn f(o: Order) -> Pair { let twice = o.o_custkey * 2; Pair { key: o.o_orderkey, twice, small: twice < 100 } } fn big(p: Pair) -> bool { !p.small } orders.map(f).filter(big).return", ORDERS),
        "const_table": program("fn f(x: i32) -> i32 { const TABLE: [[i32; 3]; 2] = [[2, 3, 5], [7, 11, 13]]; let row = TABLE[(x % 2) as usize]; row[(x % 3) as usize] * x } range(0, 50).map(f).return"),
        "match_values": program('fn f(x: i32) -> i32 { match x % 6 { 0 => -1, 1 | 2 => x, n => n * 100 } } fn g(x: i32) -> bool { !matches!(x, 1 | 300 | -1) } range(0, 60).map(f).filter(g).return'),
        "match_payload": payload_match,
        "integer_wrap": program("struct W { x: i64, a: u8, b: i8, c: i32, d: i64 } fn f(x: i32) -> W { W { x: x as i64, a: (x * 3) as u8, b: (x * 3) as i8, c: (x as i64 * 40000000) as i32, d: (x - 7) as i64 / 2 % 5 } } range(0, 300).map(f).return"),
        "early_return": program("fn f(x: i32) -> i32 { if x < 10 { return 0; } let mut n = x; let mut i = 0; while i < 3 { if n % 2 == 0 { n = n / 2; } i += 1; } if n == x { return -n; } n } range(0, 100).map(f).return"),
        "try_option": program("fn half(x: i32) -> Option<i32> { if x % 2 == 0 { Some(x / 2) } else { None } } fn f(x: i32) -> Option<i32> { let a = half(x)?; let b = half(a)?; Some(b + 1) } range(0, 100).filter_map(f).return"),
        "outside_functions": outside,
        "refused_programs": refused,
        "keep_first_n_keys": program(CUSTOMER + "fn c(a: &Customer, b: &Customer) -> Ordering { a.c_nationkey.cmp(&b.c_nationkey).then_with(|| b.c_mktsegment.cmp(&a.c_mktsegment)).then(b.c_custkey.cmp(&a.c_custkey)) } customers.keep_first_n(40, c).return", CUSTOMERS),
        "keep_first_n_keys_of_tuples": program("fn d(p: &[i32; 2]) -> i32 { (p[1] - p[0]) % 9 } fn c(p: &[i32; 2], q: &[i32; 2]) -> Ordering { match d(p).cmp(&d(q)) { Ordering::Equal => q[0].cmp(&p[0]), other => other } } range(0, 60).combinations(2).keep_first_n(25, c).return"),
        "keep_first_n_order": program(CUSTOMER + "fn w(v: &Customer) -> i64 { v.c_custkey % 50 + 1 } fn c(a: &Customer, b: &Customer) -> Ordering { (w(a) * (b.c_nationkey as i64 + 1)).cmp(&(w(b) * (a.c_nationkey as i64 + 1))) } customers.keep_first_n(30, c).return", CUSTOMERS),
        "csv_records": csv_records,
        "csv_missing_column": csv_missing_column,
        "csv_plain_under_gz": csv_plain_under_gz,
        "write_order": written_in_order,
        "write_order_of_tuples": written_scalars_in_order,
        "write_empty_struct": written_empty,
        "streaming_chain": streamed,
    }


def multi_consumer(spark: SparkSession, d: str) -> DataFrame:
    orders = items(spark, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderkey").filter(lambda x: x["o_totalprice"] > 100000)
    small = orders.filter(lambda x: x["o_orderkey"] % 2 == 0).map(lambda x: x["o_orderkey"])
    large = orders.keep_first_n(5, key=lambda x: x["o_totalprice"]).map(lambda x: -x["o_orderkey"])
    return Stream.select_all(small, large).df


def oracle_sql() -> dict[str, str]:
    return {
        "range_exclusive": "SELECT CAST(range AS INTEGER) AS value FROM range(0, 100)",
        "range_inclusive": "SELECT CAST(range AS INTEGER) AS value FROM range(0, 101)",
        "enum_range": "SELECT unnest(['Red', 'Green', 'Blue']) AS value",
        "map": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 2 + 10 AS doubled FROM lineitem",
        "filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45",
        "filter_map": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0",
        "permutations": "SELECT a.r_name AS v0, b.r_name AS v1 FROM region a, region b WHERE a.r_name <> b.r_name",
        "permutations_with_replacement": "SELECT a.r_name AS v0, b.r_name AS v1, c.r_name AS v2 FROM region a, region b, region c",
        "combinations": "SELECT a.n_nationkey AS v0, b.n_nationkey AS v1, c.n_nationkey AS v2 FROM nation a, nation b, nation c WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey",
        "comb_after_perm": "WITH p AS (SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey) SELECT p.x AS v00, p.y AS v01, q.x AS v10, q.y AS v11 FROM p, p q WHERE (p.x, p.y) < (q.x, q.y)",
        "tuple_ranks": "SELECT row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey, c.n_nationkey, d.n_nationkey) - 1 AS place, a.n_nationkey AS v0, b.n_nationkey AS v1, c.n_nationkey AS v2, d.n_nationkey AS v3 FROM nation a, nation b, nation c, nation d WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey AND c.n_nationkey < d.n_nationkey",
        "keep_first_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "keep_first_n_smallest": "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 15",
        "keep_first_n_comparator": "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey % 7 DESC, c_custkey LIMIT 10",
        "fold_sum": "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) + 10 AS BIGINT) AS value FROM lineitem",
        "fold_empty": "SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) + 7 AS BIGINT) AS value FROM lineitem WHERE false",
        "fold_struct": "SELECT count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders",
        "fold_ordered": "SELECT string_agg('/' || r_name, '' ORDER BY r_name) AS value FROM region",
        "select_all": "SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier",
        "multi_consumer": "WITH o AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000), t AS (SELECT -o_orderkey AS value FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) SELECT o_orderkey AS value FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT value FROM t",
        "multi_return": "SELECT CAST(CASE WHEN range % 2 = 0 THEN range ELSE range * 2 + 10 END AS INTEGER) AS value FROM range(0, 10)",
        "ok": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0",
        "ok_errors": "SELECT n_nationkey % 5 = 0 AS failed, count(*) AS n FROM nation GROUP BY 1",
        "enum_decode_default": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE 'Other' END AS status FROM orders",
        "bounded_field": "SELECT CAST(1 AS BIGINT) AS p_size_min, CAST(50 AS BIGINT) AS p_size_max, CAST(50 AS BIGINT) AS p_size_cardinality, CAST(-3 AS BIGINT) AS slot_min, CAST(100 AS BIGINT) AS slot_max, CAST(104 AS BIGINT) AS slot_cardinality",
        "csv_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "csv_roundtrip_gz": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "collect_and_apply": "SELECT count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS total FROM region",
        "palette_flagship": """
            WITH s AS (SELECT DISTINCT p_size AS v FROM part WHERE p_size % 10 = 0),
            c AS (SELECT a.v AS r, b.v AS g, c.v AS b, row_number() OVER (ORDER BY a.v, b.v, c.v) AS p,
                CAST(3 * (a.v * a.v + 7) + 6 * (b.v * b.v + 7) + (c.v * c.v + 7) AS BIGINT) AS light, CAST(5 * (a.v * a.v + 7) - 4 * (c.v * c.v + 7) AS BIGINT) AS tint FROM s a, s b, s c),
            t AS (SELECT x.r AS c00, x.g AS c01, x.b AS c02, y.r AS c10, y.g AS c11, y.b AS c12, z.r AS c20, z.g AS c21, z.b AS c22, x.p AS p, y.p AS q, z.p AS o,
                least(abs(x.light - y.light) + abs(x.tint - y.tint), abs(x.light - z.light) + abs(x.tint - z.tint), abs(y.light - z.light) + abs(y.tint - z.tint)) AS k
                FROM c x JOIN c y ON x.p < y.p JOIN c z ON y.p < z.p)
            SELECT c00, c01, c02, c10, c11, c12, c20, c21, c22 FROM t ORDER BY k DESC, p, q, o LIMIT 20""",
        "analyze": "SELECT * FROM (VALUES ('digits.filter(...).permutations(2).return', 'P(≤10, 2)', 'O(n!/(n-2)!)', 'O(n)', true), ('input.combinations(3).keep_first_n(20, ...).return', '20', 'O(1)', 'O(1)', true)) AS t(description, cardinality, time_class, space_class, collects_input)",
        "range_empty": "SELECT CAST(2 AS INTEGER) AS value",
        "filter_map_option": "SELECT o_orderkey * 10 + o_custkey % 7 AS value FROM orders WHERE o_orderkey % 3 = 0",
        "struct_literal": "SELECT o_orderkey AS key, o_custkey * 2 AS twice, false AS small FROM orders WHERE o_custkey * 2 >= 100",
        "const_table": "SELECT CAST((CASE range % 2 WHEN 0 THEN [2, 3, 5] ELSE [7, 11, 13] END)[range % 3 + 1] * range AS INTEGER) AS value FROM range(0, 50)",
        "match_values": "SELECT * FROM (SELECT CAST(CASE WHEN range % 6 = 0 THEN -1 WHEN range % 6 < 3 THEN range ELSE range % 6 * 100 END AS INTEGER) AS value FROM range(0, 60)) WHERE value NOT IN (1, 300, -1)",
        "match_payload": "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'",
        "integer_wrap": "SELECT range AS x, CAST(range * 3 % 256 AS SMALLINT) AS a, CAST((range * 3 + 128) % 256 - 128 AS TINYINT) AS b, CAST((range * 40000000 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS c, CAST(trunc((range - 7) / 2) AS BIGINT) % 5 AS d FROM range(0, 300)",
        "early_return": "SELECT CAST(CASE WHEN range < 10 THEN 0 WHEN range % 2 = 1 THEN -range WHEN range % 8 = 0 THEN range // 8 WHEN range % 4 = 0 THEN range // 4 ELSE range // 2 END AS INTEGER) AS value FROM range(0, 100)",
        "try_option": "SELECT CAST(range // 4 + 1 AS INTEGER) AS value FROM range(0, 100) WHERE range % 4 = 0",
        "outside_functions": "SELECT CAST(list_sum(list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: CAST(c AS BIGINT))) AS BIGINT) AS value FROM orders ORDER BY 1 DESC LIMIT 25",
        "refused_programs": "SELECT true AS body_names_function, true AS unknown_function, true AS reversed_range, true AS overflow",
        "keep_first_n_keys": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_mktsegment, c_custkey LIMIT 40",
        "keep_first_n_keys_of_tuples": "SELECT [CAST(a.range AS INTEGER), CAST(b.range AS INTEGER)] AS value FROM range(0, 60) a, range(0, 60) b WHERE a.range < b.range ORDER BY (b.range - a.range) % 9 DESC, a.range, b.range LIMIT 25",
        "keep_first_n_order": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY (c_custkey % 50 + 1) / (c_nationkey + 1) DESC, c_custkey LIMIT 30",
        "csv_records": "SELECT CAST(key AS BIGINT) AS key, name, size FROM (VALUES (1, 'a', 5), (2, 'b', NULL), (6, NULL, 9)) AS t(key, name, size)",
        "csv_missing_column": "SELECT true AS optional_is_null, true AS needed_is_error, true AS strict_raises, true AS absent_raises",
        "csv_plain_under_gz": "SELECT CAST(key AS BIGINT) AS key, name FROM (VALUES (1, 'a'), (2, 'b')) AS t(key, name)",
        "write_order": "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS line, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
        "write_order_of_tuples": "SELECT CAST(row_number() OVER (ORDER BY a.range, b.range) - 1 AS INTEGER) AS line, a.range || ',' || b.range AS text FROM range(0, 40) a, range(0, 40) b WHERE a.range < b.range",
        "write_empty_struct": "SELECT CAST(1 AS BIGINT) AS files, CAST(0 AS BIGINT) AS size",
        "streaming_chain": "SELECT o_orderkey * 2 AS value FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0",
    }
