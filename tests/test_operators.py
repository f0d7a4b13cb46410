import itertools

import pytest
from pyspark.sql import functions as F

from rivulet.stream import Stream


def plain(x):
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5])
@pytest.mark.parametrize("k", [0, 1, 2, 3, 4])
def test_tuples_are_those_of_itertools_in_order(spark, n, k):
    s = Stream.range(spark, 0, n)
    assert plain(s.permutations(k).items()) == [list(x) for x in itertools.permutations(range(n), k)]
    assert plain(s.combinations(k).items()) == [list(x) for x in itertools.combinations(range(n), k)]
    expected = [list(x) for x in itertools.product(range(n), repeat=k)] if k else []
    assert plain(s.permutations_with_replacement(k).items()) == expected


def test_tuples_of_equal_items_count_positions(spark):
    s = Stream.range(spark, 0, 3).map(lambda v: F.lit(7))
    assert plain(s.combinations(2).items()) == [[7, 7]] * 3
    assert len(s.permutations(2).items()) == 6


def test_tuples_after_a_filter_have_dense_places(spark):
    s = Stream.range(spark, 0, 10).filter(lambda v: v % 3 == 0).combinations(2)
    assert [r["_seq"] for r in s.frame.orderBy("_seq").collect()] == list(range(6))
    assert plain(s.items()) == [list(x) for x in itertools.combinations([0, 3, 6, 9], 2)]


def test_a_row_limit_is_checked_before_anything_runs(spark):
    with pytest.raises(ValueError, match="limit"):
        Stream.range(spark, 0, 1000).combinations(3, max_rows=1000)


@pytest.mark.parametrize(("values", "n", "ascending", "expected"), [([5, 3, 8, 1, 9, 2], 3, False, [9, 8, 5]), ([5, 3, 8, 1, 9, 2], 3, True, [1, 2, 3]), ([3, 1], 5, False, [3, 1]), ([], 2, False, []), ([4, 4], 0, False, [])])
def test_keep_first_n(spark, values, n, ascending, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v int")
    s = Stream.from_table(df, "i").map(lambda x: x["v"])
    assert s.keep_first_n(n, key=lambda v: v, ascending=ascending).items() == expected
    assert s.keep_first_n(n, compare=(lambda a, b: b - a) if ascending else (lambda a, b: a - b)).items() == expected


def test_ties_keep_stream_order(spark):
    s = Stream.range(spark, 0, 100)
    assert s.keep_first_n(5, key=lambda v: F.lit(1)).items() == [0, 1, 2, 3, 4]
    assert s.keep_first_n(5, compare=lambda a, b: 0).items() == [0, 1, 2, 3, 4]


def test_top_n_plan_has_no_global_sort(spark):
    plan = Stream.range(spark, 0, 1000).keep_first_n(5, key=lambda v: v).frame._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    tuples = Stream.range(spark, 0, 50).combinations(3).frame._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in tuples and "SortMergeJoin" not in tuples and "CartesianProduct" not in tuples


def test_folds(spark):
    s = Stream.range(spark, 0, 5)
    assert s.fold(F.lit(0), lambda a, x: a * 10 + x).items() == [1234]
    assert s.fold_sum(init=10).items() == [20]
    assert Stream.range(spark, 0, 0).fold(F.lit(3), lambda a, x: a + x).items() == [3]
    assert Stream.range(spark, 0, 0).fold_sum(init=3).items() == [3]
    assert [r.asDict() for r in s.fold_fields(low=("min", lambda v: v, 99), n=("+", lambda v: F.lit(1), 0)).items()] == [{"low": 0, "n": 5}]
    assert s.collect_and_apply(F.size).items() == [5]


def test_select_all_orders_by_argument(spark):
    a, b = Stream.range(spark, 0, 3), Stream.range(spark, 10, 13)
    assert Stream.select_all(a, Stream.select_all(b, a)).items() == [0, 1, 2, 10, 11, 12, 0, 1, 2]
    with pytest.raises(ValueError, match="item types"):
        Stream.select_all(a, a.map(lambda v: v.cast("string")))


def test_ranges(spark):
    assert Stream.range(spark, 5, 5, inclusive=True).items() == [5]
    assert Stream.range(spark, 0, 0).items() == []
    assert Stream.range(spark, (1 << 31) - 1, 1 << 31, inclusive=True).items() == [(1 << 31) - 1, 1 << 31]
    with pytest.raises(ValueError, match="negative"):
        Stream.range(spark, 3, 1)


def test_filter_map_keeps_present_nulls(spark):
    s = Stream.range(spark, 0, 4)
    assert s.filter_map(lambda v: F.when(v % 2 == 0, v * 10)).items() == [0, 20]
    both = s.filter_map(lambda v: F.when(v < 3, F.struct(F.when(v > 0, v).alias("v"))), optional=True)
    assert both.items() == [None, 1, 2]


def test_from_table_by_text_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "k string, v int")
    assert [r["v"] for r in Stream.from_table(df, "k").items()] == [2, 1, 3]


def test_from_table_sorts_by_ranges(spark):
    rows = [(f"{(i * 7919) % 1000:04d}", i) for i in range(1000)]
    s = Stream.from_table(spark.createDataFrame(rows, "k string, v int").repartition(7), ["k"])
    assert [r["v"] for r in s.items()] == [v for _, v in sorted(rows)]
    assert [r["v"] for r in s.filter(lambda r: r["v"] % 100 == 0).combinations(2).items()[0]] == [v for _, v in sorted(rows) if v % 100 == 0][:2]
    plan = s.frame._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_single_tuples_are_not_numbered(spark):
    s = Stream.from_table(spark.createDataFrame([("b",), ("a",), (None,)], "k string"), "k")
    assert s.combinations(1).items() == [[None], ["a"], ["b"]]
    assert "SinglePartition" not in s.permutations(1).frame._jdf.queryExecution().executedPlan().toString()


def test_tuples_of_wide_items_are_not_broadcast(spark, monkeypatch):
    from rivulet.operators import combinatorics

    s = Stream.range(spark, 0, 20).map(lambda v: F.repeat(v.cast("string"), 50))
    small = s.combinations(2)
    assert "BroadcastNestedLoopJoin" in small.frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(combinatorics, "BROADCAST_BYTES", 100)
    assert s.combinations(2).items() == small.items()
    assert not combinatorics.broadcastable(s.frame, 20)


def test_kept_items_are_released(spark):
    from rivulet import stream

    stream.release()
    s = Stream.range(spark, 0, 6).filter(lambda v: v % 2 == 0)
    pairs = s.combinations(2)
    assert pairs.df.count() == 3 and stream.KEPT
    kept = stream.KEPT[0]
    stream.release()
    assert not kept.is_cached and not stream.KEPT and pairs.df.count() == 3


def test_tops_by_comparator_over_many_chunks(spark, monkeypatch):
    from rivulet.operators import topn

    monkeypatch.setattr(topn, "CHUNK", 16)
    s = Stream.range(spark, 0, 1000)
    assert topn.by_order(s, 3, lambda a, b: F.signum((a % 10 - b % 10).cast("double")).cast("int")).items() == [9, 19, 29]
    assert topn.by_order(s.combinations(2), 2, lambda a, b: F.signum(((a[1] - a[0]) - (b[1] - b[0])).cast("double")).cast("int")).items() == [[0, 999], [0, 998]]
    assert s.keep_first_n(3, key=[(lambda v: v % 7, False), (lambda v: v, True)]).items() == [6, 13, 20]
    rows = s.map(lambda v: F.struct((v % 5).alias("a"), v.cast("string").alias("b"), F.array(v).alias("c")))
    assert [(r["a"], r["b"], r["c"]) for r in rows.keep_first_n(2, compare=lambda x, y: x["a"] - y["a"] or y["c"][0] - x["c"][0]).items()] == [(4, "4", [4]), (4, "9", [9])]
