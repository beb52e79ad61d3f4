"""Flow operators on small inputs: what they give, their edge cases, and what they refuse."""

import asyncio
import base64
import datetime
import gzip
import hashlib
import itertools
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillspark import Flow, Writer, extend, flow, fn, is_flow, is_pipeline, pipeline
from rillspark.functions import text, values
from rillspark.operators import outcomes
from rillspark.plans.index import Down, ranged
from rillspark.sources import END, read_bytes, read_lines
from rillspark.streaming import Events, PushedStream, fan_out, limited, run_available, stream_of, throttle_stream, write_available


def vals(f, column="value"):
    return [r[column] for r in f.values()]


@pytest.fixture
def ints(spark):
    return lambda *xs: flow(spark, list(xs), "value long")


# sources


def test_sources(spark, ints):
    f = ints(1, 2, 3)
    assert flow(spark, f) is f and vals(f) == [1, 2, 3]
    assert vals(flow(spark, (x for x in range(4)), "value long")) == [0, 1, 2, 3]
    assert vals(flow(spark, {5}, "value long")) == [5]

    async def items():
        for i in range(3):
            yield i

    async def one():
        return 7

    assert vals(flow(spark, items(), "value long")) == [0, 1, 2]
    assert vals(flow(spark, one(), "value long")) == [7]
    assert [(r.a, r.b) for r in flow(spark, [{"a": 1}, {"a": 2, "b": 3}]).values()] == [(1, None), (2, 3)]
    assert flow(spark, []).values() == []
    for bad in (3, "text", None):
        with pytest.raises(TypeError):
            flow(spark, bad)


def test_writer(spark):
    w = Writer(spark, "value long").write(1).write(2, 3)
    assert vals(w.flow()) == [1, 2, 3] and vals(w.end()) == [1, 2, 3] and is_flow(w.flow()) and is_pipeline(pipeline().take(1))
    with pytest.raises(ValueError, match="after end"):
        w.write(4)
    with pytest.raises(TypeError):
        w.flow().merge([1])


def test_generators_switch_and_recurse(spark):
    def fib(a, b):
        return lambda write, next: (write(a), next(fib(b, a + b)))

    assert vals(flow(spark, fib(0, 1), limit=6)) == [0, 1, 1, 2, 3, 5]

    def first(write, next):
        write(1)
        next([2, 3])

    assert vals(flow(spark, first)) == [1, 2, 3]

    def ends(write, next):
        write(1)
        write(END)
        next()

    assert vals(flow(spark, ends)) == [1]


def test_generator_error_fails_the_read(spark):
    def bad(write, next):
        write(1)
        write(ValueError("broken"))

    assert "broken" in str(flow(spark, bad).to_promise().exception())


# projections


def test_map_and_wrap(ints):
    assert vals(ints(1, 2).map(lambda r: r.value * 2)) == [2, 4]
    assert vals(ints(1, 2).map("value + 1")) == [2, 3]
    assert [(r.input.value, r.output) for r in ints(345).map(lambda r: r.value * 2, wrap=True).values()] == [(345, 690)]
    assert [(r.a, r.b) for r in ints(1).map({"a": "value", "b": 5}).values()] == [(1, 5)]


def test_paths(spark):
    rows = [((((1, 2, 3),),),), ((None,),), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a struct<b struct<c array<int>>>")
    f = Flow(df, "i")
    assert vals(f.pluck("a.b.c[1]")) == [2, None, None]
    assert vals(f.pluck('."a".b.c[7]', -1)) == [-1, -1, -1]
    assert vals(f.pluck("a.x.y", "none")) == ["none"] * 3
    with pytest.raises(TypeError, match="pluck needs a path"):
        f.pluck(3)
    assert values.split_field_path("a.b[0]['c']") == ["a", "b", "0", "c"]
    assert values.get({"a": {"b": [1, 2]}}, "a.b[1]") == 2 and values.get({"a": 1}, "b", 9) == 9
    assert values.make_getter("a.b", 0)({"a": {}}) == 0 and values.get({"a": None}, "a", 9) is None


def test_pick_and_omit(spark):
    f = Flow(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), "a")
    assert f.pick(["a", "c", "zzz"]).df.columns == ["a", "c"] and f.omit("b").df.columns == ["a", "c"]
    assert f.omit(["b", "c"]).df.columns == ["a"]


# predicates


def test_filter_reject_null(spark):
    f = Flow(spark.createDataFrame([(1, True), (2, False), (3, None)], "value int, p boolean"), "value")
    assert vals(f.filter("p")) == [1] and vals(f.reject("p")) == [2, 3]
    assert vals(f.filter(lambda r: r.value - 1)) == [2, 3]
    assert vals(f.reject(lambda r: r.value - 1)) == [1]


def test_where_find_compact(spark):
    f = Flow(spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "b", "b"), (4, None, "b")], "value int, a string, b string"), "value")
    assert vals(f.where({"a": "a", "b": "b"})) == [1] and vals(f.where({"a": None})) == [4]
    assert vals(f.find_where({"b": "b"})) == [1] and vals(f.find("value > 1")) == [2]
    nums = Flow(spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 0.0, None, float("nan")])], "i int, value double"), "i")
    assert vals(nums.compact()) == [1.0, 2.0]
    texts = Flow(spark.createDataFrame([(i, v) for i, v in enumerate(["x", "", None])], "i int, value string"), "i")
    assert vals(texts.compact()) == ["x"]


@pytest.mark.parametrize(("xs", "at", "want"), [((1, 2, 3, 4, 5, 6), 5, [1, 2, 3, 4, 5]), ((1, 2, 3), 10, [1, 2, 3]), ((10,), 10, [10]), ((), 1, [])])
def test_stop_when(ints, xs, at, want):
    assert vals(ints(*xs).stop_when(lambda r: r.value == at)) == want


# shapes


def test_flatten(spark):
    df = spark.createDataFrame([(0, [[1], [2, 3]]), (1, None), (2, []), (3, [[4]])], "i int, value array<array<int>>")
    once = Flow(df, "i").flatten()
    assert vals(once) == [[1], [2, 3], None, [4]] and vals(once.flatten()) == [1, 2, 3, None, 4]
    assert vals(Flow(df, "i").flat_map(lambda r: F.array(r.i, r.i + 10))) == [0, 10, 1, 11, 2, 12, 3, 13]


def test_collect_keeps_nulls(ints):
    assert ints(1, None, 3).collect("value").value().value == [1, None, 3]
    assert ints().collect("value").value().value == []


def test_batch(ints):
    f = ints(1, 2, 3, 4, 5)
    assert vals(f.batch(3, "value"), "values") == [[1, 2, 3], [4, 5]]
    assert vals(f.batch("2.5", "value"), "values") == [[1, 2, 3], [4, 5]] and vals(f.batch(0, "value"), "values") == [[1], [2], [3], [4], [5]]
    with pytest.raises(ValueError, match="number"):
        f.batch("many")


# folds and groups


def test_reduce(ints):
    add = lambda a, x: a + x
    assert ints(1, 2, 3).reduce(add, F.lit(0).cast("long"), "value").value().value == 6
    assert ints().reduce(add, F.lit(5).cast("long"), "value").value().value == 5
    assert ints(1, 2, 3).reduce1(lambda a, x: a * 10 + x, "value").value().value == 123
    assert ints().reduce1(add, "value").value().value is None

    async def step(memo, row):
        await asyncio.sleep(0)
        return memo * 10 + row["value"]

    assert ints(3, 1, 2).async_reduce(step, 0, "total long").value().total == 312


def test_groups(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, None), (4, None, 3)], "i int, a int, b int")
    f = Flow(df, "i")
    assert {r.key: r["values"] for r in f.group_by("a", "b").values()} == {1: [1, 2], 2: [None], None: [3]}
    assert {r.key: r.value.b for r in f.filter("i > 1").key_by("a").values()} == {1: 2, 2: None, None: 3}
    with pytest.raises(Exception, match="Multiple values per key: 1"):
        f.key_by("a").values()
    assert [(r.key, r.n) for r in f.repeated_keys("a").values()] == [(1, 2)]
    assert f.key_by("a", strict=False).df.count() == 2


def test_runs(spark):
    rows = [(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "x")]
    f = Flow(spark.createDataFrame(rows, "i int, k string"), "i")
    assert [(r.key, [v.i for v in r["values"]]) for r in f.sorted_group_by("k").values()] == [("x", [1, 2]), ("y", [3]), (None, [4, 5]), ("x", [6])]
    assert f.filter("i > 9").sorted_group_by("k").values() == []


def test_uniq(spark, ints):
    assert sorted(vals(ints(1, 2, 2, 2, 5).uniq())) == [1, 2, 5]
    f = Flow(spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 1, 1), (4, None, 1), (5, None, 1)], "i int, a int, b int"), "i")
    assert vals(f.uniq_by(["a", "b"]), "i") == [1, 2, 4] and vals(f.uniq_by(lambda r: r.i % 2), "i") == [1, 2]
    pairs = Flow(spark.createDataFrame([(1, "a_b", "c"), (2, "a", "b_c")], "i int, a string, b string"), "i")
    assert len(pairs.uniq_by(["a", "b"]).values()) == 2


# order and limits


def test_sorts(ints):
    assert vals(ints(9, 10, 1).sort()) == [1, 9, 10] and vals(ints(9, 10, 1).sort(as_text=True)) == [1, 10, 9]
    assert vals(ints(3, 8, 1).sort_by(("value", "desc"))) == [8, 3, 1] and vals(ints(3, 8, 1).sort_by("value").take(2)) == [1, 3]


def test_slices(ints):
    f = ints(1, 2, 3, 4, 5)
    assert vals(f.slice(1, 3)) == [2, 3] and f.slice(0) is f and vals(f.drop(3)) == [4, 5] and vals(f.take(2)) == [1, 2]
    assert vals(f.head()) == [1] and vals(f.last()) == [5] and ints().last().values() == []
    for bad in ((3, 2), (0, 0)):
        with pytest.raises(ValueError):
            f.slice(*bad)
    with pytest.raises(TypeError):
        f.slice("test")
    with pytest.raises(ValueError, match="order"):
        Flow(f.df).take(1)


def test_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.col("id").cast("string").alias("s")).repartition(5)
    assert Flow(df, "k").with_index("n").df.where("n <> k").count() == 0
    assert [r.n for r in Flow(df, "s").with_index("n").df.orderBy("s").collect()] == list(range(1000))


# several flows


PARENTS = [(1, "parent1"), (2, "parent2"), (3, "parent3"), (10, "parent10"), (None, "nobody")]
CHILDREN = [("child1", 1), ("child2", 1), ("child3", 3), ("child4", 4), ("lost", None)]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ("inner", {("parent1", "child1"), ("parent1", "child2"), ("parent3", "child3"), ("nobody", "lost")}),
        ("left", {("parent1", "child1"), ("parent1", "child2"), ("parent2", None), ("parent3", "child3"), ("parent10", None), ("nobody", "lost")}),
        ("right", {("parent1", "child1"), ("parent1", "child2"), ("parent3", "child3"), (None, "child4"), ("nobody", "lost")}),
    ],
)
def test_joins(spark, how, want):
    a, b = Flow(spark.createDataFrame(PARENTS, "id int, name string")), Flow(spark.createDataFrame(CHILDREN, "name string, parent int"))
    found = a.sorted_join(b, "id", "parent", how).values()
    assert {(r.a and r.a.name, r.b and r.b.name) for r in found} == want and len(found) == len(want)
    with pytest.raises(ValueError, match="join type"):
        a.sorted_join(b, "id", "parent", "outer")


def test_unmatched_rows_survive(ints):
    assert sorted(r.key for r in ints(1, 2).sorted_join(ints(2), "value", how="left").values()) == [1, 2]
    assert sorted(r.key for r in ints(1, 10).sorted_join(ints(1, 5, 12), "value", how="left").values()) == [1, 10]


def test_merge_fork_through(ints):
    a, b = ints(1, 2), ints(3, 4)
    assert sorted(vals(a.merge(b))) == [1, 2, 3, 4] and vals(b.merge(a, ordered=True)) == [3, 4, 1, 2]
    assert vals(a.fork().map("value * 2").merge(a.fork().map("value * 3"), ordered=True)) == [2, 4, 3, 6]
    assert a.through(None) is a and vals(a.through(lambda f: f.drop(1))) == [2]
    with pytest.raises(TypeError):
        a.through(5)
    assert vals(a.through(lambda f: f.df.where("value > 1"))) == [2]


def test_pipelines_are_reusable(ints):
    double = pipeline().map(lambda r: r.value * 2)
    both = double.filter("value > 2").through(pipeline().map("value + 1"))
    assert vals(ints(1, 2).through(both)) == [5] and vals(ints(3).through(both)) == [7] and vals(ints(1).through(double)) == [2]
    extend("plus", lambda self, n: self.map(lambda r: r.value + n))
    assert vals(ints(1).plus(4)) == [5] and vals(ints(1).through(pipeline().plus(2))) == [3]
    assert vals(fn.take(1)(ints(4, 5))) == [4] and vals(ints(1, 2).stopWhen("value = 1")) == [1]


# text


def test_split_and_chunks(spark):
    f = flow(spark, [b"line1\nli", b"ne2\r\n", "énd".encode()[:1], "énd".encode()[1:]], "value binary")
    assert vals(f.join_chunks().through(lambda g: Flow(g.df.withColumn("i", F.lit(0)), "i")).split()) == ["line1", "line2", "énd"]
    one = lambda s: flow(spark, [s], "value string")
    assert vals(one("||a||b").split_by("||")) == ["", "a", "b"] and vals(one("").split()) == [""] and vals(one("a\n").split()) == ["a", ""]
    assert values.escape_reg_exp("a.b*") == r"a\.b\*"


def test_base64(spark):
    f = flow(spark, ["ciao, come va?", "x" * 200], "value string").encode()
    assert vals(f)[0] == "Y2lhbywgY29tZSB2YT8=" and "\n" not in vals(f)[1]
    assert [bytes(v).decode() for v in vals(f.decode())] == ["ciao, come va?", "x" * 200]
    assert bytes(vals(flow(spark, ["Y2lhbyw"], "value string").decode())[0]) == b"ciao,"
    assert vals(flow(spark, ["Y"], "value string").decode()) == [None]
    with pytest.raises(ValueError):
        f.encode("hex")


def test_csv(spark):
    text = 'a,b,c\n1,2,3\r\n\n"ciao ""amico""","multiline\nrow",3'
    f = flow(spark, [text[:9], text[9:20], text[20:]], "value string")
    rows = [tuple(r)[1:] for r in f.csv(header=True).values()]
    assert rows == [("1", "2", "3"), ('ciao "amico"', "multiline\nrow", "3")]
    assert f.csv(header=["x", "y", "z"]).df.columns == ["_pos", "x", "y", "z"] and len(f.csv(header=["x", "y", "z"]).values()) == 3
    assert f.csv(header=lambda names: [n.upper() for n in names]).df.columns == ["_pos", "A", "B", "C"]
    assert len(f.csv(width=3).values()) == 3
    assert [tuple(r)[1:] for r in flow(spark, ["a;;c"], "value string").csv(width=3, separator=";").values()] == [("a", "", "c")]


def test_csv_stringify(spark):
    df = spark.createDataFrame([(1, 'say "hi"', "", None), (2, "a,b", "x\ny", True)], "i int, a string, b string, c boolean")
    f = Flow(df, "i")
    assert vals(f.csv_stringify()) == ['"say ""hi""",,null\n', '"a,b","x\ny",true\n']
    assert vals(f.csv_stringify(["a"], header=True)) == ["a\n", '"say ""hi"""\n', '"a,b"\n']
    assert vals(f.csv_stringify(["b", "zz"], quoted=True, quoted_empty=True))[0] == '"",null\n'
    assert f.filter("i > 5").csv_stringify(header=True).values() == []


# errors, time and concurrency


def test_errors(spark, ints):
    def step(row):
        if row["value"] == 2:
            raise ValueError("no twos")
        return row["value"] * 10

    f = ints(1, 2, 3).map(step, schema="out int")
    assert vals(f.errors(), "out") == [10, 30]
    assert vals(f.errors({"out": 5}), "out") == [10, 5, 30]
    assert [(r.message, r.type) for r in f.failed().values()] == [("no twos", "ValueError")]
    with pytest.raises(Exception, match="no twos"):
        f.values()
    assert f.to_promise().exception() is not None
    assert vals(f.stop_on_error(), "out") == [10] and vals(f.stop_on_error({"out": 22}), "out") == [10, 22]
    assert vals(ints(1).map(lambda r: ValueError("made"), schema="out int").failed(), "message") == ["made"]
    tried = ints(1, 2).map({"t": F.concat(F.lit("x"), F.col("value"))}).attempt("n", F.expr("try_cast(t AS int)"), "t", "bad")
    assert tried.errors().values() == [] and len(tried.failed().values()) == 2
    assert outcomes.bad(ints(1).df).count() == 0 and ints(1).stop_on_error().values() == ints(1).values()


def test_resolve(ints):
    async def slow(row):
        await asyncio.sleep(0.02 / row["value"])
        if row["value"] == 3:
            raise KeyError("three")
        return row["value"] * 4

    f = ints(2, 3, 4).resolve(slow, "out int", par=3)
    assert vals(f.errors(), "out") == [8, 16] and len(f.failed().values()) == 1
    assert vals(f.mass_then(lambda r: r["out"] + 1, "more int").mass_catch({"out": 0, "more": 0}), "more") == [9, 0, 17]
    with pytest.raises(ValueError):
        ints(1).resolve(slow, "out int", par=0)

    async def odd(row):
        return row["value"] % 2

    assert vals(ints(1, 2, 3).async_filter(odd, par=2)) == [1, 3]


def test_throttle_and_rate(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(milliseconds=8 * i)) for i in range(10)]
    f = Flow(spark.createDataFrame(rows, "i int, t timestamp"), "i")
    assert vals(f.throttle(50, "t"), "i") == [0, 7]
    assert vals(f.ratelimit(4, 10), "release_ms") == [0, 0, 0, 0, 10, 10, 10, 10, 20, 20]
    with pytest.raises(ValueError):
        f.ratelimit(0, 10)


def test_consume(ints):
    def pairs(rows):
        for r in rows:
            yield {"value": r["value"]}
            yield {"value": -r["value"]}

    assert sorted(vals(ints(1, 2).consume(pairs, "value long"))) == [-2, -1, 1, 2]


# terminals


def test_terminals(spark, ints, tmp_path):
    f = ints(1, 2, 3)
    assert f.take(1).value().value == 1 and ints().value() is None
    with pytest.raises(ValueError, match="more than one"):
        f.value()
    it = f.pull()
    assert next(it).value == 1 and [r.value for r in it] == [2, 3]
    assert f.to_array(len) == 3 and [r.value for r in f.to_promise().result()] == [1, 2, 3]

    async def gather():
        return [r.value async for r in f.to_async_iterator()]

    assert asyncio.run(gather()) == [1, 2, 3]
    f.map("cast(value AS string)").pick(["value"]).through(lambda g: Flow(g.df.select("value"))).pipe(f"{tmp_path}/out", "text", compression="gzip")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["1", "2", "3"]
    f.each(lambda row: None)
    assert vals(f.tap("seen").make_async(5).pause().resume().start()) == [1, 2, 3]
    f.fork(keep=True).destroy()


def test_plan_shapes(spark):
    """Filters reach the scan, columns are pruned, and nothing is ranked by one task."""
    f = flow(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet"), order=["event_id"])
    plan = f.filter("value > 50").pick(["value"]).df._jdf.queryExecution().toString()
    assert "GreaterThan(value,50.0)" in plan and "props" not in plan.split("== Physical Plan ==")[1]
    for g in (f.with_index(), f.batch(10, "value"), f.stop_when("value > 99")):
        physical = g.df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "SinglePartition" not in physical.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "", 1)


def test_small_tests_of_values():
    assert values.is_function(len) and values.is_string("") and values.is_error(ValueError()) and values.is_iterable([]) and not values.is_promise(1)
    assert values.curry(lambda a, b, c: a + b + c)(1)(2, 3) == 6 and values.ncurry(2, lambda *x: sum(x))(1)(2) == 3 and values.partial(max, 5)(3) == 5
    assert values.is_defined(0) and not values.is_defined(None) and values.has({"a": None}, "a") and not values.has({}, "a") and not values.has(None, "a")


def chunk_flow(spark, chunks):
    return flow(spark, spark.createDataFrame([(i, bytes(c)) for i, c in enumerate(chunks)], "i long, value binary"), order=["i"])


CSV = 'a,b,"c,1"\r\n1,"two ""words""",é漢😀\n\n"multi\nline, ""quoted""\r\n",,"x"\n"",4,5'
CSV_ROWS = [("1", 'two "words"', "é漢😀"), ('multi\nline, "quoted"\r\n', "", "x"), ("", "4", "5")]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_csv_chunks_cut_anywhere(spark, size):
    """Chunks may end within quotes, line ends, doubled quotes and characters."""
    data = CSV.encode()
    rows = chunk_flow(spark, [data[i : i + size] for i in range(0, len(data), size)]).csv(header=True)
    assert rows.df.columns == ["_pos", "a", "b", "c,1"]
    assert [tuple(r)[1:] for r in rows.values()] == CSV_ROWS


def test_csv_long_records(spark):
    long = "x" * 1_000_000
    quoted = '"' + "y,\n" * 300_000 + '"'
    rows = chunk_flow(spark, [f"{long},1\n{quoted},2".encode()]).csv(width=2).values()
    assert [(len(r.c0), r.c1) for r in rows] == [(1_000_000, "1"), (900_000, "2")]
    escaped = chunk_flow(spark, [f"{long},1\n{quoted},2".encode()]).csv(width=2, escape="\\").values()
    assert [(len(r.c0), r.c1) for r in escaped] == [(1_000_000, "1"), (900_000, "2")]


def test_csv_dialects(spark):
    rows = chunk_flow(spark, [b'"a\\"b\n1",2\n', b'3,"4 \\\\"\n'])
    assert [tuple(r)[1:] for r in rows.csv(width=2, escape="\\").values()] == [('a"b\n1', "2"), ("3", "4 \\")]
    fast = chunk_flow(spark, [b"a,b,c\n1,2,3\n4,5", b',6\nu,"v,z'])
    assert [tuple(r)[1:] for r in fast.csv(header=True, fast_mode=True).values()] == [("1", "2", "3"), ("4", "5", "6"), ("u", '"v', "z")]
    wide = "a;b\né;2\n".encode("utf-16-le")
    assert [tuple(r)[1:] for r in chunk_flow(spark, [wide[:3], wide[3:]]).csv(header=lambda names: [n.upper() for n in names], separator=";", encoding="utf16le").values()] == [("é", "2")]
    short = chunk_flow(spark, [b"1\n2,,3,4\n"]).csv(header=["a", "b", "c"]).values()
    assert [tuple(r)[1:] for r in short] == [("1", None, None), ("2", "", "3")]
    assert chunk_flow(spark, [b""]).csv(header=True).values() == [] and chunk_flow(spark, []).csv(width=1).values() == []
    assert [tuple(r)[1:] for r in chunk_flow(spark, ["é\n".encode("latin-1")]).csv(width=1, encoding="latin1").values()] == [("é",)]


def test_csv_writing_headers_and_encodings(spark):
    f = flow(spark, [("1", "2", "3"), ("4", "5", "6")], "a string, b string, c string")
    lines = lambda x: [r.value for r in x.values()]
    assert lines(f.csv_stringify(header=["h1", None, "h3"])) == ["h1,h3\n", "1,3\n", "4,6\n"]
    assert lines(f.csv_stringify(header=["c", "a"])) == ["c,a\n", "3,1\n", "6,4\n"]
    assert bytes(lines(f.csv_stringify(header=True, encoding="utf16le"))[0]) == "a,b,c\n".encode("utf-16-le")
    back = flow(spark, [('q"\\x', "\\")], "a string, b string").csv_stringify(escape="\\")
    assert [tuple(r)[1:] for r in back._with(back.df.withColumn("value", F.encode("value", "UTF-8"))).csv(width=2, escape="\\").values()] == [('q"\\x', "\\")]


def test_python_sees_whole_numbers_and_nulls(spark):
    n = 9007199254740993
    f = flow(spark, [n, None, n + 1], "n bigint")
    assert [r.m for r in f.map(lambda r: r["n"], schema="m bigint").values()] == [n, None, n + 1]
    assert [r.n for r in f.consume(lambda rows: iter([r for r in rows]), "n bigint").values()] == [n, None, n + 1]
    assert [(r.n, r.m) for r in f.resolve(lambda r: r["n"] is None, "m boolean").values()] == [(n, False), (None, True), (n + 1, False)]
    assert [r.n for r in f.async_filter(lambda r: r["n"] is not None).values()] == [n, n + 1]
    assert [r.total for r in f.async_reduce(lambda a, r: a + (r["n"] or 0), 0, "total bigint").values()] == [2 * n + 1]

    async def later(row):
        return row["n"] + 1

    done = f.mass_then(later, "m bigint")
    assert [r.type for r in done.failed().values()] == ["TypeError"] and [r.m for r in done.errors().values()] == [n + 1, n + 2]
    unfit = f.map(lambda r: "word" if r["n"] == n else 1, schema="m bigint")
    assert len(unfit.failed().values()) == 1 and len(unfit.errors().values()) == 2


def test_sort_by_any_type(spark):
    rows = [("b", 2, None), ("a", 1, datetime.datetime(2020, 1, 2)), ("b", 1, datetime.datetime(2020, 1, 1)), (None, 3, None)]
    f = flow(spark, rows, "s string, n int, t timestamp_ntz")
    order = lambda x: [r._pos for r in x.values()]
    assert order(f.sort_by(("s", "desc"))) == [0, 2, 1, 3] and order(f.sort_by("s")) == [3, 1, 0, 2]
    assert order(f.sort_by("n").sort_by(("s", "desc"))) == [2, 0, 1, 3] and order(f.sort_by(("t", "desc"), ("n", "desc"))) == [1, 2, 3, 0]
    assert order(f.sort_by(lambda r: -r.n)) == [3, 0, 1, 2]
    assert order(f.sort_by(lambda a, b: F.coalesce(a["n"] - b["n"], F.lit(0)) * 10 + (a["_pos"] - b["_pos"]).cast("int"))) == [1, 2, 0, 3]
    down = f.sort_by(("s", "desc"))
    assert [r._pos for r in down.with_index("at").sort("at").values()] == [0, 2, 1, 3]
    assert [r._pos for r in down.take(2).values()] == [0, 2] and [r._pos for r in down.drop(1).values()] == [2, 1, 3] and down.last().value()._pos == 3
    assert [[v._pos for v in r["values"]] for r in down.batch(3).values()] == [[0, 2, 1], [3]]
    assert [(r.key, len(r["values"])) for r in down.sorted_group_by("s").values()] == [("b", 2), ("a", 1), (None, 1)]
    assert down.collect("n").value().value == [2, 1, 1, 3] and [r._pos for r in down.uniq_by("n").sort("_pos").values()] == [0, 2, 3]
    assert [r._pos for r in down.stop_when(lambda r: r.n == 1).values()] == [0, 2]
    with pytest.raises(ValueError, match="asc or desc"):
        f.sort_by(("s", "down"))


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "timestamp", "date", "double", "binary", "decimal(9,3)"])
def test_index_by_any_type(spark, kind):
    df = spark.range(3000).withColumn("x", F.expr("(id * 7919) % 1000")).select("id", F.when(F.col("x") % 100 != 0, F.expr({
        "string": "concat('k', x)", "timestamp_ntz": "timestamp_ntz'2020-10-24 20:00:00' + make_dt_interval(0, 0, x)", "timestamp": "timestamp'2020-10-24 20:00:00' + make_dt_interval(0, 0, x)",
        "date": "date_add(date'2020-01-01', cast(x as int))", "double": "x / 7.0D", "binary": "encode(concat('k', x), 'utf-8')", "decimal(9,3)": "cast(x / 7 as decimal(9,3))",
    }[kind]).cast(kind)).alias("k"))
    got = {r.id: r.at for r in flow(spark, df, order=["k", "id"]).with_index("at").df.collect()}
    want = {r.id: i for i, r in enumerate(df.orderBy(F.col("k").asc_nulls_first(), "id").collect())}
    assert got == want
    plan = flow(spark, df, order=["k", "id"]).with_index("at").df._jdf.queryExecution().toString()
    assert "WindowSpecDefinition" not in plan or "__part" in plan
    down = {r.id: r.at for r in flow(spark, df, order=["id"]).sort_by((F.col("k"), "desc")).with_index("at").df.collect()}
    assert down == {r.id: i for i, r in enumerate(df.orderBy(F.col("k").desc_nulls_last(), "id").collect())}


def test_a_first_key_that_all_rows_share_is_split(spark):
    df = spark.range(10_000).withColumn("k", F.lit("same"))
    rows = ranged(df, ["k", "id"]).groupBy("__part").count().collect()
    assert len(rows) == 64 and max(r["count"] for r in rows) < 1000


def test_joins_go_up_or_down(spark):
    a, b = flow(spark, [1, 3, 2], "k int"), flow(spark, [2, 1], "k int")
    assert [r.key for r in a.sorted_join(b, "k", how="left", dir="desc").values()] == [3, 2, 1] and [r.key for r in a.sorted_join(b, "k").values()] == [1, 2]
    with pytest.raises(ValueError, match="asc or desc"):
        a.sorted_join(b, "k", dir="up")
    with pytest.raises(ValueError, match="par"):
        a.merge(b, par=0)


def test_files(spark, tmp_path):
    text = "".join(f"line {i} é\n" for i in range(5000))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(text.encode()) + gzip.compress(b"more"))
    lines = flow(spark, read_lines(spark, str(tmp_path)), order=["path", "_at"]).values()
    assert [r.value for r in lines if r.path.endswith("a.txt")] == text.split("\n") and [r.value for r in lines if r.path.endswith("gz")] == (text + "more").split("\n")
    raw = flow(spark, read_bytes(spark, f"{tmp_path}/b.txt.gz", unpack=True, chunk=777), order=["path", "_at"])
    assert raw.join_chunks().value().value == text + "more" and raw.df.count() > 50
    plain = flow(spark, read_bytes(spark, f"{tmp_path}/a.txt", chunk=1000), order=["path", "_at"])
    assert b"".join(bytes(r.value) for r in plain.values()) == text.encode()


def test_stream_events_sinks_and_state(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, f"2020-01-0{i + 1} 00:00:0{j}") for j in range(5)], "n long, t string").selectExpr("n", "to_timestamp_ntz(t) AS t", "n % 2 AS g").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "n long, t timestamp_ntz, g long"
    events, said = Events(), []
    for name in Events.NAMES:
        events.on(name, lambda query, what, name=name: said.append(name))
    spark.streams.addListener(events)
    try:
        write_available(stream_of(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/c1")
        assert spark.read.parquet(f"{tmp_path}/out").count() == 15
        seen = {"a": [], "b": []}
        fan_out(stream_of(spark, f"{tmp_path}/in", schema), [lambda b, i, k=k: seen[k].extend(r.n for r in b.collect()) for k in seen], f"{tmp_path}/c2")
        assert sorted(seen["a"]) == sorted(seen["b"]) == sorted(i * 10 + j for i in range(3) for j in range(5))
        rows = throttle_stream(stream_of(spark, f"{tmp_path}/in", schema, files=1, time="t"), ["g"], "t", 3.0)
        kept = run_available(rows, f"{tmp_path}/throttle")
        assert {r.n for r in kept.collect()} == {0, 1, 4, 10, 11, 14, 20, 21, 24}
        total = run_available(stream_of(spark, f"{tmp_path}/in", schema, files=1).groupBy("g").count(), f"{tmp_path}/total", "complete")
        assert {(r.g, r["count"]) for r in total.collect()} == {(0, 9), (1, 6)}
        got = []
        query = limited(spark, f"{tmp_path}/in", schema, 1, "100 milliseconds", lambda b, i: got.append(b.count()), f"{tmp_path}/c3")
        query.processAllAvailable()
        query.stop()
        assert got == [5, 5, 5]
        bad = stream_of(spark, f"{tmp_path}/in", schema).selectExpr("raise_error('no') AS x")
        with pytest.raises(Exception, match="no"):
            write_available(bad, f"{tmp_path}/bad", f"{tmp_path}/c4")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        time.sleep(1)
    finally:
        spark.streams.removeListener(events)
    assert said.count("start") == said.count("end") == 6 and said.count("error") == 1 and said.count("data") >= 6


def test_base64_across_chunks(spark):
    whole = "ciao, come va? é漢😀".encode()
    for size in (1, 2, 4, 5, 100):
        chunks = [whole[i : i + size] for i in range(0, len(whole), size)]
        coded = "".join(r.value for r in chunk_flow(spark, chunks).encode(across=True).values())
        assert coded == base64.b64encode(whole).decode()
        back = flow(spark, [coded[i : i + size] for i in range(0, len(coded), size)], "value string").decode(across=True)
        assert b"".join(bytes(r.value) for r in back.values()) == whole
    assert b"".join(bytes(r.value) for r in flow(spark, ["Y2l", "hbyw"], "value string").decode(across=True).values()) == b"ciao,"
    assert [r.value for r in flow(spark, ["Y2*h"], "value string").decode(across=True).values()] == [None]
    with pytest.raises(ValueError, match="md5"):
        flow(spark, ["a"], "value string").encode("md5")


def test_chunks_of_many_ranges_against_the_whole(spark):
    rng = random.Random(7)
    for longest in (2, 9):
        chunks = [rng.randbytes(rng.randint(0, longest)) for _ in range(700)]
        rows = [(i, None if i == 5 else c) for i, c in enumerate(chunks)]
        whole = b"".join(c for _, c in rows if c)
        f = Flow(spark.createDataFrame(rows, "i int, value binary").repartition(5), "i")
        coded = f.encode(across=True)
        text = base64.b64encode(whole)
        assert "".join(r.value for r in coded.values()).encode() == text
        cut = [text[a:b] for a, b in itertools.pairwise([0, *sorted(rng.randint(0, len(text)) for _ in range(900)), len(text)])]
        back = Flow(spark.createDataFrame(list(enumerate(cut)), "i int, value binary").repartition(3), "i").decode(across=True)
        again = coded.decode(across=True)
        assert b"".join(bytes(r.value) for r in back.values()) == b"".join(bytes(r.value) for r in again.values()) == whole
        for g, want in ((f, whole), (coded, text), (back, whole), (again, whole)):
            assert [r.value for r in g.digest().values()] == [hashlib.md5(want).hexdigest()]
    down = Flow(f.df, [Down("i")])
    assert down.digest(algorithm="sha256").df.first().value == hashlib.sha256(b"".join(c for _, c in reversed(rows) if c)).hexdigest()


def test_digest_streams_blocks(spark, monkeypatch):
    long = [("é" * 400_000) + str(i) for i in range(5)]
    f = Flow(spark.createDataFrame(list(enumerate(long)), "i int, value string").repartition(3), "i")
    assert f.digest().df.first().value == hashlib.md5("".join(long).encode()).hexdigest()
    assert Flow(f.df.where("false"), "i").digest().df.collect()[0].value == hashlib.md5(b"").hexdigest()
    # ranges in any order, a block a chunk
    monkeypatch.setattr(text, "BLOCK", 1)
    arrow = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "start", "size", "data"])
    chunks = pa.RecordBatch.from_pydict({"part": [0, 0, 0, 2, 63], "end": [2, 2, 3, 1, 4], "data": [b"ab", None, b"c", b"d", b"efgh"]})
    blocks = [tuple(c[0].as_py() for c in b.columns) for b in text._packed(iter([chunks]))]
    assert [b[:3] for b in blocks] == [(0, 0, 2), (0, 2, 1), (2, 0, 1), (63, 0, 4)]
    digest = lambda parts, rows=blocks: next(text._hashed(iter([arrow([(p, -1, 0, b""), *(b for b in rows if b[0] == p)]) for p in parts]), "x", "md5"))["x"][0].as_py()
    for parts in (range(64), range(63, -1, -1), [1, 0, *range(2, 64)], random.Random(3).sample(range(64), 64)):
        assert digest(parts) == hashlib.md5(b"abcdefgh").hexdigest()
    with pytest.raises(RuntimeError, match="range 3 of 64 is missing"):
        digest([p for p in range(64) if p != 3])
    with pytest.raises(RuntimeError, match="not where it belongs"):
        digest(range(64), blocks[1:])


def test_pushed_stream(spark, tmp_path):
    pushed = PushedStream(spark, "n long", str(tmp_path))
    assert run_available(pushed.frame(), f"{tmp_path}/a").count() == 0
    pushed.write(1, 2).write({"n": 3})
    assert sorted(r.n for r in run_available(pushed.frame(), f"{tmp_path}/a").collect()) == [1, 2, 3]
    pushed.end()
    with pytest.raises(ValueError, match="after end"):
        pushed.write(4)


def test_throttle_against_a_loop(spark):
    rng = random.Random(2)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None, "é"]), t0 + datetime.timedelta(milliseconds=rng.randint(0, 20_000))) for i in range(12_000)] + [(-1, "a", None)]
    f = Flow(spark.createDataFrame(rows, "i int, g string, t timestamp_ntz").repartition(5), "i")
    for by in (["g"], []):
        last, want = {}, {-1}
        for i, g, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
            k = g if by else 0
            if k not in last or t - last[k] >= datetime.timedelta(milliseconds=40):
                last[k] = t
                want.add(i)
        kept = f.throttle(40, "t", by=by or None)
        assert {r.i for r in kept.df.collect()} == want and kept.df.columns == ["i", "g", "t"]
