"""The registered queries of the flow operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.flow import Flow, Writer, extend, flow
from rillspark.functions.text import parse_csv
from rillspark.plans.pipeline import pipeline
from rillspark.plans.places import new_path
from rillspark.sources.build import END, read_bytes, read_lines, recursive_frame
from rillspark.streaming import PushedStream, run_available, stream_of, throttle_stream, uniq_stream, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EVENTS, LINE_KEY = ["event_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, order: list[str] | None = None) -> Flow:
    return flow(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order=order)


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


# projections and predicates


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS input_price, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS output_price FROM lineitem")
def map_wrap(spark, d):
    f = table(spark, d, "lineitem", LINE_KEY).map(lambda r: {"net": (money(r.l_extendedprice) * (1 - money(r.l_discount))).cast("double")}, wrap=True)
    return f.df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("input_price"), F.col("output").alias("output_price"))


@query("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
coalesce(json_extract_string(props, '$.none.at'), 'absent') AS missing FROM events""")
def pluck_path(spark, d):
    f = table(spark, d, "events", EVENTS)
    f = Flow(f.df.withColumn("doc", F.parse_json("props")), EVENTS)
    kept = Flow(f.df.select("event_id", "doc"), ["event_id", "doc"])  # the order's columns stay
    both = Flow(kept.pluck("doc.k", name="k").df, ["event_id", "doc", "k"]).pluck("doc.none.at", "absent", "missing")
    return both.df.select("event_id", F.coalesce(F.col("k").cast("bigint"), F.lit(-1)).alias("k"), "missing")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def pick(spark, d):
    return table(spark, d, "customer").pick(["c_custkey", "c_name", "c_acctbal", "no_such"]).df


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def omit(spark, d):
    return table(spark, d, "customer").omit(["c_acctbal", "c_mktsegment", "no_such"]).df


_NULLED = "(SELECT *, nullif(event_type, 'error') AS kind FROM events)"


def _nulled(spark, d) -> Flow:
    f = table(spark, d, "events", EVENTS)
    return Flow(f.df.withColumn("kind", F.expr("nullif(event_type, 'error')")), EVENTS)


@query(f"SELECT event_id, kind FROM {_NULLED} WHERE kind = 'purchase'")
def filter_null(spark, d):
    return _nulled(spark, d).filter(lambda r: r.kind == "purchase").df.select("event_id", "kind")


@query(f"SELECT event_id, kind FROM {_NULLED} WHERE NOT coalesce(kind = 'purchase', false)")
def reject_null(spark, d):
    return _nulled(spark, d).reject(lambda r: r.kind == "purchase").df.select("event_id", "kind")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def where_eq(spark, d):
    return table(spark, d, "orders").where({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def find_where(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).find_where({"o_orderstatus": "O"}).df.select("o_orderkey", "o_custkey")


@query("SELECT event_id, value FROM events WHERE value > 90 ORDER BY event_id LIMIT 1")
def find_first(spark, d):
    return table(spark, d, "events", EVENTS).find(lambda r: r.value > 90).df.select("event_id", "value")


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL AND v <> 0")
def compact_num(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, None).otherwise(F.col("value"))
    return table(spark, d, "events", EVENTS).map({"v": v}).compact("v").df


@query("SELECT event_id, t FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS t FROM events) WHERE t <> ''")
def compact_text(spark, d):
    return table(spark, d, "events", EVENTS).map({"t": F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type"))}).compact("t").df


@query("SELECT event_id, value FROM events WHERE event_id <= coalesce((SELECT min(event_id) FROM events WHERE event_type = 'purchase' AND value > 95), 9223372036854775807)")
def stop_when(spark, d):
    return table(spark, d, "events", EVENTS).stop_when(lambda r: (r.event_type == "purchase") & (r.value > 95)).df.select("event_id", "value")


# order and limits


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 25 OFFSET 75")
def slice_middle(spark, d):
    return table(spark, d, "events", EVENTS).slice(75, 100).df.select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 10")
def take(spark, d):
    return table(spark, d, "events", EVENTS).take(10).df.select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY event_id OFFSET 100")
def drop(spark, d):
    return table(spark, d, "events", EVENTS).drop(100).df.select("event_id", "value")


@query("(SELECT 'head' AS which, event_id FROM events ORDER BY event_id LIMIT 1) UNION ALL (SELECT 'last', event_id FROM events ORDER BY event_id DESC LIMIT 1)")
def head_last(spark, d):
    f = table(spark, d, "events", EVENTS)
    one = lambda which, x: x.df.select(F.lit(which).alias("which"), "event_id")
    return one("head", f.head()).union(one("last", f.last()))


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR), p_partkey) AS place FROM part ORDER BY CAST(p_size AS VARCHAR), p_partkey LIMIT 20")
def sort_string(spark, d):
    f = table(spark, d, "part", ["p_partkey"]).sort("p_size", as_text=True).take(20).with_index("place")
    return f.df.select("p_partkey", "p_size", (F.col("place") + 1).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topk_sort_by(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).sort_by(("o_totalprice", "desc")).take(15).df.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment DESC, c_name, c_custkey) - 1 AS place FROM customer")
def sort_by_text_down(spark, d):
    f = table(spark, d, "customer", ["c_custkey"]).sort_by("c_name").sort_by(("c_mktsegment", "desc")).with_index("place")
    return f.df.select("c_custkey", "c_mktsegment", "place")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY length(n_name), n_nationkey) - 1 AS place FROM nation")
def sort_by_compare(spark, d):
    f = table(spark, d, "nation", ["n_nationkey"]).sort_by(lambda a, b: F.length(a["n_name"]) - F.length(b["n_name"]) + F.when(F.length(a["n_name"]) == F.length(b["n_name"]), F.sign(a["n_nationkey"] - b["n_nationkey"]).cast("int")).otherwise(0))
    return f.with_index("place").df.select("n_nationkey", "n_name", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events")
def distributed_index(spark, d):
    return table(spark, d, "events", EVENTS).with_index("place").df.select("event_id", "place")


# shapes


@query("""SELECT doc_id, place, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM (
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN [NULL] WHEN doc_id % 7 = 1 THEN [] ELSE string_split(text, ' ') END AS w FROM documents))""")
def flatten_null(spark, d):
    w = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, F.array().cast("array<string>")).otherwise(F.split("text", " "))
    f = table(spark, d, "documents", ["doc_id"]).map({"word": w}).flatten("word")
    return f.df.select("doc_id", F.col("_at").cast("bigint").alias("place"), "word")


@query("SELECT lang, count(*) AS words, count(DISTINCT word) AS different FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY lang")
def flat_map_words(spark, d):
    f = table(spark, d, "documents")
    f = Flow(f.df.select("lang", "text")).map({"lang": F.col("lang"), "word": F.split("text", " ")}).flatten("word")
    return f.agg(F.count("*").alias("words"), F.countDistinct("word").alias("different"), by=["lang"]).df


@query("""SELECT batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch FROM events) GROUP BY batch""")
def batch_100(spark, d):
    f = table(spark, d, "events", EVENTS)
    v = F.col("values")
    total = F.aggregate(v, F.lit(0).cast("decimal(38,2)"), lambda a, r: (a + money(r["value"])).cast("decimal(38,2)")).cast("double")
    return f.batch(100).df.select("batch", F.size(v).cast("bigint").alias("n"), v[0]["event_id"].alias("first_id"), F.element_at(v, -1)["event_id"].alias("last_id"), total.alias("total"))


@query("SELECT md5(string_agg(c_name, ',' ORDER BY c_custkey)) AS names, count(*) AS n FROM customer")
def collect_names(spark, d):
    f = table(spark, d, "customer", ["c_custkey"]).collect("c_name")
    return f.df.select(F.md5(F.array_join("value", ",")).alias("names"), F.size("value").cast("bigint").alias("n"))


# folds and groups


@query("SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS n FROM lineitem")
def reduce_sum(spark, d):
    return table(spark, d, "lineitem").agg(F.coalesce(F.sum(money("l_quantity")).cast("double"), F.lit(0.0)).alias("quantity"), F.count("*").alias("n")).df


@query("SELECT max(o_totalprice) AS most, min(o_orderdate) AS first_day FROM orders")
def reduce1_max(spark, d):
    return table(spark, d, "orders").agg(F.max("o_totalprice").alias("most"), F.min("o_orderdate").alias("first_day")).df


@query("""SELECT l_orderkey, list_reduce(list_prepend(7::BIGINT, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)), lambda x, y: (x * 31 + y) % 1000003) AS value
FROM lineitem GROUP BY l_orderkey""")
def reduce_fold(spark, d):
    f = table(spark, d, "lineitem", LINE_KEY[1:])
    f = Flow(f.df.withColumn("q", F.col("l_quantity").cast("bigint")), f.order)
    return f.reduce(lambda a, q: (a * 31 + q) % 1000003, F.lit(7).cast("bigint"), "q", by=["l_orderkey"]).df


@query("""SELECT l_orderkey, list_reduce(list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), lambda x, y: (x * 2 - y) % 1000003) AS value
FROM lineitem GROUP BY l_orderkey""")
def reduce1_fold(spark, d):
    f = table(spark, d, "lineitem", LINE_KEY[1:])
    f = Flow(f.df.withColumn("q", F.col("l_quantity").cast("bigint")), f.order)
    return f.reduce1(lambda a, q: (a * 2 - q) % 1000003, "q", by=["l_orderkey"]).df


@query("SELECT c_nationkey, md5(string_agg(c_name, '>' ORDER BY c_custkey)) AS path FROM customer GROUP BY c_nationkey")
def async_reduce(spark, d):
    async def step(memo, row):
        await asyncio.sleep(0)
        return row["c_name"] if memo is None else f"{memo}>{row['c_name']}"

    f = table(spark, d, "customer", ["c_custkey"]).async_reduce(step, None, "path string", by=["c_nationkey"])
    return f.df.select("c_nationkey", F.md5("path").alias("path"))


@query("""SELECT list_reduce(list_prepend(7::BIGINT, list(c_nationkey::BIGINT ORDER BY c_custkey)), lambda x, y: (x * 31 + y) % 1000003) AS folded,
list_reduce(list(c_nationkey::BIGINT ORDER BY c_custkey), lambda x, y: (x * 2 - y) % 1000003) AS folded1 FROM customer""")
def reduce_ordered(spark, d):
    f = table(spark, d, "customer", ["c_custkey"])
    f = Flow(f.df.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("n")), ["c_custkey"])
    folded = f.reduce(lambda a, n: (a * 31 + n) % 1000003, F.lit(7).cast("bigint"), "n", name="folded")
    return folded.df.crossJoin(F.broadcast(f.reduce1(lambda a, n: (a * 2 - n) % 1000003, "n", name="folded1").df))  # one row each


@query("""SELECT key, count(*) AS n, md5(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey)) AS ids
FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS key, c_custkey FROM customer) GROUP BY key""")
def group_by_null(spark, d):
    f = table(spark, d, "customer", ["c_custkey"]).group_by(lambda r: F.nullif(r.c_mktsegment, F.lit("BUILDING")), "c_custkey")
    return f.df.select("key", F.size("values").cast("bigint").alias("n"), F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("ids"))


@query("SELECT o_orderkey AS key, o_custkey AS customer FROM orders")
def key_by_ok(spark, d):
    f = table(spark, d, "orders")
    return Flow(f.df.select("o_orderkey", "o_custkey")).key_by("o_orderkey").df.select("key", F.col("value.o_custkey").alias("customer"))


@query("SELECT o_custkey AS key, count(*) AS n, 'Multiple values per key: ' || o_custkey AS message FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def key_by_dupes(spark, d):
    return table(spark, d, "orders").repeated_keys("o_custkey").df


@query("""WITH m AS (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) OR row_number() OVER (ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS s FROM events),
r AS (SELECT *, sum(s) OVER (ORDER BY event_id) - 1 AS run FROM m)
SELECT CAST(run AS BIGINT) AS run, any_value(event_type) AS key, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY run""")
def sorted_group_by(spark, d):
    f = table(spark, d, "events", EVENTS)
    f = Flow(f.df.select("event_id", "event_type"), EVENTS).sorted_group_by("event_type")
    return f.df.select(F.col("run").cast("bigint").alias("run"), "key", F.size("values").cast("bigint").alias("n"), F.col("values")[0]["event_id"].alias("first_id"))


@query("SELECT DISTINCT text, lang FROM documents")
def uniq(spark, d):
    f = table(spark, d, "documents", ["doc_id"])
    return Flow(f.df.select("doc_id", "text", "lang"), ["doc_id"]).uniq().df


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def uniq_by_first(spark, d):
    return table(spark, d, "events", EVENTS).uniq_by(["user_id", "event_type"]).df.select("event_id", "user_id", "event_type", "value")


# joins


def _order_lines(how: str) -> str:
    return f"""SELECT coalesce(o_orderkey, l_orderkey) AS key, o_totalprice AS price, l_linenumber AS line, l_quantity AS quantity
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') o {how} JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'A') l ON o_orderkey IS NOT DISTINCT FROM l_orderkey"""


def _join_lines(spark, d, how: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").pick(["o_orderkey", "o_totalprice"])
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'A'").pick(["l_orderkey", "l_linenumber", "l_quantity"])
    return o.sorted_join(li, "o_orderkey", "l_orderkey", how).df.select("key", F.col("a.o_totalprice").alias("price"), F.col("b.l_linenumber").alias("line"), F.col("b.l_quantity").alias("quantity"))


@query(_order_lines("INNER"))
def join_inner(spark, d):
    return _join_lines(spark, d, "inner")


@query(_order_lines("LEFT"))
def join_left(spark, d):
    return _join_lines(spark, d, "left")


@query(_order_lines("RIGHT"))
def join_right(spark, d):
    return _join_lines(spark, d, "right")


@query("""SELECT a.k AS key, n_name, s_suppkey FROM (SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) a
LEFT JOIN (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_keys(spark, d):
    key = lambda c: lambda r: F.when(r[c] % 5 != 0, r[c])
    f = table(spark, d, "nation").sorted_join(table(spark, d, "supplier"), key("n_nationkey"), key("s_nationkey"), "left")
    return f.df.select("key", F.col("a.n_name").alias("n_name"), F.col("b.s_suppkey").alias("s_suppkey"))


@query("SELECT c_nationkey AS key, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_m2m(spark, d):
    f = table(spark, d, "customer").sorted_join(table(spark, d, "supplier"), "c_nationkey", "s_nationkey", merge=True)
    return f.df.select("key", F.col("a.c_custkey").alias("c_custkey"), F.col("b.s_suppkey").alias("s_suppkey"))


@query("SELECT n_nationkey AS key, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name ORDER BY n_nationkey DESC LIMIT 7")
def join_down(spark, d):
    customers = table(spark, d, "customer").agg(F.count("*").alias("n"), by=["c_nationkey"])
    f = table(spark, d, "nation").sorted_join(customers, "n_nationkey", "c_nationkey", "left", dir="desc").take(7)
    return f.df.select("key", F.col("a.n_name").alias("n_name"), F.coalesce("b.n", F.lit(0)).alias("customers"))


# composition


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE value > 50")
def merge_union(spark, d):
    f = Flow(table(spark, d, "events").df.select("event_id", "value", "event_type"), EVENTS)
    return f.filter("event_type = 'click'").merge(f.filter("value > 50")).df.select("event_id", "value")


@query("""SELECT branch, event_id, row_number() OVER (ORDER BY branch, event_id) - 1 AS place FROM (
SELECT 0 AS branch, event_id FROM events WHERE value > 50 UNION ALL SELECT 1, event_id FROM events WHERE value <= 50)""")
def merge_ordered(spark, d):
    f = Flow(table(spark, d, "events").df.select("event_id", "value"), EVENTS)
    return f.filter("value > 50").merge(f.filter("value <= 50"), ordered=True).with_index("place").df.select(F.col("_branch").alias("branch"), "event_id", "place")


@query("SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) * 2 AS DOUBLE) AS v FROM events UNION ALL SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) * 3 AS DOUBLE) FROM events")
def fork_merge(spark, d):
    f = table(spark, d, "events", EVENTS)
    times = lambda n: f.fork().map({"v": (money("value") * n).cast("double")})
    return times(2).merge(times(3)).df


@query("SELECT event_id, event_type FROM events WHERE value > 20 AND NOT coalesce(event_type = 'view', false) ORDER BY event_id LIMIT 50")
def pipeline_through(spark, d):
    chain = pipeline().filter("value > 20").reject(lambda r: r.event_type == "view")
    chain = pipeline().through(chain).take(50).through(None)
    return table(spark, d, "events", EVENTS).through(chain).df.select("event_id", "event_type")


# text


@query(r"SELECT doc_id, place, line FROM (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) - 1 AS place FROM (SELECT doc_id, regexp_split_to_array(replace(text, '. ', chr(13) || chr(10)), '\r?\n') AS w FROM documents))")
def split_lines(spark, d):
    f = table(spark, d, "documents", ["doc_id"]).map({"line": F.replace("text", F.lit(". "), F.lit("\r\n"))}).split("line")
    return f.df.select("doc_id", F.col("_at").cast("bigint").alias("place"), "line")


@query("SELECT c_custkey, place, part FROM (SELECT c_custkey, unnest(w) AS part, generate_subscripts(w, 1) - 1 AS place FROM (SELECT c_custkey, string_split(c_name || '#', '#') AS w FROM customer))")
def split_by(spark, d):
    f = table(spark, d, "customer", ["c_custkey"]).map({"part": F.concat("c_name", F.lit("#"))}).split_by("#", "part")
    return f.df.select("c_custkey", F.col("_at").cast("bigint").alias("place"), "part")


@query("SELECT doc_id, md5(to_base64(encode(text))) AS encoded, md5(text) AS decoded FROM documents")
def base64_roundtrip(spark, d):
    f = table(spark, d, "documents", ["doc_id"]).pick(["text"]).encode(column="text")
    back = f._with(f.df.withColumn("encoded", F.md5("text"))).decode(column="text")
    return back.df.select("doc_id", "encoded", F.md5(F.col("text").cast("string")).alias("decoded"))


@query("SELECT md5(to_base64(encode(string_agg(text, '' ORDER BY doc_id)))) AS encoded, md5(string_agg(text, '' ORDER BY doc_id)) AS decoded FROM documents")
def base64_chunks(spark, d):
    """All texts as one string whose chunks end anywhere, encoded, cut anew and decoded."""
    texts = table(spark, d, "documents", ["doc_id"]).pick(["text"])
    f = texts.encode(column="text", across=True)
    cuts = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.when(i == 0, F.substring("text", 1, 7)).otherwise(F.substring("text", 8, 1 << 30)))
    back = Flow(f.df.select(*f.order, F.posexplode(cuts).alias("k", "text")), [*f.order, "k"]).decode(column="text", across=True)
    some = texts.df.where("text IS NOT NULL").limit(1).agg((F.count("*") > 0).alias("some"))  # no text at all has no digest
    one = lambda x, name: x.digest("text").df.crossJoin(F.broadcast(some)).select(F.when(F.col("some"), F.col("text")).alias(name))
    return one(f, "encoded").crossJoin(F.broadcast(one(back, "decoded")))  # one row each


_CELL = """CASE WHEN contains({0}, '"') OR contains({0}, ',') OR contains({0}, chr(10)) THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(f"SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || lang || ',' || {_CELL.format('text')} || chr(10) AS line FROM documents")
def csv_stringify(spark, d):
    f = table(spark, d, "documents", ["doc_id"]).csv_stringify(["doc_id", "lang", "text"], name="line")
    return f.df


@query("SELECT doc_id, lang, md5(text) AS text FROM documents")
def csv_parse(spark, d):
    f = table(spark, d, "documents", ["doc_id"]).csv_stringify(["lang", "text"], name="line")
    rows = parse_csv(f.df.withColumn("line", F.expr("substring(line, 1, length(line) - 1)")), "line", ["lang", "text"])
    return rows.select("doc_id", "lang", F.md5("text").alias("text"))


@query("SELECT doc_id, lang, md5(text) AS text FROM documents")
def csv_chunks(spark, d):
    """All documents as one CSV text with a header, in chunks of bytes cut anywhere."""
    f = table(spark, d, "documents", ["doc_id"]).csv_stringify(["doc_id", "lang", "text"], header=True, name="line")
    line = F.encode("line", "UTF-8")
    third = F.ceil(F.length(line) / 3).cast("int")
    cuts = F.transform(F.array(*map(F.lit, range(3))), lambda i: F.substr(line, i * third + 1, third))
    chunks = Flow(f.df.select(*f.order, F.posexplode(cuts).alias("k", "value")), [*f.order, "k"])
    return chunks.csv(header=True).df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5("text").alias("text"))


@query(r"SELECT event_id, md5(props || ' \' || event_type || chr(10) || ',' || '\\') AS said, event_type FROM events")
def csv_escape(spark, d):
    """Quotes escaped by a backslash, in texts with backslashes, quotes, separators and line feeds."""
    said = F.concat("props", F.lit(" \\"), "event_type", F.lit("\n,\\\\"))
    f = Flow(table(spark, d, "events").df.select("event_id", said.alias("said"), "event_type"), EVENTS)
    lines = f.csv_stringify(["said", "event_type"], name="value", escape="\\", separator=";")
    back = parse_csv(lines.df.withColumn("value", F.rtrim("value", F.lit("\n"))), "value", ["said", "event_type"], ";", escape="\\")
    return back.select("event_id", F.md5("said").alias("said"), "event_type")


# time, errors, sources


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, n, ts AS last, event_id, true AS kept FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, CASE WHEN e.ts - k.last >= INTERVAL 1 DAY THEN e.ts ELSE k.last END, e.event_id, e.ts - k.last >= INTERVAL 1 DAY FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
SELECT event_id, user_id FROM k WHERE kept""")
def throttle_event_time(spark, d):
    return table(spark, d, "events", EVENTS).throttle(86_400_000, "ts", by=["user_id"]).df.select("event_id", "user_id")


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 7) * 250 AS release_ms FROM events")
def ratelimit_slots(spark, d):
    return table(spark, d, "events", EVENTS).ratelimit(7, 250).df.select("event_id", "release_ms")


@query("WITH RECURSIVE r(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM r WHERE n < 40) SELECT n, a AS fib FROM r")
def recursive_source(spark, d):
    return recursive_frame(spark, "n, a, b", "0L, 0L, 1L", "n + 1L, b, a + b FROM r WHERE n < 40").selectExpr("n", "a AS fib")


@query("SELECT range AS n, range * range AS square FROM range(1, 101)")
def generator_source(spark, d):
    def begin(write, next):
        for i in range(1, 51):
            write((i, i * i))
        next(rest)

    def rest(write, next):
        for i in range(51, 101):
            write((i, i * i))
        write(END)
        next()

    return flow(spark, begin, "n bigint, square bigint").df.select("n", "square")


_TRIED = "(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS t FROM events)"


def _tried(spark, d) -> Flow:
    t = F.when(F.col("event_id") % 11 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events", EVENTS).map({"t": t}).attempt("n", F.expr("try_cast(t AS bigint)"), "t", "not a number")


@query(f"SELECT coalesce(TRY_CAST(t AS BIGINT), -1) AS n, event_id FROM {_TRIED}")
def errors_replaced(spark, d):
    return _tried(spark, d).errors({"n": F.lit(-1).cast("bigint")}).df.select("n", "event_id")


@query(f"SELECT 'not a number' AS message, 'ValueError' AS type, t AS input FROM {_TRIED} WHERE TRY_CAST(t AS BIGINT) IS NULL")
def errors_split(spark, d):
    return _tried(spark, d).failed().df


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 1009 = 1008 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS t FROM events)
SELECT event_id, TRY_CAST(t AS BIGINT) AS n FROM t WHERE event_id < coalesce((SELECT min(event_id) FROM t WHERE TRY_CAST(t AS BIGINT) IS NULL), 9223372036854775807)""")
def stop_on_error(spark, d):
    t = F.when(F.col("event_id") % 1009 == 1008, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    f = table(spark, d, "events", EVENTS).map({"t": t}).attempt("n", F.expr("try_cast(t AS bigint)"), "t", "not a number")
    return f.stop_on_error().df.select("event_id", "n")


@query("SELECT s_suppkey, s_suppkey * 100 + s_nationkey AS code FROM supplier WHERE s_suppkey % 6 <> 0")
def resolve_async(spark, d):
    async def code(row):
        await asyncio.sleep(0.0001)
        if row["s_suppkey"] % 6 == 0:
            raise ValueError("no code")
        return row["s_suppkey"] * 100 + row["s_nationkey"]

    f = table(spark, d, "supplier", ["s_suppkey"]).resolve(code, "code bigint", par=4, preserve_order=False).errors()
    return f.df.select("s_suppkey", "code")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 1")
def async_filter(spark, d):
    async def wanted(row):
        return row["c_custkey"] % 3 == 1

    return table(spark, d, "customer").async_filter(wanted, par=8).df.select("c_custkey", "c_name")


@query("SELECT c_nationkey, count(*) AS n, max(c_name) AS last_name FROM customer GROUP BY c_nationkey")
def consume_groups(spark, d):
    def step(rows):
        key, n, last = None, 0, ""
        for r in rows:
            key, n, last = r["c_nationkey"], n + 1, max(last, r["c_name"])
        yield {"c_nationkey": key, "n": n, "last_name": last}

    return table(spark, d, "customer", ["c_custkey"]).consume(step, "c_nationkey int, n bigint, last_name string", by=["c_nationkey"]).df


# nullable whole numbers beyond what a double holds, through Python

_WIDE = "CASE WHEN event_id % 3 <> 0 THEN 9007199254740993 + event_id END"


def _wide(spark, d) -> Flow:
    f = table(spark, d, "events", EVENTS)
    return Flow(f.df.select("event_id", F.expr(_WIDE).alias("n")), EVENTS)


@query(f"SELECT event_id, {_WIDE} AS n, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE CAST({_WIDE} + 1 AS VARCHAR) END AS next FROM events")
def map_python(spark, d):
    return _wide(spark, d).map(lambda r: "none" if r["n"] is None else str(r["n"] + 1), schema="next string").df.select("event_id", "n", "next")


@query(f"SELECT event_id, {_WIDE} AS n, {_WIDE} - 1 AS less FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, -1 FROM events WHERE event_id % 3 = 0")
def mass_then_catch(spark, d):
    async def less(row):
        await asyncio.sleep(0)
        return row["n"] - 1  # a null fails

    f = _wide(spark, d).mass_then(less, "less bigint").mass_catch({"less": F.lit(-1).cast("bigint")})
    return f.df.select("event_id", "n", "less")


@query(f"SELECT event_id, {_WIDE} AS n FROM events")
def consume_python(spark, d):
    return _wide(spark, d).consume(lambda rows: (r for r in rows), "event_id bigint, n bigint").df


# sources and terminals; what begins or ends on the driver is on the small tables


def _nations(spark, d) -> Flow:
    return table(spark, d, "nation", ["n_nationkey"]).pick(["n_name", "n_regionkey"])


_NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_NATION_ROW = "n_nationkey int, n_name string, n_regionkey int"


@query(_NATIONS)
def values_source(spark, d):
    return flow(spark, [r.asDict() for r in _nations(spark, d).values()], _NATION_ROW).df.drop("_pos")


@query("SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def pull_in_order(spark, d):
    return flow(spark, [tuple(r) for r in _nations(spark, d).pull()], _NATION_ROW).df.withColumnRenamed("_pos", "place")


@query(_NATIONS)
def async_iterable_source(spark, d):
    async def rows():
        async for r in _nations(spark, d).to_async_iterator():
            yield tuple(r)

    return flow(spark, rows(), _NATION_ROW).df.drop("_pos")


@query("SELECT count(*) AS n, max(n_name) AS last FROM nation")
def promise_source(spark, d):
    async def later():
        rows = _nations(spark, d).to_promise().result()
        return {"n": len(rows), "last": max(r.n_name for r in rows)}

    return flow(spark, later(), "n bigint, last string").df.drop("_pos")


@query(_NATIONS)
def writer_source(spark, d):
    writer = Writer(spark, _NATION_ROW)
    _nations(spark, d).to_array(lambda rows: writer.write(*(tuple(r) for r in rows)))
    return writer.end().df.drop("_pos")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def value_source(spark, d):
    row = table(spark, d, "region").where({"r_regionkey": 2}).value()
    return flow(spark, [tuple(row)], "r_regionkey int, r_name string").df.drop("_pos")


@query("SELECT count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders")
def each_row(spark, d):
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(row):
        n.add(1)
        total.add(row.o_custkey)

    table(spark, d, "orders").pick(["o_custkey"]).each(add)
    return spark.createDataFrame([(n.value, total.value)], "n bigint, total bigint")


@query("SELECT event_id, value FROM events WHERE value > 10")
def tap_observe(spark, d):
    f = table(spark, d, "events", EVENTS).tap("seen", F.count("*").alias("rows")).observe()
    return f.filter("value > 10").df.select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def extend_method(spark, d):
    extend("only_of", lambda self, column, *wanted: self.filter(F.col(column).isin(*wanted)))
    return table(spark, d, "events", EVENTS).through(pipeline().only_of("event_type", "click", "view")).df.select("event_id", "event_type")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def pipe_parquet(spark, d):
    to = new_path(spark, "piped")
    table(spark, d, "orders").pick(["o_orderkey", "o_custkey", "o_totalprice"]).pipe(to)
    return spark.read.parquet(to)


@query("SELECT c_name AS line, count(*) AS n FROM customer GROUP BY c_name")
def pipe_gzip_lines(spark, d):
    to = new_path(spark, "lines")
    table(spark, d, "customer").map({"value": F.col("c_name")}).pipe(to, "text", compression="gzip")
    return read_lines(spark, f"{to}/*.txt.gz").where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS lines, sum(octet_length(encode(c_name)) + 1)::BIGINT AS bytes FROM customer")
def read_gzip_bytes(spark, d):
    to = new_path(spark, "bytes")
    table(spark, d, "customer").map({"value": F.col("c_name")}).pipe(to, "text", compression="gzip")
    found = read_bytes(spark, f"{to}/*.txt.gz", unpack=True, chunk=1000)
    ends = F.length(F.decode("value", "ISO-8859-1")) - F.length(F.replace(F.decode("value", "ISO-8859-1"), F.lit("\n"), F.lit("")))
    return found.agg(F.sum(ends).cast("bigint").alias("lines"), F.sum(F.length("value")).cast("bigint").alias("bytes"))


# streams; each runs over all files that are there and is read from its table


def _events_stream(spark, d, late: str | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return stream_of(spark, d, schema, time="ts" if late else None, late=late or "0 seconds", pattern="events.parquet")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def stream_filter(spark, d):
    return run_available(_events_stream(spark, d).where("event_type = 'purchase' AND value > 10").select("event_id", "value"), new_path(spark, "stream"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    counted = windows(_events_stream(spark, d, "1 hour"), "ts", "1 day", F.count("*").alias("n"), by=["event_type"])
    out = run_available(counted, new_path(spark, "stream"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_uniq(spark, d):
    return run_available(uniq_stream(_events_stream(spark, d, "3650 days"), ["user_id"]), new_path(spark, "stream")).select("user_id")


@query(ORACLE_SQL["throttle_event_time"])
def stream_throttle(spark, d):
    rows = _events_stream(spark, d, "0 seconds").select("event_id", "user_id", "ts")
    return run_available(throttle_stream(rows, ["user_id"], "ts", 86_400), new_path(spark, "stream")).select("event_id", "user_id")




@query("SELECT n_nationkey, n_name FROM nation")
def stream_pushed(spark, d):
    place = new_path(spark, "stream")
    pushed = PushedStream(spark, "n_nationkey int, n_name string", place)
    rows = [(r.n_nationkey, r.n_name) for r in _nations(spark, d).values()]
    pushed.write(*rows[:10])
    run_available(pushed.frame(), place)
    pushed.write(*({"n_name": n, "n_nationkey": k} for k, n in rows[10:])).end()
    return run_available(pushed.frame(), place)  # goes on from its checkpoint
