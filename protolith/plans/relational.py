"""Relational and streaming operators over fields of messages: joins of all kinds, sets, groupings, windows, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pb
from ..functions.protojson import to_json
from ..functions.sql import register_all
from ..operators.frame import materialise, self_time, unique_violations, zero_merged
from ..streaming.events import decode_events, encode_events, sessions, windowed
from .catalog import _customers, _table, query
from .json_forms import _nations
from .samples import FORMS_SCHEMA


def _people(spark, sf_dir) -> DataFrame:
    """Customers as messages, with the fields that queries use extracted in one pass."""
    return materialise(_customers(spark, sf_dir).select("msg"), "msg", {"id": (1, "int64", 0), "nation": (3, "int32", 0), "bal": (4, "double", 0.0), "seg": (5, "string", "")})


def _bought(spark, sf_dir) -> DataFrame:
    """Orders as messages: number, customer, total price."""
    msg = pb.build([(1, "int64", F.col("o_orderkey")), (2, "sint64", F.col("o_custkey")), (3, "double", F.col("o_totalprice"))])
    return materialise(_table(spark, sf_dir, "orders").select(msg.alias("msg")), "msg", {"order": (1, "int64", 0), "cust": (2, "sint64", 0), "price": (3, "double", 0.0)})


@query("pb_semi_join", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _semi(spark, sf_dir):
    return _people(spark, sf_dir).join(_bought(spark, sf_dir).where("price > 100000"), F.col("id") == F.col("cust"), "left_semi").select("id")


@query("pb_anti_join", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _anti(spark, sf_dir):
    return _people(spark, sf_dir).join(_bought(spark, sf_dir).where("price > 100000"), F.col("id") == F.col("cust"), "left_anti").select("id")


@query("pb_full_join", "SELECT coalesce(id, -1) AS id, coalesce(cust, -1) AS cust, coalesce(n, 0) AS n FROM (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12) c FULL JOIN (SELECT o_custkey AS cust, count(*) AS n FROM orders GROUP BY 1) o ON id = cust")
def _full(spark, sf_dir):
    few = _people(spark, sf_dir).where("nation < 12").select("id")
    return few.join(_bought(spark, sf_dir).groupBy("cust").agg(F.count("*").alias("n")), F.col("id") == F.col("cust"), "full").select(F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("cust", F.lit(-1)).alias("cust"), F.coalesce("n", F.lit(0)).alias("n"))


@query("pb_left_join", "SELECT c_custkey AS id, count(o_orderkey) AS n, CAST(coalesce(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)), 0) AS BIGINT) AS cents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _left(spark, sf_dir):
    rows = _people(spark, sf_dir).join(_bought(spark, sf_dir), F.col("id") == F.col("cust"), "left")
    return rows.groupBy("id").agg(F.count("order").alias("n"), F.coalesce(F.sum(F.floor(F.col("price") * 100 + 0.5)), F.lit(0)).alias("cents"))


@query("pb_set_operations", "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'less', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _sets(spark, sf_dir):
    key = lambda d, c, n: materialise(d.select(pb.build([(n, "int64", F.col(c).cast("bigint"))]).alias("m")), "m", {"k": (n, "int64", 0)}).select(F.col("k").cast("int").alias("k"))
    c, s = key(_table(spark, sf_dir, "customer"), "c_nationkey", 3), key(_table(spark, sf_dir, "supplier"), "s_nationkey", 1)
    rich, n = key(_table(spark, sf_dir, "supplier").where("s_acctbal > 5000"), "s_nationkey", 1), key(_table(spark, sf_dir, "nation"), "n_nationkey", 2)
    named = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return named("union", c.union(s).distinct()).unionAll(named("both", c.intersect(s))).unionAll(named("less", n.exceptAll(rich).distinct().join(rich, "k", "left_anti")))


@query("pb_grouping_sets", "SELECT coalesce(seg, 'all') AS seg, coalesce(nation, -1) AS nation, CAST(grouping(seg, nation) AS BIGINT) AS g, count(*) AS n, CAST(sum(CAST(floor(bal * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT c_mktsegment AS seg, CAST(c_nationkey AS INTEGER) AS nation, c_acctbal AS bal FROM customer) GROUP BY GROUPING SETS ((seg, nation), (seg), ())")
def _grouping(spark, sf_dir):
    _people(spark, sf_dir).createOrReplaceTempView("protolith_people")
    return spark.sql("SELECT coalesce(seg, 'all') AS seg, coalesce(nation, -1) AS nation, grouping_id(seg, nation) AS g, count(*) AS n, sum(floor(bal * 100 + 0.5)) AS cents FROM protolith_people GROUP BY GROUPING SETS ((seg, nation), (seg), ())")


@query("pb_cube", "SELECT coalesce(seg, 'all') AS seg, coalesce(CAST(open AS VARCHAR), 'all') AS open, count(*) AS n FROM (SELECT c_mktsegment AS seg, c_acctbal > 0 AS open FROM customer) GROUP BY CUBE (seg, open)")
def _cube(spark, sf_dir):
    return _people(spark, sf_dir).withColumn("open", F.col("bal") > 0).cube("seg", "open").agg(F.count("*").alias("n")).select(F.coalesce("seg", F.lit("all")).alias("seg"), F.coalesce(F.col("open").cast("string"), F.lit("all")).alias("open"), "n")


@query("pb_cross_scalar", "SELECT c_custkey AS id, c_acctbal > avg_bal AS above FROM customer CROSS JOIN (SELECT avg(c_acctbal) AS avg_bal FROM customer)")
def _cross(spark, sf_dir):
    """One row handed to all: the other side of the product is an aggregate without keys."""
    people = _people(spark, sf_dir)
    return people.crossJoin(F.broadcast(people.agg(F.avg("bal").alias("avg_bal")))).select("id", (F.col("bal") > F.col("avg_bal")).alias("above"))


@query("pb_scalar_subquery", "SELECT n_nationkey, '{\"nationKey\":' || n_nationkey || ',\"nationName\":\"' || n_name || '\",\"regionKey\":\"' || n_regionkey || '\",\"letters\":[],\"kind\":\"KIND_ONE\",\"raw\":\"\"}' AS j FROM nation")
def _subquery(spark, sf_dir):
    """The schema looked up in a table of schemas by a scalar subquery."""
    register_all(spark, "pb_message_to_json")
    spark.createDataFrame([("forms", FORMS_SCHEMA.to_json()), ("none", "[1,{},{}]")], "name string, descriptors string").createOrReplaceTempView("protolith_schemas")
    _nations(spark, sf_dir).createOrReplaceTempView("protolith_nation_messages")
    return spark.sql("SELECT n_nationkey, pb_message_to_json((SELECT first(descriptors) FROM protolith_schemas WHERE name = 'forms'), '.forms.Nation', msg) AS j FROM protolith_nation_messages")


@query("pb_derived_table", "SELECT nation, id FROM (SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) WHERE c_acctbal = m")
def _derived(spark, sf_dir):
    """Customers with the greatest balance of their nation: a correlated subquery over extracted columns."""
    _people(spark, sf_dir).createOrReplaceTempView("protolith_people")
    return spark.sql("SELECT nation, id FROM protolith_people p WHERE bal = (SELECT max(q.bal) FROM protolith_people q WHERE q.nation = p.nation)")


@query("pb_view_columns", "SELECT c_mktsegment AS seg, count(DISTINCT c_nationkey) AS nations FROM customer WHERE c_acctbal > 1000 GROUP BY 1")
def _view(spark, sf_dir):
    """A view with generated columns, then plain SQL over it."""
    for name in ("pb_message_get_string_field", "pb_message_get_double_field", "pb_message_get_int32_field"):
        register_all(spark, name)
    _customers(spark, sf_dir).createOrReplaceTempView("protolith_customers")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY VIEW protolith_customer_columns AS
           SELECT pb_message_get_string_field(msg, 5, '') AS seg, pb_message_get_double_field(msg, 4, CAST(0 AS DOUBLE)) AS bal, pb_message_get_int32_field(msg, 3, 0) AS nation FROM protolith_customers"""
    )
    return spark.sql("SELECT seg, count(DISTINCT nation) AS nations FROM protolith_customer_columns WHERE bal > 1000 GROUP BY seg")


@query("pb_view_json", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation GROUP BY 1")
def _view_json(spark, sf_dir):
    """A view of rendered JSON, parsed by a schema of its own."""
    j = _nations(spark, sf_dir).select(F.from_json(to_json(FORMS_SCHEMA, ".forms.Nation", "msg"), "nationKey int, regionKey string").alias("v"))
    return j.groupBy(F.col("v.regionKey").cast("int").alias("n_regionkey")).agg(F.sum("v.nationKey").alias("s"))


@query("pb_unique_violations", "SELECT seg, nation, count(*) AS n FROM (SELECT c_mktsegment AS seg, CAST(c_nationkey AS INTEGER) AS nation FROM customer) GROUP BY ALL HAVING count(*) > 1")
def _unique(spark, sf_dir):
    return unique_violations(_customers(spark, sf_dir), "msg", {"seg": (5, "string", ""), "nation": (3, "int32", 0)})


@query("pb_zero_merge", "SELECT p AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT p_partkey AS p FROM part) LEFT JOIN (SELECT l_partkey, count(*) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON p = x.l_partkey LEFT JOIN (SELECT l_partkey, count(*) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) y ON p = y.l_partkey")
def _merge(spark, sf_dir):
    """Counts of two kinds merged onto all keys, nought where a key has none."""
    line = pb.build([(1, "int64", F.col("l_partkey")), (2, "string", F.col("l_returnflag"))])
    lines = materialise(_table(spark, sf_dir, "lineitem").select(line.alias("m")), "m", {"k": (1, "int64", 0), "flag": (2, "string", "")})
    count = lambda flag, name: lines.where(F.col("flag") == flag).groupBy("k").agg(F.count("*").alias(name))
    return zero_merged(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k", count("R", "a"), count("A", "b"))


@query("pb_self_time", "WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_linenumber) OVER (PARTITION BY l_orderkey) + l_orderkey * 10 AS top, sum(l_quantity) AS took FROM lineitem GROUP BY l_orderkey, l_linenumber), c AS (SELECT top, sum(took) AS inner_ FROM t WHERE id <> top GROUP BY 1) SELECT id, took, took - coalesce(inner_, 0) AS own FROM t LEFT JOIN c ON t.id = c.top")
def _self(spark, sf_dir):
    """Spans as messages, the first line of an order calling the others: a span's own time is its time less its children's."""
    per = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("took")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    top = F.min("id").over(Window.partitionBy("l_orderkey"))
    span = pb.build([(1, "int64", F.col("id")), (2, "int64", F.when(F.col("top") != F.col("id"), F.col("top"))), (3, "double", F.col("took").cast("double"))])
    spans = per.withColumn("top", top).select(span.alias("m")).select(pb.extract("m", {"id": (1, "int64", 0), "parent": (2, "int64"), "took": (3, "double", 0.0)}).alias("x")).select("x.*")
    return self_time(spans, "id", "parent", "took")


@query("pb_sliding_windows", "SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', CAST(ts AS TIMESTAMP)), time_bucket(INTERVAL '30 minutes', CAST(ts AS TIMESTAMP)) - INTERVAL '30 minutes']) AS s, event_type, value FROM events) GROUP BY ALL")
def _sliding(spark, sf_dir):
    return windowed(decode_events(encode_events(_table(spark, sf_dir, "events"))), slide="30 minutes").withColumn("start", F.unix_seconds("start"))


@query(
    "pb_session_windows",
    """WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t FROM events), g AS (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY user_id ORDER BY t) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM e),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, CAST(epoch_us(min(t)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _sessions(spark, sf_dir):
    return sessions(decode_events(encode_events(_table(spark, sf_dir, "events"))), "6 hours").select("user_id", F.unix_micros("start").alias("start"), "n")
