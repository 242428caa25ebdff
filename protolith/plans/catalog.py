"""Registered queries of the protobuf engine and their DuckDB counterparts.

No test table holds messages, so each query first encodes columns as messages and then reads or
edits those; its SQL computes the same from the plain columns. Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, pb
from ..functions.descriptors import Schema
from ..functions.protojson import to_json, to_number_json
from ..functions.sql import register_all
from ..functions.types import TYPES
from ..operators.frame import decode, from_message, gather, materialise, to_message, which_oneof
from ..streaming.events import decode_events, encode_events, windowed
from .samples import ORDERS_SET

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- messages of the tables


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows as messages."""
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        pb.build([
            (1, "int64", F.col("l_orderkey")), (2, "uint32", F.col("l_partkey")), (3, "sint64", -F.col("l_suppkey")), (4, "int32", F.col("l_linenumber")),
            (5, "fixed64", F.col("l_quantity").cast("decimal(20,0)")), (6, "double", F.col("l_extendedprice")), (7, "enum", F.ascii("l_returnflag")), (8, "bool", F.col("l_linestatus") == "O"),
            (9, "float", F.col("l_quantity").cast("float")), (10, "string", F.col("l_returnflag")), (11, "bytes", F.col("l_linestatus").cast("binary")), (12, "double", F.col("l_discount")), (13, "double", F.col("l_tax")),
            (14, "uint64", F.col("l_orderkey").cast("decimal(20,0)")), (15, "sint32", -F.col("l_linenumber")), (16, "fixed32", F.col("l_partkey")), (17, "sfixed32", -F.col("l_linenumber")), (18, "sfixed64", -F.col("l_partkey")),
            (19, "int64", F.unix_micros(F.col("l_shipdate").cast("timestamp"))),
        ]).alias("msg"),
    )


def order_parts(spark: SparkSession, sf_dir: str, packed: bool = True) -> DataFrame:
    """Part keys of each order's lines as the repeated int64 field 7 of a message."""
    return gather(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 7, "int64", "l_partkey", packed, "msg")


_LISTS = "WITH p AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY l_orderkey) "


# ---- getters of all types (F1)

_GET = {
    "int32": (4, 0, "l_linenumber"),
    "int64": (1, 0, "l_orderkey"),
    "uint32": (2, 0, "l_partkey"),
    "uint64": (14, 0, "l_orderkey"),
    "sint32": (15, 0, "-l_linenumber"),
    "sint64": (3, 0, "-l_suppkey"),
    "enum": (7, 0, "ascii(l_returnflag)"),
    "bool": (8, False, "l_linestatus = 'O'"),
    "fixed32": (16, 0, "l_partkey"),
    "sfixed32": (17, 0, "-l_linenumber"),
    "float": (9, 0.0, "CAST(l_quantity AS DOUBLE)"),
    "fixed64": (5, 0, "CAST(l_quantity AS BIGINT)"),
    "sfixed64": (18, 0, "-l_partkey"),
    "double": (6, 0.0, "l_extendedprice"),
    "string": (10, "", "l_returnflag"),
}


def _getter(type_name: str, n: int, default):
    def run(spark, sf_dir):
        v = pb.get("msg", n, type_name, default)
        wide = {"uint64": "bigint", "fixed64": "bigint", "float": "double"}.get(type_name)
        return lineitems(spark, sf_dir).select("l_orderkey", "l_linenumber", (v.cast(wide) if wide else v).alias("v"))

    return run


for _name, (_n, _default, _sql) in _GET.items():
    query(f"pb_get_{_name}", f"SELECT l_orderkey, l_linenumber, {_sql} AS v FROM lineitem")(_getter(_name, _n, _default))


@query("pb_get_bytes", "SELECT l_orderkey, l_linenumber, hex(l_linestatus) AS v FROM lineitem")
def _get_bytes(spark, sf_dir):
    return lineitems(spark, sf_dir).select("l_orderkey", "l_linenumber", F.hex(pb.get("msg", 11, "bytes", b"")).alias("v"))


@query("pb_get_message", "SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _get_message(spark, sf_dir):
    inner = _table(spark, sf_dir, "customer").select("c_custkey", pb.build([(1, "int64", F.col("c_custkey")), (2, "string", F.col("c_name")), (3, "int32", F.col("c_nationkey"))]).alias("c"))
    orders = _table(spark, sf_dir, "orders").join(inner, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", pb.build([(2, "message", F.col("c"))]).alias("msg"))
    nested = pb.get("msg", 2, "message", b"")
    return orders.select("o_orderkey", pb.get(nested, 2, "string", "").alias("c_name"), pb.get(nested, 3, "int32", 0).alias("c_nationkey"))


@query("pb_default_and_has", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1.5 END AS v, c_acctbal > 0 AS has_v FROM customer")
def _default(spark, sf_dir):
    set_ = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    d = _table(spark, sf_dir, "customer").select("c_custkey", pb.build([(1, "int64", F.col("c_custkey")), (4, "double", set_)]).alias("msg"))
    return d.select("c_custkey", pb.get("msg", 4, "double", -1.5).alias("v"), pb.has("msg", 4, "double").alias("has_v"))


# ---- repeated fields (F3, F4, F14, F15) and edits (F5-F13)


def _shown(message) -> F.Column:
    return F.array_join(F.transform(pb.get_repeated(message, 7, "int64"), lambda x: x.cast("string")), ",")


def _edit_query(name: str, sql: str, edit, packed: bool = True):
    def run(spark, sf_dir):
        return order_parts(spark, sf_dir, packed).select("l_orderkey", _shown(edit(F.col("msg"))).alias("v"))

    query(name, f"{_LISTS} SELECT l_orderkey, coalesce(array_to_string({sql}, ','), '') AS v FROM p")(run)


for _packed in (True, False):
    _kind = "packed" if _packed else "unpacked"
    _edit_query(f"pb_repeated_{_kind}", "l", lambda m: m, _packed)
    _edit_query(f"pb_add_{_kind}", "list_concat(l, [77])", lambda m, p=_packed: pb.add(m, 7, "int64", 77, packed=p), _packed)
    _edit_query(f"pb_add_all_{_kind}", "list_concat(l, [8, -9, 10])", lambda m, p=_packed: pb.add_all(m, 7, "int64", F.array(*map(F.lit, (8, -9, 10))), packed=p), _packed)
    _edit_query(f"pb_insert_{_kind}", "list_concat([-5], l)", lambda m, p=_packed: pb.insert(m, 7, "int64", 0, -5, packed=p), _packed)
    _edit_query(f"pb_replace_{_kind}", "list_concat([42], l[2:])", lambda m: pb.replace(m, 7, "int64", 0, 42), _packed)
    _edit_query(f"pb_remove_{_kind}", "l[2:]", lambda m: pb.remove(m, 7, "int64", 0), _packed)
_edit_query("pb_clear", "CAST([] AS BIGINT[])", lambda m: pb.clear(m, 7, "int64"))
_edit_query("pb_set_repeated", "[3, 2, 1]", lambda m: pb.set_repeated(m, 7, "int64", F.array(*map(F.lit, (3, 2, 1))), packed=True))
_edit_query("pb_set_singular", "[600]", lambda m: pb.set(m, 7, "int64", 600))
_edit_query("pb_edit_program", "list_concat(l[2:], [11, 12])", lambda m: pb.edit(m).remove(7, "int64", 0).add(7, "int64", 11, packed=True).set(9, "string", "x").add(7, "int64", 12, packed=True).clear(9).to_message())
_edit_query("pb_wire_json_edit", "list_concat(l, [77])", lambda m: pb.from_wire(pb.add(pb.wire_json(m), 7, "int64", 77, packed=True, kind="wire_json")))


@query("pb_count_and_element", f"{_LISTS} SELECT l_orderkey, CAST(len(l) AS INTEGER) AS n, l[1] AS first_v, l[len(l)] AS last_v FROM p")
def _elements(spark, sf_dir):
    n = pb.count("msg", 7, "int64")
    return order_parts(spark, sf_dir).select("l_orderkey", n.alias("n"), pb.element("msg", 7, "int64", 0).alias("first_v"), pb.element("msg", 7, "int64", n - 1).alias("last_v"))


@query("pb_json_arrays", f"""{_LISTS} SELECT l_orderkey, '[' || array_to_string(l, ',') || ']' AS a, '["' || array_to_string(l, '","') || '"]' AS s FROM p""")
def _arrays(spark, sf_dir):
    return order_parts(spark, sf_dir).select("l_orderkey", pb.as_json_array("msg", 7, "int64").alias("a"), pb.as_json_string_array("msg", 7, "int64").alias("s"))


@query("pb_float_list", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first_v, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1048576) AS BIGINT)), ',') AS all_v FROM embeddings")
def _floats(spark, sf_dir):
    d = _table(spark, sf_dir, "embeddings").select("vec_id", pb.build([(1, "int64", F.col("vec_id")), (2, "float", F.col("embedding")), (3, "sint32", F.col("label"))]).alias("msg"))
    return d.select("vec_id", pb.count("msg", 2, "float").alias("n"), pb.element("msg", 2, "float", 0).cast("double").alias("first_v"), F.array_join(F.transform(pb.get_repeated("msg", 2, "float"), lambda x: F.floor(x.cast("double") * 1048576).cast("string")), ",").alias("all_v"))


# ---- relational operators over extracted fields


@query(
    "pb_pricing_summary",
    """SELECT l_returnflag AS flag, l_linestatus = 'O' AS is_open, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""",
)
def _pricing(spark, sf_dir):
    got = pb.extract("msg", {"flag": (10, "string", ""), "is_open": (8, "bool", False), "qty": (5, "fixed64", 0), "price": (6, "double", 0.0), "disc": (12, "double", 0.0), "ship": (19, "int64", 0)})
    rows = lineitems(spark, sf_dir).select(got.alias("x")).select("x.*")
    return (
        rows.where(F.timestamp_micros("ship") <= F.lit("1998-09-02 00:00:00").cast("timestamp"))
        .groupBy("flag", "is_open")
        .agg(F.sum(F.col("qty").cast("bigint")).alias("sum_qty"), F.round(F.sum("price"), 2).alias("sum_price"), F.round(F.avg("disc"), 6).alias("avg_disc"), F.count("*").alias("n"))
    )


def _customers(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey",
        pb.build([(1, "int64", F.col("c_custkey")), (2, "string", F.col("c_name")), (3, "int32", F.col("c_nationkey")), (4, "double", F.col("c_acctbal")), (5, "string", F.col("c_mktsegment"))]).alias("msg"),
    )


@query("pb_filter_between", "SELECT c_custkey, c_name AS name FROM customer WHERE c_nationkey BETWEEN 5 AND 12 AND c_mktsegment LIKE 'B%' ")
def _between(spark, sf_dir):
    d = _customers(spark, sf_dir).where(pb.get("msg", 3, "int32", 0).between(5, 12) & pb.get("msg", 5, "string", "").like("B%"))
    return d.select("c_custkey", pb.get("msg", 2, "string", "").alias("name"))


@query("pb_case_guard", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS v, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer")
def _case(spark, sf_dir):
    x = pb.extract("msg", {"bal": (4, "double", 0.0), "seg": (5, "string", "")})
    d = _customers(spark, sf_dir).withColumn("x", x)
    return d.select("c_custkey", F.when(F.col("x.bal") > 0, "credit").otherwise("debit").alias("v"), F.nullif(F.col("x.seg"), F.lit("BUILDING")).alias("seg"))


@query("pb_join_group_topk", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10")
def _join(spark, sf_dir):
    rows = materialise(_customers(spark, sf_dir).select("msg"), "msg", {"nation": (3, "int32", 0), "bal": (4, "double", 0.0)})
    joined = rows.join(_table(spark, sf_dir, "nation"), F.col("nation") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("bal")).orderBy(F.desc("n"), "n_name").limit(10)


@query("pb_window_rank", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS r FROM customer")
def _rank(spark, sf_dir):
    rows = materialise(_customers(spark, sf_dir), "msg", {"seg": (5, "string", ""), "bal": (4, "double", 0.0)})
    return rows.select("c_custkey", F.row_number().over(Window.partitionBy("seg").orderBy(F.desc("bal"), "c_custkey")).alias("r"))


@query("pb_conditional_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'AT RISK' ELSE c_mktsegment END AS seg FROM customer")
def _update(spark, sf_dir):
    d = _customers(spark, sf_dir)
    low = pb.get("msg", 4, "double", 0.0) < 0
    return d.withColumn("msg", F.when(low, pb.set("msg", 5, "string", "AT RISK")).otherwise(F.col("msg"))).select("c_custkey", pb.get("msg", 5, "string", "").alias("seg"))


@query("pb_check_constraint", "SELECT c_mktsegment AS seg, count(*) FILTER (WHERE c_acctbal >= 0 AND length(c_name) > 0) AS valid, count(*) AS n FROM customer GROUP BY 1")
def _check(spark, sf_dir):
    rows = materialise(_customers(spark, sf_dir), "msg", {"seg": (5, "string", ""), "bal": (4, "double", 0.0), "name": (2, "string", "")})
    return rows.groupBy("seg").agg(F.count_if((F.col("bal") >= 0) & (F.length("name") > 0)).alias("valid"), F.count("*").alias("n"))


# ---- the wire format


@query("pb_wire_table", "SELECT c_custkey, unnest([0, 1]) AS i, unnest([1, 3]) AS n, CAST(0 AS TINYINT) AS t, unnest([c_custkey, CAST(c_nationkey AS BIGINT)]) AS u FROM customer")
def _wire(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", pb.build([(1, "int64", F.col("c_custkey")), (3, "int32", F.col("c_nationkey"))]).alias("msg"))
    return d.select("c_custkey", F.inline(pb.elements("msg"))).drop("b")


@query("pb_wire_table_udtf", "SELECT n, t, count(*) AS c FROM (SELECT unnest([1, 2, 3, 4, 5]) AS n, unnest([0, 2, 0, 1, 2]) AS t FROM customer) GROUP BY ALL")
def _udtf(spark, sf_dir):
    register_all(spark, "pb_message_show_wire_format")
    _customers(spark, sf_dir).createOrReplaceTempView("protolith_customers")
    return spark.sql("SELECT w.n, w.t, count(*) AS c FROM protolith_customers, LATERAL pb_message_show_wire_format(msg) w GROUP BY w.n, w.t")


@query("pb_distinct_fields", "SELECT n, cnt FROM (VALUES (1), (2), (3), (4), (5)) v(n), (SELECT count(*) AS cnt FROM customer)")
def _distinct(spark, sf_dir):
    return _customers(spark, sf_dir).select(F.explode(pb.elements("msg")["n"]).alias("n")).groupBy("n").agg(F.count("*").alias("cnt"))


@query("pb_wire_json", """SELECT c_custkey, '{"1":[{"i":0,"n":1,"t":0,"v":' || c_custkey || '}],"3":[{"i":1,"n":3,"t":0,"v":' || c_nationkey || '}]}' AS j, true AS same FROM customer""")
def _wire_json(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", pb.build([(1, "int64", F.col("c_custkey")), (3, "int32", F.col("c_nationkey"))]).alias("msg"))
    return d.select("c_custkey", pb.wire_json("msg").alias("j"), (pb.from_wire(pb.wire_json("msg")) == F.col("msg")).alias("same"))


@query("pb_to_message_bytes", "SELECT n_nationkey, '08' || lpad(hex(n_nationkey), 2, '0') || '12' || lpad(hex(length(n_name)), 2, '0') || hex(n_name) AS h FROM nation")
def _bytes(spark, sf_dir):
    d = _table(spark, sf_dir, "nation")
    return d.select("n_nationkey", F.hex(pb.build([(1, "int32", F.col("n_nationkey")), (2, "string", F.col("n_name"))])).alias("h"))


@query("pb_which_oneof", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'number' ELSE 'word' END AS w FROM customer")
def _oneof(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    d = _table(spark, sf_dir, "customer").select("c_custkey", pb.build([(1, "int64", F.when(even, F.col("c_custkey"))), (2, "string", F.when(~even, F.col("c_name")))]).alias("msg"))
    return d.select("c_custkey", which_oneof("msg", {"number": 1, "word": 2}).alias("w"))


# ---- schema and JSON


def _order_messages(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    stamp = pb.build([(1, "int64", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))])
    return orders.select(
        "o_orderkey",
        pb.build([(1, "uint64", F.col("o_orderkey").cast("decimal(20,0)")), (2, "string", F.col("o_orderstatus")), (3, "message", stamp), (4, "int32", F.array(F.lit(1), F.lit(2))), (5, "enum", F.lit(1))]).alias("msg"),
    )


_DATE = "strftime(date_trunc('second', o_orderdate), '%Y-%m-%dT%H:%M:%SZ')"


@query("pb_proto_json", f"""SELECT o_orderkey, '{{"orderKey":"' || o_orderkey || '","status":"' || o_orderstatus || '","placed":"' || {_DATE} || '","lines":[1,2],"kind":"KIND_ONE","note":""}}' AS j FROM orders""")
def _proto_json(spark, sf_dir):
    return _order_messages(spark, sf_dir).select("o_orderkey", to_json(Schema.from_json(ORDERS_SET), ".shop.Order", "msg").alias("j"))


@query("pb_number_json", f"""SELECT o_orderkey, '{{"1":' || o_orderkey || ',"2":"' || o_orderstatus || '","3":"' || {_DATE} || '","4":[1,2],"5":1,"6":""}}' AS j FROM orders""")
def _number_json(spark, sf_dir):
    return _order_messages(spark, sf_dir).select("o_orderkey", to_number_json(Schema.from_json(ORDERS_SET), ".shop.Order", "msg").alias("j"))


@query("pb_decode_struct", f"SELECT o_orderkey, o_orderstatus AS status, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS seconds, '1,2' AS lines, '' AS note FROM orders")
def _decode(spark, sf_dir):
    rows = decode(_order_messages(spark, sf_dir), "msg", Schema.from_json(ORDERS_SET), ".shop.Order")
    return rows.select("o_orderkey", "status", F.col("placed.seconds").alias("seconds"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "note")


@query("pb_encode_struct", "SELECT o_orderkey, true AS same FROM orders")
def _encode(spark, sf_dir):
    schema = Schema.from_json(ORDERS_SET)
    rows = _order_messages(spark, sf_dir)
    again = rows.select("o_orderkey", "msg", from_message(schema, ".shop.Order", "msg").alias("s")).withColumn("again", to_message(schema, ".shop.Order", "s"))
    # the texts are compared: an encoder leaves out a zero that a message may carry
    return again.select("o_orderkey", (to_json(schema, ".shop.Order", "again") == to_json(schema, ".shop.Order", "msg")).alias("same"))


@query("pb_schema_index", """SELECT * FROM (VALUES ('.google.protobuf.Timestamp', 11, '$[1]."1"[0]."4"[0]'), ('.shop.Order', 11, '$[1]."1"[1]."4"[0]'), ('.shop.Kind', 14, '$[1]."1"[1]."5"[0]')) v(name, kind, place)""")
def _schema(spark, sf_dir):
    index = Schema.from_json(ORDERS_SET).index
    return spark.createDataFrame([(k, v[0], v[2]) for k, v in index.items()], "name string, kind int, place string")


@query("pb_sql_functions", "SELECT c_custkey, c_nationkey + 1 AS nation, c_mktsegment AS seg, true AS has_name FROM customer")
def _sql(spark, sf_dir):
    for name in ("pb_message_get_int32_field", "pb_message_set_int32_field", "pb_message_get_string_field", "pb_message_has_string_field"):
        register_all(spark, name)
    _customers(spark, sf_dir).createOrReplaceTempView("protolith_customers")
    return spark.sql(
        """SELECT c_custkey, pb_message_get_int32_field(pb_message_set_int32_field(msg, 3, c_nationkey + 1), 3, 0) AS nation,
           pb_message_get_string_field(msg, 5, '') AS seg, pb_message_has_string_field(msg, 2) AS has_name FROM protolith_customers"""
    )


@query("pb_bits", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 OR l_partkey = 0 THEN 2 * l_partkey ELSE 2 * l_partkey - 1 END AS z, l_extendedprice AS d, l_partkey AS back FROM lineitem")
def _bits(spark, sf_dir):
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(-F.col("l_partkey"))
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", bits.zigzag_encode(v).alias("z"),
        bits.uint64_as_double(bits.double_as_uint64(F.col("l_extendedprice"))).alias("d"),
        bits.swap_endian_64(bits.swap_endian_64(F.col("l_partkey"))).alias("back"),
    )


@query("pb_event_windows", "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _events(spark, sf_dir):
    return windowed(decode_events(encode_events(_table(spark, sf_dir, "events")))).withColumn("start", F.unix_seconds("start"))


assert set(TYPES) == {*_GET, "bytes", "message"}
