"""Well-known types, maps, oneofs and presence as ProtoJSON; descriptor compilation; JSON paths; JSON back to messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import pb
from ..functions.protojson import to_json
from ..functions.sql import register_all
from ..operators.frame import decode, from_json_text, from_message, map_value, to_message, where_element
from .catalog import _table, query
from .samples import FORMS_SCHEMA

_SECONDS = lambda s, n: pb.build([(1, "int64", s), (2, "int32", n)])


def _key() -> Column:
    return F.col("c_custkey")


def _nation() -> Column:
    return F.col("c_nationkey").cast("double")


def _form(spark, sf_dir, fields: list, name: str = ".forms.Form"):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", pb.build(fields).alias("msg"))
    return rows.select("c_custkey", to_json(FORMS_SCHEMA, name, "msg").alias("j"))


def _fraction(nanos: str) -> str:
    """SQL of the fraction of a second: none, three, six or nine digits."""
    digits = f"lpad(CAST({nanos} AS VARCHAR), 9, '0')"
    return f"CASE WHEN {nanos} = 0 THEN '' WHEN {nanos} % 1000000 = 0 THEN '.' || substr({digits}, 1, 3) WHEN {nanos} % 1000 = 0 THEN '.' || substr({digits}, 1, 6) ELSE '.' || {digits} END"


_NANOS = {"zero": "0", "milli": "(c_custkey % 1000) * 1000000", "micro": "(c_custkey % 1000) * 1000", "nano": "c_custkey % 1000"}
for _name, _sql in _NANOS.items():

    @query(f"pb_json_duration_{_name}", f"""SELECT c_custkey, '{{"took":"' || CASE WHEN c_custkey % 2 = 1 THEN '-' ELSE '' END || c_custkey || {_fraction(_sql)} || 's"}}' AS j FROM customer""")
    def _duration(spark, sf_dir, nanos=_sql):
        sign = F.when(_key() % 2 == 1, -1).otherwise(1)
        return _form(spark, sf_dir, [(1, "message", _SECONDS(_key() * sign, (F.expr(nanos) * sign).cast("int")))])

    @query(f"pb_json_timestamp_{_name}", f"""SELECT c_custkey, '{{"at":"' || strftime(to_timestamp(c_custkey * 86413) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || {_fraction(_sql)} || 'Z"}}' AS j FROM customer""")
    def _stamp(spark, sf_dir, nanos=_sql):
        return _form(spark, sf_dir, [(20, "message", _SECONDS(_key() * 86413, F.expr(nanos).cast("int")))])


def _value(number: int, type_name: str, v: Column) -> Column:
    return pb.build([(number, type_name, v)])


def _entry(key: str, value: Column) -> Column:
    return pb.build([(1, "string", F.lit(key)), (2, "message", value)])



@query(
    "pb_json_struct",
    """SELECT c_custkey, '{"someValue":' || CASE c_custkey % 4 WHEN 0 THEN '"' || c_name || '"' WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN 'true' ELSE 'null' END
       || ',"tags":{"name":"' || c_name || '","n":' || c_nationkey || ',"flag":false,"nil":null,"deep":{"in":"x"}},"list":[' || c_nationkey || ',"' || c_mktsegment || '",[true]]}' AS j FROM customer""",
)
def _struct(spark, sf_dir):
    some = F.expr("c_custkey % 4")
    value = F.when(some == 0, _value(3, "string", F.col("c_name"))).when(some == 1, _value(2, "double", _nation())).when(some == 2, _value(4, "bool", F.lit(True))).otherwise(_value(1, "enum", F.lit(0)))
    deep = _value(5, "message", pb.build([(1, "message", F.array(_entry("in", _value(3, "string", F.lit("x")))))]))
    tags = pb.build([(1, "message", F.array(
        _entry("name", _value(3, "string", F.col("c_name"))), _entry("n", _value(2, "double", _nation())), _entry("flag", _value(4, "bool", F.lit(False))),
        _entry("nil", _value(1, "enum", F.lit(0))), _entry("deep", deep),
    ))])
    inner = _value(6, "message", pb.build([(1, "message", F.array(_value(4, "bool", F.lit(True))))]))
    items = pb.build([(1, "message", F.array(_value(2, "double", _nation()), _value(3, "string", F.col("c_mktsegment")), inner))])
    return _form(spark, sf_dir, [(2, "message", value), (3, "message", tags), (4, "message", items)])


@query(
    "pb_json_wrappers",
    """SELECT c_custkey, '{"mask":"userName,a.bC","nothing":{},"wDouble":' || c_nationkey || '.5,"wFloat":' || c_nationkey || ',"wInt64":"' || -c_custkey || '","wUint64":"' || c_custkey
       || '","wInt32":' || -c_nationkey || ',"wUint32":' || c_nationkey || ',"wBool":' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || ',"wString":"' || c_name || '","wBytes":"' || to_base64(encode(c_mktsegment)) || '"}' AS j FROM customer""",
)
def _wrappers(spark, sf_dir):
    n, one = F.col("c_nationkey"), lambda t, v: pb.build([(1, t, v)])
    made = [
        one("double", n + 0.5), one("float", n.cast("float")), one("int64", -_key()), one("uint64", _key().cast("decimal(20,0)")), one("int32", (-n).cast("int")),
        one("uint32", n.cast("bigint")), one("bool", F.col("c_acctbal") > 0), one("string", F.col("c_name")), one("bytes", F.col("c_mktsegment").cast("binary")),
    ]
    mask = pb.build([(1, "string", F.array(F.lit("user_name"), F.lit("a.b_c")))])
    return _form(spark, sf_dir, [(5, "message", mask), (6, "message", pb.new()), *((10 + k, "message", c) for k, c in enumerate(made))])


@query(
    "pb_json_shapes",
    """SELECT c_custkey, '{"counts":{"a":' || c_nationkey || ',"b":2},"kind":' || CASE c_custkey % 3 WHEN 0 THEN '"KIND_UNSPECIFIED"' WHEN 1 THEN '"KIND_ONE"' ELSE '7' END
       || CASE WHEN c_custkey % 2 = 0 THEN ',"maybe":0' ELSE '' END || CASE c_custkey % 5 WHEN 0 THEN ',"aNumber":0' WHEN 1 THEN ',"aWord":"w"' WHEN 2 THEN ',"aWord":"both"' ELSE '' END || '}' AS j FROM customer""",
)
def _shapes(spark, sf_dir):
    k3, k5 = _key() % 3, _key() % 5
    entry = lambda key, v: pb.build([(1, "string", F.lit(key)), (2, "int32", v)])
    counts = F.array(entry("a", F.lit(-1)), entry("b", F.lit(2)), entry("a", F.col("c_nationkey").cast("int")))  # the last entry of a key wins
    kind = F.when(k3 == 1, 1).when(k3 == 2, 7)
    return _form(
        spark, sf_dir,
        [(1, "message", counts), (2, "enum", kind), (3, "int32", F.when(k5 == 0, 0).when(k5 == 2, 5)), (4, "string", F.when(k5 == 1, "w").when(k5 == 2, "both")), (5, "int32", F.when(_key() % 2 == 0, 0))],
        ".forms.Shape",
    )


# ---- descriptors


@query(
    "pb_descriptor_set",
    """SELECT n_nationkey, '[1,{"1":[{"1":"row.proto","2":"n' || n_nationkey || '","4":[{"1":"Row","2":[{"1":"' || lower(n_name) || '","3":' || n_nationkey + 1 || ',"4":1,"5":3}],"3":[{"1":"In"}]}],"12":"proto3"}]},{".n'
       || n_nationkey || '.Row":[11,"$[1].\\"1\\"[0]","$[1].\\"1\\"[0].\\"4\\"[0]"],".n' || n_nationkey || '.Row.In":[11,"$[1].\\"1\\"[0]","$[1].\\"1\\"[0].\\"4\\"[0].\\"3\\"[0]"]}]' AS j FROM nation""",
)
def _descriptors(spark, sf_dir):
    """A schema of its own for each row, compiled from descriptor bytes."""
    register_all(spark, "pb_build_descriptor_set_json")
    own = pb.build([(1, "string", F.lower("n_name")), (3, "int32", (F.col("n_nationkey") + 1).cast("int")), (4, "enum", F.lit(1)), (5, "enum", F.lit(3))])
    row = pb.build([(1, "string", F.lit("Row")), (2, "message", F.array(own)), (3, "message", F.array(pb.build([(1, "string", F.lit("In"))])))])
    whole = pb.build([(1, "string", F.lit("row.proto")), (2, "string", F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))), (4, "message", F.array(row)), (12, "string", F.lit("proto3"))])
    d = _table(spark, sf_dir, "nation").select("n_nationkey", pb.build([(1, "message", F.array(whole))]).alias("b"))
    return d.select("n_nationkey", F.call_function("pb_build_descriptor_set_json", F.col("b")).alias("j"))


@query("pb_schema_compiled_json", "SELECT n_nationkey, '{\"nationKey\":' || n_nationkey || ',\"nationName\":\"' || n_name || '\",\"regionKey\":\"' || n_regionkey || '\",\"letters\":[],\"kind\":\"KIND_ONE\",\"raw\":\"\"}' AS j FROM nation")
def _compiled(spark, sf_dir):
    """Schema text from descriptor bytes, then the SQL name of the renderer, all inside SQL."""
    register_all(spark, "pb_build_descriptor_set_json")
    register_all(spark, "pb_message_to_json")
    _nations(spark, sf_dir).createOrReplaceTempView("protolith_nation_messages")
    data = FORMS_SCHEMA.to_descriptor_set().hex()
    return spark.sql(f"SELECT n_nationkey, pb_message_to_json(pb_build_descriptor_set_json(X'{data}'), '.forms.Nation', msg) AS j FROM protolith_nation_messages")


def _nations(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", "n_regionkey",
        pb.build([(1, "int32", F.col("n_nationkey").cast("int")), (2, "string", F.col("n_name")), (3, "int64", F.col("n_regionkey").cast("bigint")), (5, "enum", F.lit(1))]).alias("msg"),
    )


# ---- JSON paths, and JSON to messages


@query("pb_json_path", "SELECT n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation WHERE n_nationkey BETWEEN 3 AND 20 GROUP BY n_regionkey")
def _path(spark, sf_dir):
    j = _nations(spark, sf_dir).select(to_json(FORMS_SCHEMA, ".forms.Nation", "msg").alias("j"))
    at = lambda p: F.get_json_object("j", f"$.{p}")
    rows = j.where(at("nationKey").cast("int").between(3, 20)).select(at("regionKey").cast("int").alias("n_regionkey"), at("nationName").alias("name"))
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("pb_json_path_array", "SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS second, 3 AS size FROM orders")
def _path_array(spark, sf_dir):
    k = (F.col("o_orderkey") % 100).cast("int")
    d = _table(spark, sf_dir, "orders").select("o_orderkey", pb.as_json_array(pb.set_repeated(pb.new(), 4, "int32", F.array(F.lit(1), k, F.lit(3)), packed=True), 4, "int32").alias("j"))
    return d.select("o_orderkey", F.get_json_object("j", "$[1]").cast("int").alias("second"), F.json_array_length("j").alias("size"))


_NATION_BYTES = """'08' || lpad(hex(n_nationkey), 2, '0') || '12' || lpad(hex(length(n_name)), 2, '0') || hex(n_name)"""
_ZERO_LEFT_OUT = """CASE WHEN n_nationkey = 0 THEN '' ELSE '08' || lpad(hex(n_nationkey), 2, '0') END || '12' || lpad(hex(length(n_name)), 2, '0') || hex(n_name)
       || CASE WHEN n_regionkey = 0 THEN '' ELSE '18' || lpad(hex(n_regionkey), 2, '0') END"""


@query("pb_json_to_message", f"SELECT n_nationkey, {_ZERO_LEFT_OUT} || '220161220162' || '2801' || '320200FF' || '3A05088907' || '1005' AS h FROM nation")
def _back(spark, sf_dir):
    """JSON as ProtoJSON writes it: 64-bit numbers as strings, enums by name, bytes in base64, a time as text."""
    text = F.format_string('{"nationKey":%d,"nationName":"%s","regionKey":"%d","letters":["a","b"],"kind":"KIND_ONE","raw":"AP8=","at":"1970-01-01T00:15:05.000000005Z"}', "n_nationkey", "n_name", "n_regionkey")
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.hex(from_json_text(FORMS_SCHEMA, ".forms.Nation", text)).alias("h"))


@query("pb_encode_struct_bytes", f"SELECT n_nationkey, {_ZERO_LEFT_OUT} || '220161' || '2801' AS h FROM nation")
def _encode_bytes(spark, sf_dir):
    s = F.struct(F.col("n_nationkey").cast("int").alias("nation_key"), F.col("n_name").alias("nation_name"), F.col("n_regionkey").cast("bigint").alias("region_key"), F.array(F.lit("a")).alias("letters"), F.lit(1).alias("kind"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.hex(to_message(FORMS_SCHEMA, ".forms.Nation", s)).alias("h"))


@query("pb_map_entry", "SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS a, true AS no_z, 2 AS size FROM customer")
def _map_entry(spark, sf_dir):
    entry = lambda key, v: pb.build([(1, "string", F.lit(key)), (2, "int32", v)])
    d = _table(spark, sf_dir, "customer").select("c_custkey", pb.build([(1, "message", F.array(entry("a", F.lit(1)), entry("b", F.lit(2)), entry("a", F.col("c_nationkey").cast("int"))))]).alias("msg"))
    s = d.withColumn("s", from_message(FORMS_SCHEMA, ".forms.Shape", "msg"))
    return s.select("c_custkey", map_value(F.col("s.counts"), "a").alias("a"), map_value(F.col("s.counts"), "z").isNull().alias("no_z"), F.size("s.counts").alias("size"))


@query("pb_repeated_search", "SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS q FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) GROUP BY l_orderkey")
def _search(spark, sf_dir):
    """The element of a repeated message field whose key field has a value, the greatest of several."""
    line = pb.build([(1, "int32", F.col("l_linenumber").cast("int")), (2, "double", F.col("l_quantity").cast("double"))])
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("m"), F.col("l_quantity"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_quantity", "m"))).alias("l")).select("l_orderkey", pb.set_repeated(pb.new(), 3, "message", F.col("l.m")).alias("msg"))
    found = orders.select("l_orderkey", where_element("msg", 3, {"number": (1, "int32", 0), "q": (2, "double", 0.0)}, "number", 2).alias("e"))
    return found.select("l_orderkey", F.col("e.q").alias("q"))


@query("pb_decode_columns", "SELECT n_nationkey, CAST(n_nationkey AS INTEGER) AS nation_key, n_name AS nation_name, CAST(n_regionkey AS BIGINT) AS region_key, 1 AS kind FROM nation")
def _decoded(spark, sf_dir):
    return decode(_nations(spark, sf_dir).select("n_nationkey", "msg"), "msg", FORMS_SCHEMA, ".forms.Nation").select("n_nationkey", "nation_key", "nation_name", "region_key", "kind")
