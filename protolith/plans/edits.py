"""Every family on every type, as queries: reads and edits at the first, middle and last place, in both
encodings and both representations. DuckDB does the same to lists of the shown values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bits, pb
from ..functions.sql import register_all
from ..functions.types import TYPES
from ..operators.frame import gather
from .catalog import _GET, _table, lineitems, query

_INT = ("CAST(v AS STRING)", "CAST({v} AS VARCHAR)")
_HEX = ("hex(v)", "hex({v})")
#: type -> (value of a line for Spark, the same for DuckDB, how both show it, a new value, how that shows).
VALUES = {
    "int32": ("CAST(l_suppkey - 50 AS INT)", "l_suppkey - 50", *_INT, -77, "-77"),
    "int64": ("l_partkey * 1000000007", "l_partkey * 1000000007", *_INT, -(1 << 62), str(-(1 << 62))),
    "uint32": ("l_partkey", "l_partkey", *_INT, 4294967295, "4294967295"),
    "uint64": ("l_partkey", "l_partkey", *_INT, 1 << 62, str(1 << 62)),
    "sint32": ("CAST(-l_suppkey AS INT)", "-l_suppkey", *_INT, -2147483648, "-2147483648"),
    "sint64": ("-l_partkey", "-l_partkey", *_INT, -5, "-5"),
    "enum": ("CAST(l_linenumber AS INT)", "l_linenumber", *_INT, 9, "9"),
    "bool": ("l_linestatus = 'O'", "l_linestatus = 'O'", *_INT, True, "true"),
    "fixed32": ("l_partkey", "l_partkey", *_INT, 4294967295, "4294967295"),
    "sfixed32": ("CAST(-l_partkey AS INT)", "-l_partkey", *_INT, -1, "-1"),
    "float": ("CAST(l_quantity AS FLOAT)", "CAST(l_quantity AS FLOAT)", "CAST(CAST(v AS BIGINT) AS STRING)", "CAST(CAST({v} AS BIGINT) AS VARCHAR)", 3.0, "3"),
    "fixed64": ("l_orderkey + l_partkey", "l_orderkey + l_partkey", *_INT, 7, "7"),
    "sfixed64": ("-l_partkey", "-l_partkey", *_INT, -(1 << 60), str(-(1 << 60))),
    "double": ("l_extendedprice", "l_extendedprice", "CAST(CAST(floor(v * 100 + 0.5) AS BIGINT) AS STRING)", "CAST(CAST(floor({v} * 100 + 0.5) AS BIGINT) AS VARCHAR)", 1.25, "125"),
    "string": ("concat(l_returnflag, 'é', l_linestatus)", "concat(l_returnflag, 'é', l_linestatus)", "v", "{v}", "naïve", "naïve"),
    "bytes": ("CAST(concat(l_returnflag, l_linestatus) AS BINARY)", "concat(l_returnflag, l_linestatus)", *_HEX, b"\x00\xff", "00FF"),
    "message": ("unhex(concat('08', lpad(hex(l_linenumber), 2, '0')))", "unhex(concat('08', lpad(hex(l_linenumber), 2, '0')))", *_HEX, b"\x08\x05", "0805"),
}
SHOWN_AS_JSON = {"bool", "string"} | {k for k, v in VALUES.items() if v[2] == _INT[0]}


def _places() -> tuple[Column, Column, Column]:
    """The first, middle and last place, by the number of lines: an index that a Python function counts would have to leave its worker and come back."""
    return F.lit(0), F.floor(F.col("size") / 2).cast("int"), F.col("size") - 1


def _edits(m: Column, type_name: str, packed: bool, kind: str) -> dict[str, Column]:
    new = VALUES[type_name][4]
    first, middle, last = _places()
    two = F.array(*[F.lit(bytes(new) if isinstance(new, bytes) else new).cast(TYPES[type_name].spark)] * 2)
    return {
        "same": m,
        "added": pb.add(m, 7, type_name, new, packed=packed, kind=kind),
        "added_all": pb.add_all(m, 7, type_name, two, packed=packed, kind=kind),
        **{f"inserted_{x}": pb.insert(m, 7, type_name, k, new, packed=packed, kind=kind) for x, k in (("first", first), ("middle", middle), ("last", F.col("size")))},
        **{f"replaced_{x}": pb.replace(m, 7, type_name, k, new, kind=kind) for x, k in (("first", first), ("middle", middle), ("last", last))},
        **{f"removed_{x}": pb.remove(m, 7, type_name, k, kind=kind) for x, k in (("first", first), ("middle", middle), ("last", last))},
        "cleared": pb.clear(m, 7, type_name, kind=kind),
        "cleared_all": pb.clear_repeated(m, 7, type_name, kind=kind),
        "reset": pb.set_repeated(m, 7, type_name, two, packed=packed, kind=kind),
        "single": pb.set(m, 7, type_name, new, kind=kind),
    }


def _lists_sql(type_name: str) -> str:
    _, value, _, show, _, new = VALUES[type_name]
    x, k = f"['{new}']", "CAST(floor(len(l) / 2) AS BIGINT)"
    lists = {
        "same": "l", "added": f"list_concat(l, {x})", "added_all": f"list_concat(l, list_concat({x}, {x}))",
        "inserted_first": f"list_concat({x}, l)", "inserted_middle": f"list_concat(list_concat(l[1:{k}], {x}), l[{k} + 1:])", "inserted_last": f"list_concat(l, {x})",
        "replaced_first": f"list_concat({x}, l[2:])", "replaced_middle": f"list_concat(list_concat(l[1:{k}], {x}), l[{k} + 2:])", "replaced_last": f"list_concat(l[1:len(l) - 1], {x})",
        "removed_first": "l[2:]", "removed_middle": f"list_concat(l[1:{k}], l[{k} + 2:])", "removed_last": "l[1:len(l) - 1]",
        "cleared": "CAST([] AS VARCHAR[])", "cleared_all": "CAST([] AS VARCHAR[])", "reset": f"list_concat({x}, {x})", "single": x,
    }
    shown = ", ".join(f"coalesce(array_to_string({e}, ','), '') AS {c}" for c, e in lists.items())
    element = f"CAST(len(l) AS INTEGER) AS n, l[1] AS e_first, l[{k} + 1] AS e_middle, l[len(l)] AS e_last"
    mark = '"' if type_name == "string" else ""
    json = f", '[{mark}' || array_to_string(l, '{mark},{mark}') || '{mark}]' AS json" if type_name in SHOWN_AS_JSON else ""
    rows = f"SELECT l_orderkey, list({show.format(v='x')} ORDER BY l_linenumber, x) AS l FROM (SELECT *, {value} AS x FROM lineitem) GROUP BY l_orderkey"
    return f"WITH p AS ({rows}) SELECT l_orderkey, {element}, {shown}{json} FROM p"


def _edit_query(type_name: str, packed: bool, kind: str):
    value, _, show, *_ = VALUES[type_name]

    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "lineitem").withColumn("x", F.expr(value))
        # evaluated once: all edits read the same column
        held = gather(rows, ["l_orderkey"], "l_linenumber", 7, type_name, "x", packed, "msg", count="size", once=kind == pb.MESSAGE)
        if kind == pb.WIRE_JSON:
            held = held.withColumn("msg", pb.wire_json("msg", once=True))
        m = F.col("msg")
        if show == _INT[0]:  # one text leaves the worker in place of an array, whose decimals cost more than the edit
            many = lambda edited: F.btrim(pb.as_json_array(edited, 7, type_name, kind=kind), F.lit("[]"))
        else:
            many = lambda edited: F.array_join(F.transform(pb.get_repeated(edited, 7, type_name, kind=kind), lambda v: _shown(show, v)), ",")
        n = pb.count(m, 7, type_name, kind=kind)
        at = dict(zip(("e_first", "e_middle", "e_last"), _places(), strict=True))
        json = [pb.as_json_array(m, 7, type_name, kind=kind).alias("json")] if type_name in SHOWN_AS_JSON else []
        return held.select(
            "l_orderkey", n.alias("n"), *(_shown(show, pb.element(m, 7, type_name, k, kind=kind)).alias(c) for c, k in at.items()),
            *(many(e).alias(c) for c, e in _edits(m, type_name, packed, kind).items()), *json,
        )

    return run


def _shown(show: str, v: Column) -> Column:
    """The Spark side of how a value shows, as a column of a lambda's variable."""
    if show == "v":
        return v
    if show == _HEX[0]:
        return F.hex(v)
    if show == _INT[0]:
        return v.cast("string")
    return (F.floor(v * 100 + 0.5) if "floor" in show else v).cast("bigint").cast("string")


for _name in VALUES:
    _packable = TYPES[_name].packable
    query(f"pb_edit_{_name}", _lists_sql(_name))(_edit_query(_name, _packable, pb.MESSAGE))
    if _packable:
        query(f"pb_edit_{_name}_unpacked", _lists_sql(_name))(_edit_query(_name, False, pb.MESSAGE))
    query(f"pb_edit_{_name}_wire_json", _lists_sql(_name))(_edit_query(_name, _packable, pb.WIRE_JSON))


# ---- single fields of wire JSON, and presence


def _wire_getter(type_name: str, n: int, default):
    def run(spark, sf_dir):
        j = pb.wire_json("msg")
        v = pb.get(j, n, type_name, default, kind="wire_json")
        wide = {"uint64": "bigint", "fixed64": "bigint", "float": "double"}.get(type_name)
        return lineitems(spark, sf_dir).select(
            "l_orderkey", "l_linenumber", (v.cast(wide) if wide else v).alias("v"),
            pb.has(j, n, type_name, kind="wire_json").alias("there"), pb.has(j, 99, type_name, kind="wire_json").alias("absent"),
        )

    return run


for _name, (_n, _default, _sql) in _GET.items():
    query(f"pb_wire_json_get_{_name}", f"SELECT l_orderkey, l_linenumber, {_sql} AS v, true AS there, false AS absent FROM lineitem")(_wire_getter(_name, _n, _default))

_FIELDS = {**{k: v[0] for k, v in _GET.items()}, "bytes": 11}


@query("pb_has_every_type", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"true AS has_{k}, false AS no_{k}" for k in _FIELDS) + " FROM lineitem")
def _has(spark, sf_dir):
    some = [c for k, n in _FIELDS.items() for c in (pb.has("msg", n, k).alias(f"has_{k}"), pb.has("msg", 99, k).alias(f"no_{k}"))]
    return lineitems(spark, sf_dir).select("l_orderkey", "l_linenumber", *some)


@query("pb_defaults_of_every_type", "SELECT l_orderkey, l_linenumber, -7 AS d_int, 'none' AS d_text, true AS d_bool, CAST(2.5 AS DOUBLE) AS d_double, true AS d_null FROM lineitem")
def _defaults(spark, sf_dir):
    return lineitems(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", pb.get("msg", 99, "sint32", -7).alias("d_int"), pb.get("msg", 99, "string", "none").alias("d_text"),
        pb.get("msg", 99, "bool", True).alias("d_bool"), pb.get("msg", 99, "double", 2.5).alias("d_double"), pb.get("msg", 99, "bytes").isNull().alias("d_null"),
    )


# ---- bit utilities as columns, each against arithmetic

_SWAP = "+".join(f"(((p >> {8 * k}) & 255) << {24 - 8 * k})" for k in range(4))


@query(
    "pb_bits_columns",
    f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN p = 0 THEN 0 ELSE 2 * p - 1 END AS zig, -s - 1 AS zag, {_SWAP} AS swap32, p * 72057594037927936 // 1 AS swap64_low,
           lpad(hex(p), 8, '0') AS bin32, lpad(hex(p), 16, '0') AS bin64, p AS from32, p AS from64, -s AS signed32, CASE WHEN s = 0 THEN 0 ELSE 4294967296 - s END AS unsigned32, p // 8 AS number, p % 8 AS wire FROM q WHERE p < 128""",
)
def _bit_columns(spark, sf_dir):
    q = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).where("p < 128")
    p, s = F.col("p"), F.col("s")
    return q.select(
        "l_orderkey", "l_linenumber", bits.zigzag_encode(-p).alias("zig"), bits.zigzag_decode(2 * s + 1).alias("zag"), bits.swap_endian_32(p).alias("swap32"),
        bits.swap_endian_64(p).alias("swap64_low"), F.hex(bits.uint32_to_bin(p)).alias("bin32"), F.hex(bits.uint64_to_bin(p)).alias("bin64"),
        bits.bin_as_uint32(bits.uint32_to_bin(p)).alias("from32"), bits.bin_as_int64(bits.uint64_to_bin(p)).alias("from64"),
        bits.bin_as_int32(F.unhex(F.lpad(F.hex(bits.int32_as_uint32(-s)), 8, "0"))).cast("bigint").alias("signed32"), bits.int32_as_uint32((-s).cast("int")).alias("unsigned32"),
        bits.field_number(p).alias("number"), bits.wire_type(p).alias("wire"),
    )


# 1.0, 2.0, 4.0, ... have nothing but an exponent: their bits follow by arithmetic
@query(
    "pb_bits_ieee",
    """SELECT c_custkey, (1023 + c_custkey % 60) * 4503599627370496 AS d_bits, (127 + c_custkey % 60) * 8388608 AS f_bits,
       CAST(1::BIGINT << (c_custkey % 60) AS DOUBLE) AS d, CAST(1::BIGINT << (c_custkey % 60) AS DOUBLE) AS f, true AS inf_is_null FROM customer""",
)
def _ieee(spark, sf_dir):
    k = F.col("c_custkey") % 60
    power = F.pow(F.lit(2.0), k)
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", bits.double_as_uint64(power).alias("d_bits"), bits.float_as_uint32(power.cast("float")).alias("f_bits"),
        bits.uint64_as_double((1023 + k) * (1 << 52)).alias("d"), bits.uint32_as_float((127 + k) * (1 << 23)).cast("double").alias("f"),
        bits.uint64_as_double(F.lit(0x7FF0000000000000)).isNull().alias("inf_is_null"),
    )


@query(
    "pb_bits_narrowing",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INTEGER) AS i, CAST(-l_partkey AS INTEGER) AS n, l_partkey AS u, CAST(l_partkey AS VARCHAR) AS d, l_partkey AS back,
       CASE l_partkey % 6 WHEN 0 THEN 'VARINT' WHEN 1 THEN 'I64' WHEN 2 THEN 'LEN' WHEN 3 THEN 'SGROUP' WHEN 4 THEN 'EGROUP' ELSE 'I32' END AS w FROM lineitem""",
)
def _narrow(spark, sf_dir):
    p = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", bits.uint64_as_int32(p).alias("i"), bits.int64_as_int32(-p).alias("n"), bits.uint64_as_uint32(p).alias("u"),
        bits.uint64_as_decimal(bits.int64_as_uint64(p)).cast("string").alias("d"), bits.decimal_as_uint64(p.cast("decimal(20,0)")).alias("back"), bits.wire_type_name(p % 6).alias("w"),
    )


# ---- SQL names that take wire JSON


@query("pb_wire_json_table", "SELECT c_custkey, unnest([0, 1, 2]) AS i, unnest([1, 2, 3]) AS n, unnest([0, 2, 0]) AS t, unnest([CAST(c_custkey AS VARCHAR), to_base64(encode(c_name)), CAST(c_nationkey AS VARCHAR)]) AS v FROM customer")
def _wire_json_table(spark, sf_dir):
    register_all(spark, "pb_wire_json_as_table")
    d = _table(spark, sf_dir, "customer").select("c_custkey", pb.wire_json(pb.build([(1, "int64", F.col("c_custkey")), (2, "string", F.col("c_name")), (3, "int32", F.col("c_nationkey"))])).alias("j"))
    d.createOrReplaceTempView("protolith_wire_texts")
    return spark.sql("SELECT c_custkey, w.i, w.n, w.t, w.v FROM protolith_wire_texts, LATERAL pb_wire_json_as_table(j) w")


@query("pb_wire_json_new", "SELECT n_nationkey, '{}' AS j, '08' || lpad(hex(n_nationkey), 2, '0') AS h, '' AS nothing FROM nation")
def _wire_json_new(spark, sf_dir):
    for name in ("pb_wire_json_new", "pb_wire_json_set_int32_field", "pb_wire_json_to_message", "pb_message_new"):
        register_all(spark, name)
    _table(spark, sf_dir, "nation").createOrReplaceTempView("protolith_nations")
    return spark.sql(
        """SELECT n_nationkey, pb_wire_json_new() AS j, hex(pb_wire_json_to_message(pb_wire_json_set_int32_field(pb_wire_json_new(), 1, CAST(n_nationkey AS INT)))) AS h,
           hex(pb_message_new()) AS nothing FROM protolith_nations"""
    )
