"""Column functions, SQL names, frames, sources and streaming on Spark."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from protolith.functions import bits, pb
from protolith.functions.descriptors import Schema
from protolith.functions.sql import register_all
from protolith.operators.frame import decode, from_message, gather, materialise, to_message, which_oneof
from protolith.plans.samples import ORDERS_SET
from protolith.sources.delimited import delimited, read_delimited, read_schema
from protolith.streaming.events import decode_events, encode_events, windowed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


NAMES = [k for k in entry.oracle_sql() if k.startswith("pb_")]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_sql_names_register(spark):
    assert register_all(spark) == 494
    row = spark.sql(
        """SELECT hex(pb_message_add_all_repeated_int32_field_elements(pb_message_new(), 7, '[10, 20, 30]', true)) AS a,
           pb_wire_json_get_repeated_int32_field_as_json_array(pb_message_to_wire_json(X'3A030A141E'), 7) AS b,
           hex(pb_wire_json_to_message(pb_wire_json_set_int32_field(pb_wire_json_new(), 1, 10))) AS c"""
    ).first()
    assert (row.a, row.b, row.c) == ("3A030A141E", "[10,20,30]", "080A")
    rows = spark.sql("SELECT i, n, t, v FROM pb_wire_json_as_table('{\"2\":[{\"i\":1,\"n\":2,\"t\":2,\"v\":\"AQ==\"}],\"1\":[{\"i\":0,\"n\":1,\"t\":0,\"v\":5}]}')").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 0, "5"), (1, 2, 2, "AQ==")]


def test_one_evaluation_and_pushdown(spark, tmp_path):
    d = spark.range(100).withColumn("m", pb.build([(1, "int64", F.col("id"))]))
    rows = materialise(d, "m", {"v": (1, "int64", 0)})
    plan = rows.where("v > 5").select("v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # building and extracting fuse, the filter does not repeat them
    rows.write.parquet(str(tmp_path / "x"))
    plan = spark.read.parquet(str(tmp_path / "x")).where("v > 5").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,5)" in plan and "ReadSchema: struct<v:bigint>" in plan


def test_struct_round_trip_with_maps_and_nesting(spark):
    text = '[1,{"1":[{"1":"x.proto","2":"x","4":[{"1":"A","2":[{"1":"m","3":1,"4":3,"5":11,"6":".x.A.MEntry"},{"1":"kids","3":2,"4":3,"5":11,"6":".x.A"},{"1":"v","3":3,"4":1,"5":17,"9":0,"17":true}],"3":[{"1":"MEntry","2":[{"1":"key","3":1,"4":1,"5":9},{"1":"value","3":2,"4":1,"5":5}],"7":{"7":true}}],"8":[{"1":"_v"}]}],"12":"proto3"}]},{}]'
    schema = Schema.from_json(text)
    kid = "named_struct('m', map('k', 1), 'v', -3)"
    d = spark.sql(f"SELECT named_struct('m', map('a', 5, 'b', 0), 'kids', array({kid}, {kid}), 'v', cast(null as int)) AS s")
    row = d.select(to_message(schema, ".x.A", "s").alias("msg")).select(from_message(schema, ".x.A", "msg", depth=3).alias("s")).first().s
    assert row.m == {"a": 5, "b": 0} and row.v is None and [k.v for k in row.kids] == [-3, -3] and row.kids[0].m == {"k": 1}
    dup = spark.createDataFrame([(bytes.fromhex("0a050a016110010a050a01611002"),), (None,)], "msg binary")
    assert [r.s and r.s.m for r in dup.select(from_message(schema, ".x.A", "msg", depth=1).alias("s")).collect()] == [{"a": 2}, None]


def test_decode_gather_and_oneof(spark):
    d = spark.createDataFrame([(1, 2, 20), (1, 1, 10), (2, 1, 5)], "k int, o int, v long")
    got = {r.k: r.l for r in gather(d, ["k"], "o", 7, "int64", "v").select("k", pb.get_repeated("message", 7, "int64").alias("l")).collect()}
    assert got == {1: [10, 20], 2: [5]}
    m = spark.createDataFrame([(bytes.fromhex("08011202616210" + "05"),)], "msg binary")
    assert m.select(which_oneof("msg", {"a": 1, "b": 2}).alias("w")).first().w == "b"
    order = spark.createDataFrame([(1, bytes.fromhex("08051201411a02080a22020102"))], "id int, msg binary")
    row = decode(order, "msg", Schema.from_json(ORDERS_SET), ".shop.Order").first()
    assert (row.id, row.order_key, row.status, row.placed.seconds, row.lines, row.kind, row.note) == (1, 5, "A", 10, [1, 2], 0, "")


def test_delimited_files(spark, tmp_path):
    d = spark.range(3).select(delimited(pb.build([(1, "int64", F.col("id"))])).alias("f"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.binpb").write_bytes(b"".join(bytes(r.f) for r in d.orderBy("f").collect()))
    (tmp_path / "in" / "empty.binpb").write_bytes(b"")
    rows = read_delimited(spark, str(tmp_path / "in")).select("position", pb.get("message", 1, "int64", -1).alias("v")).orderBy("position").collect()
    assert [(r.position, r.v) for r in rows] == [(0, 0), (1, 1), (2, 2)]
    (tmp_path / "set.pb").write_bytes(bytes.fromhex("0a0b0a017812017822030a0154"))
    assert ".x.T" in read_schema(spark, str(tmp_path / "set.pb")).messages


def test_bits(spark):
    d = spark.sql("SELECT cast(-1 as bigint) a, X'FFFFFFFE' b, cast(1.5 as double) c")
    row = d.select(
        bits.zigzag_encode(F.col("a")).alias("z"), bits.bin_as_int32(F.col("b")).alias("i"), bits.uint64_as_decimal(F.col("a")).alias("u"), bits.uint64_as_double(bits.double_as_uint64(F.col("c"))).alias("d"),
        bits.uint64_as_double(F.lit(0x7FF0000000000000)).alias("inf"), bits.swap_endian_32(F.lit(1).cast("bigint")).alias("s"), bits.wire_type_name(F.lit(2)).alias("w"), F.hex(bits.uint32_to_bin(F.lit(258).cast("bigint"))).alias("h"),
    ).first()
    assert (row.z, row.i, int(row.u), row.d, row.inf, row.s, row.w, row.h) == (1, -2, (1 << 64) - 1, 1.5, None, 1 << 24, "LEN", "00000102")


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    encode_events(events).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = windowed(decode_events(spark.read.parquet(str(tmp_path / "in")))).collect()
    stream = spark.readStream.schema("ts timestamp, msg binary").parquet(str(tmp_path / "in"))
    q = windowed(decode_events(stream), delay="10000 days").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(repr, spark.table("windows").collect())) == sorted(map(repr, batch))


def test_json_text_to_messages(spark):
    from protolith.operators.frame import from_json_text
    from protolith.plans.samples import FORMS_SCHEMA

    rows = [('{"nationKey":3,"kind":"7","extra":1}',), ('{"kind":"KIND_ONE","at":"1969-12-31T23:59:59.5Z","letters":["é"]}',), ("{}",), (None,), ("no json",)]
    d = spark.createDataFrame(rows, "j string").select(F.hex(from_json_text(FORMS_SCHEMA, ".forms.Nation", "j")).alias("h"))
    assert [r.h for r in d.collect()] == ["08032807", "2202C3A928013A1108FFFFFFFFFFFFFFFFFF01" + "1080CAB5EE01", "", None, None]


def test_entry_without_the_pipeline_or_the_subpackage(spark, tmp_path):
    """The entry file alone decides what is there: each part can be missing by itself."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for gone, left in ((("protolith/llm",), "pipeline"), (("corpus_pipeline.py", "protolith/llm"), None), (("corpus_pipeline.py",), "op5_secrets")):
        copy = tmp_path / "-".join(gone).replace("/", "_")
        copy.mkdir()
        for name in ("protolith", "__spark_entry__.py", "corpus_pipeline.py"):
            (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", copy / name)
        for name in gone:
            (shutil.rmtree if os.path.isdir(copy / name) else os.remove)(copy / name)
        code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print('pb_get_int32' in q, 'op5_secrets' in q, 'pipeline' in q)"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=100, env={**os.environ, "PYTHONPATH": str(copy)})
        assert said.stdout.split() == ["True", str(left == "op5_secrets"), "False"], said.stderr


def test_streamed_sessions_equal_batch(spark, tmp_path):
    from protolith.streaming.events import sessions

    events = spark.read.parquet(f"{SF}/events.parquet")
    encode_events(events).write.parquet(str(tmp_path / "in"))
    batch = sessions(decode_events(spark.read.parquet(str(tmp_path / "in"))), "6 hours").collect()
    stream = spark.readStream.schema("ts timestamp, msg binary").parquet(str(tmp_path / "in"))
    q = sessions(decode_events(stream), "6 hours", "10000 days").writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(repr, spark.table("sessions").collect())) == sorted(map(repr, batch))
