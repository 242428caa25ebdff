"""Kernels against golden bytes and against google.protobuf on random messages."""

import json
import random
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from protolith.functions import families as FA
from protolith.functions import wire as W
from protolith.functions import wirejson as J
from protolith.functions.types import TYPES, WIDE, WireError

pb2 = pytest.importorskip("google.protobuf.descriptor_pb2")
from google.protobuf import descriptor_pool, json_format, message_factory  # noqa: E402

h = bytes.fromhex


def call(family, t, messages, *args, kind="message", **o):
    out = FA.implement(kind, family, TYPES[t], **o)(pa.array(messages, pa.binary() if kind == "message" else pa.string()), *args)
    return out.to_pylist()


def n(k, rows=1):
    return pa.array([k] * rows)


GOLDEN = [
    ("10ffffffff07", 2, "uint32", 2147483647), ("108080808008", 2, "uint32", 2147483648), ("10ffffffff0f", 2, "uint32", 4294967295),
    ("20ffffffffffffffffff01", 4, "uint64", Decimal(18446744073709551615)), ("48feffffff0f", 9, "sint32", 2147483647), ("4801", 9, "sint32", -1), ("48ffffffff0f", 9, "sint32", -2147483648),
    ("50feffffffffffffffff01", 10, "sint64", 9223372036854775807), ("08ffffffffffffffffff01", 1, "int32", -1), ("0880808080f8ffffffff01", 1, "int32", -2147483648),
    ("18ffffffffffffffff7f", 3, "int64", 9223372036854775807), ("2a03616263", 5, "string", "abc"), ("2a03616263", 5, "bytes", b"abc"), ("0801", 1, "bool", True), ("2805", 5, "enum", 5),
    ("85010000c03f", 16, "float", 1.5), ("69000000000000f83f", 13, "double", 1.5), ("590000000000000080", 11, "sfixed64", -(1 << 63)), ("61ffffffffffffffff", 12, "fixed64", Decimal((1 << 64) - 1)),
    ("75ffffff7f", 14, "sfixed32", 2147483647), ("7500000080", 14, "sfixed32", -2147483648), ("7dffffffff", 15, "fixed32", 4294967295), ("4202080a", 8, "message", h("080a")),
]


@pytest.mark.parametrize("text,number,t,value", GOLDEN)
def test_golden_values_both_ways(text, number, t, value):
    m = h(text)
    zero = pa.nulls(1, TYPES[t].arrow)
    assert call("get", t, [m], n(number), zero) == [value]
    assert call("has", t, [m], n(number)) == [True]
    assert call("set", t, [b""], n(number), pa.array([value], TYPES[t].arrow)) == [m]
    wj = FA.to_wire_json(pa.array([m])).to_pylist()
    assert call("get", t, wj, n(number), zero, kind="wire_json") == [value]
    assert FA.from_wire_json(pa.array(wj)).to_pylist() == [m]


def test_nulls_defaults_and_errors():
    assert call("get", "int32", [None, b""], n(1, 2), pa.array([7, None], pa.int32())) == [7, None]
    assert call("has", "int32", [None], n(1)) == [False]
    assert call("count", "int32", [None], n(1)) == [0]
    assert call("json_array", "int32", [None], n(1)) == ["[]"]
    assert call("set", "int32", [None], n(1), pa.array([1])) == [h("0801")]
    for bad in ("08", "0a05ab", "0d0000", "0880808080808080808080808001", "00", "0b"):
        with pytest.raises(WireError):
            call("get", "int32", [h(bad)], n(9), pa.array([0]))
        assert call("get", "int32", [h(bad)], n(9), pa.array([0]), on_error="null") == [None]
    with pytest.raises(WireError):  # a packed field is no singular one
        call("get", "int32", [h("3a03010203")], n(7), pa.array([0]))
    with pytest.raises(WireError):
        call("get", "int32", [h("08ffffffffffffffff7f")], n(1), pa.array([0]))
    with pytest.raises(WireError, match="repeated index out of range"):
        call("element", "int32", [h("3a03010203")], n(7), n(3))
    assert call("element", "int32", [h("3a03010203")], n(7), n(-1)) == [None]
    with pytest.raises(WireError, match="Index out of bounds"):
        call("remove", "int32", [h("3a03010203")], n(7), n(3))
    with pytest.raises(WireError):
        call("set", "int32", [b""], n(1), pa.array([None], pa.int32()))
    with pytest.raises(WireError):
        call("get", "string", [h("0a01ff")], n(1), pa.array([""]))
    assert call("get", "double", [h("09000000000000f07f")], n(1), pa.array([1.0])) == [None]
    assert call("set", "float", [b""], n(1), pa.array([None], pa.float32())) == [h("0d0000c07f")]


def test_wire_json_keeps_ordinals():
    wj = ['{"1":[{"i":0,"n":1,"t":0,"v":10}]}']
    assert json.loads(call("set", "int32", wj, n(1), pa.array([99]), kind="wire_json")[0]) == {"1": [{"i": 1, "n": 1, "t": 0, "v": 99}]}
    assert FA.from_wire_json(pa.array(['{"1":[{"i":2,"n":1,"t":0,"v":20}],"2":[{"i":1,"n":2,"t":0,"v":10}],"3":[{"i":0,"n":3,"t":0,"v":30}]}'])).to_pylist() == [h("181e100a0814")]
    assert call("clear", "int32", [None], n(1), kind="wire_json") == [None]


def test_slices_and_empty_batches():
    a = pa.array([h("0801"), None, h("0803"), h("0804")], pa.binary()).slice(1, 2)
    assert FA.implement("message", "get", TYPES["int32"])(a, n(1, 2), n(0, 2)).to_pylist() == [0, 3]
    assert FA.implement("message", "get", TYPES["int32"])(pa.array([], pa.binary()), n(1, 0).cast(pa.int64()), pa.array([], pa.int32())).to_pylist() == []
    assert FA.implement("message", "get", TYPES["int32"])(a.cast(pa.large_binary()), n(1, 2), n(0, 2)).to_pylist() == [0, 3]


# ---- random messages

KINDS = {k: getattr(pb2.FieldDescriptorProto, f"TYPE_{k.upper()}") for k in TYPES if k not in ("message", "enum")}


def factory(kind: str, packed: bool):
    f = pb2.FileDescriptorProto(name=f"{kind}{packed}.proto", package=f"p{kind}{packed}", syntax="proto3")
    m = f.message_type.add(name="Test")
    m.field.add(name="a", number=1, type=KINDS["int32"], label=1)
    v = m.field.add(name="value", number=2, type=KINDS[kind], label=3)
    if TYPES[kind].packable:
        v.options.packed = packed
    m.field.add(name="b", number=3, type=KINDS["string"], label=1)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{f.package}.Test"))


def values(rng: random.Random, kind: str, k: int):
    t = TYPES[kind]
    if kind in ("string", "bytes"):
        s = ["".join(rng.choice("aé漢z") for _ in range(rng.randint(0, 5))) for _ in range(k)]
        return [x.encode() for x in s] if kind == "bytes" else s
    if kind == "bool":
        return [rng.random() < 0.5 for _ in range(k)]
    if kind == "float":
        return [struct.unpack("<f", struct.pack("<f", rng.uniform(-1e6, 1e6)))[0] for _ in range(k)]
    if kind == "double":
        return [rng.choice((0.0, -0.0, rng.uniform(-1e300, 1e300), 5e-324)) for _ in range(k)]
    size = 64 if kind in WIDE else 32
    low, high = (0, (1 << size) - 1) if kind[0] in "uf" else (-(1 << size - 1), (1 << size - 1) - 1)
    return [rng.choice((low, high, 0, 1, rng.randint(low, high))) for _ in range(k)]


def arrow(kind, v):
    return pa.array([Decimal(x) for x in v] if TYPES[kind].arrow == pa.decimal128(20, 0) else v, TYPES[kind].arrow)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("kind", sorted(KINDS))
def test_families_match_protobuf(kind, packed):
    cls, rng, t = factory(kind, packed), random.Random(f"{kind}{packed}"), TYPES[kind]
    rows = 20
    lists = [values(rng, kind, rng.randint(1, 4)) for _ in range(rows)]
    make = lambda v: cls(a=rng.randint(0, 9), value=v, b="x" * rng.randint(0, 3))
    messages = [make(v) for v in lists]
    raw = [m.SerializeToString() for m in messages]
    new, more = values(rng, kind, rows), [values(rng, kind, rng.randint(0, 3)) for _ in range(rows)]
    at = [rng.randrange(len(v)) for v in lists]
    p = (pa.array([packed] * rows),) if t.packable else ()
    k, number = pa.array(at), n(2, rows)
    many = pa.array([arrow(kind, v).to_pylist() for v in more], pa.list_(t.arrow))
    same = lambda x, y: repr(x) == repr(y)  # noqa: E731  signed zeros count

    assert call("count", kind, raw, number) == [len(v) for v in lists]
    assert same(call("element", kind, raw, number, k), arrow(kind, [v[i] for v, i in zip(lists, at, strict=True)]).to_pylist())
    assert same(call("json_array", kind, raw, number, as_list=True), [arrow(kind, v).to_pylist() for v in lists])
    cases = [
        ("add", (arrow(kind, new), *p), [[*v, x] for v, x in zip(lists, new, strict=True)]),
        ("add_all", (many, *p), [[*v, *x] for v, x in zip(lists, more, strict=True)]),
        ("set_repeated", (many, *p), more),
        ("insert", (k, arrow(kind, new), *p), [[*v[:i], x, *v[i:]] for v, i, x in zip(lists, at, new, strict=True)]),
        ("replace", (k, arrow(kind, new)), [[*v[:i], x, *v[i + 1 :]] for v, i, x in zip(lists, at, new, strict=True)]),
        ("remove", (k,), [v[:i] + v[i + 1 :] for v, i in zip(lists, at, strict=True)]),
        ("clear", (), [[] for _ in lists]),
        ("clear_repeated", (), [[] for _ in lists]),
    ]
    wj = FA.to_wire_json(pa.array(raw)).to_pylist()
    for family, args, want in cases:
        got = call(family, kind, raw, number, *args)
        for g, m, v in zip(got, messages, want, strict=True):
            out = cls.FromString(g)
            assert repr(list(out.value)) == repr(list(cls(value=v).value)) and out.a == m.a and out.b == m.b, (family, g)
        texts = call(family, kind, wj, number, *args, kind="wire_json")
        assert FA.from_wire_json(pa.array(texts)).to_pylist() == got, family


def test_all_public_names():
    from protolith.functions.families import public_names

    names = [x[0] for x in public_names()]
    assert len(names) == len(set(names)) == 486  # and 8 single ones in sql.py


def test_random_bytes_never_crash():
    rng = np.random.RandomState(4)
    junk = [rng.bytes(rng.randint(0, 30)) for _ in range(3000)]
    e, bad = W.parse(pa.array(junk, pa.binary()))
    assert e.rows == 3000 and (bad != 0).any()
    for t in TYPES:
        call("json_array", t, junk, n(1, 3000), on_error="null")


def test_round_trip():
    rng = random.Random(8)
    cls = factory("sint64", True)
    raw = [cls(a=rng.randint(-9, 9), value=values(rng, "sint64", 3), b="é" * 70).SerializeToString() for _ in range(50)]
    assert J.render(W.parse(pa.array(raw))[0]).to_pylist() == FA.to_wire_json(pa.array(raw)).to_pylist()
    assert FA.from_wire_json(FA.to_wire_json(pa.array(raw))).to_pylist() == raw


def test_json_matches_protojson():
    from google.protobuf import duration_pb2, struct_pb2, timestamp_pb2, wrappers_pb2

    from protolith.functions.descriptors import Schema
    from protolith.functions.protojson import Renderer

    fds = pb2.FileDescriptorSet()
    for m in (timestamp_pb2, duration_pb2, struct_pb2, wrappers_pb2, pb2):
        m.DESCRIPTOR.CopyToProto(fds.file.add())
    f = fds.file.add(name="t.proto", package="t", syntax="proto3", dependency=[x.name for x in fds.file])
    kind = f.enum_type.add(name="E")
    kind.value.add(name="E_ZERO", number=0)
    kind.value.add(name="E_ONE", number=1)
    t = f.message_type.add(name="T")
    for k, (name, code) in enumerate(KINDS.items(), 1):
        t.field.add(name=f"f_{name}", number=k, type=code, label=1)
        t.field.add(name=f"r_{name}", number=100 + k, type=code, label=3)
    t.field.add(name="e", number=50, type=14, type_name=".t.E", label=1)
    t.oneof_decl.add(name="one")
    t.field.add(name="one_a", number=60, type=KINDS["int32"], label=1, oneof_index=0)
    t.field.add(name="one_b", number=61, type=KINDS["string"], label=1, oneof_index=0)
    t.field.add(name="at", number=70, type=11, type_name=".google.protobuf.Timestamp", label=1)
    t.field.add(name="took", number=71, type=11, type_name=".google.protobuf.Duration", label=1)
    t.field.add(name="any_value", number=72, type=11, type_name=".google.protobuf.Value", label=1)
    t.field.add(name="big", number=73, type=11, type_name=".google.protobuf.Int64Value", label=1)
    entry = t.nested_type.add(name="MEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, type=KINDS["bool"], label=1)
    entry.field.add(name="value", number=2, type=11, type_name=".t.T", label=1)
    t.field.add(name="m", number=80, type=11, type_name=".t.T.MEntry", label=3)
    pool = descriptor_pool.DescriptorPool()
    for x in fds.file:
        pool.Add(x)
    cls = message_factory.GetMessageClass(pool.FindMessageTypeByName("t.T"))
    schema, rng = Schema.from_descriptor_set(fds.SerializeToString()), random.Random(5)
    assert Schema.from_json(schema.to_json()).to_json() == schema.to_json()
    shown = Renderer(schema)
    # floats are shown widened to double, so only short ones are the same text
    some = lambda name, k: [rng.randint(-9999, 9999) / 4 for _ in range(k)] if name == "float" else values(rng, name, k)
    for _ in range(60):
        m = cls(e=rng.choice((0, 1, 7)))
        for name in KINDS:
            if rng.random() < 0.5:
                setattr(m, f"f_{name}", some(name, 1)[0])
            getattr(m, f"r_{name}").extend(some(name, rng.randint(0, 2)))
        if rng.random() < 0.5:
            m.one_a = rng.choice((0, 5))
        elif rng.random() < 0.5:
            m.one_b = ""
        m.at.seconds, m.at.nanos = rng.randint(-10**10, 10**10), rng.choice((0, 89_000_000, 5, 120_000))
        m.took.seconds, m.took.nanos = -rng.randint(0, 99), -rng.choice((0, 1_000_000))
        json_format.ParseDict(rng.choice(({"a": [1, None, "x"]}, None, True, 2.5)), m.any_value)
        m.big.value = rng.randint(-(1 << 63), (1 << 63) - 1)
        m.m[True].f_int32 = 5
        want = json.loads(json_format.MessageToJson(m, always_print_fields_with_no_presence=True))
        assert json.loads(shown.text(".t.T", m.SerializeToString())) == want
    numbers = json.loads(Renderer(schema, numbers=True).text(".t.T", cls(f_int64=-5, e=1).SerializeToString()))
    assert numbers[str(list(KINDS).index("int64") + 1)] == -5 and numbers["50"] == 1
    assert shown.text(".t.T", None) is None
    with pytest.raises(WireError, match="not found in descriptor set"):
        shown.text(".t.Missing", b"")


def test_batches_render_as_rows_do():
    """The same texts a batch at a time, for messages that suit it, on random messages with absent and odd values."""
    from google.protobuf import timestamp_pb2

    from protolith.functions.descriptors import Schema
    from protolith.functions.protojson import BatchRenderer, Renderer

    fds = pb2.FileDescriptorSet()
    timestamp_pb2.DESCRIPTOR.CopyToProto(fds.file.add())
    f = fds.file.add(name="u.proto", package="u", syntax="proto3", dependency=["google/protobuf/timestamp.proto"])
    kind = f.enum_type.add(name="E")
    kind.value.add(name="E_ZERO", number=0)
    kind.value.add(name="E_ONE", number=1)
    inner = f.message_type.add(name="Inner")
    inner.field.add(name="word", number=1, type=KINDS["string"], label=1)
    t = f.message_type.add(name="T")
    for k, (name, code) in enumerate(KINDS.items(), 1):
        t.field.add(name=f"f_{name}", number=k, type=code, label=1)
        t.field.add(name=f"r_{name}", number=100 + k, type=code, label=3)
    t.field.add(name="e", number=50, type=14, type_name=".u.E", label=1)
    t.field.add(name="at", number=70, type=11, type_name=".google.protobuf.Timestamp", label=1)
    t.field.add(name="inner", number=71, type=11, type_name=".u.Inner", label=1)
    t.field.add(name="many", number=72, type=11, type_name=".u.Inner", label=3)
    pool = descriptor_pool.DescriptorPool()
    for x in fds.file:
        pool.Add(x)
    cls = message_factory.GetMessageClass(pool.FindMessageTypeByName("u.T"))
    schema, rng, raw = Schema.from_descriptor_set(fds.SerializeToString()), random.Random(6), [None, b""]
    for _ in range(80):
        m = cls(e=rng.choice((0, 1, 7)))
        for name in KINDS:
            if rng.random() < 0.5:
                setattr(m, f"f_{name}", values(rng, name, 1)[0])
            getattr(m, f"r_{name}").extend(values(rng, name, rng.randint(0, 2)))
        if rng.random() < 0.5:
            m.at.seconds, m.at.nanos = rng.randint(-6 * 10**10, 2 * 10**11), rng.choice((0, 89_000_000, 5, 120_000))
            m.inner.word = rng.choice(("", 'a"b', "é\n", "back\\slash", "\x7f", "plain"))
        for _ in range(rng.randint(0, 2)):
            m.many.add(word="w")
        raw.append(m.SerializeToString())
    raw.append(cls(f_double=float("nan"), r_double=[1.5, float("inf")], f_float=float("-inf")).SerializeToString())
    for numbers in (False, True):
        batch, rows = BatchRenderer(schema, numbers), Renderer(schema, numbers)
        assert batch.suits(".u.T") and not batch.suits(".u.Missing")
        assert batch.message(".u.T", pa.array(raw, pa.binary())).to_pylist() == [rows.text(".u.T", x) for x in raw]


def test_descriptor_sets_both_ways():
    from protolith.functions.descriptors import Schema
    from protolith.plans.samples import FORMS_SCHEMA, ORDERS

    for schema in (FORMS_SCHEMA, ORDERS):
        data = schema.to_descriptor_set()
        assert Schema.from_descriptor_set(data).to_json() == schema.to_json()
        assert pb2.FileDescriptorSet.FromString(data).SerializeToString() == data
    pool = descriptor_pool.DescriptorPool()
    for f in pb2.FileDescriptorSet.FromString(FORMS_SCHEMA.to_descriptor_set()).file:
        pool.Add(f)
    assert pool.FindMessageTypeByName("forms.Shape").fields_by_name["counts"].message_type.GetOptions().map_entry
