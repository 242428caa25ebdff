"""What keeps the edit queries and wire JSON affordable on large tables, held against plain versions."""

import base64
import json
import random
from dataclasses import replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from protolith.functions import wire as W
from protolith.functions import wirejson as J
from protolith.functions.families import implement, json_texts
from protolith.functions.types import TYPES
from protolith.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _text(rnd: random.Random) -> str:
    fields = {}
    for n in sorted(rnd.sample([1, 2, 7, 16, 99, W.MAX_FIELD], rnd.randint(0, 4))):
        kinds = [rnd.choice([W.VARINT, W.I64, W.LEN, W.I32]) for _ in range(rnd.randint(1, 4))]
        value = lambda t: base64.b64encode(rnd.randbytes(rnd.choice([0, 1, 2, 3, 4, 50]))).decode() if t == W.LEN else rnd.choice([0, 5, 10**19, 2**64 - 1, rnd.getrandbits(64)])
        fields[str(n)] = [{"i": rnd.randint(0, 12), "n": n, "t": t, "v": value(t)} for t in kinds]
    return json.dumps(fields, separators=(",", ":"))


def _same(a: W.Elements, b: W.Elements) -> None:
    order = [x.take(np.lexsort((x.i, x.row))) for x in (a, b)]
    for k in ("row", "i", "n", "t", "u", "len"):
        assert np.array_equal(*(getattr(x, k) for x in order)), k
    assert W.binary(a.data, a.off, a.len).equals(W.binary(b.data, b.off, b.len)) or W.binary(*(getattr(order[0], k) for k in ("data", "off", "len"))).equals(W.binary(*(getattr(order[1], k) for k in ("data", "off", "len"))))


def test_plain_texts_are_read_without_json():
    rnd = random.Random(3)
    for _ in range(200):
        rows = [rnd.choice([None, "", "{}"]) if rnd.random() < 0.2 else _text(rnd) for _ in range(rnd.randint(0, 7))]
        column = pa.array(["x", *rows, "y"], pa.string()).slice(1, len(rows))
        e, odd = J._read_plain(*W.buffers(column))
        assert not odd.any()
        _same(e, J._read_any([r or "" for r in rows], np.arange(len(rows)), len(rows)))


def test_other_texts_are_read_as_json_reads_them():
    rnd = random.Random(4)
    for k in range(3000):
        text = bytearray(_text(rnd).encode())
        at = rnd.randrange(len(text))
        text[at : at + k % 2] = bytes([rnd.choice(b'{}[]",:0129intvA=+- ')]) * (k % 3 > 0)
        column = pa.array([text.decode(), '{"1":[{"i":0,"n":1,"t":0,"v":3}]}'])
        try:
            want = J._read_any(column.to_pylist(), np.arange(2), 2)
        except Exception as error:
            with pytest.raises(type(error)):
                J.read(column)
        else:
            _same(J.read(column), want)


def test_the_last_read_column_is_not_taken_for_another():
    a, b = (pa.array([json.dumps({"1": [{"i": 0, "n": 1, "t": 0, "v": v}]}, separators=(",", ":"))]) for v in (1, 2))
    assert [int(J.read(x).u[0]) for x in (a, a, b, a)] == [1, 1, 2, 1]


def test_rendered_texts_read_in_place_are_what_they_say(monkeypatch):
    rnd = random.Random(6)
    for _ in range(200):
        e = J.read(pa.array([_text(rnd) for _ in range(5)]))
        texts = J.render(e, np.array([rnd.random() < 0.7 for _ in range(5)]))
        _same(J.read(texts), J._read(texts))
    monkeypatch.setattr(J, "_read", None)  # a chained function does not parse what was just written for it
    J.read(texts)


def test_json_arrays_at_once_equal_json():
    for name, values in {
        "int64": [-5, None, 1 << 62], "uint64": [Decimal(2**64 - 1), None], "bool": [True, None], "string": ["é", None, "", "x"], "bytes": [b"", b"a", None, b"abcd"],
    }.items():
        lists = pa.array([None, values, [], values[:1]], pa.list_(TYPES[name].arrow)).slice(0, 4)
        plain = lambda v: base64.b64encode(v).decode() if isinstance(v, bytes) else int(v) if isinstance(v, Decimal) else v
        want = [None if x is None else json.dumps([plain(v) for v in x], separators=(",", ":"), ensure_ascii=False) for x in lists.to_pylist()]
        assert json_texts(TYPES[name], lists, False).to_pylist() == want
    odd = pa.array([['a"b', "\\", "\n"]])
    assert json.loads(json_texts(TYPES["string"], odd, False)[0].as_py()) == ['a"b', "\\", "\n"]


@pytest.mark.parametrize("name", ["pb_edit_bytes_wire_json", "pb_edit_string_wire_json", "pb_edit_fixed64"])
def test_edits_read_one_message_column(spark, name):
    """One function makes the messages, one reads and edits them: two Python workers a task, and no message is made twice."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert plan.count("array_sort") == 1


def test_fixed_edits_leave_the_worker_as_texts(spark):
    """Arrays of decimals would cost the JVM more than the edits."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = QUERIES["pb_edit_fixed64"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "array_join" not in plan and "array<decimal" not in plan and plan.count("trim(") >= 16


def _messages(rnd: random.Random, rows: int) -> pa.Array:
    """Messages with a packed and a plain field of eight bytes each; some are empty, some end too soon."""
    out = []
    for _ in range(rows):
        run = b"".join(rnd.getrandbits(64).to_bytes(8, "little") for _ in range(rnd.randint(0, 4))) + b"\1" * (rnd.random() < 0.1)
        single = b"\x39" + rnd.getrandbits(64).to_bytes(8, "little")
        out.append(b"".join(rnd.choice([single, b"\x3a" + bytes([len(run)]) + run, b"\x08\x05"]) for _ in range(rnd.randint(0, 3))))
    return pa.array(out, pa.binary())


def test_packed_runs_of_fixed_values_read_at_once():
    rnd = random.Random(7)
    for _ in range(100):
        e, _ = W._parse(_messages(rnd, 6), np.full(6, 7))
        want, codes = [], np.zeros(len(e.row), np.int8)
        for k in range(len(e.row)):
            raw = e.data[e.off[k] : e.off[k] + e.len[k]].tobytes()
            if e.t[k] == W.I64:
                want.append((k, -1, int(e.u[k])))
            want += [(k, p, int.from_bytes(raw[8 * p : 8 * p + 8], "little")) for p in range(len(raw) // 8)]
            codes[k] = W.TRUNCATED if len(raw) % 8 else W.OK
        at, place, u, bad = W.logical(e, W.I64)
        assert list(zip(at.tolist(), place.tolist(), u.tolist(), strict=True)) == want
        assert np.array_equal(bad, codes)


def test_written_messages_are_not_read_again_and_are_what_they_say(monkeypatch):
    rnd = random.Random(8)
    for _ in range(100):
        e, _ = W._parse(_messages(rnd, 6), None)
        written = W.serialise(e.take(np.flatnonzero(np.array([rnd.random() < 0.7 for _ in e.row], bool))))
        for want in (None, np.full(6, 7)):
            (a, bad), (b, code) = W.parse(written, want), W._parse(written, want)
            _same(a, b)
            assert np.array_equal(bad, code)
    odd, number = W.serialise(replace(e, n=np.zeros_like(e.n))), np.full(6, 7)
    assert np.array_equal(W.parse(odd)[1], W._parse(odd, None)[1])  # what cannot be read is read for its errors
    column = _messages(rnd, 6)
    first, codes = W.parse(column, number)
    codes[:] = W.RANGE
    monkeypatch.setattr(W, "_parse", None)
    again, codes = W.parse(column, number)
    assert again is first and not (codes == W.RANGE).any()


def test_edits_of_fixed_lists_equal_edits_of_lists():
    rnd, t = random.Random(9), TYPES["fixed64"]
    for _ in range(60):
        lists = [[rnd.getrandbits(64) for _ in range(rnd.randint(1, 5))] for _ in range(4)]
        at, packed, texts = [rnd.randrange(len(x)) for x in lists], rnd.random() < 0.5, implement("message", "json_array", t)
        new, k = pa.array([Decimal(5)] * 4, t.arrow), pa.array(at, pa.int32())
        m = implement("message", "set_repeated", t)(pa.array([b""] * 4), 7, pa.array([[Decimal(v) for v in x] for x in lists], pa.list_(t.arrow)), packed)
        for family, args, edit in (
            ("insert", (k, new, packed), lambda x, p: x[:p] + [5] + x[p:]), ("replace", (k, new), lambda x, p: x[:p] + [5] + x[p + 1 :]), ("remove", (k,), lambda x, p: x[:p] + x[p + 1 :]),
        ):
            edited = implement("message", family, t)(m, 7, *args)
            want = [json.dumps(edit(x, p), separators=(",", ":")) for x, p in zip(lists, at, strict=True)]
            assert texts(edited, 7).to_pylist() == want
            assert texts(pa.concat_arrays([edited]).slice(0, 4), 7).to_pylist() == want
