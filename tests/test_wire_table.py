"""The wire table, which Spark asks for a message at a time, against the batch parser."""

import json
import random

import pyarrow as pa

from protolith.functions import udtf
from protolith.functions import wire as W
from protolith.functions.families import to_wire_json
from protolith.functions.types import WireError


def test_wire_table_of_a_message_equals_the_batch_parser(monkeypatch):
    rnd = random.Random(5)
    messages = [rnd.randbytes(rnd.randint(0, 12)) for _ in range(3000)] + [b"\x08" + b"\xff" * 9 + b"\x7f", b"\x08" + b"\x80" * 10, b"\x12\x03abc\x19" + bytes(8) + b"\x25" + bytes(4)]
    want = []
    for m in messages:
        try:
            text = to_wire_json(pa.array([m], pa.binary()))[0].as_py()
            want.append(sorted((x["i"], x["n"], x["t"], str(x["v"])) for found in json.loads(text).values() for x in found))
        except WireError as error:
            want.append(str(error))
    monkeypatch.setattr(W, "parse", None)  # one message must not pay for the kernels of a batch
    for m, rows in zip(messages, want, strict=True):
        try:
            assert [*udtf.WireFormatTable().eval(m)] == rows
        except WireError as error:
            assert str(error) == rows
