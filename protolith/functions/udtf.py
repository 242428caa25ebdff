"""The wire format as a table: ``SELECT ... FROM t, LATERAL pb_message_show_wire_format(t.msg)``.

Spark calls a table function once per row, so a message is read here by a plain loop: the kernels of ``wire``
cost some hundred NumPy calls a batch, which one message cannot repay.
"""

from __future__ import annotations

import base64

from pyspark.sql.functions import udtf

from . import wire as W
from . import wirejson as J
from .types import I32, I64, LEN, VARINT, WireError

WIRE_TABLE = "i int, n int, t int, v string"


def _varint(data: bytes, pos: int) -> tuple[int, int]:
    """(value modulo 2^64, position after it)."""
    value = 0
    for k in range(10):
        if pos >= len(data):
            raise WireError(W.MESSAGES[W.TRUNCATED])
        b = data[pos]
        pos += 1
        value |= (b & 0x7F) << 7 * k
        if b < 128:
            return value & 0xFFFFFFFFFFFFFFFF, pos
    raise WireError(W.MESSAGES[W.LONG_VARINT])


def wire_rows(data: bytes):
    """(ordinal, field number, wire type, value as text) of each element, with the checks of ``wire.parse``."""
    pos, end, i = 0, len(data), 0
    while pos < end:
        tag, pos = _varint(data, pos)
        n, t = tag >> 3, tag & 7
        if not 1 <= n <= W.MAX_FIELD:
            raise WireError(W.MESSAGES[W.FIELD_NUMBER])
        if t == VARINT:
            u, pos = _varint(data, pos)
            v = str(u)
        elif t == LEN:
            size, pos = _varint(data, pos)
            if size > end - pos:
                raise WireError(W.MESSAGES[W.TRUNCATED])
            v = base64.b64encode(data[pos : pos + size]).decode()
            pos += size
        elif t in (I64, I32):
            size = 8 if t == I64 else 4
            if pos + size > end:
                raise WireError(W.MESSAGES[W.TRUNCATED])
            v = str(int.from_bytes(data[pos : pos + size], "little"))
            pos += size
        else:
            raise WireError(W.MESSAGES[W.WIRE_TYPE])
        yield i, n, t, v
        i += 1


class WireJsonTable:
    """Rows of a wire JSON text, by ordinal."""

    def eval(self, wire_json: str):
        for i, n, t, _, _, v in sorted(J.elements(wire_json), key=lambda x: x[0]):
            yield i, n, t, str(v)


class WireFormatTable:
    """Rows of a message, by ordinal."""

    def eval(self, message: bytes):
        if message is not None:
            yield from [*wire_rows(bytes(message))]  # a message in error has no rows


wire_json_as_table = udtf(WireJsonTable, returnType=WIRE_TABLE)
show_wire_format = udtf(WireFormatTable, returnType=WIRE_TABLE)
