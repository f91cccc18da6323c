"""Small binary decoders: event batches in a FlatBuffer, trace requests in the OTLP protobuf format."""

from __future__ import annotations

import struct

import numpy as np

#: One event of a batch: time, duration, status code, padding.
EVENT = np.dtype([("timestamp", "<u8"), ("duration_ms", "<f4"), ("status_code", "<u2"), ("padding", "<u2")])


def encode_batch(trace_id: str, events: np.ndarray) -> bytes:
    """A batch: root offset, a vtable with two fields, the table, the trace id, the vector of events."""
    name = trace_id.encode()
    text = struct.pack("<I", len(name)) + name + b"\0"
    text += b"\0" * (-len(text) % 4)
    head = struct.pack("<IHHHH", 12, 8, 12, 4, 8)
    table = struct.pack("<iII", 8, 8, 4 + len(text))
    return head + table + text + struct.pack("<I", len(events)) + events.astype(EVENT).tobytes()


def decode_batch(data: bytes | None) -> np.ndarray:
    """The events of a batch; a malformed or short one has none."""
    none = np.zeros(0, EVENT)
    try:
        if data is None or len(data) < 8:
            return none
        (table,) = struct.unpack_from("<I", data, 0)
        (back,) = struct.unpack_from("<i", data, table)
        vtable = table - back
        if vtable < 0 or vtable + 8 > len(data) or struct.unpack_from("<H", data, vtable)[0] < 8:
            return none
        (field,) = struct.unpack_from("<H", data, vtable + 6)
        if not field:
            return none
        vector = table + field + struct.unpack_from("<I", data, table + field)[0]
        (count,) = struct.unpack_from("<I", data, vector)
        return np.frombuffer(data, EVENT, count, vector + 4)
    except (struct.error, ValueError):
        return none


def _fields(data: bytes):
    """(number, wire type, value) of each protobuf field."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        elif kind == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("field beyond the end")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, value


def _attributes(items: list[bytes]) -> dict[str, str]:
    """Attributes as text; of several with one key the last counts."""
    out: dict[str, str] = {}
    for item in items:
        pair = {n: v for n, _, v in _fields(item)}
        for n, _, v in _fields(pair.get(2, b"")):
            text = v.decode() if n == 1 else str(bool(v)).lower() if n == 2 else str(v - (1 << 64) if v >> 63 else v) if n == 3 else str(struct.unpack("<d", v.to_bytes(8, "little"))[0]) if n == 4 else None
            if text is not None:
                out[pair.get(1, b"").decode()] = text
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int, fixed: bool = False) -> bytes:
    """A field of a protobuf message: bytes with their length, or a number, of 8 bytes if fixed."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3 | 1) + value.to_bytes(8, "little") if fixed else _varint(number << 3) + _varint(value)


def _pair(key: str, value: str) -> bytes:
    return _field(1, key.encode()) + _field(2, _field(1, value.encode()))


def encode_trace_request(service: str | None, spans: list[dict]) -> bytes:
    """An OTLP trace request of one service; spans as decode_trace_request gives them."""
    out = b""
    for s in spans:
        own = _field(1, bytes.fromhex(s["trace_id"])) + _field(2, bytes.fromhex(s["span_id"]))
        own += _field(4, bytes.fromhex(s["parent_span_id"])) if s.get("parent_span_id") else b""
        own += _field(5, s["name"].encode()) + _field(7, s["start_ns"], True) + _field(8, s["end_ns"], True)
        own += b"".join(_field(9, _pair(k, v)) for k, v in s["attrs"].items()) + _field(15, _field(3, s["status"]))
        out += _field(2, own)
    resource = _field(1, _field(1, _pair("service.name", service))) if service else b""
    return _field(1, resource + _field(2, out))


def decode_trace_request(data: bytes | None) -> list[dict]:
    """The spans of a request, with their resource's service name; a malformed request has none."""
    out: list[dict] = []
    try:
        for n, _, resource_spans in _fields(data or b""):
            if n != 1:
                continue
            parts = list(_fields(resource_spans))
            resource = [v for k, _, r in parts if k == 1 for j, _, v in _fields(r) if j == 1]
            service = next((name for r in resource if (name := _attributes([r]).get("service.name"))), "unknown")
            for scope in (v for k, _, v in parts if k == 2):
                for span in (v for k, _, v in _fields(scope) if k == 2):
                    fields = list(_fields(span))
                    one = {k: v for k, _, v in fields}
                    status = {k: v for k, _, v in _fields(one.get(15, b""))}
                    out.append(
                        {
                            "service": service,
                            "trace_id": one.get(1, b"").hex() or None,
                            "span_id": one.get(2, b"").hex() or None,
                            "parent_span_id": one.get(4, b"").hex() or None,
                            "name": one.get(5, b"").decode(),
                            "start_ns": one.get(7, 0),
                            "end_ns": one.get(8, 0),
                            "status": status.get(3, 0),
                            "attrs": _attributes([v for k, _, v in fields if k == 9]),
                        }
                    )
    except (IndexError, ValueError, struct.error, AttributeError, UnicodeDecodeError, TypeError):
        return []
    return out
