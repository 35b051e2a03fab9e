"""CBOR (RFC 8949) for JSON-like values: definite and indefinite lengths, in plain Python."""

from __future__ import annotations

import math
import struct

SELF_DESCRIBED = b"\xd9\xd9\xf7"


class CborError(ValueError):
    pass


def dumps(value, tagged: bool = True) -> bytes:
    out = bytearray(SELF_DESCRIBED if tagged else b"")
    _write(out, value)
    return bytes(out)


def _head(out: bytearray, major: int, n: int) -> None:
    for limit, info, form in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < limit:
            out.append(major << 5 | (n if info is None else info))
            if form:
                out += struct.pack(form, n)
            return
    raise CborError("the number is too large")


def _write(out: bytearray, v) -> None:
    if v is None or isinstance(v, bool):
        out.append({None: 0xF6, False: 0xF4, True: 0xF5}[v])
    elif isinstance(v, int):
        _head(out, 0 if v >= 0 else 1, v if v >= 0 else -1 - v)
    elif isinstance(v, float):
        out += b"\xfb" + struct.pack(">d", v)
    elif isinstance(v, (bytes, str)):
        raw = v.encode() if isinstance(v, str) else v
        _head(out, 3 if isinstance(v, str) else 2, len(raw))
        out += raw
    elif isinstance(v, (list, tuple)):
        _head(out, 4, len(v))
        for x in v:
            _write(out, x)
    elif isinstance(v, dict):
        _head(out, 5, len(v))
        for k, x in v.items():
            _write(out, k)
            _write(out, x)
    else:
        raise CborError(f"no CBOR for {type(v).__name__}")


def loads(data: bytes):
    value, at = _read(data, 0, 0)
    if value is _BREAK:
        raise CborError("a break where none belongs")
    if at != len(data):
        raise CborError("bytes after the value")
    return value


_BREAK = object()


def _read(d: bytes, at: int, depth: int):
    if depth > 200:
        raise CborError("nested too deep")
    if at >= len(d):
        raise CborError("the value is cut off")
    major, info = d[at] >> 5, d[at] & 31
    at += 1
    if info < 24:
        n = info
    elif info < 28:
        size = 1 << (info - 24)
        if at + size > len(d):
            raise CborError("the value is cut off")
        n, at = int.from_bytes(d[at : at + size], "big"), at + size
    elif info == 31 and major in (2, 3, 4, 5, 7):
        n = None
    else:
        raise CborError("a reserved length")
    if major == 7:
        return _simple(d, at, info, n)
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major == 6:
        return _read(d, at, depth + 1)  # tags say nothing that JSON has
    if major in (2, 3):
        if n is None:
            parts = []
            while (got := _read(d, at, depth + 1))[0] is not _BREAK:
                parts.append(got[0])
                at = got[1]
            return (b"" if major == 2 else "").join(parts), got[1]
        if at + n > len(d):
            raise CborError("the value is cut off")
        raw = d[at : at + n]
        try:
            return (raw if major == 2 else raw.decode()), at + n
        except UnicodeDecodeError as e:
            raise CborError("text that is not UTF-8") from e
    items: list = []
    while n is None or len(items) < n * (major - 3):
        v, at = _read(d, at, depth + 1)
        if v is _BREAK:
            if n is not None:
                raise CborError("a break where none belongs")
            break
        items.append(v)
    if major == 4:
        return items, at
    if len(items) % 2:
        raise CborError("a key without a value")
    return dict(zip(items[::2], items[1::2], strict=True)), at


def _simple(d: bytes, at: int, info: int, n):
    if info == 31:
        return _BREAK, at
    if info in (20, 21, 22, 23):
        return (False, True, None, None)[info - 20], at
    raw = d[at - (1 << (info - 24)) : at] if info >= 24 else b""
    if info == 25:
        return struct.unpack(">e", raw)[0], at
    if info == 26:
        return struct.unpack(">f", raw)[0], at
    if info == 27:
        return struct.unpack(">d", raw)[0], at
    raise CborError(f"simple value {n}")


def jsonable(v):
    """Floats without a value become null, as JSON has none."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return [jsonable(x) for x in v] if isinstance(v, list) else {k: jsonable(x) for k, x in v.items()} if isinstance(v, dict) else v
