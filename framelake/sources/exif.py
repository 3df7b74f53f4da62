"""Tags of a JPEG's or TIFF's EXIF block."""

from __future__ import annotations

import struct

#: EXIF tag numbers by name, and the sizes of TIFF field types.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength",
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
SUB_IFD = 0x8769


def read_exif(data: bytes) -> dict[str, str]:
    """Known tags as text; an empty dict for anything unreadable."""
    try:
        block = _tiff_block(data)
        return _tags(block) if block else {}
    except (struct.error, IndexError, KeyError, ValueError, ZeroDivisionError):
        return {}


def _tiff_block(data: bytes) -> bytes | None:
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def _tags(block: bytes) -> dict[str, str]:
    order = "<" if block[:2] == b"II" else ">"
    out: dict[str, str] = {}
    pending, seen = [struct.unpack(order + "I", block[4:8])[0]], set()
    while pending:
        at = pending.pop()
        if at in seen or not at:
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", block[at : at + 2])[0]):
            tag, kind, n, raw = struct.unpack(order + "HHI4s", block[at + 2 + 12 * i : at + 14 + 12 * i])
            size = SIZES.get(kind, 1) * n
            where = raw[:size] if size <= 4 else block[(p := struct.unpack(order + "I", raw)[0]) : p + size]
            if tag == SUB_IFD:
                pending.append(struct.unpack(order + "I", raw)[0])
            elif tag in TAGS:
                out.setdefault(TAGS[tag], _value(where, kind, n, order))
    return out


def _value(raw: bytes, kind: int, n: int, order: str) -> str:
    if kind == 2:
        return raw.split(b"\0")[0].decode("latin-1").strip()
    if kind in (5, 10):
        a, b = struct.unpack(order + ("II" if kind == 5 else "ii"), raw[:8])
        return str(a / b)
    code = {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind]
    return ",".join(map(str, struct.unpack(order + code * n, raw[: SIZES[kind] * n])))
