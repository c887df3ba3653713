"""Identifying metadata of JPEG, PNG and WebP images: eleven EXIF fields, PNG texts, GPS coordinates."""

from __future__ import annotations

import re
import struct

from .archives import inflate

#: EXIF tags by name, of the main and of the Exif directory, and PNG keywords.
MAIN = {"description": 0x010E, "make": 0x010F, "model": 0x0110, "software": 0x0131, "dateTime": 0x0132, "artist": 0x013B, "copyright": 0x8298}
EXIF = {"dateTimeOriginal": 0x9003, "ownerName": 0xA430, "cameraSerial": 0xA431, "lensModel": 0xA434}
EXIF_AT, GPS_AT = 0x8769, 0x8825
KEYWORDS = re.compile("(author|artist|copyright|comment|description|software|source|creation time)", re.I)
SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
CODE = {3: "H", 4: "I", 9: "i", 5: "I", 10: "i"}
VALUES, DIRECTORY, TEXT = 10_000, 4096, 2 << 20

Metadata = tuple[dict[str, str], tuple[float, float] | None]


def tiff(data: bytes) -> Metadata | None:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return None

    def value(kind: int, count: int, at: int):
        size = SIZE.get(kind, 1) * count
        if size > 4:
            at = struct.unpack_from(order + "I", data, at)[0]
        if at + size > len(data) or count > VALUES:
            return None
        raw = data[at: at + size]
        if kind == 2:
            return raw.decode("latin-1").rstrip("\0").strip()
        if kind in (1, 7):
            return raw[0] if count == 1 else list(raw)
        if kind not in CODE:
            return []
        got = struct.unpack(order + CODE[kind] * (count * (2 if kind in (5, 10) else 1)), raw)
        if kind in (5, 10):
            got = [a / b if b else None for a, b in zip(got[::2], got[1::2])]
        return got[0] if count == 1 else list(got)

    def directory(at) -> dict:
        out: dict = {}
        if not isinstance(at, int) or at < 0 or at + 2 > len(data):
            return out
        for i in range(min(struct.unpack_from(order + "H", data, at)[0], DIRECTORY)):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            try:
                out[tag] = value(kind, count, entry + 8)
            except struct.error:
                continue
        return out

    main = directory(struct.unpack_from(order + "I", data, 4)[0])
    more, gps = directory(main.get(EXIF_AT)), directory(main.get(GPS_AT))
    named = {n: main.get(t) for n, t in MAIN.items()} | {n: more.get(t) for n, t in EXIF.items()}
    fields = {n: shown(v) for n, v in named.items() if v is not None and shown(v).strip()}
    place = []
    for axis, ref, minus in ((2, 1, "S"), (4, 3, "W")):
        parts = gps.get(axis)
        if not isinstance(parts, list) or len(parts) < 3:
            return fields, None
        d, m, s = (0.0 if p is None else float(p) for p in parts[:3])
        degrees = d + m / 60 + s / 3600
        place.append(-degrees if str(gps.get(ref)).upper().startswith(minus) else degrees)
    return fields, (place[0], place[1])


def shown(v) -> str:
    if isinstance(v, list):
        return ",".join("" if x is None else shown(x) for x in v)
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def jpeg(data: bytes) -> Metadata | None:
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        while at < len(data) and data[at] == 0xFF:
            at += 1
        marker = data[at] if at < len(data) else 0xD9
        at += 1
        if marker in (0xD9, 0xDA):
            break
        if 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at: at + 2], "big")
        if at + 2 > len(data) or size < 2 or at + size > len(data):
            break
        if marker == 0xE1 and data[at + 2: at + 8] == b"Exif\0\0" and size >= 8:
            return tiff(data[at + 8: at + size])
        at += size
    return {}, None


def png(data: bytes) -> Metadata | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    texts: dict[str, str] = {}
    exif, at = None, 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8: at + 8 + size]
        if at + 12 + size > len(data):
            break
        key, gap, rest = body.partition(b"\0")
        try:
            if kind == b"eXIf":
                exif = tiff(body)
            elif gap and key and kind == b"tEXt":
                texts[key.decode("latin-1")] = rest.decode("latin-1")
            elif gap and key and kind == b"zTXt" and rest[:1] == b"\0":
                texts[key.decode("latin-1")] = inflate(rest[1:], TEXT, True).decode("utf-8", "replace")
            elif gap and key and kind == b"iTXt" and len(rest) > 1:
                payload = rest[2:].partition(b"\0")[2].partition(b"\0")[2]
                texts[key.decode("latin-1")] = (inflate(payload, TEXT, True) if rest[0] == 1 else payload).decode("utf-8", "replace")
        except (ValueError, struct.error):
            pass  # optional metadata that cannot be read
        at += 12 + size
        if kind == b"IEND":
            break
    fields = dict(exif[0]) if exif else {}
    fields |= {f"png:{k}": v for k, v in texts.items() if KEYWORDS.fullmatch(k)}
    return fields, exif[1] if exif else None


def webp(data: bytes) -> Metadata | None:
    if len(data) < 16 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return None
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            break
        if data[at: at + 4] == b"EXIF":
            return tiff(data[at + 8: at + 8 + size])
        at += 8 + size + size % 2
    return {}, None


def metadata(data: bytes) -> Metadata | None:
    return next((m for m in (f(data) for f in (jpeg, png, webp)) if m), None)
