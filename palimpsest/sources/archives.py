"""ZIP packages as rows: a bounded walk of the central directory and reading of the wanted parts, one file at a time.

The walk is our own because limits, duplicate names, unsafe paths and mismatches must be seen rather than repaired. A
kernel never raises out of a task: errors become rows, which the rules turn into findings and limitations.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

#: Limits of a scan, in entries and bytes.
ENTRIES, ENTRY_BYTES, TOTAL_BYTES = 20_000, 128 << 20, 768 << 20
XML_BYTES, MEDIA_BYTES = 32 << 20, 64 << 20
FULL16, FULL32, SAFE = 0xFFFF, 0xFFFFFFFF, (1 << 53) - 1


def at_place(form: str, data, at: int) -> tuple:
    """The numbers that stand there; ``data`` is bytes, or what reads them where they are asked for."""
    return struct.unpack(form, data[at: at + struct.calcsize(form)])


class PackageError(Exception):
    """What is wrong with a package; messages and codes are fixed values that reports show."""

    def __init__(self, message: str, code: str = "ZIP_INVALID"):
        super().__init__(message)
        self.code = code


@dataclass
class Entry:
    name: str
    packed: int
    unpacked: int
    method: int
    crc: int
    flags: int
    offset: int

    @property
    def directory(self) -> bool:
        return self.name.endswith("/")

    @property
    def encrypted(self) -> bool:
        return bool(self.flags & 0x41)

    @property
    def safe(self) -> bool:
        plain = self.name.replace("\\", "/")
        drive = len(plain) > 2 and plain[0].isascii() and plain[0].isalpha() and plain[1:3] == ":/"
        return not ("\0" in plain or plain.startswith("/") or drive or ".." in plain.split("/"))


@dataclass
class Package:
    data: bytes
    entries: list[Entry] = field(default_factory=list)
    zip64: bool = False
    total: int = 0

    def read(self, e: Entry, entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES) -> bytes:
        """The entry's bytes, with size and CRC checked; the sum over all reads is bounded."""
        if e.directory:
            return b""
        for broken, message, code in (
                (e.encrypted, f"Encrypted ZIP entry cannot be inspected: {e.name}", "ZIP_ENCRYPTED"),
                (not e.safe, f"Unsafe ZIP entry path cannot be inspected: {e.name}", "ZIP_UNSAFE_PATH"),
                (e.unpacked > entry_bytes, f"Entry exceeds the {entry_bytes}-byte safety limit: {e.name}", "ZIP_ENTRY_LIMIT"),
                (self.total + e.unpacked > total_bytes, "Inflated archive data exceeds the total safety limit.", "ZIP_TOTAL_LIMIT"),
                (self.data[e.offset: e.offset + 4] != b"PK\3\4" or e.offset + 30 > len(self.data), f"Local ZIP header is invalid for {e.name}.", "ZIP_LOCAL_HEADER")):
            if broken:
                raise PackageError(message, code)
        begin = e.offset + 30 + sum(at_place("<HH", self.data, e.offset + 26))
        if begin + e.packed > len(self.data):
            raise PackageError(f"Compressed data extends past the end of the file: {e.name}.", "ZIP_DATA_RANGE")
        raw = self.data[begin: begin + e.packed]
        if e.method == 8:
            raw = inflate(raw, entry_bytes)
        elif e.method != 0:
            raise PackageError(f"Unsupported ZIP compression method {e.method} for {e.name}.", "ZIP_COMPRESSION")
        if len(raw) != e.unpacked:
            raise PackageError(f"Uncompressed size mismatch for {e.name}.", "ZIP_SIZE_MISMATCH")
        if zlib.crc32(raw) != e.crc:
            raise PackageError(f"CRC-32 mismatch for {e.name}.", "ZIP_CRC")
        self.total += len(raw)
        return raw


def inflate(raw: bytes, most: int, wrapped: bool = False) -> bytes:
    """Bounded inflation of a raw (or, with ``wrapped``, zlib) stream; cut-off or over-long data is an error."""
    if wrapped:
        if len(raw) < 6 or raw[0] & 15 != 8 or (raw[0] << 8 | raw[1]) % 31 or raw[1] & 32:
            raise ValueError("not a zlib stream")
        raw = raw[2:-4]
    one = zlib.decompressobj(-15)
    try:
        out = one.decompress(raw, most + 1)
    except zlib.error as e:
        raise ValueError(f"damaged deflate data: {e}") from None
    if len(out) > most:
        raise ValueError(f"inflated data exceeds the {most}-byte limit")
    if not one.eof:
        raise ValueError("the deflate data ends early")
    return out


def u64(data: bytes, at: int) -> int:
    value = at_place("<Q", data, at)[0]
    if value > SAFE:
        raise PackageError("ZIP64 value exceeds the safe integer range.", "ZIP64_RANGE")
    return value


def directory_end(data: bytes) -> tuple[int, int, int, bool]:
    """(entries, size, offset) of the central directory and whether ZIP64 records gave them."""
    if len(data) < 22:
        raise PackageError("File is too small to be a ZIP archive.", "ZIP_TOO_SMALL")
    at = len(data) - 21
    while (at := data.rfind(b"PK\5\6", max(0, len(data) - 22 - FULL16), at + 3)) >= 0:
        if at + 22 + at_place("<H", data, at + 20)[0] <= len(data):
            break
    if at < 0:
        raise PackageError("ZIP end-of-central-directory record was not found.", "ZIP_EOCD")
    disk, first_disk, _, n, size, offset = at_place("<HHHHII", data, at + 4)
    if disk or first_disk:
        raise PackageError("Multi-disk ZIP archives are not supported.", "ZIP_MULTIDISK")
    if n != FULL16 and FULL32 not in (size, offset):
        return n, size, offset, False
    if at < 20 or data[at - 20: at - 16] != b"PK\6\7":
        raise PackageError("ZIP64 locator was not found.", "ZIP64_LOCATOR")
    far = u64(data, at - 12)
    if far + 56 > len(data) or data[far: far + 4] != b"PK\6\6":
        raise PackageError("ZIP64 end-of-central-directory record is invalid.", "ZIP64_EOCD")
    if any(at_place("<II", data, far + 16)):
        raise PackageError("Multi-disk ZIP64 archives are not supported.", "ZIP_MULTIDISK")
    return u64(data, far + 32), u64(data, far + 40), u64(data, far + 48), True


def extra_field(extra: bytes, wanted: int) -> bytes | None:
    found, at = None, 0
    while at + 4 <= len(extra):
        kind, size = at_place("<HH", extra, at)
        if at + 4 + size > len(extra):
            break
        if kind == wanted:
            found = extra[at + 4: at + 4 + size]
        at += 4 + size
    return found


def open_package(data: bytes, most: int = ENTRIES) -> Package:
    n, size, at, zip64 = directory_end(data)
    if n > most:
        raise PackageError(f"Archive has {n} entries; the safety limit is {most}.", "ZIP_ENTRY_LIMIT")
    if at + size > len(data):
        raise PackageError("ZIP central directory extends past the end of the file.", "ZIP_CENTRAL_RANGE")
    package = Package(data, zip64=zip64)
    for i in range(n):
        if at + 46 > len(data) or data[at: at + 4] != b"PK\1\2":
            raise PackageError(f"Invalid central-directory entry at index {i}.", "ZIP_CENTRAL_ENTRY")
        flags, method, _, crc, packed, unpacked, n_name, n_extra, n_comment, disk = at_place("<HHIIIIHHHH", data, at + 8)
        offset = at_place("<I", data, at + 42)[0]
        begin = at + 46
        at = begin + n_name + n_extra + n_comment
        if at > len(data):
            raise PackageError("Truncated central-directory entry.", "ZIP_CENTRAL_ENTRY")
        raw = data[begin: begin + n_name]
        try:
            name = raw.decode("utf-8-sig" if raw[:3] == b"\xef\xbb\xbf" else "utf-8")
        except UnicodeDecodeError:
            name = raw.decode("latin-1")
        sizes = [unpacked, packed, offset]
        if FULL32 in sizes or disk == FULL16:
            wide, cursor = extra_field(data[begin + n_name: begin + n_name + n_extra], 1), 0
            if wide is None:
                raise PackageError("ZIP64 entry is missing its ZIP64 extra field.", "ZIP64_EXTRA")
            for k, v in enumerate(sizes):
                if v == FULL32:
                    if cursor + 8 > len(wide):
                        raise PackageError("Truncated ZIP64 extra field.", "ZIP64_EXTRA")
                    sizes[k] = u64(wide, cursor)
                    cursor += 8
            if disk == FULL16:
                if cursor + 4 > len(wide):
                    raise PackageError("Truncated ZIP64 disk field.", "ZIP64_EXTRA")
                disk = at_place("<I", wide, cursor)[0]
        if disk:
            raise PackageError("Multi-disk ZIP entry found.", "ZIP_MULTIDISK")
        package.entries.append(Entry(name, sizes[1], sizes[0], method, crc, flags, sizes[2]))
    return package


def looks_like_package(data: bytes) -> bool:
    return data[:4] in (b"PK\3\4", b"PK\5\6")
