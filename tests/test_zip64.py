"""ZIP64 archives and what can be wrong with them, byte by byte."""

import struct
import zlib

import pytest

from palimpsest.sources import archives

FULL = 0xFFFFFFFF


def archive(name: bytes = b"ppt/a.xml", body: bytes = b"<a>words</a>", wide: bytes | None = None, locator: bytes = b"PK\6\7", eocd: bytes = b"PK\6\6", disk: int = 0, disks: int = 0,
            crc: int | None = None, method: int = 8, cut: int = 0) -> bytes:
    """One entry whose sizes, offset and directory stand in ZIP64 records only."""
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = packer.compress(body) + packer.flush() if method == 8 else body
    crc = zlib.crc32(body) if crc is None else crc
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, method, 0, 0, crc, len(raw), len(body), len(name), 0) + name + raw
    extra = struct.pack("<QQQ", len(body), len(raw), 0) if wide is None else wide
    extra = struct.pack("<HHH", 0x9999, 2, 7) + struct.pack("<HH", 1, len(extra)) + extra
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, method, 0, 0, crc, FULL, FULL, len(name), len(extra), 0, disk, 0, 0, FULL) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", eocd, 44, 45, 45, disks, 0, 1, 1, len(central), len(local))
    tail = struct.pack("<4sIQI", locator, 0, len(local) + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, FULL, FULL, 0)
    return local[: len(local) - cut] + b"\0" * cut + central + end64 + tail


def test_zip64_archives_are_read():
    package = archives.open_package(archive())
    assert package.zip64 and [(e.name, e.unpacked) for e in package.entries] == [("ppt/a.xml", 12)] and package.read(package.entries[0]) == b"<a>words</a>"
    stored = archives.open_package(archive(method=0))
    assert stored.read(stored.entries[0]) == b"<a>words</a>"


@pytest.mark.parametrize("name,want", [(b"\xef\xbb\xbfa.xml", "a.xml"), ("é.xml".encode(), "é.xml"), (b"\xe9.xml", "é.xml")])
def test_entry_names(name, want):
    assert archives.open_package(archive(name)).entries[0].name == want


@pytest.mark.parametrize("harm,code", [({"locator": b"PK\0\0"}, "ZIP64_LOCATOR"), ({"eocd": b"PK\0\0"}, "ZIP64_EOCD"), ({"disks": 1}, "ZIP_MULTIDISK"), ({"disk": 3}, "ZIP_MULTIDISK"),
                                       ({"wide": b"\0" * 12}, "ZIP64_EXTRA"), ({"wide": struct.pack("<QQQ", 1 << 60, 1, 0)}, "ZIP64_RANGE"), ({"disk": 0xFFFF}, "ZIP64_EXTRA")])
def test_damaged_zip64_records(harm, code):
    with pytest.raises(archives.PackageError) as e:
        archives.open_package(archive(**harm))
    assert e.value.code == code


@pytest.mark.parametrize("harm", [{"crc": 1}, {"cut": 4}, {"method": 12}])
def test_entries_that_cannot_be_read(harm):
    package = archives.open_package(archive(**harm))
    with pytest.raises((archives.PackageError, ValueError)):
        package.read(package.entries[0])


def test_every_cut_of_an_archive_is_an_error_or_reads():
    """No prefix of an archive makes the walk fail in any other way."""
    whole = archive()
    for n in range(len(whole)):
        with pytest.raises(archives.PackageError):
            archives.open_package(whole[:n])
