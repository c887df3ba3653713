import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from palimpsest.sources import archives, build, content, images, pdf

from . import plain_content


def small_zip(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data, zipfile.ZIP_DEFLATED if len(data) > 20 else zipfile.ZIP_STORED)
    return out.getvalue()


@pytest.mark.parametrize("level", [0, 1, 6, 9])
@pytest.mark.parametrize("data", [b"", b"abc" * 9000, bytes(31 * i % 251 for i in range(131072))])
def test_inflate(level, data):
    raw = zlib.compress(data, level)
    assert archives.inflate(raw, 1 << 20, True) == data
    assert archives.inflate(raw[2:-4], 1 << 20) == data
    with pytest.raises(ValueError):
        archives.inflate(raw[2:-5] if data else b"", 1 << 20)


def test_inflate_is_bounded():
    with pytest.raises(ValueError, match="limit"):
        archives.inflate(zlib.compress(b"x" * 100_000)[2:-4], 1000)


def test_package_reads_and_refuses():
    data = small_zip(**{"a.txt": b"short", "b.xml": b"<x/>" * 50, "../up": b"no"})
    p = archives.open_package(data)
    assert [p.read(e) for e in p.entries[:2]] == [b"short", b"<x/>" * 50]
    with pytest.raises(archives.PackageError) as e:
        p.read(p.entries[2])
    assert e.value.code == "ZIP_UNSAFE_PATH"
    broken = data.replace(b"short", b"shorT")
    q = archives.open_package(broken)
    with pytest.raises(archives.PackageError, match="CRC"):
        q.read(q.entries[0])
    with pytest.raises(archives.PackageError) as e:
        archives.open_package(data, most=2)
    assert e.value.code == "ZIP_ENTRY_LIMIT"


@pytest.mark.parametrize("data,code", [(b"PK", "ZIP_TOO_SMALL"), (b"x" * 100, "ZIP_EOCD"), (b"PK\5\6" + struct.pack("<HHHHIIH", 1, 0, 0, 0, 0, 0, 0), "ZIP_MULTIDISK"),
                                       (b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 99, 0, 0), "ZIP_CENTRAL_RANGE"),
                                       (b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 65535, 65535, 0, 0, 0), "ZIP64_LOCATOR")])
def test_package_errors(data, code):
    with pytest.raises(archives.PackageError) as e:
        archives.open_package(data)
    assert e.value.code == code


def exif(order: str) -> bytes:
    """Artist and GPS 10 30 0 S, 20 0 36 W."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    head = (b"II" if order == "<" else b"MM") + pack("HI", 42, 8)
    main = pack("H", 2) + pack("HHII", 0x013B, 2, 6, 38) + pack("HHII", 0x8825, 4, 1, 44) + pack("I", 0)
    gps = pack("H", 4) + pack("HHI", 1, 2, 2) + b"S\0\0\0" + pack("HHII", 2, 5, 3, 98) + pack("HHI", 3, 2, 2) + b"W\0\0\0" + pack("HHII", 4, 5, 3, 122) + pack("I", 0)
    return head + main + b"Jane\0\0" + gps + pack("6I", 10, 1, 30, 1, 0, 1) + pack("6I", 20, 1, 0, 1, 36, 1)


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_in_all_containers(order):
    t = exif(order)
    want = ({"artist": "Jane"}, (-10.5, -20.01))
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(t) + 8) + b"Exif\0\0" + t + b"\xff\xd9"
    webp = b"RIFF" + struct.pack("<I", len(t) + 12) + b"WEBPEXIF" + struct.pack("<I", len(t)) + t
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(t)) + b"eXIf" + t + b"\0\0\0\0"
    for data in (jpeg, webp, png):
        fields, place = images.metadata(data)
        assert fields == want[0] and place == pytest.approx(want[1])
        for cut in range(0, len(data), 7):  # malformed input never raises anything but struct errors inside
            images.metadata(data[:cut])


def test_png_texts_are_an_allow_list():
    assert images.metadata(build.png({"Author": "A", "Other": "B"}))[0] == {"png:Author": "A"}


def test_pdf_strings_and_streams():
    src = r"/Author (a\(b\) (n) \101\n) /Author <feff0041> /Author 7"
    assert pdf.keyed_strings(src, "Author") == ["a(b) (n) A\n", "A"]
    doc = build.pdf(build.show("hello", 10, 20))
    (s,) = pdf.streams(doc.decode("latin-1"))
    assert pdf.decoded(s.raw, s.filters).decode() == build.show("hello", 10, 20)
    wrong = doc.replace(b"/Length ", b"/Length 9")
    assert [x.raw for x in pdf.streams(wrong.decode("latin-1"))] == [s.raw]


@pytest.mark.parametrize("filters,raw,want", [(["AHx"], b"48 65 6C6>zz", b"Hel`"), (["A85"], b"<~87cURDZ~>", b"Hello"), (["ASCII85Decode"], b"z", b"\0\0\0\0")])
def test_pdf_filters(filters, raw, want):
    assert pdf.decoded(raw, filters) == want


def test_pdf_filter_errors():
    with pytest.raises(pdf.Unsupported):
        pdf.decoded(b"", ["DCTDecode"])
    with pytest.raises(ValueError):
        pdf.decoded(b"87cURD", ["A85"])


def drawn(source: str) -> tuple[list[tuple], list[tuple]]:
    """(text, box, mode, fill) of the texts and (box, fill) of the filled rectangles."""
    page = content.interpret(source)
    shown, filled = np.array(page.shown).reshape(-1, 12), np.array(page.filled).reshape(-1, 13)
    return ([(t, *b, *r[8:]) for t, b, r in zip(page.texts, content.text_boxes(shown).tolist(), shown.tolist())],
            [(*b, *r[10:]) for b, r in zip(content.path_boxes(filled).tolist(), filled.tolist())])


PARTS = ["(ab)", "(a(b)c)", r"(a\)b)", "<41 42>", "<4", "<<", ">>", "[(a)-20(b c) (d)]", "[(a) -20 (b)]", "[", "]", "[(x]y) 3]", "[()(a)]", "(", "(\xfe\xff\0a)", "[(\xfe\xff\0a)]", "%c (x)\n", "/N(x)", "/A%b",
         "/A#\xa0b", "1 0 0 1 5 6 cm", "12 Tf", "3 Tr", "BT", "ET", "1 2 Td", "-1 2.5 TD", "T*", "(q)'", '1 2 (z)"', "0 g", "1 1 1 rg", "0 0 0 1 k", "0 0 5 5 re", "f", "n", "q", "Q", "2 0 0 2 1 1 Tm", "50 Tz",
         "8 TL", "12abc", "1e3 Tf", "1e999 Tf", "0x1F", "0b11 g", "+.5 g", "-.", "\xa0", "12\xa0 Tf", "abc%d", "}", "{", ")", ">", "(  a  b )", "Tj", "TJ", "TJ", "Tj", "\0", "\x0b", "\x1c", "3\x0b4", "1\0 2 Td",
         "1 2 3 4 5 6 7 8 9 Tm", "(a)Tj", "(a) Tjx", "5 (a) Tj", "(a) 5 Tj", "\\", "(a\\"]


def test_fast_reader_gives_what_the_plain_one_gives():
    rng = random.Random(11)
    for _ in range(6000):
        source = rng.choice(("", " ", "\n")).join(rng.choice(PARTS) + rng.choice(("", " ", " ", "\r\n")) for _ in range(rng.randint(1, 25)))
        page, (texts, rects) = plain_content.interpret(source), drawn(source)
        assert repr(([tuple(t) for t in page.texts], [tuple(r) for r in page.rects])) == repr((texts, rects)), source


@pytest.mark.parametrize("limit", [1, 7, 30])
def test_both_readers_stop_at_the_same_token(monkeypatch, limit):
    source = "BT 12 Tf 1 2 Td (a) Tj /N 3 4 5 (b) Tj % x\n (c) Tj 1 1 1 rg [(d) 3 (e)] TJ 0 0 1 1 re f ET " * 3
    monkeypatch.setattr(content, "TOKENS", limit)
    monkeypatch.setattr(plain_content, "TOKENS", limit)
    page, (texts, rects) = plain_content.interpret(source), drawn(source)
    assert ([t[0] for t in page.texts], len(page.rects)) == ([t[0] for t in texts], len(rects))


def test_content_interpreter():
    page = plain_content.interpret("q 0.1 0.1 0.1 rg 0 0 10 10 re f Q 1 g 0 0 5 5 re f BT 10 Tf 1 0 0 1 5 5 Tm (ab) Tj T* [(c) -120(lost) (d)] TJ ET")
    assert [r[4:] for r in page.rects] == [(0.1, 0.1, 0.1), (1.0, 1.0, 1.0)]
    assert [t[0] for t in page.texts] == ["ab", "c", "d"]
    assert page.texts[0][1:5] == (5.0, 15.0, 3.0, 13.0)
