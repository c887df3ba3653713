"""Small PDF and PowerPoint files from given texts, for queries and tests: the inverse of what the scan takes apart."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

P = 'xmlns:p="p" xmlns:a="a" xmlns:r="r"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def pdf(content: str | list[str], info: dict[str, str] | None = None, extra: str = "", filters: str = "/FlateDecode", revisions: int = 1) -> bytes:
    """A page with one compressed content stream for each content; ``extra`` objects and ``revisions`` end marks."""
    streams = [zlib.compress(c.encode("latin-1", "replace")) for c in ([content] if isinstance(content, str) else content)]
    numbers = [(3, 4)] + [(100 + 2 * i, 101 + 2 * i) for i in range(1, len(streams))]
    kids = " ".join(f"{page} 0 R" for page, _ in numbers)
    out = [b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n",
           f"2 0 obj\n<< /Type /Pages /Kids [{kids}] /Count {len(streams)} >>\nendobj\n".encode()]
    for (page, body), stream in zip(numbers, streams):
        out += [b"%d 0 obj\n<< /Type /Page /MediaBox [0 0 612 792] /Contents %d 0 R >>\nendobj\n" % (page, body),
                b"%d 0 obj\n<< /Length %d /Filter %s >>\nstream\n" % (body, len(stream), filters.encode()), stream, b"\nendstream\nendobj\n"]
    if info:
        out.append(("5 0 obj\n<< " + " ".join(f"/{k} ({v})" for k, v in info.items()) + " >>\nendobj\n").encode("latin-1", "replace"))
    out.append(extra.encode("latin-1", "replace") + b"\nstartxref\n0\n" + b"%%EOF\n" * revisions)
    return b"".join(out)


def quoted(text: str) -> str:
    return "(" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"


def show(text: str, x: float, y: float, before: str = "") -> str:
    return f"{before} BT /F1 12 Tf {x} {y} Td {quoted(text)} Tj ET\n"


def shape(name: str, text: str, x: int = 685800, y: int = 685800, w: int = 914400, h: int = 914400, hidden: bool = False, kind: str = "sp", inner: str = "", descr: str = "") -> str:
    return (f'<p:{kind}><p:cNvPr id="2" name={quoteattr(name)} descr={quoteattr(descr)}{" hidden=" + chr(34) + "1" + chr(34) if hidden else ""}/>{inner}'
            f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:{kind}>')


def slide(shapes: list[str], hidden: bool = False) -> str:
    return f'<p:sld {P}{" show=" + chr(34) + "0" + chr(34) if hidden else ""}><p:spTree>{"".join(shapes)}</p:spTree></p:sld>'


def relationships(*rows: tuple[str, str, str, bool]) -> str:
    each = "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target={quoteattr(to)}{" TargetMode=" + chr(34) + "External" + chr(34) if out else ""}/>' for i, t, to, out in rows)
    return f"<Relationships>{each}</Relationships>"


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pptx(slides: list[str], more: dict[str, str | bytes] | None = None) -> bytes:
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml'/></Types>",
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldSz cx="12192000" cy="6858000"/></p:presentation>'}
    parts |= {f"ppt/slides/slide{i}.xml": s for i, s in enumerate(slides, 1)}
    return package(parts | (more or {}))


def png(texts: dict[str, str]) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    notes = b"".join(chunk(b"tEXt", f"{k}\0{v}".encode("latin-1")) for k, v in texts.items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + notes + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
