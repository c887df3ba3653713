"""The document rules over files built from table rows: each key decides by its remainders what its file conceals.

The same remainders say in SQL which findings the scan has to give, so rules, evidence, places and severities of whole scans
can be compared with what a database works out from the tables alone.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import on_workers
from ..sources import build
from . import scan
from .files import built


def as_pdf(k: int, name: str) -> bytes:
    page = build.show(f"Plain {k}", 72, 740)
    if k % 2 == 0:
        page += build.show(f"hidden note {k}", 72, 700, "BT 3 Tr ET") + "BT 0 Tr ET\n"
    if k % 3 == 0:
        page += build.show(f"covered {k}", 72, 600) + "0 g 60 590 500 30 re f\n"
    if k % 5 == 0:
        page += build.show(f"far {k}", 5000, 500)
    if k % 7 == 0:
        page += build.show(f"faint {k}", 72, 400, "1 g") + "0 g\n"
    if k % 17 == 0:
        page += f"/Author (inner {k})\n"
    marks = ["/EmbeddedFiles /F (file %d.doc)" % k] if k % 6 == 0 else []
    marks += ["/OpenAction"] if k % 8 == 0 else []
    marks += ["/JavaScript"] if k % 16 == 0 else []
    marks += ["/AcroForm"] if k % 9 == 0 else []
    marks += [f"/V (value {k})"] if k % 18 == 0 else []
    marks += [f"/Subtype /Text /Contents (note {k})"] if k % 10 == 0 else []
    marks += ["/OCProperties"] if k % 11 == 0 else []
    marks += ["/Encrypt"] if k % 12 == 0 else []
    return build.pdf(page, {"Author": name} if k % 2 else None, "9 0 obj\n<< " + " ".join(marks) + " >>\nendobj\n", revisions=2 if k % 4 == 0 else 1)


def as_deck(k: int, brand: str) -> bytes:
    shapes = [build.shape("Title", f"Plain {k}")]
    if k % 4 == 0:
        shapes.append(build.shape("Box", f"veiled {k}", hidden=True))
    if k % 5 == 0:
        shapes.append(build.shape("Aside", f"aside {k}", x=13_000_000))
    if k % 6 == 0:
        shapes.append(build.shape("Photo", "", kind="pic", inner='<a:blip r:embed="rId3"/><a:srcRect l="12000"/>'))
    slides = [build.slide(shapes)] + ([build.slide([build.shape("Aim", f"Secret {k}")], hidden=True)] if k % 2 == 0 else [])
    more: dict[str, str | bytes] = {}
    links = [("rId2", "notesSlide", "../notesSlides/notesSlide1.xml", False)] if k % 3 == 0 else []
    links += [("rId3", "image", "../media/image1.png", False)] if k % 6 == 0 else []
    if links:
        more["ppt/slides/_rels/slide1.xml.rels"] = build.relationships(*links)
    notes = lambda text: f"<p:notes {build.P}><a:t>{text}</a:t></p:notes>"
    if k % 3 == 0:
        more["ppt/notesSlides/notesSlide1.xml"] = notes(f"Spoken {k}")
    if k % 7 == 0:
        more["ppt/notesSlides/notesSlide9.xml"] = notes(f"lost {k}")
    if k % 8 == 0:
        more["ppt/commentAuthors.xml"] = f'<p:cmAuthorLst><p:cmAuthor id="0" name="Reviewer {k}"/></p:cmAuthorLst>'
        more["ppt/comments/comment1.xml"] = f'<p:cmLst><p:cm authorId="0"><p:text>remark {k}</p:text></p:cm></p:cmLst>'
    elif k % 9 == 0:
        more["ppt/people.xml"] = "<p/>"
    if k % 10 == 0:
        more["ppt/embeddings/book.xlsx"] = b"0" * 64
    if k % 11 == 0:
        more["customXml/item1.xml"] = f"<a>inner {k}</a>"
    if k % 12 == 0:
        more["ppt/tags/tag1.xml"] = "<t/>"
    if k % 13 == 0:
        link = ("rId1", "oleObject", f"file:///C:/data/{k}.xlsx", True) if k % 3 == 0 else ("rId1", "hyperlink", f"https://h.example/p{k}", True) if k % 3 == 1 else (
            "rId1", "video", f"https://h.example/v{k}", True)
        more["ppt/_rels/presentation.xml.rels"] = build.relationships(link)
    if k % 14 == 0:
        more["docProps/core.xml"] = f"<c><dc:creator>{brand}</dc:creator></c>"
    if k % 15 == 0:
        more["docProps/custom.xml"] = f'<Properties><property name="Class"><vt:lpwstr>level {k}</vt:lpwstr></property></Properties>'
    if k % 16 == 0:
        more["ppt/vbaProject.bin"] = b"x"
    if k % 17 == 0:
        more["ppt/media/image1.png"] = build.png({"Author": f"Desk {k}"})
    if k % 19 == 0:
        more["../up.xml"] = "x"
    if k % 20 == 0:
        more["PPT/presentation.xml"] = "x"
    return build.pptx(slides, more)


OLE = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(24)
#: Bytes that the scan of the container query permits.
PERMITTED = 20_000


def claimed(deck: bytes, name: str, unpacked: int | None = None, flags: int = 0) -> bytes:
    """The package whose directory claims another size, or further flags, of an entry."""
    out = bytearray(deck)
    at = out.rfind(name.encode()) - 46
    if unpacked is not None:
        struct.pack_into("<II", out, at + 20, 5, unpacked)
    out[at + 8] |= flags
    return bytes(out)


def located(degrees: int) -> bytes:
    """A JPEG that was taken at so many and a half degrees north, and as many east."""
    tiff = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 26) + struct.pack("<I", 0)
    tiff += struct.pack("<H", 4) + struct.pack("<HHI", 1, 2, 2) + b"N\0\0\0" + struct.pack("<HHII", 2, 5, 3, 80) + struct.pack("<HHI", 3, 2, 2) + b"E\0\0\0" + struct.pack("<HHII", 4, 5, 3, 80) + struct.pack("<I", 0)
    tiff += struct.pack("<6I", degrees, 1, 30, 1, 0, 1)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def as_container(k: int) -> tuple[str, bytes]:
    """The ending and the bytes of a file that is no plain one."""
    slide = [build.slide([build.shape("Title", f"Plain {k}")])]
    match k % 10:
        case 0:
            return "txt", b"plain text"
        case 1:
            return "pptx", OLE
        case 2:
            return "doc", OLE
        case 3:
            return "pptx", build.pptx(slide).replace(b"PK\1\2", b"PK\1\3", 1)
        case 4:
            return "pptx", claimed(build.pptx(slide, {"blob.bin": b"12345"}), "blob.bin", 200_000_000 + k)
        case 5:
            return "pptx", claimed(build.pptx(slide, {"secret.bin": b"12345"}), "secret.bin", flags=1)
        case 6:
            return "pptx", build.package({"word/document.xml": "<w/>"})
        case 7:
            return "pptx", build.pptx(slide, {"ppt/media/image1.jpg": located(k % 90)})
        case 8:
            return "pdf", build.pdf(build.show(f"Plain {k}", 72, 740), extra="% " + "x" * PERMITTED)
    return "pdf", build.pdf(build.show(f"Plain {k}", 72, 740))


#: (rule, severity, SQL condition on k, SQL evidence, SQL location) of the built PDF files.
IN_PDFS = [
    ("pdf.text.invisible", "medium", "k % 2 = 0", "'hidden note ' || k", "'PDF stream 1'"), ("pdf.redaction.overlay", "high", "k % 3 = 0", "'covered ' || k", "'PDF stream 1'"),
    ("pdf.text.off-page", "medium", "k % 5 = 0", "'far ' || k", "'PDF stream 1'"), ("pdf.text.pale", "low", "k % 7 = 0", "'faint ' || k", "'PDF stream 1'"),
    ("pdf.metadata.stream", "medium", "k % 17 = 0", "'inner ' || k", "'PDF stream 1'"), ("pdf.metadata.personal", "medium", "k % 2 = 1", "'Author: ' || said", "'Document'"),
    ("pdf.revisions.incremental", "medium", "k % 4 = 0", "'2 EOF markers; 1 startxref marker'", "'Document'"), ("pdf.attachments", "high", "k % 6 = 0", "'file ' || k || '.doc'", "'Document'"),
    ("pdf.active-content", "medium", "k % 16 = 8", "'OpenAction'", "'Document'"), ("pdf.active-content", "high", "k % 16 = 0", "'JavaScript, OpenAction'", "'Document'"),
    ("pdf.forms", "low", "k % 18 = 9", "'AcroForm or XFA structure found'", "'Document'"), ("pdf.forms", "medium", "k % 18 = 0", "'value ' || k", "'Document'"),
    ("pdf.annotations", "medium", "k % 10 = 0", "'note ' || k", "'Document'"), ("pdf.layers", "medium", "k % 11 = 0", "NULL", "'Document'"),
    ("pdf.encryption", "info", "k % 12 = 0", "NULL", "'Document'"), ("file.extension-mismatch", "medium", "k % 13 = 0", "NULL", "'Document'"),
]
#: The same of the built presentations.
IN_DECKS = [
    ("pptx.slide.hidden", "medium", "k % 2 = 0", "'Secret ' || k", "'Slide 2'"), ("pptx.notes", "high", "k % 3 = 0", "'Spoken ' || k", "'Slide 1'"),
    ("pptx.object.hidden", "medium", "k % 4 = 0", "'veiled ' || k", "'Slide 1 — Box'"), ("pptx.object.off-slide", "medium", "k % 5 = 0", "'aside ' || k", "'Slide 1 — Aside'"),
    ("pptx.image.cropped", "medium", "k % 6 = 0", "'ppt/media/image1.png'", "'Slide 1 — Photo'"), ("pptx.notes.orphaned", "high", "k % 7 = 0", "'lost ' || k", "'ppt/notesSlides/notesSlide9.xml'"),
    ("pptx.comments", "medium", "k % 8 = 0", "'remark ' || k", "'ppt/comments/comment1.xml — Reviewer ' || k"), ("pptx.collaboration", "low", "k % 9 = 0 AND k % 8 <> 0", "'ppt/people.xml'", "'Document'"),
    ("pptx.embedded-files", "high", "k % 10 = 0", "'ppt/embeddings/book.xlsx (64 B)'", "'Document'"), ("pptx.custom-xml", "medium", "k % 11 = 0", "'customXml/item1.xml: inner ' || k", "'Document'"),
    ("pptx.retained-state", "low", "k % 12 = 0", "'ppt/tags/tag1.xml'", "'Document'"), ("pptx.external.local-path", "medium", "k % 39 = 0", "'file:///C:/data/' || k || '.xlsx'", "'Document'"),
    ("pptx.external.hyperlinks", "low", "k % 13 = 0 AND k % 3 = 1", "'https://h.example/p' || k", "'Document'"),
    ("pptx.external.linked-data", "medium", "k % 13 = 0 AND k % 3 = 2", "'video: https://h.example/v' || k", "'Document'"),
    ("pptx.metadata.personal", "medium", "k % 14 = 0", "'creator: ' || said", "'Document'"), ("pptx.metadata.custom", "medium", "k % 15 = 0", "'Class: level ' || k", "'Document'"),
    ("pptx.macro", "high", "k % 16 = 0", "'ppt/vbaProject.bin'", "'Document'"), ("pptx.macro.extension-mismatch", "high", "k % 16 = 0 AND k % 18 <> 0", "NULL", "'Document'"),
    ("pptx.image.metadata", "medium", "k % 17 = 0", "'ppt/media/image1.png: png:Author=Desk ' || k", "'Document'"), ("file.extension-mismatch", "medium", "k % 18 = 0", "NULL", "'Document'"),
    ("pptx.package.unsafe-path", "high", "k % 19 = 0", "'../up.xml'", "'Document'"), ("pptx.package.duplicate-name", "medium", "k % 20 = 0", "'PPT/presentation.xml'", "'Document'"),
]


#: The same of the built containers.
IN_CONTAINERS = [
    ("file.unsupported", "high", "k % 10 IN (0, 2)", "NULL", "'Document'"), ("pptx.encrypted-package", "high", "k % 10 = 1", "NULL", "'Document'"),
    ("pptx.package.invalid", "high", "k % 10 = 3", "'Invalid central-directory entry at index 0.'", "'Document'"),
    ("pptx.package.large-entry", "medium", "k % 10 = 4", "'blob.bin'", "'Document'"), ("pptx.package.high-compression-ratio", "medium", "k % 10 = 4", "'blob.bin'", "'Document'"),
    ("pptx.package.encrypted-entry", "high", "k % 10 = 5", "'secret.bin'", "'Document'"), ("pptx.package.signature", "high", "k % 10 = 6", "NULL", "'Document'"),
    ("pptx.image.gps", "high", "k % 10 = 7", "'ppt/media/image1.jpg: ' || (k % 90) || '.50000, ' || (k % 90) || '.50000'", "'Document'"),
    ("file.size-limit", "high", "k % 10 = 8", "NULL", "'Document'"),
]


def expected(rules: list[tuple], source: str, name: str) -> str:
    each = " UNION ALL ".join(f"SELECT {name} AS name, '{rule}' AS rule_id, '{severity}' AS severity, CAST({evidence} AS VARCHAR) AS evidence, {place} AS location FROM s WHERE {when}"
                              for rule, severity, when, evidence, place in rules)
    return f"WITH s AS ({source}) {each}"


def found(files: DataFrame, max_bytes: int = scan.MAX_BYTES) -> DataFrame:
    done = scan.scan(files, max_bytes)
    return done.findings.join(done.files.select("file_id", "name"), "file_id").select("name", "rule_id", "severity", "evidence", "location")


def pdf_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS BIGINT) AS k", "c_name")
    return found(built(rows, as_pdf, "cust{}.pdf", ("cust{}.txt", 13)))


def pptx_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey AS BIGINT) AS k", "p_brand")
    return found(built(rows, as_deck, "part{}.pptx", ("part{}.bin", 18)))


def container_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey AS BIGINT) AS k")

    def run(pdfs):
        for pdf in pdfs:
            made = [(f"file{k}", *as_container(int(k))) for k in pdf["k"]]
            yield pd.DataFrame([(f"{n}.{ending}", f"{n}.{ending}", data) for n, ending, data in made], columns=["file_id", "name", "content"])

    return found(rows.mapInPandas(run, "file_id string, name string, content binary"), PERMITTED)


QUERIES = {f.__name__: f for f in (pdf_rule_findings, pptx_rule_findings, container_rule_findings)}
ORACLES = {
    "pdf_rule_findings": expected(IN_PDFS, "SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS said FROM customer", "'cust' || k || CASE WHEN k % 13 = 0 THEN '.txt' ELSE '.pdf' END"),
    "pptx_rule_findings": expected(IN_DECKS, "SELECT CAST(p_partkey AS BIGINT) AS k, p_brand AS said FROM part", "'part' || k || CASE WHEN k % 18 = 0 THEN '.bin' ELSE '.pptx' END"),
    "container_rule_findings": expected(IN_CONTAINERS, "SELECT CAST(p_partkey AS BIGINT) AS k FROM part", "'file' || k || CASE k % 10 WHEN 0 THEN '.txt' WHEN 2 THEN '.doc' WHEN 8 THEN '.pdf' WHEN 9 THEN '.pdf' ELSE '.pptx' END"),
}
