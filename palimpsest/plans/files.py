"""Queries over files that Spark builds from the given tables: each row becomes a PDF or a presentation and is scanned."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dealt, on_workers
from ..functions import sensitive
from ..functions.text import SPACE
from ..operators import evidence
from ..sources import build
from . import render, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def built(rows: DataFrame, make, name: str, other: tuple[str, int] | None = None) -> DataFrame:
    """(file_id, name, content) of ``make(values...)``; the first value is the key, of which every so many take the ``other`` name."""
    columns = rows.columns
    on_workers(rows.sparkSession)

    def run(pdfs):
        for pdf in pdfs:
            values = [[x.item() if hasattr(x, "item") else x for x in v] for v in zip(*(pdf[c] for c in columns))]
            called = [(other[0] if other and v[0] % other[1] == 0 else name).format(v[0]) for v in values]
            out = [(n, n, make(*v)) for n, v in zip(called, values)]
            yield pd.DataFrame(out, columns=["file_id", "name", "content"])

    return dealt(rows, columns[0]).mapInPandas(run, "file_id string, name string, content binary")


PATTERNS = {r.id: re.compile(r.pattern.replace("<b>", r"\b").replace("<s>", SPACE), re.ASCII) for r in sensitive.RULES}
#: Rules whose matches may hold blanks: no line or shape ends within such a match. What a text must hold, in lower case, one of these at least, or as a pattern.
SPACED = {"private-key": ("-----",), "bearer-token": ("bearer",), "credential-assignment": ("key", "secret", "passw", "token"),
          **{k: re.compile("[0-9][ -]?[0-9]") for k in ("us-ssn", "iban", "payment-card")}}
LINE, LONGEST, LINES = 80, 300, 20  # characters of a line and of one shown text at most; lines of a content stream, within the caps of each kind


def units(text: str) -> list[str]:
    """The words with what a rule matches across blanks kept in one."""
    clean = " ".join(text.split())
    low = clean.lower()
    there = [k for k, hint in SPACED.items() if (any(w in low for w in hint) if isinstance(hint, tuple) else hint.search(clean))]
    held = [m.span() for k in there for m in PATTERNS[k].finditer(clean)]
    if not held:
        return clean.split(" ") if clean else []
    bound = {at for begin, end in held for at in range(begin, end) if clean[at] == " "}
    out, begin = [], 0
    for at in [i for i, c in enumerate(clean) if c == " " and i not in bound] + [len(clean)] if clean else []:
        out.append(clean[begin:at])
        begin = at + 1
    return out


def cut(unit: str) -> list[str]:
    """The unit in pieces of ``LONGEST`` characters at most, none of which ends within a match that one piece can hold."""
    if len(unit) <= LONGEST:
        return [unit]
    held = sorted(m.span() for p in PATTERNS.values() for m in p.finditer(unit) if m.end() - m.start() <= LONGEST)
    out, begin = [], 0
    while begin < len(unit):
        end = min(len(unit), begin + LONGEST)
        for first, last in reversed(held):
            if begin < first < end < last:
                end = first
        out.append(unit[begin:end])
        begin = end
    return out


def wrapped(line: str) -> list[str]:
    """All of the line in pieces of about ``LINE`` characters; a unit without a break is cut only where one shown text ends."""
    out: list[str] = []
    for unit in units(line):
        if out and len(out[-1]) + 1 + len(unit) <= LINE:
            out[-1] += " " + unit
        else:
            out += cut(unit)
    return out or [""]


def as_pdf(key: int, text: str, source: str) -> bytes:
    """All lines of the text, wrapped, shown, covered, invisible or pale by turns, on as many pages as they need."""
    ways = ("", "BT 3 Tr ET", "BT 0 Tr ET 1 g", "BT 0 Tr ET 0 g")
    lines = [piece for line in text.split("\n") for piece in wrapped(line)]
    pages = []
    for begin in range(0, len(lines), LINES):
        content = ""
        for i, line in enumerate(lines[begin: begin + LINES]):
            content += build.show(line, 72, 760 - 18 * i, ways[i % 4])
            if i % 4 == 3:
                content += f"0 g 60 {750 - 18 * i} {max(500, 24 + 6 * len(line))} 24 re f\n"
        pages.append(content)
    return build.pdf(pages, {"Author": source} if key % 3 == 0 else None, revisions=1 + key % 2)


def as_deck(key: int, text: str, role: str) -> bytes:
    """All words of the text over as many slides, and notes, as they need."""
    words = units(text)
    slides, notes = [], {}
    for at in range(0, max(1, len(words)), 30):
        title, aside, box = (" ".join(words[at + i: at + j]) for i, j in ((0, 8), (8, 16), (16, 30)))
        slides.append(build.slide([build.shape("Title", title), build.shape("Aside", aside, x=13_000_000 if key % 2 else 0),
                                   build.shape("Box", box, hidden=key % 3 == 0)], hidden=key % 5 == 0))
    for n, at in enumerate(range(0, max(1, len(words)), 40), 1):
        said = " ".join(words[at: at + 40]).replace("<", " ").replace("&", " ")
        notes[f"ppt/slides/_rels/slide{n}.xml.rels"] = build.relationships(("rId1", "notesSlide", f"../notesSlides/notesSlide{n}.xml", False))
        notes[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {build.P}><a:t>{said}</a:t></p:notes>"
    more = {"docProps/core.xml": f"<c><dc:creator>{role}</dc:creator></c>", "ppt/media/image1.png": build.png({"Author": role})}
    return build.pptx(slides, more | (notes if key % 4 == 0 else {}))


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source")), as_pdf, "doc{}.pdf")


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    return built(rows, as_deck, "deck{}.pptx")


COLUMNS = ("name", "size", "high", "medium", "low", "total", "score", "verdict_code", "complete")


@query
def pdf_reports(spark, sf_dir):
    return scan.reports(pdfs(spark, sf_dir)).select(*COLUMNS)


@query
def pptx_reports(spark, sf_dir):
    return scan.reports(decks(spark, sf_dir)).select(*COLUMNS)


@query
def pdf_text_items(spark, sf_dir):
    files = evidence.described(pdfs(spark, sf_dir))
    return evidence.pdf_evidence(files).where("kind = 'text'").select("file_id", "stream", "seq", "text", "left", "right", "bottom", "top", "render_mode")


@query
def zip_entries(spark, sf_dir):
    files = evidence.described(decks(spark, sf_dir))
    return evidence.package_entries(files).select("file_id", "idx", "name", "packed", "unpacked", "method", "crc", "directory")


@query
def image_metadata(spark, sf_dir):
    files = evidence.described(decks(spark, sf_dir))
    rows = evidence.package_entries(files).where("fields IS NOT NULL").select("file_id", "name", F.explode("fields").alias("f"))
    return rows.select("file_id", F.col("name").alias("part"), F.col("f.name").alias("field"), F.col("f.value").alias("value"))


@query
def markdown_reports(spark, sf_dir):
    done = scan.scan(pdfs(spark, sf_dir))
    return render.rendered(render.full_reports(done, "2024-01-01T00:00:00.000Z"), "markdown")
