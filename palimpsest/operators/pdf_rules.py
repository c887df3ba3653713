"""The PDF rules: regular expressions over the raw bytes, joins and caps over the evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import EDGE, SPACE, safe_evidence
from .packages import covered_texts
from .rules import emit, hit, in_order, listed

#: The checks that a report names, and (in ``coverage``) what limits one.
CHECKS = ("PDF signature and structural markers", "Metadata and document properties", "Incremental revisions and prior-save markers",
          "Embedded files, actions, forms, annotations, and optional content", "Decoded content streams")
LABELS = {"Author": "Author", "Creator": "Creator application", "Producer": "PDF producer"}
ACTIONS = ("JavaScript", "OpenAction", "AA", "Launch", "SubmitForm")
NOTES = "Text|FreeText|Popup|Stamp|Ink|Highlight|Squiggly|Underline|StrikeOut"
CAPS = {"covered": 20, "invisible": 20, "off": 10, "pale": 5}


def strings(evidence: DataFrame) -> DataFrame:
    """For each file ordered lists of its string values by key; ``names`` as they are in the file, the others cleaned."""
    rows = evidence.where("kind = 'string' AND stream = 0").withColumn("clean", safe_evidence(F.col("text")))
    turn = F.when(F.col("key") == "Author", 0).when(F.col("key") == "Creator", 1).otherwise(2)
    label = F.lit("")
    for k, v in LABELS.items():
        label = F.when(F.col("key") == k, f"{v}: ").otherwise(label)
    seq, clean = F.col("seq"), F.col("clean")
    keyed = lambda *keys: F.col("key").isin(*keys) & (clean != "")
    return rows.groupBy("file_id").agg(
        in_order(keyed(*LABELS), F.struct("key", F.rtrim(label, F.lit(": ")).alias("label"), clean.alias("value")), turn, seq).alias("fields"),
        in_order(keyed(*LABELS), F.concat(label, clean), turn, seq).alias("identity"),
        F.array_distinct(in_order(F.col("key").isin("F", "UF"), F.col("text"), F.col("key") == "UF", seq)).alias("names"),
        F.array_distinct(in_order(keyed("V", "DV"), clean, F.col("key") == "DV", seq)).alias("values"),
        in_order(keyed("Contents"), clean, seq).alias("comments"))


#: Fixed values, as are ACTIONS and NOTES: whether a marker stands in the file, as patterns over its bytes.
MARKERS = {
    "encrypt": f"/Encrypt{EDGE}",
    "prev": rf"/Prev[{SPACE}]+\d+",
    "attached": rf"/EmbeddedFiles{EDGE}|/Subtype[{SPACE}]*/FileAttachment{EDGE}|/Type[{SPACE}]*/Filespec{EDGE}",
    "active": rf"/JavaScript{EDGE}|/JS[{SPACE}]*(?:\(|<)|/OpenAction{EDGE}|/AA{EDGE}|/Launch{EDGE}|/SubmitForm{EDGE}",
    "severe": f"/JavaScript{EDGE}|/Launch{EDGE}",
    "form": f"/AcroForm{EDGE}|/XFA{EDGE}",
    "noted": rf"/Annots{EDGE}|/Subtype[{SPACE}]*/(?:{NOTES}){EDGE}",
    "layered": rf"/OCProperties{EDGE}|/Type[{SPACE}]*/OCG{EDGE}",
}
MARKS = ", ".join(f"{k} boolean" for k in MARKERS) + ", eof bigint, xref bigint, actions array<string>, version string"


def marks(source: Column) -> Column:
    """The struct MARKS of a file's bytes as text: all that the rules need of them."""
    found = [F.rlike(source, F.lit(p)).alias(k) for k, p in MARKERS.items()]
    counts = [F.regexp_count(source, F.lit(w)).cast("bigint").alias(k) for k, w in (("eof", "%%EOF"), ("xref", "startxref"))]
    actions = F.array_compact(F.array(*[F.when(F.rlike(source, F.lit(f"/{a}{EDGE}")), a) for a in ACTIONS]))
    return F.struct(*found, *counts, actions.alias("actions"), F.substring(source, 6, 3).alias("version"))


def hits(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rule rows of PDF files (file_id, marks)."""
    mark = lambda k: F.col(f"marks.{k}")
    empty = F.array().cast("array<string>")
    whole = files.select("file_id", "marks").join(strings(evidence), "file_id", "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("identity", "names", "values", "comments")})
    eof, xref = mark("eof"), mark("xref")
    plural = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w} marker"), F.when(n == 1, "").otherwise("s"))
    values, comments = F.slice("values", 1, 8), F.slice("comments", 1, 12)
    filled, noted = F.size("values") > 0, F.size("comments") > 0
    raw = emit(
        whole,
        hit(1, "pdf.encryption", mark("encrypt")),
        hit(2, "pdf.metadata.personal", F.size("identity") > 0, evidence=listed(F.col("identity"), 5, "; "), data=F.to_json(F.struct(F.slice("fields", 1, 10).alias("fields")))),
        hit(3, "pdf.revisions.incremental", (eof > 1) | (xref > 1) | mark("prev"), evidence=F.concat(plural(eof, "EOF"), F.lit("; "), plural(xref, "startxref"))),
        hit(4, "pdf.attachments", mark("attached"),
            evidence=F.when(F.size("names") > 0, F.array_join(F.transform(F.slice("names", 1, 10), safe_evidence), ", ")).otherwise("EmbeddedFiles, FileAttachment, or Filespec structure found")),
        hit(5, "pdf.active-content", mark("active"), severity=F.when(mark("severe"), "high").otherwise("medium"), evidence=F.array_join(mark("actions"), ", ")),
        hit(6, "pdf.forms", mark("form"), severity=F.when(filled, "medium").otherwise("low"),
            summary=F.when(filled, "The PDF contains form fields with saved or default values."), evidence=F.when(filled, F.array_join(values, "; ")).otherwise("AcroForm or XFA structure found"),
            scan=F.when(filled, F.array_join(values, "\n")), scan_location="PDF form values"),
        hit(7, "pdf.annotations", mark("noted"), severity=F.when(noted, "medium").otherwise("low"),
            summary=F.when(noted, "Annotation text may be visible through a PDF reader even when it is not prominent on the page."),
            evidence=F.when(noted, F.array_join(comments, " | ")).otherwise("Annotation markers found"), scan=F.when(noted, F.array_join(comments, "\n")), scan_location="PDF annotations"),
        hit(8, "pdf.layers", mark("layered")))
    return raw.unionByName(stream_hits(evidence))


def concealed(evidence: DataFrame) -> DataFrame:
    """(file_id, stream, what, at, text, ratio): concealed texts, the first few of each kind in a stream."""
    texts = evidence.where("kind = 'text'")
    rects = evidence.where("kind = 'rect'").where(g.dark_fill(F.col("r"), F.col("g"), F.col("b")))
    covered = covered_texts(texts, rects, ["file_id", "stream"]).select("file_id", "stream", "seq", F.lit("covered").alias("what"), "text", "ratio")
    unseen = g.invisible(F.col("render_mode"))
    kinds = F.array_compact(F.array(
        F.when(unseen, "invisible"), F.when(g.off_page(*[F.col(c) for c in ("left", "right", "bottom", "top")]), "off"),
        F.when(~unseen & g.pale_fill(F.col("r"), F.col("g"), F.col("b")), "pale")))
    others = texts.select("file_id", "stream", "seq", F.explode(kinds).alias("what"), "text", F.lit(None).cast("double").alias("ratio"))
    at = F.row_number().over(Window.partitionBy("file_id", "stream", "what").orderBy("seq"))
    most = F.lit(0)
    for k, n in CAPS.items():
        most = F.when(F.col("what") == k, n).otherwise(most)
    return covered.unionByName(others).withColumn("at", at).where(F.col("at") <= most)


def stream_hits(evidence: DataFrame) -> DataFrame:
    place = F.concat(F.lit("PDF stream "), F.col("stream").cast("string"))
    what, clean = F.col("what"), safe_evidence(F.col("text"))
    base = (F.col("stream") + 1).cast("bigint") * 1000
    found = emit(
        concealed(evidence),
        hit(base + F.col("at"), "pdf.redaction.overlay", what == "covered", evidence=clean, location=place, scan=F.col("text"), data=F.to_json(F.struct(F.round("ratio", 2).alias("overlapRatio")))),
        hit(base + 100 + F.col("at"), "pdf.text.invisible", what == "invisible", evidence=clean, location=place, scan=F.col("text")),
        hit(base + 200 + F.col("at"), "pdf.text.off-page", what == "off", evidence=clean, location=place),
        hit(base + 300 + F.col("at"), "pdf.text.pale", what == "pale", evidence=clean, location=place))
    turn = F.when(F.col("key") == "Author", 0).when(F.col("key") == "Creator", 1).otherwise(2)
    metadata = evidence.where("kind = 'string' AND stream > 0").withColumn("clean", clean).where("clean <> ''").groupBy("file_id", "stream").agg(
        in_order(F.lit(True), F.col("clean"), turn, F.col("seq")).alias("values"))
    return found.unionByName(emit(metadata, hit(base + 400, "pdf.metadata.stream", evidence=listed(F.col("values"), 5, "; "), location=place)))


def stream_counts(evidence: DataFrame) -> DataFrame:
    """file_id, streams, decodedStreams, decodedBytes, unsupported, failed, over."""
    status = lambda s: F.count_if(F.col("key") == s)
    return evidence.where("kind = 'stream'").groupBy("file_id").agg(
        F.count("*").alias("streams"), status("decoded").alias("decodedStreams"), F.coalesce(F.sum("size"), F.lit(0)).alias("decodedBytes"),
        status("unsupported").alias("unsupported"), status("failed").alias("failed"), status("over").alias("over"))


def coverage(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """file_id, checks, limitations."""
    rows = files.select("file_id", F.col("marks.encrypt").alias("encrypted")).join(stream_counts(evidence), "file_id", "left").fillna(0)
    n = lambda c: F.concat(F.col(c).cast("string"), F.lit(" PDF stream"), F.when(F.col(c) == 1, "").otherwise("s"))
    limits = F.array_compact(F.array(
        F.when(F.col("encrypted"), "Encrypted PDF content may not be readable by the scanner."),
        F.when(F.col("streams") >= 10_000, "Only the first 10000 PDF streams were considered."),
        F.when(F.col("over") > 0, "Decoded stream data reached the 268435456-byte aggregate safety limit."),
        F.when(F.col("unsupported") > 0, F.concat(n("unsupported"), F.lit(" used unsupported filters and could not be decoded."))),
        F.when(F.col("failed") > 0, F.concat(n("failed"), F.lit(" could not be decoded because the data was malformed or exceeded a safety limit.")))))
    return rows.select("file_id", F.lit(list(CHECKS)).alias("checks"), limits.alias("limitations"))


def details(files: DataFrame, evidence: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """The counters of PDF reports, by file_id; ``rule_rows`` are the rows of ``hits``."""
    count = lambda rule: F.count_if(F.col("rule") == rule)
    shown = rule_rows.groupBy("file_id").agg(count("pdf.redaction.overlay").alias("coveredTextItems"), count("pdf.text.invisible").alias("invisibleTextItems"),
                                             count("pdf.text.off-page").alias("offPageTextItems"), count("pdf.text.pale").alias("paleTextItems"))
    rows = files.select("file_id", F.col("marks.version").alias("pdfVersion"), F.greatest("marks.eof", "marks.xref").alias("revisions"))
    streams = stream_counts(evidence).drop("unsupported", "failed", "over")
    return rows.join(streams, "file_id", "left").join(shown, "file_id", "left").fillna(0)
