"""What the rules say, and the shape in which rule branches emit findings.

A branch gives rows (file_id, ord, rule, severity, evidence, location, summary, data, scan, scan_location): ``scan`` is
concealed text whose sensitive values become findings right after it. ``said`` adds the fixed texts and the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import identified, sensitive_findings

#: Rule, default severity, confidence, title, summary, tags. Identifiers hash the summary.
TEXTS = (
    ("file.size-limit", "high", "high", "File exceeds the scan safety limit", "", "coverage"),
    ("file.extension-mismatch", "medium", "high", "Filename extension does not match the content", "", "format"),
    ("file.unsupported", "high", "high", "Unsupported or unrecognized file format", "", "coverage"),
    ("scanner.failure", "high", "high", "Scan could not be completed", "The scanner encountered malformed data or an internal safety limit.", "coverage"),
    ("pptx.encrypted-package", "high", "high", "Encrypted or legacy Office container detected", "Modern password-protected Office files are stored in an encrypted compound container that cannot be inspected without decryption.", "encryption,coverage"),
    ("pdf.encryption", "info", "high", "Encrypted PDF detected", "Encrypted content cannot be fully inspected without decrypting the document first.", "coverage"),
    ("pdf.metadata.personal", "medium", "high", "Authoring metadata remains in the PDF", "The file contains author or software-identifying properties that recipients can inspect.", "metadata,identity"),
    ("pdf.revisions.incremental", "medium", "high", "Earlier PDF revisions may remain recoverable", "The file contains multiple end-of-file or cross-reference revision markers, consistent with incremental saves.", "revision-history,recoverable-content"),
    ("pdf.attachments", "high", "high", "Embedded file or file attachment detected", "The PDF package appears to contain another file that may be accessible to the recipient.", "attachment,hidden-content"),
    ("pdf.active-content", "medium", "high", "Active PDF behavior detected", "The document contains an action that can run, launch, submit, or execute when the PDF is opened or used.", "active-content,security"),
    ("pdf.forms", "low", "high", "Interactive form data detected", "The PDF contains an interactive form structure.", "form,hidden-content"),
    ("pdf.annotations", "low", "high", "Comments or annotations detected", "The PDF contains annotation structures.", "comments,hidden-content"),
    ("pdf.layers", "medium", "high", "Optional content layers detected", "The PDF includes content groups that a recipient may be able to show or hide.", "layer,hidden-content"),
    ("pdf.redaction.overlay", "high", "medium", "Recoverable text appears beneath an opaque rectangle", "Text remains in the content stream and appears geometrically covered rather than removed.", "redaction,recoverable-content"),
    ("pdf.text.invisible", "medium", "high", "Invisible text remains in the PDF", "The content stream uses a non-painting text-rendering mode, so text can remain selectable or extractable without being visibly drawn.", "hidden-text,recoverable-content"),
    ("pdf.text.off-page", "medium", "low", "Text may be positioned outside the visible page", "Text coordinates appear to fall outside a standard page boundary. Complex page transforms can cause false positives.", "hidden-text"),
    ("pdf.text.pale", "low", "low", "Very light text detected", "Text is drawn in a near-white fill and may be difficult to see on a light page, although it can be legitimate on a dark background.", "hidden-text"),
    ("pdf.metadata.stream", "medium", "medium", "Metadata found inside a decoded PDF stream", "A decoded metadata or object stream contains authoring information.", "metadata"),
    ("pptx.package.invalid", "high", "high", "PowerPoint package could not be opened", "The file is not a readable Office Open XML package or it violates a scanner safety limit.", "format,coverage"),
    ("pptx.package.unsafe-path", "high", "high", "Unsafe path found inside the presentation package", "Entry name is unsafe.", "package,integrity"),
    ("pptx.package.duplicate-name", "medium", "high", "Unusual Office package structure detected", "", "package,integrity"),
    ("pptx.package.large-entry", "medium", "high", "Unusual Office package structure detected", "Entry exceeds the per-entry safety limit.", "package,integrity"),
    ("pptx.package.high-compression-ratio", "medium", "high", "Unusual Office package structure detected", "", "package,integrity"),
    ("pptx.package.encrypted-entry", "high", "high", "Encrypted package entries cannot be inspected", "", "coverage,encryption"),
    ("pptx.package.signature", "high", "high", "File is not a valid PowerPoint Open XML presentation", "Required PowerPoint package parts are missing.", "format"),
    ("pptx.macro", "high", "high", "VBA macro content detected", "The presentation contains executable Visual Basic for Applications content.", "macro,active-content"),
    ("pptx.macro.extension-mismatch", "high", "high", "Macro content does not match the .pptx extension", "Executable VBA content was found in a file named as a non-macro PowerPoint presentation.", "macro,format"),
    ("pptx.metadata.personal", "medium", "high", "Authoring metadata remains in the presentation", "Recipients can inspect author, company, editor, or template properties stored in the file.", "metadata,identity"),
    ("pptx.metadata.custom", "medium", "high", "Custom document properties detected", "Custom properties can contain internal workflow, classification, or identifying information.", "metadata"),
    ("pptx.slide.hidden", "medium", "high", "Hidden slide remains in the presentation", "Hidden slides are still part of the file and can be opened or unhidden by the recipient.", "hidden-slide,recoverable-content"),
    ("pptx.notes", "high", "high", "Speaker notes remain in the presentation", "Speaker notes are stored inside the file and can be read by the recipient.", "speaker-notes,hidden-content"),
    ("pptx.object.hidden", "medium", "high", "Hidden slide object detected", "The object is marked hidden but remains stored in the presentation.", "hidden-object,recoverable-content"),
    ("pptx.object.off-slide", "medium", "high", "Object is positioned entirely outside the slide", "Off-slide objects do not appear in the normal slide canvas but remain extractable from the file.", "off-slide,hidden-content"),
    ("pptx.image.cropped", "medium", "high", "Cropped image may retain the removed areas", "PowerPoint stores the source image in the package. A recipient may be able to extract areas hidden by cropping.", "image,recoverable-content"),
    ("pptx.notes.orphaned", "high", "high", "Unlinked speaker-note content remains in the package", "A notes part exists even though no current slide relationship points to it.", "speaker-notes,orphaned-content"),
    ("pptx.comments", "medium", "high", "Review comments remain in the presentation", "Comment text and collaboration context can be inspected by the recipient.", "comments,collaboration"),
    ("pptx.collaboration", "low", "high", "Collaboration identity data detected", "The package includes people or author records associated with collaboration features.", "collaboration,identity"),
    ("pptx.embedded-files", "high", "high", "Embedded files remain in the presentation", "Recipients may be able to open or extract the original embedded documents and their underlying data.", "attachment,embedded-object"),
    ("pptx.custom-xml", "medium", "high", "Custom XML data detected", "The presentation package contains application-defined XML that is not normally visible on slides.", "custom-xml,hidden-content"),
    ("pptx.retained-state", "low", "high", "Retained editing or presentation-state parts detected", "The package contains internal state such as tags, views, or revision-related parts that are not central to slide rendering.", "editing-state"),
    ("pptx.external.local-path", "medium", "high", "Local or network file paths remain in the presentation", "Linked paths can reveal usernames, directory structures, server names, or internal locations.", "external-link,local-path"),
    ("pptx.external.linked-data", "medium", "high", "External linked content detected", "The presentation references external data, media, or objects that may reveal locations or change after delivery.", "external-link,linked-data"),
    ("pptx.external.hyperlinks", "low", "high", "External hyperlinks detected", "Hyperlinks may be intentional, but their targets and query parameters are stored in the file package.", "hyperlink"),
    ("pptx.image.gps", "high", "high", "GPS coordinates remain in an embedded image", "The original image metadata contains a location that a recipient may be able to extract from the presentation package.", "image,gps,metadata"),
    ("pptx.image.metadata", "medium", "high", "Identifying metadata remains in embedded images", "Camera, owner, software, copyright, or creation information may be extractable from original images.", "image,metadata"),
)

#: What a sensitive value in concealed text means, by kind of file.
CONCEALED = {
    "pdf": "A potentially sensitive value appears in content that may not be obvious in the normal document view.",
    "pptx": "A private or credential-like value appears in content that may not be obvious in the normal slide view.",
}

ADVICE = {
    "file": "Check the source of the file, or inspect it by hand before sharing.",
    "scanner": "Do not treat this file as cleared; make a fresh copy and scan it again.",
    "pdf": "Remove it in the source document, export a new file and scan that again.",
    "pptx": "Remove it from the copy that is to be shared, save that and scan it again.",
}

#: Rules added by ``register``: their texts, as in TEXTS, and their branches.
REGISTERED: list[tuple[tuple[str, str, str, str, str, str], Callable[[DataFrame, DataFrame, DataFrame], DataFrame]]] = []


def register(text: tuple[str, str, str, str, str, str], branch: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """Adds a rule to every scan after it. ``branch(files, pdf rows, package entries)`` gives the rows of ``emit``."""
    if any(text[0] == known[0] for known in (*TEXTS, *(t for t, _ in REGISTERED))):
        raise ValueError(f"there is a rule {text[0]} already")
    REGISTERED.append((text, branch))


FIELDS = {"ord": "bigint", "rule": "string", "severity": "string", "evidence": "string", "location": "string", "summary": "string",
          "data": "string", "scan": "string", "scan_location": "string"}
#: Places between two emitted rows, for what their concealed text holds.
GAP = 100


def hit(ord_: Column | int, rule: str, when: Column | bool = True, **given: Column | str) -> Column:
    """A finding struct where ``when`` holds, else null."""
    values = {"ord": (F.lit(ord_) if isinstance(ord_, int) else ord_).cast("bigint") * GAP, "rule": F.lit(rule)}
    for k, v in given.items():
        values[k] = F.lit(v) if isinstance(v, str) else v
    row = F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])
    return F.when(F.coalesce(when, F.lit(False)) if isinstance(when, Column) else F.lit(when), row)


def emit(rows: DataFrame, *hits: Column) -> DataFrame:
    return rows.select("file_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("file_id", *[F.col(f"h.{k}").alias(k) for k in FIELDS])


def listed(values: Column, most: int, separator: str) -> Column:
    return F.array_join(F.slice(values, 1, most), separator)


def in_order(when: Column, value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group's rows where ``when`` holds, in order."""
    one = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(when, one))), lambda x: x["v"])


def said(rows: DataFrame) -> DataFrame:
    """Findings in the common shape: the rules' own and those of the sensitive values in what they conceal.

    ``rows`` are those of ``emit`` with their ``family``, pdf or pptx.
    """
    spark = rows.sparkSession
    texts = spark.createDataFrame([*TEXTS, *(text for text, _ in REGISTERED)], "rule string, severity_ string, confidence string, title string, summary_ string, tags_ string")
    prefix = F.substring_index("rule", ".", 1)
    advice = F.lit(ADVICE["file"])
    for k, v in ADVICE.items():
        advice = F.when(prefix == k, v).otherwise(advice)
    own = rows.where("rule <> ''").join(F.broadcast(texts), "rule").select(  # as many rows as there are rules
        "file_id", "ord", F.col("rule").alias("rule_id"), F.coalesce("severity", "severity_").alias("severity"), "confidence", "title",
        F.coalesce("summary", "summary_").alias("summary"), "evidence", "location", advice.alias("remediation"), F.split("tags_", ",").alias("tags"), "data")
    by = lambda texts: F.when(F.col("family") == "pdf", texts["pdf"]).otherwise(texts["pptx"])
    scanned = rows.where("scan <> ''").select("file_id", (F.col("ord") + 1).alias("base"), F.coalesce("scan_location", "location").alias("location"), "scan",
                                              by(CONCEALED).alias("concealed"), by(ADVICE).alias("advice"))
    found = sensitive_findings(scanned, "scan", F.col("concealed"), F.col("advice"))
    return identified(own).unionByName(found)
