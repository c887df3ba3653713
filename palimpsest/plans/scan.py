"""Scanning a DataFrame of files (name, content): findings, coverage and one report for each file.

The files are read once: the pass that inspects them writes its rows, without bytes, to the shared folder, and every rule reads its
kinds of rows from there; what the rules hit is kept likewise. Nothing stays in executors' memory; ``Scan.release`` removes the
tables once the results are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers
from ..functions.text import extension_of
from ..operators import evidence, findings, pdf_rules, pptx_rules
from ..operators.evidence import MAX_BYTES, POWERPOINT
from ..operators.kept import forget, keep
from ..operators.pdf_rules import MARKS
from ..operators.rules import REGISTERED, emit, hit, said
from ..sources import ranges


@dataclass(frozen=True)
class Scan:
    """What a scan gives, all by ``file_id``; unpacks into files, findings and coverage."""

    files: DataFrame
    findings: DataFrame
    coverage: DataFrame
    details: DataFrame
    paths: tuple[str, ...]

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.files, self.findings, self.coverage))

    def reports(self) -> DataFrame:
        """One row for each file: descriptor, counts, score, verdict, coverage."""
        return findings.reports(*self)

    def release(self) -> None:
        """Removes the kept tables; what reads from them no longer works."""
        for path in self.paths:
            forget(self.files.sparkSession, path)


def container_hits(files: DataFrame, max_bytes: int) -> DataFrame:
    """Rule rows on the file as a whole: size, type, extension, and a scan that failed."""
    ext, kind = F.col("extension"), F.col("detected")
    read = F.col("failure").isNull()
    powerpoint, fits = ext.isin(*POWERPOINT), ~F.col("too_large")
    late = 10**13
    size = F.concat(F.lit("The file is "), F.col("size").cast("string"), F.lit(f" bytes; this scan permits at most {max_bytes} bytes."))
    unknown = F.when(ext != "", F.concat(F.lit("This scanner cannot inspect ."), ext, F.lit(" files."))).otherwise("The file format could not be identified.")
    package = F.when(ext != "", F.concat(F.lit("The file contains a PowerPoint package but is named ."), ext, F.lit("."))).otherwise(
        "The file contains a PowerPoint package but has no PowerPoint extension.")
    return emit(
        files,
        hit(0, "file.size-limit", F.col("too_large"), summary=size),
        hit(0, "file.unsupported", fits & ((kind == "unknown") | ((kind == "ole") & ~powerpoint)), summary=unknown),
        hit(0, "scanner.failure", ~read, evidence=F.col("failure")),
        hit(0, "pptx.encrypted-package", fits & (kind == "ole") & powerpoint),
        hit(late, "file.extension-mismatch", read & fits & (kind == "pdf") & ~ext.isin("", "pdf"), summary=F.concat(F.lit("The file contains PDF data but is named ."), ext, F.lit("."))),
        hit(late, "file.extension-mismatch", read & fits & (kind == "zip") & ~powerpoint, summary=package))


def container_coverage(files: DataFrame) -> DataFrame:
    """file_id, checks, limitations of files that no kernel has read through."""
    rest = files.where("too_large OR failure IS NOT NULL OR detected IN ('ole', 'unknown')")
    failed = F.col("failure").isNotNull()
    ole = ~F.col("too_large") & (F.col("detected") == "ole") & F.col("extension").isin(*POWERPOINT)
    check = F.when(F.col("too_large"), "File size").when(ole, "File container").otherwise("File signature")
    limit = F.when(failed, "The scan stopped before all checks completed.").when(ole, "Encrypted or legacy compound-file content was not inspected.").otherwise("File content was not inspected.")
    return rest.select("file_id", F.array(check).alias("checks"), F.array(limit).alias("limitations"))


def folded(rows: DataFrame) -> DataFrame:
    """file_id, checks, limitations, complete of coverage rows."""
    events = [rows.select("file_id", F.posexplode(c).alias("seq", "text"), F.lit(kind).alias("kind")) for c, kind in (("checks", "check"), ("limitations", "limitation"))]
    return findings.fold_coverage(events[0].unionByName(events[1]))


def scan(files: DataFrame, max_bytes: int = MAX_BYTES, strict: bool = True) -> Scan:
    """Findings, distinct by id and with their place in the report, and coverage of (name, content[, file_id, type])."""
    spark = files.sparkSession
    on_workers(spark)
    rows, path = keep(evidence.inspected(evidence.described(files, max_bytes), needed_only=True), "scan", by="kind")
    paths = [path]
    about = evidence.file_rows(rows)
    if parts := evidence.parts_for(rows.where("kind = 'body'")):  # files too large for one task
        more, path = keep(evidence.unfolded(rows.where("kind = 'body'"), parts, needed_only=True), "scan-streams", by="kind")
        paths.append(path)
        about, rows = about.unionByName(evidence.file_rows(more)), rows.unionByName(more)
    wrong = about.agg(F.bool_or(F.col("detected").isNull()).alias("late"), F.bool_or(F.col("failure").isNotNull()).alias("any")).first()
    if wrong["late"]:
        about = evidence.failed_late(about)
    if wrong["any"]:
        rows = evidence.without_failed(rows, about)
    return from_evidence(about, evidence.item_rows(rows), evidence.entry_rows(rows), paths, max_bytes, strict)


def from_evidence(about: DataFrame, items: DataFrame, entries: DataFrame, paths: list[str], max_bytes: int, strict: bool, unread: DataFrame | None = None) -> Scan:
    """The scan of files whose evidence is at hand; ``unread`` (file_id, checks, limitations) is what was left out."""
    readable = about.where("NOT too_large AND failure IS NULL")
    pdfs, zips = readable.where("detected = 'pdf'"), readable.where("detected = 'zip'")
    there = {r["detected"] for r in readable.select("detected").distinct().collect()}  # at most four; what is not there needs no plan
    branches = [("pptx", container_hits(about, max_bytes)), *([("pdf", pdf_rules.hits(pdfs, items))] if "pdf" in there else []),
                *([("pptx", pptx_rules.hits(zips, entries))] if "zip" in there else []), *(("pdf", branch(readable, items, entries)) for _, branch in REGISTERED)]
    hits = reduce(DataFrame.unionByName, [rows_.withColumn("family", F.lit(family)) for family, rows_ in branches])
    hits, also = keep(hits, "scan-hits")  # findings, their sensitive values and the counters all start from it
    covered = container_coverage(about).unionByName(pdf_rules.coverage(pdfs, items)).unionByName(pptx_rules.coverage(zips, entries, strict))
    covered = covered.unionByName(unread) if unread is not None else covered
    more = about.select("file_id", "detected", F.col("type").alias("declaredType"), "extension").join(
        pdf_rules.details(pdfs, items, hits), "file_id", "left").join(pptx_rules.details(zips, entries, hits), "file_id", "left")
    details = more.select("file_id", F.to_json(F.struct(*more.columns[1:])).alias("details"))
    return Scan(about.drop("marks"), findings.ordered(findings.first_wins(said(hits))), folded(covered), details, (*paths, also))


def reports(files: DataFrame, max_bytes: int = MAX_BYTES, strict: bool = True) -> DataFrame:
    """One row for each file: descriptor, counts, score, verdict, coverage."""
    return scan(files, max_bytes, strict).reports()


def scan_packages(spark: SparkSession, path: str, recursive: bool = False, strict: bool = True) -> Scan:
    """A scan of the presentations at ``path`` that fetches their directories and XML parts only.

    Reports have no SHA-256, and where a package holds media its report is not complete, since their metadata were not looked at.
    """
    ranges.register(spark)
    rows, kept_at = keep(spark.read.format("office_packages").option("recursive", str(recursive).lower()).load(path), "scan-ranges")
    rows = rows.withColumn("file_id", F.col("path"))
    null = lambda type_: F.lit(None).cast(type_)
    entries = rows.withColumns({"fields": null("array<struct<name:string,value:string>>"), "latitude": null("double"), "longitude": null("double")}).select(*evidence.names(evidence.ENTRY))
    about = rows.where("idx IN (-1, 0)").select(
        "file_id", F.col("path").alias("name"), F.lit("").alias("type"), "size", null("string").alias("sha256"), extension_of(F.col("path")).alias("extension"), F.lit("zip").alias("detected"),
        F.lit(False).alias("too_large"), null("string").alias("failure"), null("bigint").alias("duration_ms"), null(f"struct<{MARKS.replace(' ', ':').replace(',:', ',')}>").alias("marks"))
    media = rows.where("name LIKE 'ppt/media/%' AND NOT directory").select("file_id").distinct()
    unread = media.select("file_id", F.array().cast("array<string>").alias("checks"), F.array(F.lit("Embedded image metadata was not inspected.")).alias("limitations"))
    items = spark.createDataFrame([], evidence.PDF)
    return from_evidence(about, items, entries, [kept_at], MAX_BYTES, strict, unread)
