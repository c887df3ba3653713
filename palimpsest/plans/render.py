"""Reports as text, Markdown, HTML, JSON and SARIF: each one Column expression over a report row with its findings."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html, escape_markdown, format_bytes
from ..operators.findings import LEVEL, SEVERITIES, reports, sarif_results, sarif_rules
from .scan import Scan

NAME, VERSION = "Palimpsest", "0.1.0"
SARIF = "https://json.schemastore.org/sarif-2.1.0.json"
INCOMPLETE = f"{NAME.lower()}.scan-incomplete"
DISCLAIMER = "This report identifies known indicators. It does not prove that a file is safe."
ITEM = ("place", "id", "rule_id", "severity", "confidence", "title", "summary", "evidence", "location", "remediation", "tags", "data")


def full_reports(done: Scan, scanned_at: str) -> DataFrame:
    """Report rows with ``items``, the file's findings in order, and ``details``. One file's findings are bounded by its rules' caps."""
    items = done.findings.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("items"))
    rows = reports(*done).join(items, "file_id", "left").join(done.details, "file_id", "left")
    none = F.array().cast(items.schema["items"].dataType)
    strings = F.array().cast("array<string>")
    return rows.withColumns({"items": F.coalesce("items", none), "checks": F.coalesce("checks", strings), "limitations": F.coalesce("limitations", strings), "scanned_at": F.lit(scanned_at)})


def lines(*parts: Column | str, sep: str = "\n") -> Column:
    """The parts that are there, each an expression or a fixed line, one below the other."""
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), sep)


def each(array: Column, show) -> Column:
    return F.when(F.size(array) > 0, F.array_join(F.transform(array, show), "\n"))


def tally() -> Column:
    return F.concat_ws(" · ", *[F.concat_ws(" ", F.col(s).cast("string"), F.lit(s)) for s in SEVERITIES])


def labelled(label: str, value: Column, after: str = "") -> Column:
    return F.concat(F.lit(label), value, F.lit(after))


def as_text() -> Column:
    def item(f: Column) -> Column:
        return lines(labelled("- ", f["title"]), labelled("  ", f["summary"]), labelled("  Location: ", f["location"]), labelled("  Evidence: ", f["evidence"]),
                     labelled("  Fix: ", f["remediation"]), F.concat(F.lit("  Rule: "), f["rule_id"], F.lit(" · Confidence: "), f["confidence"]))

    def section(severity: str) -> Column:
        return labelled(f"\n{severity.upper()}\n", each(F.filter("items", lambda f: f["severity"] == severity), item))

    return lines(NAME.upper(), "", F.upper("verdict_title"), F.col("verdict_summary"), "", labelled("File: ", F.col("name")), labelled("Size: ", format_bytes(F.col("size"))),
                 labelled("SHA-256: ", F.col("sha256")), labelled("Scanned: ", F.col("scanned_at")), f"Scanner: {NAME} {VERSION}", "", labelled("Findings: ", tally()),
                 F.when(F.size("items") == 0, "\nNo findings."), *[section(s) for s in SEVERITIES], "\nCOVERAGE", labelled("Complete: ", F.when(F.col("complete"), "yes").otherwise("no")),
                 each(F.col("checks"), lambda c: F.concat(F.lit("- Checked: "), c)), each(F.col("limitations"), lambda c: F.concat(F.lit("- Limitation: "), c)), f"\n{DISCLAIMER}\n")


def as_markdown() -> Column:
    md = escape_markdown

    def item(f: Column) -> Column:
        return lines(labelled("\n#### ", md(f["title"])), labelled("\n", md(f["summary"])), labelled("\n**Location:** ", md(f["location"])), labelled("\n**Evidence:** ", md(f["evidence"])),
                     labelled("\n**Fix:** ", md(f["remediation"])), F.concat(F.lit("\n**Rule:** `"), f["rule_id"], F.lit("` · **Confidence:** "), f["confidence"]))

    def section(severity: str) -> Column:
        return labelled(f"\n### {severity.capitalize()}\n", each(F.filter("items", lambda f: f["severity"] == severity), item))

    def row(label: str, value: Column, mark: str = "") -> Column:
        return F.concat(F.lit(f"| {label} | {mark}"), value, F.lit(f"{mark} |"))

    return lines(f"# {NAME} report\n", labelled("## ", md(F.col("verdict_title")), "\n"), md(F.col("verdict_summary")), "\n| Field | Value |\n|---|---|", row("File", md(F.col("name")), "`"),
                 row("Size", md(format_bytes(F.col("size")))), row("SHA-256", F.col("sha256"), "`"), row("Scanned", md(F.col("scanned_at"))), row("Findings", tally()), "\n## Findings",
                 F.when(F.size("items") == 0, "\nNo findings."), *[section(s) for s in SEVERITIES], "\n## Coverage\n", labelled("**Complete:** ", F.when(F.col("complete"), "Yes").otherwise("No"), "\n"),
                 each(F.col("checks"), lambda c: F.concat(F.lit("- Checked: "), md(c))), each(F.col("limitations"), lambda c: F.concat(F.lit("- Limitation: "), md(c))), f"\n> {DISCLAIMER}\n")


def as_html() -> Column:
    h = escape_html

    def part(label: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"<dl><dt>{label}</dt><dd>"), h(value), F.lit("</dd></dl>")), F.lit(""))

    def item(f: Column) -> Column:
        return F.concat(F.lit('<article class="finding '), f["severity"], F.lit('"><span>'), f["severity"], F.lit("</span> <strong>"), h(f["title"]), F.lit("</strong><p>"), h(f["summary"]), F.lit("</p>"),
                        part("Location", f["location"]), part("Evidence", f["evidence"]), part("Fix", f["remediation"]), F.lit("<small>"), h(f["rule_id"]), F.lit(" · "), f["confidence"], F.lit(" confidence</small></article>"))

    def listed(array: str, label: str) -> Column:
        return F.coalesce(each(F.col(array), lambda c: F.concat(F.lit(f"<li>{label}: "), h(c), F.lit("</li>"))), F.lit(""))

    return F.concat(F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>'), F.lit(f"{NAME} report — "), h(F.col("name")), F.lit("</title></head><body>\n<h1>"), h(F.col("verdict_title")),
                    F.lit("</h1><p>"), h(F.col("verdict_summary")), F.lit("</p>"), part("File", F.col("name")), part("Size", format_bytes(F.col("size"))), part("SHA-256", F.col("sha256")), part("Scanned", F.col("scanned_at")),
                    F.lit("<p>"), tally(), F.lit("</p>\n<h2>Findings</h2>"), F.coalesce(each(F.col("items"), item), F.lit("<p>No findings.</p>")), F.lit("\n<h2>Coverage</h2><p>Complete: "),
                    F.when(F.col("complete"), "Yes").otherwise("No"), F.lit("</p><ul>"), listed("checks", "Checked"), listed("limitations", "Limitation"), F.lit(f"</ul><p>{DISCLAIMER}</p></body></html>\n"))


def as_json() -> Column:
    items = F.transform("items", lambda f: F.struct(f["id"].alias("id"), f["rule_id"].alias("ruleId"), *[f[c].alias(c) for c in ITEM[3:-1]]))
    values = F.transform("items", lambda f: F.struct(f["id"].alias("id"), f["data"].alias("data")))
    report = F.to_json(F.struct(
        F.lit("1.0").alias("schemaVersion"), F.struct(F.lit(NAME).alias("name"), F.lit(VERSION).alias("version")).alias("scanner"), F.col("scanned_at").alias("scannedAt"),
        "duration_ms", F.struct("name", "size", "type", "sha256").alias("file"), F.struct(F.col("verdict_code").alias("code"), F.col("verdict_title").alias("title"), F.col("verdict_summary").alias("summary"), "score").alias("verdict"),
        items.alias("findings"), F.struct(*SEVERITIES, "total").alias("counts"), F.struct("complete", "checks", "limitations").alias("coverage")))
    # ``data`` and ``details`` are JSON already: they follow as objects of their own
    more = F.array_join(F.transform(F.filter(values, lambda v: v["data"].isNotNull()), lambda v: F.concat(F.lit('"'), v["id"], F.lit('":'), v["data"])), ",")
    return F.concat(F.substring(report, F.lit(1), F.length(report) - 1),
                    F.lit(',"details":'), F.coalesce("details", F.lit("{}")), F.lit(',"data":{'), more, F.lit("}}"))


def as_line() -> Column:
    """The quiet form: verdict, file and counts."""
    return F.format_string("%s  %s  %dH %dM %dL", F.upper("verdict_title"), "name", "high", "medium", "low")


def as_painted_line() -> Column:
    """The quiet form with the verdict in red, yellow or green."""
    tone = F.when(F.col("verdict_code") == "DO_NOT_SEND", 31).when(F.col("verdict_code").isin("REVIEW", "INCOMPLETE"), 33).otherwise(32)
    return F.format_string("\033[%dm%s\033[0m  %s  %dH %dM %dL", tone, F.upper("verdict_title"), "name", "high", "medium", "low")


FORMATS = {"text": as_text, "markdown": as_markdown, "html": as_html, "json": as_json, "quiet": as_line, "painted": as_painted_line}


def rendered(full: DataFrame, form: str) -> DataFrame:
    return full.select("file_id", FORMATS[form]().alias("report"))


def sarif_rows(done: Scan) -> DataFrame:
    """A row for each SARIF result: file_id, ord, result (JSON); what is written where the findings are too many for one document."""
    place = lambda name: F.array(F.struct(F.struct(F.struct(name.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    r = sarif_results(done.findings).join(done.files.select("file_id", "name"), "file_id")
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place(F.col("name")).alias("locations"),
                                F.struct("severity", "confidence", F.col("finding_id").alias("findingId")).alias("properties")))
    left = done.coverage.where("NOT complete").join(done.files.select("file_id", "name"), "file_id")
    text = F.coalesce(F.nullif(F.array_join("limitations", " "), F.lit("")), F.lit("The scan did not cover the complete file."))
    more = F.to_json(F.struct(F.lit(INCOMPLETE).alias("ruleId"), F.lit(LEVEL["medium"]).alias("level"), F.struct(text.alias("text")).alias("message"), place(F.col("name")).alias("locations")))
    return r.select("file_id", "ord", result.alias("result")).unionByName(left.select("file_id", F.lit(2**62).alias("ord"), more.alias("result")))


def sarif(done: Scan) -> str:
    """One SARIF 2.1.0 document over all files, as small as their findings; put together on the driver for the command line."""
    rules = rule_entries(done)
    results = [json.loads(r["result"]) for r in sarif_rows(done).orderBy("file_id", "ord").toLocalIterator()]
    results.sort(key=lambda r: r["ruleId"] == INCOMPLETE)
    return json.dumps({"version": "2.1.0", "$schema": SARIF,
                       "runs": [{"tool": {"driver": {"name": NAME, "version": VERSION, "rules": rules}}, "results": results}]}, indent=2, ensure_ascii=False) + "\n"


def rule_entries(done: Scan) -> list[dict]:
    """What SARIF says of each rule that found something, and of incomplete scans if there are any."""
    rules = [{"id": r["rule_id"], "name": r["name"], "shortDescription": {"text": r["short"]}, "fullDescription": {"text": r["full"]}, "help": {"text": r["help"]},
              "defaultConfiguration": {"level": r["level"]}, "properties": {"confidence": r["confidence"]}} for r in sarif_rules(done.findings).orderBy("rule_id").toLocalIterator()]
    if not done.coverage.where("NOT complete").isEmpty():
        rules.append({"id": INCOMPLETE, "name": "scan_incomplete", "shortDescription": {"text": f"{NAME} scan incomplete"}, "defaultConfiguration": {"level": LEVEL["medium"]}})
    return rules


def sarif_shards(done: Scan, folder: str, most: int = 5000) -> DataFrame:
    """Writes the results as SARIF documents of at most ``most`` each, one a file below ``folder``/results, all naming the same rules;
    gives the manifest (document, results, errors), written below ``folder``/manifest.

    The rules, as many as there are kinds of findings, are folded first and stand in each document; results never meet the driver.
    """
    rules = ", ".join(json.dumps(r, ensure_ascii=False) for r in rule_entries(done))
    tool = f'"tool": {{"driver": {{"name": "{NAME}", "version": "{VERSION}", "rules": [{rules}]}}}}'
    rows = sarif_rows(done).repartitionByRange("file_id", "ord").sortWithinPartitions("file_id", "ord").select("result")

    def run(batches):
        held: list[str] = []

        def document(results: list[str]) -> pa.RecordBatch:
            text = f'{{"version": "2.1.0", "$schema": "{SARIF}", "runs": [{{{tool}, "results": [{", ".join(results)}]}}]}}'
            return pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= most:
                yield document(held[:most])
                held = held[most:]
        if held:
            yield document(held)

    at = f"{folder.rstrip('/')}/results"
    rows.mapInArrow(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(at)  # JSON text holds no line break
    spark = done.files.sparkSession
    levels = F.from_json("value", "runs array<struct<results array<struct<level string>>>>")["runs"][0]["results"]["level"]
    written = spark.read.text(at, wholetext=True).select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("document"), levels.alias("levels"))
    manifest = written.select("document", F.size("levels").cast("bigint").alias("results"), F.size(F.filter("levels", lambda x: x == "error")).cast("bigint").alias("errors"))
    manifest.write.mode("overwrite").json(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder.rstrip('/')}/manifest")


def json_document(reports_: list[str]) -> str:
    """The reports of ``as_json`` as one document: an object, or an array of several; data and details in their places."""
    out = []
    for text in reports_:
        report = json.loads(text)
        details, data = report.pop("details"), report.pop("data")
        report["durationMs"] = report.pop("duration_ms", 0)
        report["coverage"]["details"] = details
        for item in report["findings"]:
            if item["id"] in data:
                item["data"] = data[item["id"]]
        out.append(report)
    return json.dumps(out[0] if len(out) == 1 else out, indent=2, ensure_ascii=False) + "\n"
