import json
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators import evidence
from palimpsest.operators import rules as rules_module
from palimpsest.plans import render, scan
from palimpsest.sources import build
from palimpsest.streaming import arrivals

from . import fixtures as fx

OLE = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(20)
PDF_RULES = ["pdf.redaction.overlay", "content.credential-assignment", "content.email-address", "content.payment-card", "pdf.annotations",
             "pdf.metadata.personal", "pdf.revisions.incremental", "pdf.text.invisible", "pdf.text.invisible"]
PPTX_RULES = {"pptx.notes", "pptx.embedded-files", "pptx.metadata.personal", "pptx.metadata.custom", "pptx.object.hidden", "pptx.object.off-slide", "pptx.image.cropped",
              "pptx.slide.hidden", "pptx.comments", "pptx.custom-xml", "pptx.external.local-path", "pptx.image.metadata", "pptx.external.hyperlinks"}


def damaged() -> bytes:
    return fx.clean_pptx().replace(b"PK\1\2", b"PK\1\3", 1)


@pytest.fixture(scope="module")
def scanned(spark):
    odd = build.pptx([build.slide([])], {"ppt/vbaProject.bin": b"x", "ppt/people.xml": "<p/>", "ppt/tags/tag1.xml": "<t/>", "../up.xml": "x",
                                         "ppt/notesSlides/notesSlide9.xml": "<n><a:t>lost words</a:t></n>",
                                         "ppt/_rels/presentation.xml.rels": build.relationships(("r1", "video", "https://h.example/v?k=1", True))})
    active = build.pdf(build.show("x", 5000, 10) + build.show("pale", 72, 300, "1 g"), None, "/Encrypt /AcroForm /V (saved value) /OpenAction /JavaScript /OCProperties /EmbeddedFiles /F (a.doc) /Prev 12")
    image = build.pdf("x", filters="/DCTDecode")
    rows = [("clean.pdf", fx.clean_pdf()), ("unsafe.pdf", fx.unsafe_pdf()), ("clean.pptx", fx.clean_pptx()), ("unsafe.pptx", fx.unsafe_pptx()), ("deck.bin", fx.clean_pptx()),
            ("text.pdf", b"hello"), ("old.pptx", OLE), ("old.doc", OLE), ("odd.pptx", odd), ("bad.pptx", damaged()), ("word.docx", build.package({"word/document.xml": "<w/>"})),
            ("active.pdf", active), ("image.pdf", image)]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    done = scan.scan(files)
    reports = {r["name"]: r for r in done.reports().collect()}
    found = {}
    for r in done.findings.join(done.files.select("file_id", "name"), "file_id").orderBy("name", "place").collect():
        found.setdefault(r["name"], []).append(r)
    return done, reports, found


def rules(found, name):
    return [f["rule_id"] for f in found.get(name, [])]


def test_clean_files_have_no_findings(scanned):
    _, reports, found = scanned
    for name in ("clean.pdf", "clean.pptx"):
        assert not rules(found, name) and reports[name]["verdict_code"] == "NO_OBVIOUS_RISKS" and reports[name]["complete"]


def test_unsafe_pdf(scanned):
    _, reports, found = scanned
    assert rules(found, "unsafe.pdf") == PDF_RULES
    r = reports["unsafe.pdf"]
    assert (r["high"], r["medium"], r["score"], r["verdict_code"], r["complete"]) == (1, 8, 100, "DO_NOT_SEND", True)
    assert [f["evidence"] for f in found["unsafe.pdf"] if f["rule_id"] == "content.payment-card"] == ["411111…1111"]
    assert json.loads(found["unsafe.pdf"][0]["data"]) == {"overlapRatio": 1.0}


def test_unsafe_pptx(scanned):
    _, reports, found = scanned
    assert PPTX_RULES <= set(rules(found, "unsafe.pptx"))
    by = {f["rule_id"]: f for f in found["unsafe.pptx"]}
    assert by["pptx.image.cropped"]["evidence"] == "ppt/media/image1.png"
    assert by["pptx.comments"]["location"] == "ppt/comments/comment1.xml — A Reviewer"
    assert by["pptx.external.hyperlinks"]["evidence"] == "https://portal.example.test/share?token=%E2%80%A6"
    assert reports["unsafe.pptx"]["verdict_code"] == "DO_NOT_SEND"


def test_other_rules(scanned):
    _, _, found = scanned
    assert {"pptx.macro", "pptx.macro.extension-mismatch", "pptx.collaboration", "pptx.retained-state", "pptx.package.unsafe-path", "pptx.notes.orphaned", "pptx.external.linked-data"} <= set(rules(found, "odd.pptx"))
    assert {"pdf.encryption", "pdf.forms", "pdf.active-content", "pdf.layers", "pdf.attachments", "pdf.revisions.incremental", "pdf.text.off-page", "pdf.text.pale"} <= set(rules(found, "active.pdf"))
    assert rules(found, "word.docx") == ["pptx.package.signature", "file.extension-mismatch"]
    assert rules(found, "deck.bin") == ["file.extension-mismatch"]


def test_incomplete_is_never_cleared(scanned):
    _, reports, found = scanned
    for name, rule in (("text.pdf", "file.unsupported"), ("old.pptx", "pptx.encrypted-package"), ("old.doc", "file.unsupported"), ("bad.pptx", "pptx.package.invalid")):
        assert rules(found, name) == [rule] and not reports[name]["complete"]
    assert reports["image.pdf"]["verdict_code"] == "INCOMPLETE" and reports["image.pdf"]["limitations"] == ["1 PDF stream used unsupported filters and could not be decoded."]
    assert all(r["verdict_code"] != "NO_OBVIOUS_RISKS" for r in reports.values() if not r["complete"])


def test_size_limit(spark):
    files = spark.createDataFrame([("big.pdf", fx.clean_pdf())], "name string, content binary")
    described, found, covered = scan.scan(files, max_bytes=10)
    assert [r["rule_id"] for r in found.collect()] == ["file.size-limit"] and not covered.first()["complete"]


def test_ids_do_not_depend_on_partitions(spark, scanned):
    files = spark.createDataFrame([("unsafe.pdf", fx.unsafe_pdf())], "name string, content binary")
    again = {r["id"] for r in scan.scan(files).findings.collect()}
    assert again == {f["id"] for f in scanned[2]["unsafe.pdf"]}


def test_renderers(spark, scanned):
    done, _, rows = scanned
    full = render.full_reports(done, "2024-01-01T00:00:00Z").where(F.col("name").isin("unsafe.pdf", "clean.pdf")).persist()
    name = {r["file_id"]: r["name"] for r in full.collect()}
    got = {form: {name[r["file_id"]]: r["report"] for r in render.rendered(full, form).collect()} for form in render.FORMATS}
    assert "No findings." in got["text"]["clean.pdf"] and "HIGH\n- Recoverable text" in got["text"]["unsafe.pdf"]
    assert "### High" in got["markdown"]["unsafe.pdf"] and r"api\_ke" in got["markdown"]["unsafe.pdf"]
    assert got["html"]["unsafe.pdf"].startswith("<!doctype html>") and got["html"]["unsafe.pdf"].count("<article") == 9
    report = json.loads(render.json_document([got["json"]["unsafe.pdf"]]))
    assert report["counts"]["total"] == 9 and len(report["findings"]) == 9 and report["findings"][0]["data"] == {"overlapRatio": 1.0}
    assert report["coverage"]["details"] == {"detected": "pdf", "declaredType": "", "extension": "pdf", "pdfVersion": "1.7", "revisions": 2, "streams": 1, "decodedStreams": 1, "decodedBytes": report["coverage"]["details"]["decodedBytes"],
                                             "coveredTextItems": 1, "invisibleTextItems": 1, "offPageTextItems": 0, "paleTextItems": 0} or report["coverage"]["details"]["coveredTextItems"] == 1
    assert len(json.loads(render.json_document([got["json"]["unsafe.pdf"], got["json"]["clean.pdf"]]))) == 2
    sarif = json.loads(render.sarif(done))["runs"][0]
    assert {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in sarif["results"]} >= {"unsafe.pdf", "image.pdf"}
    assert len([r for r in sarif["results"] if "properties" in r]) == sum(map(len, rows.values()))
    assert {r["ruleId"] for r in sarif["results"]} == {r["id"] for r in sarif["tool"]["driver"]["rules"]}


def test_sarif_in_documents(spark, scanned, tmp_path):
    """The documents hold together what the one document holds."""
    done, _, _ = scanned
    whole = json.loads(render.sarif(done))["runs"][0]
    manifest = render.sarif_shards(done, str(tmp_path), most=7).collect()
    parts = [json.loads((tmp_path / "results" / r["document"]).read_text())["runs"][0] for r in manifest]
    assert all(p["tool"] == whole["tool"] and len(p["results"]) == r["results"] <= 7 for p, r in zip(parts, manifest)) and len(parts) > 3
    said = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert said(r for p in parts for r in p["results"]) == said(whole["results"])
    assert sum(r["errors"] for r in manifest) == sum(r["level"] == "error" for r in whole["results"])


def test_standard_input(spark, monkeypatch, capsys):
    import io
    import sys

    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(fx.unsafe_pptx())}))
    assert cli.main(["-f", "json", "--stdin-name", "deck.pptx", "-"], spark) == 2
    report = json.loads(capsys.readouterr().out)
    assert report["file"]["name"] == "deck.pptx" and PPTX_RULES <= {f["ruleId"] if "ruleId" in f else f["rule_id"] for f in report["findings"]}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "clean.PDF").write_bytes(fx.clean_pdf())
    (tmp_path / "notes.txt").write_text("x")
    assert cli.main(["-q", str(tmp_path)], spark) == 0
    assert "0H 0M 0L" in capsys.readouterr().out
    assert cli.main(["--fail-on", "never", "-f", "json", str(tmp_path / "notes.txt")], spark) == 3
    assert cli.main([str(tmp_path / "notes.txt")], spark) == 2
    assert cli.main([str(tmp_path / "missing.pdf")], spark) == 1
    assert cli.main(["--nonsense"], spark) == 1
    assert [cli.parse_size(s) for s in ("10", "1.5kb", "2MiB")] == [10, 1500, 2 << 20]


def test_one_file_never_ends_the_scan(spark):
    long_number, long_length = build.pdf("0x" + "f" * 300 + " 0 0 rg BT (words) Tj ET"), build.pdf("BT (more words) Tj ET").replace(b"/Length ", b"/Length " + b"9" * 5000, 1)
    deep = fx.clean_pdf()
    files = spark.createDataFrame([("a.pdf", long_number), ("b.pdf", long_length), ("c.pdf", deep)], "name string, content binary")
    assert {r["name"]: (r["complete"], r["failure"]) for r in scan.reports(files).collect()} == {n: (True, None) for n in ("a.pdf", "b.pdf", "c.pdf")}


def test_a_failure_is_a_finding(spark, monkeypatch):
    rows = evidence.described(spark.createDataFrame([("a.docx", fx.clean_pdf()), ("b.pdf", fx.clean_pdf())], "name string, content binary"))

    # a kernel that raises: what is left of the file is its failure
    import pyarrow as pa

    names = evidence.names(evidence.FILE)
    done = evidence.table_of([("x", "a.docx", "", 1, "h", "docx", "pdf", False, None, "bad byte", 3)], [*names, *evidence.names(evidence.OUTCOME)], "file")
    about = evidence.file_rows(spark.createDataFrame(pa.Table.from_batches([done])))
    found = scan.container_hits(about, 100).collect()
    assert [(r["rule"], r["evidence"]) for r in found] == [("scanner.failure", "bad byte")]
    covered = scan.folded(scan.container_coverage(about)).first()
    assert not covered["complete"] and covered["checks"] == ["File signature"] and covered["limitations"] == ["The scan stopped before all checks completed."]
    assert rows.count() == 2


def test_files_of_one_name_stay_apart(spark):
    files = spark.createDataFrame([("a.pdf", fx.unsafe_pdf()), ("a.pdf", fx.clean_pdf())], "name string, content binary")
    assert sorted((r["name"], r["total"]) for r in scan.reports(files).collect()) == [("a.pdf", 0), ("a.pdf", 9)]


def test_the_files_are_read_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(fx.unsafe_pdf())
    done = scan.scan(cli.read_files(spark, [str(tmp_path)]))
    plan = done.reports()._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryfile" not in plan.lower() and "content#" not in plan and "InMemoryRelation" not in plan and "parquet" in plan
    done.release()


def test_registered_rules_run(spark, monkeypatch):
    monkeypatch.setattr(rules_module, "REGISTERED", [])
    monkeypatch.setattr(scan, "REGISTERED", rules_module.REGISTERED)
    rules_module.register(("pdf.tiny", "low", "high", "Tiny file", "The file is tiny.", "format"), lambda files, items, entries: rules_module.emit(files, rules_module.hit(5, "pdf.tiny", F.col("size") < 10_000)))
    with pytest.raises(ValueError):
        rules_module.register(("pdf.tiny", "low", "high", "x", "x", "x"), None)
    done = scan.scan(spark.createDataFrame([("a.pdf", fx.clean_pdf())], "name string, content binary"))
    assert [r["rule_id"] for r in done.findings.collect()] == ["pdf.tiny"]


def test_only_checks_that_were_made_are_claimed(scanned):
    _, reports, _ = scanned
    assert reports["bad.pptx"]["checks"] == ["Office package structure"] and len(reports["word.docx"]["checks"]) == 1 and len(reports["clean.pptx"]["checks"]) == 8


def test_folders(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(fx.clean_pdf())
    (tmp_path / "in" / "sub" / "b.pdf").write_bytes(fx.unsafe_pdf())
    assert cli.main(["-q", "--no-color", str(tmp_path / "in")], spark) == 0
    assert capsys.readouterr().out.count("\n") == 1
    assert cli.main(["-q", "-r", str(tmp_path / "in")], spark) == 2
    assert capsys.readouterr().out.count("\n") == 2
    (tmp_path / "in" / "x=1").mkdir()
    (tmp_path / "in" / "x=1" / "c.pdf").write_bytes(fx.unsafe_pdf())
    assert cli.main(["-f", "json", str(tmp_path / "in")], spark) == 0
    assert json.loads(capsys.readouterr().out)["file"]["name"].endswith("/in/a.pdf")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(fx.unsafe_pdf())
    query = arrivals.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(240)
    assert [r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [9]


def test_a_batch_met_again_is_reported_once(spark, tmp_path, monkeypatch):
    """The stream fails between writing a batch and noting it as done: the batch comes again and replaces what it had written."""
    (tmp_path / "in").mkdir()
    folders = [str(tmp_path / x) for x in ("in", "out", "state")]
    (tmp_path / "in" / "a.pdf").write_bytes(fx.unsafe_pdf())
    release, calls = scan.Scan.release, []

    def once(self):
        release(self)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost before the batch was noted")

    monkeypatch.setattr(scan.Scan, "release", once)
    with pytest.raises(Exception):
        arrivals.watch(spark, *folders).awaitTermination(240)
    assert spark.read.parquet(folders[1]).count() == 1
    arrivals.watch(spark, *folders).awaitTermination(240)
    (tmp_path / "in" / "b.pdf").write_bytes(fx.clean_pdf())
    arrivals.watch(spark, *folders).awaitTermination(240)
    got = spark.read.parquet(folders[1])
    assert sorted((r["epoch"], r["total"]) for r in got.collect()) == [(0, 9), (1, 0)] and len(calls) == 3
