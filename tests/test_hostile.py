"""No file can end the scan of the others: hostile names, numbers, attributes and sizes through whole scans."""

import random
import resource
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence
from palimpsest.plans import scan
from palimpsest.sources import build, content, pdf

from . import fixtures as fx

NUMBERS = ["9999999999999", "9" * 20, "9" * 400, "1e999", "-1e999", "NaN", "Infinity", "0x7fffffffffffffff", "-", "", " ", "1" * 30 + ".5", "٣", "1_0", "&#55296;", "&#x110000;", "&#99999999999;", "\x01"]


def deck(rng: random.Random, k: int) -> bytes:
    """A presentation with odd numbers and names wherever one is read."""
    n = lambda: rng.choice(NUMBERS)
    shapes = [f'<p:pic><p:cNvPr id="{n()}" name="{n()}" hidden="{rng.choice(["1", n()])}" descr="{n()}"/><a:xfrm><a:off x="{n()}" y="{n()}"/><a:ext cx="{n()}" cy="{n()}"/></a:xfrm>'
              f'<a:srcRect l="{n()}" t="{n()}"/><a:blip r:embed="{n()}"/><a:t>words {n()}</a:t></p:pic>' for _ in range(4)]
    more = {f"ppt/slides/slide{rng.choice(['9999999999999', '9' * 20, '9' * 330, '0', '007'])}.xml": build.slide(shapes, hidden=True),
            f"ppt/slides/_rels/slide1.xml.rels": build.relationships((n(), n(), rng.choice(["..\\..\\..", "/", "//[", "http://[::1", "https://a:b@c:99999/?" + "x=1&" * 50, n()]), rng.random() < 0.7)),
            "ppt/presentation.xml": f'<p:presentation><p:sldSz cx="{n()}" cy="{n()}"/></p:presentation>', "ppt/comments/c.xml": f'<p:cm authorId="{n()}"><p:text>{n()} said</p:text></p:cm>',
            "ppt/commentAuthors.xml": f'<p:cmAuthor id="{n()}" name="{n()}"/>', "docProps/custom.xml": f'<property name="{n()}"><v>{n()}</v></property>',
            "ppt/notesSlides/notesSlide" + "8" * 25 + ".xml": "<a:t>" + "&#x41;" * 50 + "</a:t>", "customXml/item" + "1" * 30 + ".xml": "<" * 2000, "ppt/media/a.png": rng.randbytes(40)}
    data = bytearray(build.pptx([build.slide(shapes)], more))
    if k % 3 == 0:
        for _ in range(3):
            data[rng.randrange(4, len(data))] = rng.randrange(256)
    return bytes(data)


def paper(rng: random.Random, k: int) -> bytes:
    n = lambda: rng.choice(NUMBERS[:10] + ["1e308", "-1e308", "1e-320"])
    content_ = " ".join(f"q {n()} {n()} {n()} {n()} {n()} {n()} cm {n()} {n()} {n()} {n()} re 0 g f BT /F {n()} Tf {n()} Tz {n()} {n()} Td (text {i}) Tj [(x){n()} (y)] TJ {n()} Tr ET {rng.choice(['Q', 'Q Q', ''])}" for i in range(6))
    data = bytearray(build.pdf(content_, {"Author": "x\\", "Creator": "(" * 50}, f"/Length {n()} /Prev {n()} /V (" + "a" * 9000 + rng.choice(["", ")"]), filters=rng.choice(["/FlateDecode", "[/FlateDecode /ASCIIHexDecode]", "/A85 /Fl", "/Nope"])))
    if k % 3 == 0:
        for _ in range(3):
            data[rng.randrange(8, len(data))] = rng.randrange(256)
    return bytes(data)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_file_changes_another_files_report(spark, seed):
    rng = random.Random(seed)
    plain = [("clean.pdf", fx.clean_pdf()), ("unsafe.pdf", fx.unsafe_pdf()), ("clean.pptx", fx.clean_pptx()), ("unsafe.pptx", fx.unsafe_pptx())]
    odd = [(f"odd{k}.pptx", deck(rng, k)) for k in range(25)] + [(f"odd{k}.pdf", paper(rng, k)) for k in range(25)] + [("cut.pptx", fx.unsafe_pptx()[:200]), ("zero.pdf", b"%PDF-"), ("none", b""), ("null", None), (None, b"x")]
    seen = ("high", "medium", "low", "total", "score", "verdict_code", "complete", "checks", "limitations", "failure")

    def reports(rows):
        files = spark.createDataFrame(rows, "name string, content binary").repartition(2)
        return {r["name"]: tuple(r[c] for c in seen) for r in scan.reports(files).collect()}

    alone, mixed = reports(plain), reports(plain + odd)
    assert {n: mixed[n] for n in alone} == alone and len(mixed) == len(plain) + len(odd)
    assert all(mixed[n][-1] or mixed[n][3] or not mixed[n][6] for n, _ in odd if n and n.endswith("pptx"))


def test_slide_numbers_of_any_length(spark):
    numbers = ["2", "0010", "9999999999999", "12345678901234567890", "9" * 30, "9" * 400]
    parts = {f"ppt/slides/slide{n}.xml": build.slide([build.shape("Title", f"words {i}")], hidden=True) for i, n in enumerate(numbers)}
    files = spark.createDataFrame([("a.pptx", build.pptx([], parts)), ("b.pdf", fx.clean_pdf())], "name string, content binary")
    done = scan.scan(files)
    found = done.findings.where("rule_id = 'pptx.slide.hidden'").orderBy("ord").collect()
    assert [r["location"] for r in found] == [f"Slide {n}" for n in ("2", "10", "9999999999999", "12345678901234567000", "1e+30", "Infinity")]
    assert [r["evidence"] for r in found] == [f"words {i}" for i in range(6)]
    assert {r["name"]: r["total"] for r in done.reports().collect()}["b.pdf"] == 0


def broken(file_id, data, out):
    """A kernel that raises once rows of the file have left."""
    for k in range(3 * evidence.AT_ONCE):
        out.add(evidence.PDF, (file_id, "string", 0, k, "Author", "someone", *evidence.NONE))
        if out.full():
            yield from out.take()
    if b"Quarterly" not in data and len(data) % 2:
        raise RuntimeError("bad byte")


def test_rows_of_a_file_that_fails_later_do_not_count(spark, monkeypatch):
    odd, even = fx.clean_pdf() + b" " * (1 - len(fx.clean_pdf()) % 2), fx.clean_pdf() + b" " * (len(fx.clean_pdf()) % 2)
    rows = [("f", "text", 1, 0, None, "t", *[0.0] * 8, None, None), ("g", "text", 1, 0, None, "t", *[0.0] * 8, None, None)]
    about = spark.createDataFrame([("f", "why"), ("g", None)], "file_id string, failure string")
    items = spark.createDataFrame([r[:-1] for r in rows], evidence.PDF)
    assert [r["file_id"] for r in evidence.without_failed(items, about).collect()] == ["g"]
    told = spark.createDataFrame([("f", "f", None), ("g", "g", "early"), ("h", "h", None), ("f", None, "late"), ("f", None, "later"), ("g", None, "late")], "file_id string, detected string, failure string")
    assert sorted((r["file_id"], r["failure"]) for r in evidence.failed_late(told).collect() if r["failure"]) == [("f", "late"), ("g", "early")] and evidence.failed_late(told).count() == 3
    out = evidence.Batches(True)
    batches = []
    with pytest.raises(RuntimeError):
        for b in broken("x", odd, out):
            batches.append(b.num_rows)
    assert batches == [evidence.AT_ONCE] * 3 and list(broken("y", even, evidence.Batches(True)))


def test_a_value_that_no_column_holds_fails_its_file_alone():
    out = evidence.Batches(True)
    for name, size in (("a", 1), ("b", 1 << 70), ("c", 3)):
        out.add(evidence.ENTRY, (name, 0, "n", size, 1, 0, 0, 0, False, False, None, None, False, None, None, None, True, True))
        out.files.append((name, name, "", 1, "h", "pptx", "zip", False, None, None, 3))
    rows = [r for b in out.take() for r in b.to_pylist()]
    assert {r["file_id"] for r in rows if r["kind"] == "entry"} == {"a", "c"}
    assert {r["file_id"]: r["failure"] is None for r in rows if r["kind"] == "file"} == {"a": True, "b": False, "c": True}


# ---- large files


def many_streams(n: int, each: str, distinct: bool = False) -> bytes:
    packed = zlib.compress(each.encode("latin-1"), 9)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream endobj\n" % (k, len(packed), packed) for k in range(n)) + b"startxref\n0\n%%EOF\n"


def test_memory_does_not_grow_with_what_a_file_shows():
    """300 streams within all limits: rows leave while the file is read, and the kernel itself leaves the reading to others."""
    each = "0 g 0 0 600 800 re f BT 10 Tf (t) Tj ET " * 20_000
    data = many_streams(60, each)
    assert len(data) < 1 << 20
    before, rows, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
    out = evidence.Batches(True)
    bodies = []
    for b in [*evidence.pdf_rows("f", data, out), *out.take()]:
        bodies += [r for r in b.to_pylist() if r["kind"] == "body"]
    assert len(bodies) == 60 and all(r["size"] == len(each) for r in bodies)
    for r in bodies[:8]:
        evidence.put_stream("f", r["stream"], pdf.decoded(r["raw"], r["key"].split()), out)
        if out.full():
            for b in out.take():
                rows, most = rows + b.num_rows, max(most, b.num_rows)
    assert rows > 8 * 20_000 and most <= evidence.AT_ONCE
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_a_large_file_gives_what_a_small_limit_gives(spark, monkeypatch):
    """The same file read by one task and dealt out by stream."""
    pages = [build.show(f"page {k}", 72, 700) + build.show(f"hidden {k}", 72, 600, "BT 3 Tr ET") + "0 g 60 690 300 30 re f " + " ".join(build.show(f"line {i}", 72, 10 * i) for i in range(40)) + f" /Author (writer {k})" for k in range(300)]
    data = [build.pdf(pages, {"Author": "someone"}), fx.unsafe_pdf()]
    files = spark.createDataFrame([(f"{k}.pdf", d) for k, d in enumerate(data)], "name string, content binary")

    def seen(done):
        name = {r["file_id"]: r["name"] for r in done.files.collect()}
        return sorted((name[r["file_id"]], r["ord"], r["id"], r["evidence"], r["data"]) for r in done.findings.collect()), sorted((r["name"], r["complete"], r["score"]) for r in done.reports().collect())

    one = scan.scan(files)
    want = seen(one)
    assert len(one.paths) == 2 and len(want[0]) > 900
    described = evidence.described(files)

    def spread_rows(limit):  # workers import the module afresh: the limit is given to the kernel here
        out = evidence.Batches(False)
        monkeypatch.setattr(evidence, "SPREAD", limit)
        return [r for k, d in enumerate(data) for b in [*evidence.pdf_rows(f"{k}.pdf", d, out), *out.take()] for r in b.to_pylist()]

    whole, dealt = spread_rows(1 << 30), spread_rows(1000)
    bodies = spark.createDataFrame([(r["file_id"], r["stream"], r["key"], r["raw"], r["size"]) for r in dealt if r["kind"] == "body"], "file_id string, stream int, key string, raw binary, size bigint")
    assert evidence.parts_for(bodies) > 100 and evidence.parts_for(bodies.where("false")) == 0
    rest = [r.asDict() for r in evidence.item_rows(evidence.unfolded(bodies, 7)).collect()]
    key = lambda r: (r["file_id"], r["kind"], r["stream"], r["seq"], r["key"] or "")
    columns = evidence.names(evidence.PDF)
    got = sorted(({c: r[c] for c in columns} for r in [*(r for r in dealt if r["kind"] != "body"), *rest]), key=key)
    assert got == sorted(({c: r[c] for c in columns} for r in whole), key=key)


def test_the_budget_over_all_streams(monkeypatch):
    data = many_streams(6, "BT (x) Tj ET " * 100)
    size = len("BT (x) Tj ET " * 100)
    for budget, spread, statuses in ((3 * size, 1 << 30, ["decoded"] * 3 + ["over"]), (3 * size, 10, ["decoded"] * 3 + ["over"]), (3 * size + 1, 10, ["decoded"] * 4 + ["over"]),
                                     (6 * size, 10, ["decoded"] * 6), (6 * size + 1, 10, ["decoded"] * 6), (5 * size, 10, ["decoded"] * 5 + ["over"])):
        monkeypatch.setattr(pdf, "ALL_BYTES", budget)
        monkeypatch.setattr(evidence, "SPREAD", spread)
        out = evidence.Batches(False)
        rows = [r for b in [*evidence.pdf_rows("f", data, out), *out.take()] for r in b.to_pylist()]
        assert [r["key"] for r in rows if r["kind"] == "stream"] == statuses
        assert len([r for r in rows if r["kind"] == ("body" if spread == 10 else "text")]) == statuses.count("decoded") * (1 if spread == 10 else 100)


def test_only_what_a_rule_can_name_leaves(spark):
    """With and without the kernel's choice the concealed texts are the same."""
    from palimpsest.operators import pdf_rules

    rng = random.Random(3)
    streams = []
    for _ in range(12):
        parts = [rng.choice([build.show(f"t{i}", rng.choice([-900, 72, 72, 300, 900]), rng.randrange(0, 800, 20), rng.choice(["", "BT 3 Tr ET", "BT 0 Tr ET 1 g", "BT 0 Tr ET 0 g"])),
                             f"{rng.choice([0, 0, 1])} g {rng.randrange(0, 400)} {rng.randrange(0, 700)} {rng.randrange(1, 300)} {rng.randrange(1, 60)} re f "]) for i in range(150)]
        streams.append("".join(parts))
    found = []
    for only in (False, True):
        out = evidence.Batches(only)
        for k, s in enumerate(streams):
            out.add_page("f", k, content.interpret(s))
        rows = [tuple(r[c] for c in evidence.names(evidence.PDF)) for b in out.take() for r in b.to_pylist()]
        found.append((len(rows), sorted((r["stream"], r["what"], r["at"], r["text"], r["ratio"] or 0) for r in pdf_rules.concealed(spark.createDataFrame(rows, evidence.PDF)).collect())))
    assert found[0][1] == found[1][1] and found[1][0] < found[0][0] and len({w for _, w, *_ in found[0][1]}) == 4
