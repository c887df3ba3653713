"""Packages read by ranges: the same entries as from the whole bytes, and few bytes fetched."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators import evidence, packages, pptx_rules
from palimpsest.plans import scan
from palimpsest.sources import archives, build, ranges

from . import fixtures as fx

COLUMNS = ("idx", "name", "packed", "unpacked", "method", "crc", "flags", "directory", "zip64", "part", "whole")


def heavy() -> bytes:
    """A deck with media of eight megabytes that cannot be compressed."""
    rng = random.Random(1)
    return build.pptx([build.slide([build.shape("Title", f"words {k}")]) for k in range(30)], {f"ppt/media/image{k}.png": rng.randbytes(1 << 20) for k in range(8)} | {"../up.xml": "x"})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("packages")
    (at / "sub").mkdir()
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for k in range(3000):
            z.writestr(f"customXml/item{k}.xml", f"<a>{k}</a>")
        z.comment = b"c" * 60_000
    for name, data in (("heavy.pptx", heavy()), ("unsafe.PPTM", fx.unsafe_pptx()), ("cut.pptx", fx.unsafe_pptx()[:-30]), ("empty.pptx", b""), ("many.potx", many.getvalue()), ("notes.txt", b"x"), ("sub/a.pptx", fx.clean_pptx())):
        (at / name).write_bytes(data)
    return at


def test_entries_are_those_of_the_whole_bytes(spark, folder):
    ranges.register(spark)
    got = spark.read.format("office_packages").option("per_task", 1 << 20).load(str(folder))
    rows = {}
    for r in got.collect():
        rows.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    assert set(rows) == {"heavy.pptx", "unsafe.PPTM", "cut.pptx", "empty.pptx", "many.potx"} and got.rdd.getNumPartitions() > 1
    for name in ("heavy.pptx", "unsafe.PPTM", "many.potx"):
        out = evidence.Batches(True)
        whole = [r for b in [*evidence.package_rows(name, (folder / name).read_bytes(), out), *out.take()] for r in b.to_pylist()]
        mine = sorted(rows[name], key=lambda r: r["idx"])
        assert [tuple(r[c] for c in COLUMNS) for r in mine] == [tuple(r[c] for c in COLUMNS) for r in whole]
        xml = [(r["text"], r["error"]) for r in whole if not r["name"].startswith("ppt/media/")]
        assert [(r["text"], r["error"]) for r in mine if not r["name"].startswith("ppt/media/")] == xml
    assert [(r["idx"], r["error"]) for n in ("cut.pptx", "empty.pptx") for r in rows[n]] == [(-1, "ZIP end-of-central-directory record was not found."), (-1, "File is too small to be a ZIP archive.")]


def test_few_bytes_are_fetched(spark, folder):
    ranges.register(spark)
    got = spark.read.format("office_packages").load(f"file://{folder}/heavy.pptx").agg(F.max("fetched"), F.max("size"), F.count("*")).first()
    assert got[0] < got[1] / 20 and got[1] > 8 << 20 and got[2] > 40
    assert spark.read.format("office_packages").option("recursive", "true").load(str(folder)).where("path LIKE '%/sub/a.pptx'").count() > 0


def test_rules_over_ranged_entries(spark, folder):
    """The structure rules and those on parts take the rows as they are."""
    ranges.register(spark)
    entries = spark.read.format("office_packages").load(str(folder)).withColumn("file_id", F.col("path"))
    unsafe = entries.where(~packages.safe_path(F.col("name"))).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["name"]) for r in unsafe] == [("heavy.pptx", "../up.xml")]
    slides = pptx_rules.slides(pptx_rules.named(entries).where("whole")).where("file_id LIKE '%unsafe%'").collect()
    assert sorted(r["number"] for r in slides) == ["1", "2"]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_slices(size, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", size)
    monkeypatch.setattr(ranges, "KEPT", 2)
    data = fx.unsafe_pptx()
    seen = ranges.Ranged(io.BytesIO(data), len(data))
    rng = random.Random(size)
    for _ in range(200):
        a, b = rng.randrange(-5, len(data) + 5), rng.randrange(-5, len(data) + 5)
        assert seen[a:b] == data[a:b]
    assert seen.rfind(b"PK\5\6", 3, len(data)) == data.rfind(b"PK\5\6", 3, len(data)) and seen.rfind(b"none", 0, 90) == -1
    assert [e.name for e in archives.open_package(seen).entries] == [e.name for e in archives.open_package(data).entries]


def test_a_scan_by_ranges_finds_what_a_whole_scan_finds(spark, folder):
    """But for what media hold, which is named as not inspected."""
    whole = scan.scan(cli.read_files(spark, [str(folder)]))
    ranged = scan.scan_packages(spark, str(folder))

    def seen(done):
        name = {r["file_id"]: r["name"].rsplit("/", 1)[-1] for r in done.files.collect()}
        return {(name[r["file_id"]], r["place"], r["id"]) for r in done.findings.collect() if not r["rule_id"].startswith("pptx.image.metadata")}, {
            name[r["file_id"]]: (r["complete"], r["limitations"]) for r in done.coverage.collect()}

    a, b = seen(whole), seen(ranged)
    known = set(b[1])
    of = lambda found: {(n, i) for n, _, i in found if n in known - {"empty.pptx"}}  # noqa: E731  nothing tells an empty file's type
    assert of(a[0]) == of(b[0]) and len(of(a[0])) > 15
    assert "Embedded image metadata was not inspected." in b[1]["heavy.pptx"][1] and "Embedded image metadata was not inspected." not in a[1]["heavy.pptx"][1]
    assert not b[1]["unsafe.PPTM"][0] and not b[1]["cut.pptx"][0] and ("pptx.package.signature" in {i.rsplit("-", 1)[0] for n, _, i in b[0] if n == "many.potx"})
    assert {r["sha256"] for r in ranged.files.collect()} == {None}
    for done in (whole, ranged):
        done.reports().count()
        done.release()
