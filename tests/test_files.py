"""The files built from rows hold the whole text."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence
from palimpsest.plans import files, scan

KEY, CARD = "AKIA" + "Q7" * 8, "4111 1111 1111 1111"
LONG = "\n".join(f"line {i} " + "word " * 60 for i in range(50)) + "\n" + "\n".join([f"{KEY} {CARD}"] * 4)


def test_pdf_holds_all_lines(spark):
    rows = spark.createDataFrame([("doc.pdf", files.as_pdf(1, LONG, "web"))], "name string, content binary")
    shown = evidence.pdf_evidence(evidence.described(rows)).where("kind = 'text'").orderBy("stream", "seq").collect()
    assert " ".join(r["text"] for r in shown).split() == LONG.split()
    assert {"content.aws-access-key", "content.payment-card"} <= {r["rule_id"] for r in scan.scan(rows).findings.collect()}


def test_covered_lines_are_covered_to_their_end(spark):
    rows = spark.createDataFrame([("doc.pdf", files.as_pdf(1, "a\nb\nc\n" + "d" * 290, "web"))], "name string, content binary")
    found = {r["rule_id"]: r["data"] for r in scan.scan(rows).findings.collect()}
    assert "1.0" in found["pdf.redaction.overlay"]


def test_deck_holds_all_words(spark):
    text = "word " * 300 + f"{KEY} Bearer {'a1' * 12} end"
    rows = spark.createDataFrame([("deck.pptx", files.as_deck(12, text, "user"))], "name string, content binary")
    parts = evidence.package_entries(evidence.described(rows)).where(F.col("text").isNotNull())
    for where in ("ppt/slides/slide", "ppt/notesSlides/"):
        held = [(int(re.search(r"\d+", r["name"])[0]), r["text"]) for r in parts.where(F.col("name").startswith(where)).collect()]
        runs = [t for _, xml in sorted(held) for t in re.findall("<a:t>(.*?)</a:t>", xml)]
        assert " ".join(runs).split() == text.split()
    assert {"content.aws-access-key", "content.bearer-token"} <= {r["rule_id"] for r in scan.scan(rows).findings.collect()}


@pytest.mark.parametrize("value", [CARD, "GB82 WEST 1234 5698 7654 32", "Bearer " + "a1" * 12, "password: hunter2hunter2", "-----BEGIN RSA PRIVATE KEY-----"])
def test_no_break_within_a_match(value):
    for before in range(90):
        line = "x " * before + value + " tail" * 20
        assert any(value in piece for piece in files.wrapped(line))
        assert " ".join(files.wrapped(line)) == line


@pytest.mark.parametrize("before", range(260, 300, 3))
def test_long_words_are_not_cut_within_a_match(before):
    word = "x" * before + "," + KEY + "," + "y" * 700
    assert any(KEY in piece for piece in files.wrapped(word)) and "".join(files.wrapped(word)) == word
