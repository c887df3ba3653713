import pytest
from pyspark.sql import functions as F

from palimpsest.functions import geometry, sensitive, text, xml


def one(spark, column, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values))))
    return row.select(column.alias("x")).first()["x"]


def V():
    return F.col("v0")


@pytest.mark.parametrize("value,want", [("", "811c9dc5"), ("a", "e40c292c"), ("é😀", "44cc4da1")])
def test_fnv1a_counts_utf16_units(spark, value, want):
    assert one(spark, text.fnv1a(V()), value) == want


def test_compact_squeezes_and_cuts(spark):
    assert one(spark, text.compact(V(), 10), "  a \n b﻿ ") == "a b"
    assert one(spark, text.compact(V(), 5), "abc   defg") == "abc…"
    assert one(spark, text.compact(V(), 4), "😀😀😀") == "😀…"


def test_redact_keeps_twelve_characters(spark):
    assert one(spark, text.redact(V()), "123456789012") == "123456789012"
    assert one(spark, text.redact(V()), "1234567890123") == "123456…0123"


@pytest.mark.parametrize("name,want", [("a.PDF", "pdf"), ("none", ""), ("/a.b/file", "b/file"), ("x.", "")])
def test_extension(spark, name, want):
    assert one(spark, text.extension_of(V()), name) == want


@pytest.mark.parametrize("n,want", [("0", "0 B"), ("1023", "1023 B"), ("1024", "1.00 KB"), ("10240", "10.0 KB"), ("-1", "unknown size"), ("1099511627776", "1.00 TB")])
def test_format_bytes(spark, n, want):
    assert one(spark, text.format_bytes(V().cast("double")), n) == want


HEX = "0123456789abcdef0123456789ABCDEF"
POSITIVE = {
    "private-key": ("-----begin RSA private key-----", "-----BEGIN CERTIFICATE-----"),
    "aws-access-key": ("AKIA" + "A1" * 8, "AKIA" + "A1" * 9),
    "google-api-key": ("AIza" + "a" * 35, "AIza" + "a" * 34),
    "github-token": ("ghp_" + HEX, "ghx_" + HEX),
    "npm-token": ("npm_" + HEX, "npm_" + HEX[:20]),
    "slack-token": ("xoxb-1234567890", "xoxz-1234567890"),
    "stripe-secret": ("sk_live_" + HEX[:16], "sk_prod_" + HEX[:16]),
    "sendgrid-key": (f"SG.{HEX[:16]}.{HEX[:16]}", f"SG.{HEX[:15]}.{HEX[:16]}"),
    "jwt": ("eyJ" + ".".join([HEX[:8]] * 3), "eyJ" + ".".join([HEX[:8]] * 2)),
    "bearer-token": ("bearer " + HEX[:20], "bearer " + HEX[:19]),
    "credential-assignment": ("Password = hunter2hunter2", "password = short"),
    "connection-string": ("postgresql://u:p@host/db", "oracle://host"),
    "internal-url": ("http://10.1.2.3:80/x", "http://11.1.2.3/x"),
    "email-address": ("a.b@example.co", "a.b@example"),
    "us-ssn": ("123-45-6789", "666-45-6789"),
    "iban": ("GB82WEST12345698765432", "GB83WEST12345698765432"),
    "payment-card": ("4111 1111 1111 1111", "0000000000000000"),
}


def test_each_rule_has_a_positive_and_a_near_miss(spark):
    assert list(POSITIVE) == [r.id for r in sensitive.RULES]
    rows = spark.createDataFrame([(k, i, v) for k, vs in POSITIVE.items() for i, v in enumerate(vs)], "id string, i int, text string")
    got = {(r["id"], r["i"]): [m["rule_id"] for m in r["m"]] for r in rows.select("id", "i", sensitive.matches(F.col("text")).alias("m")).collect()}
    for k in POSITIVE:
        assert k in got[k, 0], k
        assert k not in got[k, 1], k


def test_matches_stop_at_fifty_in_rule_order(spark):
    got = one(spark, sensitive.matches(V()), " ".join(f"u{i}@example.com" for i in range(60)) + " AKIA" + "A1" * 8)
    assert len(got) == 50 and got[0]["rule_id"] == "aws-access-key"


def test_accented_neighbour_is_a_border(spark):
    assert len(one(spark, sensitive.matches(V()), "éAKIA" + "A1" * 8)) == 1


def test_xml(spark):
    assert one(spark, xml.decode_xml(V()), "&amp;lt; &#65;&#x1F600; &#xD800; &LT; &nbsp;") == "&lt; A😀 &#xD800; < &nbsp;"
    assert one(spark, xml.strip_xml(V()), "<?xml v?><a>x<br/>y</a><![CDATA[<z>]]> ") == "x\ny"
    assert one(spark, xml.attribute(V(), "id"), "id='1' name=\"n\" id=\"2&amp;\"") == "2&"
    assert one(spark, xml.text_runs(V()), "<a:t>a</a:t><t x='1'> b </t>") == "a b"
    assert one(spark, xml.resolve_part(V(), F.col("v1")), "ppt/slides/slide1.xml", "../notes/./n.xml") == "ppt/notes/n.xml"
    assert one(spark, xml.resolve_part(V(), F.col("v1")), "a.xml", "..\\..\\b.xml") == "b.xml"
    assert one(spark, xml.relationships_part(V()), "ppt/slides/slide1.xml") == "ppt/slides/_rels/slide1.xml.rels"
    assert one(spark, xml.link_class(V(), F.col("v1")), "x/hyperlink", "\\\\server\\share") == "local-path"


def test_geometry_borders(spark):
    def box(l, r, b, t):
        return dict(zip(("left", "right", "bottom", "top"), map(F.lit, (l, r, b, t))))

    assert one(spark, geometry.overlap_ratio(box(0., 10., 0., 10.), box(0., 5.5, 0., 10.)), "") == pytest.approx(0.55)
    assert one(spark, geometry.off_slide(*map(F.lit, (100., 0., 5., 5.)), 100, 100), "") is True
    assert one(spark, geometry.off_slide(*map(F.lit, (99., 0., 5., 5.)), 100, 100), "") is False
    assert one(spark, geometry.off_slide(F.lit(None).cast("double"), *map(F.lit, (0., 5., 5.)), 100, 100), "") is False


def test_redacted_values_are_cut_by_units(spark):
    from palimpsest.functions import text

    rows = spark.createDataFrame([("abcdefghijklmnop",), ("🦊🦊🦊🦊🦊🦊🦊🦊",), ("abcde🦊ghijklm🦊xyz",)], "v string")
    assert [r[0] for r in rows.select(text.redact(rows["v"])).collect()] == ["abcdef…mnop", "🦊🦊🦊…🦊🦊", "abcde…xyz"]
