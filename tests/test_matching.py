"""The kernel of the sensitive-value rules against the rules' own patterns as Java expressions, and the hash against its definition."""

import random
import re

from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import sensitive
from palimpsest.functions.text import fnv1a, redact

BITS = ["AKIA", "ASIA", "A1B2C3D4E5F6G7H8", "AIza", "ghp_", "npm_", "xoxb-", "sk_live_", "SG.", "eyJ", "Bearer ", "bearer ", "token", "=", ": ", "api key", "client-secret", "password", "secret",
        "postgres://", "redis://", "MongoDB+srv://", "mysql://", "http://", "HTTPS://localhost", "10.0.0.1", "a.internal", ":80", "/x", "@", "a@b.co", "a.b-c%+x@y.z.org", ".", "..", "-", "_", " ", "  ",
        "\n", "é", "🦊", "K", "ſ", "İ", "123-45-6789", "000 12 3456", "123-00-4567", "666-45-6789", "912-45-6789", "1", "12", "123", "1234567", "4111111111111111", "4111 1111-1111 1111",
        "5555-5555-5555-4444", "378282246310005", "0000000000000000", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "GB", "x", "Z", "9", "00000", "'", '"', "<", "ab" * 20, "Z" * 36, "z0" * 150,
        "-----BEGIN RSA PRIVATE KEY-----", "-----begin private key-----", "-----"]


def by_patterns(text):
    """The first ``MOST`` matches, rule by rule, each rule's pattern over the whole text."""
    def one(r):
        return F.transform(sensitive.rule_matches(text, r), lambda m: F.concat(F.lit(r.id + " "), redact(m)))

    return F.slice(F.concat(*map(one, sensitive.RULES)), 1, sensitive.MOST)


def test_kernel_finds_what_the_patterns_find(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 25))) for _ in range(3000)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", F.transform(sensitive.matches(F.col("text")), lambda m: F.concat_ws(" ", m["rule_id"], m["evidence"])).alias("got"), by_patterns(F.col("text")).alias("want"))
    assert got.where("size(got) > 0").count() > 1000
    assert got.where("NOT (got <=> want)").collect() == []


def test_a_full_text_is_not_searched_further(spark, monkeypatch):
    find = sensitive.matching.Finder([(r.id, r.label, r.severity, r.pattern, r.check) for r in sensitive.RULES], sensitive.MOST)
    tried = []
    monkeypatch.setattr(sensitive.matching, "runs", lambda text: tried.append(text) or [])
    assert len(find.found("-----BEGIN PRIVATE KEY----- " * 60 + "4111111111111111")) == sensitive.MOST
    assert not tried


def test_hash_goes_by_utf16_units(spark):
    def plain(text):
        h, raw = 0x811C9DC5, text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i: i + 2], "little")) * 0x01000193 % 2**32
        return f"{h:08x}"

    texts = ["", "a", "é🦊", "Document\0x\0y", "🦊" * 50, *map(str, range(500))]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").repartition(3)
    assert {r["v"]: r["h"] for r in rows.select("v", fnv1a(F.col("v")).alias("h")).collect()} == {t: plain(t) for t in texts}


def keys(spark, tmp_path, n):
    spark.range(1, n).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_texts_are_built_on_all_cores(spark, tmp_path):
    """One small file of keys is one split; the wide texts that follow from it are not one task."""
    assert catalog.constructed(spark, keys(spark, tmp_path, 1000)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_wide_texts_are_built_after_the_shuffle(spark, tmp_path):
    """Only keys move: no exchange holds a text."""
    df = catalog.QUERIES["sensitive_capped"](spark, keys(spark, tmp_path, 1000))
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert "lpad" in above and "lpad" not in plan[plan.index("Exchange"):].split("(")[0]
    assert df.groupBy("g").count().where("count <> 50").count() == 0 and df.select("g").distinct().count() == 50


def test_findings_move_once_and_narrow(spark, tmp_path):
    """Dedupe, order and counts share one shuffle by file_id; what is not asked for does not move."""
    at = keys(spark, tmp_path, 100)
    for name in ("finding_sort", "severity_counts"):
        plan = catalog.QUERIES[name](spark, at)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [file_id") == 1 and "min_by" not in plan
        assert "Revoke or rotate" not in plan and "hidden-content" not in plan


def test_even_texts_come_out_as_all_others(spark):
    """The short way round the pattern of all white characters gives what the pattern gives."""
    from palimpsest.functions import text

    rnd = random.Random(3)
    bits = [" ", "  ", "\t", "\n", "\x01", "\x1f", "\x7f", " ", " ", " ", "﻿", "é", "🦊", "a", "b c", "x" * 40, "…"]
    values = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(2000)] + [None, "x" * 179 + " ", "x" * 180, "x" * 181, " " + "x" * 180, "é" * 180]
    rows = spark.createDataFrame([(v,) for v in values], "v string")

    def plain(value, most):
        if value is None:
            return None
        clean = re.sub(f"[{text.SPACE}]+", " ", value).strip(" ")
        raw = clean.encode("utf-16-be")
        if len(raw) // 2 <= most:
            return clean
        return raw[: 2 * most - 2].decode("utf-16-be", "ignore").rstrip(" ") + "…"

    for r in rows.select("v", text.compact(F.col("v")).alias("c"), text.safe_evidence(F.col("v")).alias("s")).collect():
        assert r["c"] == plain(r["v"], 180)
        assert r["s"] == plain(r["v"] and re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ", r["v"]), 220)


def test_files_are_built_on_all_cores(spark, tmp_path):
    """One small file of texts is one split; the files built of it are many tasks."""
    from palimpsest.plans import files

    rows = spark.range(500).selectExpr("id AS doc_id", "concat('a text of token = abcdefgh', id) AS text", "'s' AS source").coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    done = files.pdfs(spark, str(tmp_path))
    assert done.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert done.select("name").distinct().count() == 500


def test_units_without_numbers_need_no_pattern():
    from palimpsest.plans import files

    assert files.units("one  two\nthree") == ["one", "two", "three"] and files.units(" ") == []
    assert files.units("see token = abcdefgh now") == ["see", "token = abcdefgh", "now"]
    assert files.units("card 4111 1111 1111 1111 end") == ["card", "4111 1111 1111 1111", "end"]
