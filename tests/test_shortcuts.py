"""The plain search before a rule's pattern loses no match."""

from pyspark.sql import functions as F

from palimpsest.functions import sensitive

A, X = "A" * 35, "x" * 35
#: For each rule a text that matches and holds as little besides as its pattern allows.
MINIMAL = {
    "private-key": "-----BEGIN PRIVATE KEY-----", "aws-access-key": f"ASIA{A[:16]}", "google-api-key": f"AIza{X}", "github-token": f"ghr_{X[:30]}",
    "npm-token": f"npm_{X[:30]}", "slack-token": f"xoxs-{X[:10]}", "stripe-secret": f"sk_test_{X[:16]}", "sendgrid-key": f"SG.{X[:16]}.{X[:16]}",
    "jwt": f"eyJ{X[:8]}.{X[:8]}.{X[:8]}", "bearer-token": f"bearer {X[:20]}", "credential-assignment": f"token={X[:8]}", "connection-string": "redis://x",
    "internal-url": "http://x.corp", "email-address": "x@x.xx", "us-ssn": "123 45 6789", "iban": "GB82 W E S T 1 2 3 4 5 6 9 8 7 6 5 4 3 2",
    "payment-card": " ".join("4111111111111111"),
}
MORE = [("payment-card", "-".join("4111111111111111")), ("payment-card", " ".join("4222222222222")), ("credential-assignment", f"passwd:{X[:8]}")]


def test_every_rule_has_a_minimal_text():
    assert set(MINIMAL) == {r.id for r in sensitive.RULES}


def test_minimal_texts_match(spark):
    rows = spark.createDataFrame([*MINIMAL.items(), *MORE], "rule string, text string")
    for r in rows.select("rule", "text", sensitive.matches(F.col("text")).alias("m")).collect():
        assert r["rule"] in [m["rule_id"] for m in r["m"]], r["text"]
