"""The sensitive-value rules, in their order, as Column expressions.

A text's matches are found rule by rule, checked, and cut to the first ``MOST``; no row leaves its partition. One rule is a native
expression, all of them together the kernel of ``matching``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import on_workers
from . import matching
from .text import EDGE, SPACE

MOST = 50
MATCHES = ArrayType(StructType([StructField("rule_ord", IntegerType()), *[StructField(c, StringType()) for c in ("rule_id", "label", "severity", "evidence")]]))


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    severity: str
    pattern: str  # <b> stands for a word border, <s> for the white characters of a class
    check: str = ""

    def java(self) -> str:
        return self.pattern.replace("<b>", EDGE).replace("<s>", SPACE)

    def re2(self) -> str:
        import re

        spelt = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", SPACE)
        return self.pattern.replace("<b>", r"\b").replace("<s>", spelt)


#: Identifiers, labels, severities and patterns of the rules.
RULES = (
    Rule("private-key", "Private key material", "high", r"(?i)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("aws-access-key", "AWS access key identifier", "high", r"<b>(?:AKIA|ASIA)[A-Z0-9]{16}<b>"),
    Rule("google-api-key", "Google API key", "high", r"<b>AIza[0-9A-Za-z_-]{35}<b>"),
    Rule("github-token", "GitHub token", "high", r"<b>(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,255}<b>"),
    Rule("npm-token", "npm access token", "high", r"<b>npm_[A-Za-z0-9]{30,255}<b>"),
    Rule("slack-token", "Slack token", "high", r"<b>xox[baprs]-[A-Za-z0-9-]{10,200}<b>"),
    Rule("stripe-secret", "Stripe secret key", "high", r"<b>sk_(?:live|test)_[A-Za-z0-9]{16,}<b>"),
    Rule("sendgrid-key", "SendGrid API key", "high", r"<b>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}<b>"),
    Rule("jwt", "JSON Web Token", "high", r"<b>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}<b>"),
    Rule("bearer-token", "Bearer token", "high", r"(?i)<b>Bearer[<s>]+[A-Za-z0-9._~+/-]{20,}={0,2}<b>"),
    Rule("credential-assignment", "Credential-like assignment", "medium",
         r"""(?i)<b>(?:api[_ -]?key|client[_ -]?secret|secret|password|passwd|token)[<s>]*[:=][<s>]*["']?[^<s>"'<>]{8,}"""),
    Rule("connection-string", "Database connection string", "high", r"""(?i)<b>(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^<s><>"']+"""),
    Rule("internal-url", "Private or internal URL", "medium",
         r"""(?i)<b>https?://(?:localhost|127\.0\.0\.1|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|[^<s>/]+\.(?:internal|local|corp))(?::\d+)?[^<s><>"']*"""),
    Rule("email-address", "Email address", "medium", r"(?i)<b>[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}<b>"),
    Rule("us-ssn", "US Social Security number pattern", "medium", r"<b>(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}<b>"),
    Rule("iban", "IBAN", "medium", r"<b>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}<b>", "iban"),
    Rule("payment-card", "Payment-card number", "medium", r"<b>(?:\d[ -]?){12,18}\d<b>", "luhn"),
)


def luhn(value: Column) -> Column:
    """13 to 19 digits, not all the same, with a valid check digit."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(13, 19) & ~digits.rlike(r"^(\d)\1+$") & F.call_function("luhn_check", digits)


def iban(value: Column) -> Column:
    """The shape of an IBAN and remainder 1 modulo 97, letters counting as 10 to 35."""
    plain = F.upper(F.regexp_replace(value, f"[{SPACE}]+", ""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(
        c.rlike("^[A-Z]$"), (r * 100 + F.ascii(c) - 55) % 97).when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise(r))
    return plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


#: What a text must hold, one of these at least, before a rule's pattern can match: a plain search spares most texts the pattern.
NEEDS = {
    "private-key": ("-----",), "aws-access-key": ("AKIA", "ASIA"), "google-api-key": ("AIza",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm-token": ("npm_",), "slack-token": ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), "stripe-secret": ("sk_live_", "sk_test_"), "sendgrid-key": ("SG.",), "jwt": ("eyJ",),
    "email-address": ("@",),
}
#: The same for patterns of any case, looked for in the text in lower case.
LOW_NEEDS = {
    "bearer-token": ("bearer",), "credential-assignment": ("key", "secret", "passw", "token"), "connection-string": ("sql://", "postgres://", "mongodb://", "mongodb+srv://", "redis://"),
    "internal-url": ("http://", "https://"),
}
#: Rules of numbers: a pair of digits must be there; those of a card may be set apart.
DIGITS = {"us-ssn": "[0-9][0-9]", "iban": "[0-9][0-9]", "payment-card": "[0-9][ -]?[0-9]"}


def may_match(text: Column, low: Column, rule: Rule) -> Column:
    if rule.id in DIGITS:
        return text.rlike(DIGITS[rule.id])
    looked, words = (low, LOW_NEEDS[rule.id]) if rule.id in LOW_NEEDS else (text, NEEDS.get(rule.id, ()))
    return reduce(or_, [F.contains(looked, F.lit(w)) for w in words], F.lit(not words))


CHECKS = {"": None, "luhn": luhn, "iban": iban}


def rule_matches(text: Column, rule: Rule, low: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    found = F.when(may_match(text, F.lower(text) if low is None else low, rule), F.regexp_extract_all(text, F.lit(rule.java()), F.lit(0))).otherwise(none)
    return F.filter(found, CHECKS[rule.check]) if rule.check else found


def matches(text: Column, most: int = MOST) -> Column:
    """array<struct<rule_ord, rule_id, label, severity, evidence>> of the first ``most`` matches in rule order."""
    find = matching.Finder([(r.id, r.label, r.severity, r.pattern, r.check) for r in RULES], most)

    def run(texts: pa.Array) -> pa.Array:
        return find(texts)

    on_workers(SparkSession.active())
    return F.arrow_udf(run, MATCHES)(text)
