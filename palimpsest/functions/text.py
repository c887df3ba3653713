"""String functions as Column expressions; lengths and cuts count UTF-16 units."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import on_workers

#: What counts as white space, inside a character class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: A border between an ASCII word character and anything else.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def first_units(text: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units; a pair that would be cut in half is left out."""
    def cut(raw: Column) -> Column:
        half = F.hex(F.substring(raw, 2 * n - 1, 1)).between("D8", "DB")
        return F.decode(F.when(half, F.substring(raw, 1, 2 * n - 2)).otherwise(raw), "UTF-16BE")

    return F.when(units(text) == F.length(text), F.substring(text, 1, n)).otherwise(let(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * n), cut))


def last_units(text: Column, n: int) -> Column:
    """The last ``n`` UTF-16 units; a pair that would be cut in half is left out."""
    def cut(raw: Column) -> Column:
        tail = F.substring(raw, -2 * n, 2 * n)
        half = F.hex(F.substring(tail, 1, 1)).between("DC", "DF")
        return F.decode(F.when(half, F.substring(tail, 3, 2 * n - 2)).otherwise(tail), "UTF-16BE")

    return F.when(units(text) == F.length(text), F.substring(text, -n, n)).otherwise(let(F.encode(text, "UTF-16BE"), cut))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def even(text: Column, most: int) -> Column:
    """Whether the text has at most ``most`` units and nothing to squeeze or replace inside: two cheap looks that spare most texts the class of all white characters."""
    return (F.octet_length(text) <= most) & ~F.contains(text, F.lit("  ")) & ~F.rlike(text, F.lit(r"[\x00-\x1F\u00A0\u1680-\uFFFF]"))


def compact(text: Column, most: int = 180) -> Column:
    """White space squeezed; what is longer than ``most`` units is cut and ends in an ellipsis."""
    whole = let(squeezed(text), lambda clean: F.when(units(clean) <= most, clean).otherwise(
        F.concat(F.rtrim(first_units(clean, most - 1)), F.lit("…"))))
    return F.when(even(text, most), F.trim(text)).otherwise(whole)


def redact(text: Column) -> Column:
    """The first six and last four characters; values of up to twelve stay as they are."""
    return let(compact(text, 240), lambda clean: F.when(units(clean) <= 12, clean).otherwise(
        F.concat(first_units(clean, 6), F.lit("…"), last_units(clean, 4))))


def safe_evidence(text: Column) -> Column:
    return F.when(even(text, 220), F.trim(text)).otherwise(compact(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), 220))


def extension_of(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def basename(path: Column) -> Column:
    leaf = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(leaf == "", path).otherwise(leaf)


def format_bytes(n: Column) -> Column:
    """Sizes by powers of 1024 with two decimals, one from ten up; negative, NaN and null sizes are unknown."""
    n = n.cast("double")
    out = F.when(n.isNull() | F.isnan(n) | (n < 0) | (n == float("inf")), "unknown size")
    out = out.when(n < 1024, F.concat(F.regexp_replace(n.cast("string"), r"\.0$", ""), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (power + 1), _scaled(n / 1024**power, unit))
    return out.otherwise(_scaled(n / 1024**4, "TB"))


def _scaled(value: Column, unit: str) -> Column:
    return F.when(value >= 10, F.format_string(f"%.1f {unit}", value)).otherwise(F.format_string(f"%.2f {unit}", value))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|>])", r"\\$1")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, eight hexadecimal digits."""
    from . import matching

    def run(texts: pa.Array) -> pa.Array:
        return matching.fnv1a(texts)

    on_workers(SparkSession.active())
    return F.arrow_udf(run, StringType())(text)


def finding_id(rule_id: Column, location: Column, evidence: Column, summary: Column) -> Column:
    place = F.when(F.coalesce(location, F.lit("")) == "", "Document").otherwise(location)
    zero = F.lit("\0")
    return F.concat(rule_id, F.lit("-"), fnv1a(F.concat(place, zero, F.coalesce(evidence, F.lit("")), zero, F.coalesce(summary, F.lit("")))))
